import hashlib
import io
import random
import zipfile
import zlib

import pytest

from areaindex.llm import warc


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_valid_and_read_by_ranges(zip64):
    rng, members = random.Random(2), []
    for i in range(40):
        members.append((f"dir/é{i}", rng.randbytes(rng.choice([0, 1, 100, 70_000]))))
    out = io.BytesIO()
    warc.write_zip(out, members, zip64)
    with zipfile.ZipFile(out) as other:
        assert other.testzip() is None and [(n, other.read(n)) for n in other.namelist()] == members
    found = warc.stored_members(out, len(out.getvalue()))
    assert {n: warc.read_range(out, *place) for n, place in found.items()} == dict(members)


def test_other_writers_archives_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain", b"stored")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("large"), "w", force_zip64=True) as f:
            f.write(b"64")
        z.comment = b"a comment with PK\x05\x06 inside"
    size = len(out.getvalue())
    found = warc.stored_members(out, size)
    assert set(found) == {"plain", "large"} and warc.read_range(out, *found["large"]) == b"64"
    empty = io.BytesIO()
    warc.write_zip(empty, [], True)
    assert warc.stored_members(empty, len(empty.getvalue())) == {}
    with pytest.raises(ValueError):
        warc.stored_members(io.BytesIO(b"no archive at all, really none"), 30)
    with pytest.raises(ValueError):
        warc.read_range(out, size - 1, 5)


def brute(rows):
    made = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        keeper = max(same) if len(body) >= 1000 and same else i
        revisit = keeper != i
        made.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(made, key=str)


def test_round_trip(spark, tmp_path):
    rng = random.Random(6)
    big = ["".join(rng.choices("abcé <p>\n", k=n)) for n in (1000, 1500, 4000)]
    rows = [(i, f"http://h/{i}", rng.choice([*big, "short", "", None, "é" * 500, "é" * 499])) for i in range(120)]
    rows += [(500, None, big[0]), (501, "bad\r\nurl", big[1]), (502, "u", "x" * 300_000), (503, "u", "\r\n\r\n" * 400)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, kind int").repartition(3)
    got = warc.round_trip(pages, folder=str(tmp_path / "a"), package_bytes=2_000)
    assert sorted(((r.ident, r.n_bytes, r.digest, r.kind, r.refers_to) for r in got.collect()), key=str) == brute(rows)
    urls = {r.ident: r.url for r in got.collect()}
    assert urls[500] is None and urls[501] == "bad%0D%0Aurl" and urls[0] == "http://h/0"
    payloads = {r.ident: bytes(r.payload).decode() for r in got.where("kind = 'response'").collect()}
    assert all(payloads[i] == (h or "") for i, _, h in rows if i in payloads) and len(list((tmp_path / "a").iterdir())) > 3


def test_repeated_and_missing_ids_and_empty(spark, tmp_path):
    body = "z" * 1200
    pages = spark.createDataFrame([(7, "u", body), (7, "u", body), (3, "u", body), (None, "u", body), (None, "u", "s")], "page_id long, url string, html string")
    got = warc.round_trip(pages, folder=str(tmp_path / "b")).collect()
    assert sorted((str(r.ident), r.kind, str(r.refers_to)) for r in got) == [
        ("3", "revisit", "7"), ("7", "response", "None"), ("7", "response", "None"), ("None", "response", "None"), ("None", "revisit", "7")
    ]
    assert warc.round_trip(pages.limit(0), folder=str(tmp_path / "c")).count() == 0


def test_changed_payload_is_noticed(spark, tmp_path):
    good = warc.record_bytes("response", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.parse_record(good)[2] == b"abc"
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    plan = warc.plan_records(pages).withColumn("payload", pages.html.cast("binary") if False else warc.F.lit("abd").cast("binary"))
    folder = str(tmp_path / "d")
    packages = warc.write_packages(plan, folder)
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(warc.index_entries(packages, folder), folder).collect()


def test_packages_of_another_layout(spark, tmp_path):
    """Several archives and indexes under other names, keys before the JSON object, offsets as text or number."""
    def record(i, body):
        return warc.record_bytes("response", i, f"http://h/{i}", body, hashlib.sha1(body).hexdigest(), len(body), None)

    first, second = [record(i, b"a" * i) for i in range(5)], [record(10 + i, b"b" * i) for i in range(3)]
    lines, at = [], 0
    for i, r in enumerate(first):
        lines.append(f'h)/{i} 20200101000000 {{"url": "http://h/{i}", "offset": "{at}", "length": "{len(r)}", "filename": "one.warc.gz"}}')
        at += len(r)
    more, at = ["!meta of the index", ""], 0
    for r in second:
        more.append(f'{{"offset": {at}, "length": {len(r)}, "filename": "archive/two.warc.gz"}}')
        at += len(r)
    with zipfile.ZipFile(tmp_path / "other.wacz", "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(first))
        z.writestr("archive/two.warc.gz", b"".join(second))
        z.writestr("indexes/a.cdxj", "\n".join(lines))
        z.writestr("indexes/b.cdx", "\r\n".join(more))
        z.writestr("pages/pages.jsonl", '{"offset": 1}')
    packages = spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string")
    got = warc.read_records(warc.index_entries(packages, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((r.ident, bytes(r.payload)) for r in got) == [(i, b"a" * i) for i in range(5)] + [(10 + i, b"b" * i) for i in range(3)]
    one = {"archive/x.warc.gz": (100, 50)}
    assert list(warc.index_places(b'k 1 {"offset": 3, "length": 4}\n', one)) == [(103, 4)]
    for bad in (b'{"offset": 48, "length": 4}', b'{"offset": 0, "length": 4, "filename": "y.warc.gz"}'):
        with pytest.raises(ValueError):
            list(warc.index_places(bad, one))
    head = zlib.decompress(first[3], 31)
    assert warc.parse_record(head)[2] == b"aaa"


def test_index_lines_are_sorted_by_host(spark, tmp_path):
    assert warc.sort_key("http://User@News.Example.org:8080/a b?c") == "org,example,news:8080)/ab?c"
    assert warc.sort_key("https://example.org") == "org,example)/" and warc.sort_key(None) == "-" == warc.sort_key("no url")


def test_reading_is_spread_by_record_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_RANGE", 1 << 14)
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(map(chr, rng.choices(range(33, 120), k=3000)))) for i in range(400)], "page_id long, url string, html string")
    got = warc.round_trip(pages.coalesce(1), folder=str(tmp_path / "e"))
    assert got.withColumn("task", warc.F.spark_partition_id()).select("task").distinct().count() >= 8
