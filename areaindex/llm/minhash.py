"""Near duplicates by min-max hashing.

Every permutation of a document's shingles gives two signature values, its
smallest and its largest hash, so P permutations cost P hash evaluations per
shingle and fill bands with 2 P values. Minimum and maximum agree between two
sets each with the probability of their similarity; a band draws them from
different permutations, where they are independent.

Work on groups of copies stays linear. Documents of the same shingle set are
one node. In a bucket every member is first compared with the smallest member
only; the confirmed links give components; what is then left are pairs of one
bucket whose components differ, and those are compared, all of them, block by
block. So a link between two candidates is never lost, while a bucket full of
copies of one text costs one comparison per member. Links are confirmed on the full sets of words,
read from the texts in blocks of one leader and a few dozen members.

Defined results: a document without words has no shingles, is alone in its
component and kept; rows without an id are compared with nothing and all kept; a
document with fewer words than a shingle has its whole
sequence as the one shingle; the smallest id represents a component; rows that
repeat an id are taken as one document and are returned once, as the row of the
smallest hash of its text, which is the only one that is sketched and compared;
an empty table gives no rows; further input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows, without, written
from areaindex.session import join_measured

#: 46 bands of 6 values: two sets of similarity 0.8 share no band once in a million times,
#: while of those of similarity 0.3 three in a hundred share one.
PERMUTATIONS = 138
ROWS_PER_BAND = 6
SEED = 17
BLOCK = 64
_CHUNK = 1 << 14


class MinMaxHasher:
    """Signatures of shingle sets; equal parameters give equal signatures anywhere."""

    def __init__(self, shingle: int, permutations: int = PERMUTATIONS, rows: int = ROWS_PER_BAND, seed: int = SEED):
        draw = np.random.default_rng(seed)

        def odd(n):
            return draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shingle, self.rows = shingle, rows
        self.place = odd(shingle)
        self.flip, self.factor = odd(permutations)[:, None].astype(np.uint32), odd(permutations)[:, None].astype(np.uint32)
        order = np.empty(2 * permutations, np.int64)  # minimum and maximum of one permutation never share a band
        half = permutations // 2
        order[0::2] = np.arange(permutations)
        order[1::2] = permutations + (np.arange(permutations) + half) % permutations
        self.bands = len(order) // rows
        self.order = order[: self.bands * rows]
        self.weights = odd(self.bands * rows).reshape(self.bands, rows)
        self.offset = odd(self.bands)

    def shingle_hashes(self, words: list[bytes]) -> np.ndarray:
        """One 64-bit hash for each distinct shingle, sorted."""
        k = min(self.shingle, len(words))
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        n = len(words) - k + 1
        code, found = ids[:n], np.zeros(n, np.uint64)
        for j in range(k):
            found += (hashes * self.place[j])[ids[j : j + n]]
            if j:
                code = np.unique(code, return_inverse=True)[1] * len(numbers) + ids[j : j + n] if j > 1 else code * len(numbers) + ids[j : j + n]
        first = np.unique(code, return_index=True)[1]
        found = found[first]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(32)
        found.sort()
        return found

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Minima, then maxima, of every permutation."""
        low = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.flip), np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), _CHUNK):
            mixed = short[None, at : at + _CHUNK] ^ self.flip
            mixed *= self.factor
            np.minimum(low, mixed.min(axis=1), out=low)
            np.maximum(high, mixed.max(axis=1), out=high)
        return np.concatenate([low, high])

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        values = signature[self.order].astype(np.uint64).reshape(self.bands, self.rows) + np.uint64(1)
        keys = (values * self.weights).sum(axis=1, dtype=np.uint64) ^ self.offset
        keys ^= keys >> np.uint64(31)
        keys *= np.uint64(0x94D049BB133111EB)
        return keys.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks and \\t to \\r, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], shingle: int) -> set[tuple]:
    k = min(shingle, len(words))
    return set(zip(*[words[i:] for i in range(k)])) if words else set()


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(doc, n_shingles, digest of the whole set, band keys) per row."""
    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        hasher = MinMaxHasher(shingle)
        for k, t in items:
            words = words_of(t)
            if not words:
                yield k, 0, None, None
                continue
            hashes = hasher.shingle_hashes(words)
            digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()
            yield k, len(hashes), digest, hasher.band_keys(hasher.signature(hashes)).tolist()

    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    return map_rows(
        docs.select(col(key), col(text).cast("string")), f"doc {kind}, n_shingles long, digest string, bands array<long>", rows
    )


def confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (leader, member) whose full shingle sets reach the similarity.

    The texts of a leader and of up to BLOCK of its members meet in one block;
    a leader with many members has many blocks.
    """
    sized = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    blocks = pairs.join(sized, "leader").select(
        "leader", F.col("member").alias("doc"), F.lit(1).alias("role"),
        F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / BLOCK)).alias("block"),
    )
    heads = blocks.select("leader", F.col("leader").alias("doc"), F.lit(0).alias("role"), "block").distinct()
    wanted = written(blocks.unionByName(heads), "wanted")
    texts = docs.select(col(key).alias("doc"), col(text).cast("string").alias("text"))
    placed = join_measured(texts, wanted, ["doc"], 64 * wanted.count())
    kind = pairs.schema["leader"].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        held, head = None, set()
        for leader, block, _, doc, t in items:
            found = shingle_set(words_of(t), shingle)
            if held != (leader, block):
                held, head = (leader, block), found
                continue
            if doc == leader:
                continue
            both = len(head & found)
            if 100 * both >= percent * (len(head) + len(found) - both):
                yield leader, doc

    ordered = (
        placed.select("leader", "block", "role", "doc", "text").repartition("leader", "block")
        .sortWithinPartitions("leader", "block", "role", "doc")
    )
    return map_rows(ordered, f"leader {kind}, member {kind}", rows)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node it reaches.

    Each round every node takes the smallest label around it, then the label of
    its label, so that long chains shrink fast. Minima are aggregates and joins
    on evenly spread keys; nothing but a count comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels"
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        nearer = labels.join(around, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = written(
            nearer.join(jump, "next").select("node", F.col("component").alias("old"), F.least("next", "further").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def confirm_blocks(
    open_rows: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int
) -> DataFrame:
    """Links (leader, member) between documents of one bucket that lie in different components.

    ``open_rows`` are (bucket, doc, component, leader). In every bucket the
    documents outside its largest component are compared with all others. They
    are gathered in blocks; a task holds the sets of one block and passes part
    of the documents of its buckets by them, so that no table of pairs is made.
    """
    parts = open_rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    minor = written(open_rows.join(largest, "bucket").where("component <> major").select("bucket", "doc", "component", "leader"), "minor")
    families = minor.groupBy("doc", "component").agg(F.min("leader").alias("family"))
    sizes = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts"))
    blocks = written(families.join(sizes, "family").select(
        "doc", "component", F.xxhash64("family", F.pmod(F.xxhash64("doc"), F.col("salts"))).alias("block")
    ), "blocks")
    of_bucket = minor.join(blocks.select("doc", "block"), "doc").groupBy("bucket").agg(F.collect_set("block").alias("blocks"))
    passing = (
        open_rows.join(of_bucket, "bucket").groupBy("doc", "component")
        .agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
        .select("doc", "component", F.explode("blocks").alias("block"))
    )
    passing = written(passing, "passing")
    shares = passing.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("shares"))
    heads = blocks.join(shares, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), "doc", "component"
    )
    members = passing.join(shares, "block").select(
        "block", F.pmod(F.xxhash64("doc"), F.col("shares")).alias("share"), F.lit(1).alias("role"), "doc", "component"
    )
    wanted = written(heads.unionByName(members), "wanted")
    texts = docs.select(col(key).alias("doc"), col(text).cast("string").alias("text"))
    placed = join_measured(texts, wanted, ["doc"], 64 * wanted.count())
    kind = open_rows.schema["doc"].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        held, heads = None, {}
        for block, share, role, doc, component, t in items:
            if held != (block, share):
                held, heads = (block, share), {}
            found = shingle_set(words_of(t), shingle)
            if role == 0:
                heads[doc] = (component, found)
                continue
            for head, (other, theirs) in heads.items():
                least, most = sorted((len(found), len(theirs)))
                if other == component or 100 * least < percent * most:
                    continue
                both = len(found & theirs)
                if 100 * both >= percent * (least + most - both):
                    yield head, doc

    ordered = (
        placed.select("block", "share", "role", "doc", "component", "text").repartition("block", "share")
        .sortWithinPartitions("block", "share", "role", "doc")
    )
    return map_rows(ordered, f"leader {kind}, member {kind}", rows).distinct()


def one_per_id(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The table with one row of each id, by the smallest hash of the text, then of the row; rows without an id stay."""
    ids = docs.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("__n"))
    again = written(ids.where("__n > 1").drop("__n"), "repeated")
    if again.isEmpty():
        return docs
    names = [col(c) for c in docs.columns]
    order = F.struct(F.xxhash64(col(text).cast("string")), F.xxhash64(*names))
    first = docs.join(again, key, "left_semi").groupBy(col(key)).agg(F.min_by(F.struct(*names), order).alias("__first"))
    rest = docs.join(again, key, "left_anti").select(*names)
    return rest.unionByName(written(first.select("__first.*"), "first"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every document.

    Documents are linked when their sets of ``shingle`` consecutive words share
    at least ``percent`` of their union; components are what links reach.
    """
    return _judged(one_per_id(docs, key, text), key, text, shingle, percent)


def _judged(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` of a table in which no id repeats."""
    raw = written(sketches(docs, key, text, shingle), "raw")
    named = F.col("doc").isNotNull()
    nameless = raw.where(~named).withColumns({"digest": F.lit(None).cast("string"), "bands": F.lit(None).cast("array<bigint>")})
    every = raw if nameless.isEmpty() else written(raw.where(named).unionByName(nameless), "sketches")
    sketch = every.where(named)
    sets = sketch.where("n_shingles > 0").groupBy("digest").agg(F.min("doc").alias("node"))
    sets = written(sets, "sets")
    nodes = sketch.join(sets.select(F.col("node").alias("doc")), "doc").withColumnRenamed("n_shingles", "n")
    rows = written(nodes.select("doc", "n", F.explode("bands").alias("bucket")), "buckets")
    shared = written(
        rows.groupBy("bucket").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1"), "shared"
    )
    members = written(rows.join(shared, "bucket"), "members")
    sizes = sketch.select(F.col("doc").alias("leader"), F.col("n_shingles").alias("n_leader"))

    def may_reach(a: str, b: str) -> F.Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    led = (
        members.where("doc <> leader").select("leader", F.col("doc").alias("member"), "n").distinct()
        .join(sizes, "leader").where(may_reach("n", "n_leader")).select("leader", "member")
    )
    links = written(confirm(led, docs, key, text, shingle, percent), "led")
    labels = components(links.select(F.col("leader").alias("a"), F.col("member").alias("b")))

    # what is left: members of one bucket in different components, neither of them its leader
    placed = members.where("members > 2 AND doc <> leader").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(
        "bucket", "doc", "leader", F.coalesce("component", "doc").alias("component")
    )
    torn = placed.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi").select("bucket")
    open_rows = written(placed.join(torn, "bucket"), "open")
    more = written(confirm_blocks(open_rows, docs, key, text, shingle, percent), "more")
    if not more.isEmpty():
        edges = links.union(more).select(F.col("leader").alias("a"), F.col("member").alias("b"))
        labels = components(edges)

    classes = sets.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return (
        every.select("doc", "n_shingles", "digest").join(classes, "digest", "left")
        .select(
            F.col("doc").alias(key), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"),
            F.coalesce("component_id", "doc").eqNullSafe(F.col("doc")).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all columns; rows without an id all stay."""
    docs = one_per_id(docs, key, text)
    judged = _judged(docs, key, text, shingle, percent)
    gone = written(judged.where("NOT kept").select(col(key)), "duplicates")
    return without(docs, gone, key).select(*[col(c) for c in docs.columns])
