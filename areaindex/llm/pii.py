"""Personal data: patterns, and a character-level BiLSTM-CRF for what they miss.

The patterns give the base spans. The network is trained on labelled spans: base
spans of a bounded sample of the texts, and generated spans of every kind, in
several spellings, set into text of the sample. It reads overlapping windows;
each is decoded by itself, and the spans of all windows of a text are reconciled
at once: pieces cut by a window's edge are joined, then the set of spans that do
not overlap and have the largest total score is taken. A decoded span counts
only if its kind's check holds, and every value that passes one holds an anchor:
a digit, an @, or 16 visible ASCII characters in a row, as a secret of letters
has. So windows without an anchor cannot add a span, and are decoded only where a
span of the window beside them is cut, until no span is cut at a window left out.

Defined results: a NULL or empty text has no spans; positions are code points,
ends exclusive; base spans of different kinds may overlap, spans of the network
never overlap a base span or each other; equal rows are treated alike; an empty
table trains on generated spans only and gives no rows; further input columns
are kept by ``redact`` and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.bilstm_crf import BiLstmCrf, character_classes
from areaindex.llm.common import col, map_rows

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
WINDOW, STRIDE = 128, 64
#: Texts that labelled windows may come from, and windows to train on: the sample's bounds.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 1500, 1000
MIN_SCORE = 2.0
_DECODE = 256
#: What every value of a kind holds: a digit, an @, or so many visible ASCII characters in a row.
_SECRET_LENGTH = 16
_ANCHOR = re.compile(f"[0-9@]|[!-~]{{{_SECRET_LENGTH},}}")
_DIGIT = re.compile("[0-9]")

# The base patterns. Runs are entered at their start only, where
# any match must begin, so that long runs stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(number)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    found = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append(("email", start, host.end()))
            free = host.end()
        else:
            free = at + 1 if start < at else free
        at = text.find("@", max(free, at + 1))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(number := digits(m.group())) <= 19 and luhn(number):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def plausible(kind: str, value: str) -> bool:
    """The check that a decoded span of a kind has to pass."""
    number = digits(value)
    if kind == "email":
        local, _, host = value.partition("@")
        return bool(local) and "." in host.strip(".") and not any(c.isspace() for c in value)
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number) and set(value) <= set("0123456789 -.")
    if kind == "phone":
        return 8 <= len(number) <= 15 and set(value) <= set("0123456789 -.()+/") and any(c in " -.()+/" for c in value)
    return len(value) >= _SECRET_LENGTH and number != value and value.isascii() and not any(c.isspace() for c in value)


# --- labelled spans ------------------------------------------------------------

def _generated(kind: str, rng: np.random.Generator) -> str:
    """A made-up value of a kind in one of its spellings."""
    def pick(options):
        return options[int(rng.integers(len(options)))]

    def letters(low, high, pool="abcdefghijklmnopqrstuvwxyz"):
        return "".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(low, high))))

    def number(n):
        return "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        local = letters(3, 9) + pick([".", "_", "-", "", "+"]) + pick([letters(2, 8), number(2), number(3)])
        return f"{local}@{letters(3, 9)}{pick(['', number(1), '-' + letters(2, 5)])}.{pick(['com', 'org', 'net', 'example.com', 'co.uk', 'de', 'fr'])}"
    if kind == "ip":
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        body = number(15)
        last = next(d for d in "0123456789" if luhn(body + d))
        full = body + last
        return pick(["", "", " ", "-", "."]).join(full[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a[:2]}/{b}{c}"])
    return pick([letters(24, 48, "0123456789abcdef"), letters(20, 40, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")])


def _harmless(rng: np.random.Generator) -> str:
    """Numbers that are no personal data."""
    n = rng.integers(0, 10_000, 4)
    return str((
        f"{n[0]}", f"{n[0] % 10}.{n[1] % 10}", f"{n[0] % 10}.{n[1] % 10}.{n[2] % 20}", f"20{n[0] % 100:02d}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d}",
        f"{n[0] % 24}:{n[1] % 60:02d}", f"{n[0]},{n[1] % 1000:03d}", f"{n[0] % 100}%", f"${n[0]}.{n[1] % 100:02d}", f"@{'abcdefgh'[: 3 + n[0] % 5]}",
        f"v{n[0] % 10}.{n[1] % 10}", f"{n[0] % 100}th", f"{n[0]}/{n[1]}", f"({n[0] % 100})",
    )[int(rng.integers(13))])


def window_starts(length: int) -> range:
    return range(0, max(1, length - WINDOW + STRIDE), STRIDE)


def _tagged(text: str, spans: list[tuple[str, int, int]], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of one window; tag 2k+1 begins kind k, 2k+2 goes on with it."""
    x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    part = character_classes(text[start : start + WINDOW])
    x[: len(part)] = part
    for kind, a, b in spans:
        a, b, k = max(a - start, 0), min(b - start, WINDOW), KINDS.index(kind)
        if a < b:
            y[a:b] = 2 * k + 2
            y[a] = 2 * k + 1
    return x, y


def training_windows(texts: list[str], windows: int = SAMPLE_WINDOWS, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: base spans where they are, and generated values set into the texts."""
    rng, found = np.random.default_rng(seed), []
    texts = [t for t in texts if t] or ["and the of to in is that for it as was with be by on not he his but at"]
    for text in texts:
        spans = base_spans(text)
        if spans and len(found) < windows // 3:
            kind, a, _ = spans[int(rng.integers(len(spans)))]
            found.append(_tagged(text, spans, max(0, a - int(rng.integers(0, 100)))))
    while len(found) < windows:
        text = texts[int(rng.integers(len(texts)))]
        at = int(rng.integers(0, max(1, len(text) - WINDOW)))
        around = text[at : at + WINDOW]
        words, spans, length, out = around.split(" "), [], 0, []
        put = sorted(rng.choice(len(words) + 1, min(len(words) + 1, int(rng.integers(1, 4))), replace=False).tolist())
        for i, word in enumerate([*words, ""]):
            if i in put:
                if rng.random() < 0.3:
                    value, kind = _harmless(rng), None
                else:
                    kind = KINDS[int(rng.integers(len(KINDS)))]
                    value = _generated(kind, rng)
                lead = 'token = "' if kind == "secret" and rng.random() < 0.7 else "(" if rng.random() < 0.05 else ""
                tail = '"' if lead.endswith('"') else ")" if lead else str(rng.choice(["", "", ".", ",", "!!", ";"]))
                if kind:
                    spans.append((kind, length + len(lead), length + len(lead) + len(value)))
                out.append(lead + value + tail)
                length += len(out[-1]) + 1
            out.append(word)
            length += len(word) + 1
        whole = " ".join(out)
        start = int(rng.integers(0, max(1, len(whole) - WINDOW + 1)))
        found.append(_tagged(whole, spans, start))
    x, y = zip(*found)
    return np.stack(x), np.stack(y)


def train(texts: list[str], epochs: int = 10, hidden: int = 24) -> BiLstmCrf:
    model = BiLstmCrf(2 * len(KINDS) + 1, hidden)
    model.fit(*training_windows(texts), epochs=epochs)
    return model


def sample_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = SAMPLE_TEXTS, width: int = 600) -> list[str]:
    """A bounded sample for training: excerpts of texts chosen by hash, around an anchor where there is one."""
    rows = docs.where(col(text).isNotNull()).select(F.xxhash64(col(key), F.length(col(text))).alias("h"), col(text).cast("string").alias("t"))
    rate = min(1.0, count / max(1, docs.count()))
    start = F.greatest(F.regexp_instr("t", F.lit("[0-9@]")) - width // 2, F.lit(1))
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000).select("h", F.substring("t", start, F.lit(width)).alias("t"))
    return [r[1] for r in sorted(map(tuple, chosen.limit(2 * count).collect()))]


# --- decoding ------------------------------------------------------------------

def _window_spans(tags: np.ndarray, lead: np.ndarray, start: int, length: int, last: bool) -> list[tuple]:
    """(kind, start, end, score, cut) of one decoded window, in places of the text."""
    out, t = [], 0
    while t < length:
        tag = int(tags[t])
        if tag == 0:
            t += 1
            continue
        kind, first = (tag - 1) // 2, t
        t += 1
        while t < length and tags[t] == 2 * kind + 2:
            t += 1
        cut = (first == 0 and start > 0) or (t == length and not last)
        out.append((kind, start + first, start + t, float(lead[first:t].sum()), cut))
    return out


def reconcile(spans: list[tuple]) -> list[tuple]:
    """The spans without overlap whose scores add up to most, after joining those cut at window edges."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))
    joined: list[list] = []
    last_cut: dict[int, list] = {}  # of each kind, the one that reaches furthest
    for kind, a, b, score, cut in spans:
        other = last_cut.get(kind) if cut else None
        if other and other[2] >= a:
            share = max(0, other[2] - a) / max(1, b - a)
            other[2], other[3] = max(other[2], b), other[3] + score * (1 - share)
        else:
            joined.append([kind, a, b, score, cut])
            if cut:
                last_cut[kind] = joined[-1]
    joined.sort(key=lambda s: (s[2], s[1], s[0]))
    ends, best = [s[2] for s in joined], [(0.0, None, -1)]
    for i, s in enumerate(joined):
        j = int(np.searchsorted(ends[:i], s[1], "right"))
        take = best[j][0] + s[3]
        best.append((take, s, j) if s[3] > 0 and take > best[-1][0] else (best[-1][0], None, len(best) - 1))
    out, at = [], len(best) - 1
    while at > 0:
        _, s, back = best[at]
        if s is not None:
            out.append(tuple(s[:4]))
        at = back
    return out[::-1]


def added_spans(model: BiLstmCrf, texts: list[str], bases: list[list[tuple]], min_score: float = MIN_SCORE) -> list[list[tuple]]:
    """The spans (kind, start, end) that the network adds to the base spans of each text."""
    jobs, classes = [], {}
    for n, text in enumerate(texts):
        wanted: set[int] = set()
        for m in _ANCHOR.finditer(text):
            k = m.start() // STRIDE
            wanted.update(range(max(k - 1, 0), (m.end() - 1) // STRIDE + 1))
        starts = window_starts(len(text))
        jobs += [(n, k * STRIDE) for k in sorted(wanted) if k < len(starts)]
        if wanted:
            classes[n] = character_classes(text)
    spans: list[list[tuple]] = [[] for _ in texts]
    seen = set(jobs)
    while jobs:
        beside: set[tuple[int, int]] = set()
        for at in range(0, len(jobs), _DECODE):
            part = jobs[at : at + _DECODE]
            x = np.zeros((len(part), WINDOW), np.int64)
            for row, (n, start) in enumerate(part):
                piece = classes[n][start : start + WINDOW]
                x[row, : len(piece)] = piece
            tags, lead = model.decode(x)
            for row, (n, start) in enumerate(part):
                length = min(WINDOW, len(texts[n]) - start)
                found = _window_spans(tags[row], lead[row], start, length, start + WINDOW >= len(texts[n]))
                spans[n] += found
                for _, a, b, _, cut in found:
                    if cut and a == start > 0:
                        beside.add((n, start - STRIDE))
                    if cut and b == start + length < len(texts[n]):
                        beside.add((n, start + STRIDE))
        jobs = sorted(beside - seen)
        seen.update(jobs)
    out = []
    for text, base, found in zip(texts, bases, spans):
        kept = []
        if found:
            taken = sorted((a, b) for _, a, b in base)
            starts, stops = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken] or [0])
            for kind, a, b, score in reconcile(found):
                before = int(np.searchsorted(starts, b)) if len(starts) else 0
                free = before == 0 or stops[before - 1] <= a
                if free and score >= min_score and _ANCHOR.search(text, a, b) and plausible(KINDS[kind], text[a:b]):
                    kept.append((KINDS[kind], a, b))
        out.append(kept)
    return out


#: Whole rows that a task masking texts holds as Python values at a time, and the characters decoded together.
AT_ONCE, GROUP_CHARS = 200, 1 << 19


def text_spans(items: Iterator[tuple], model: BiLstmCrf, at: int, group_chars: int = 1 << 21) -> Iterator[tuple[tuple, list, list]]:
    """(row, base spans, added spans) of rows whose text is column ``at``, decoded in groups of bounded size."""
    rows, texts, size = [], [], 0

    def flush():
        bases = [base_spans(t) for t in texts]
        yield from zip(rows, bases, added_spans(model, texts, bases))

    for row in items:
        rows.append(row)
        texts.append(row[at] or "")
        size += len(texts[-1])
        if size >= group_chars or len(rows) >= 1000:
            yield from flush()
            rows, texts, size = [], [], 0
    yield from flush()


def _listed(spans: list[tuple]) -> str:
    ordered = sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans): counts of base spans, base spans, all spans."""
    model = model or train(sample_texts(docs, key, text))
    kind = docs.select(col(key)).schema[0].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        for (k, _), base, added in text_spans(items, model, 1):
            names = [s[0] for s in base]
            yield (k, *[names.count(n) for n in BASE_KINDS], _listed(base), _listed(base + added))

    counts = ", ".join(f"n_{n} long" for n in BASE_KINDS)
    return map_rows(
        docs.select(col(key), col(text).cast("string")), f"`{key}` {kind}, {counts}, base string, spans string", rows
    )


def masked(text: str, spans: list[tuple]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """The table with all spans masked in its texts; other columns stay."""
    model = model or train(sample_texts(docs, key, text))
    names = docs.columns
    at = names.index(text)

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        for row, base, added in text_spans(items, model, at, GROUP_CHARS):
            spans = base + added
            yield row if not spans else (*row[:at], masked(row[at], spans), *row[at + 1 :])

    return map_rows(docs, docs.schema, rows, per_batch=AT_ONCE, at_once=AT_ONCE)
