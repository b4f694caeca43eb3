"""Quality rules as a bitmask ledger.

Every text is measured once. Every rule is evaluated once on the measurements
and leaves one bit, so the ledger (key, measurements, bits) answers any later
question without the texts: a policy is a mask, its verdict one AND, and an
ablation an aggregate over the distinct bit patterns.

Defined results: a NULL or empty text has zero measurements and fails
``few_words``; equal rows are measured alike and both kept; an empty table
gives an empty ledger; further input columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows

WINDOW = 8
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_alpha_words", "n_letters", "n_capitals", "n_bullet_lines",
)
# Rule names with the SQL condition under which a text fails. The
# position of a rule is its bit, so rules are only ever added at the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("not_alphabetic", "10 * n_alpha_words < 7 * n_words"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
# Versioned policies: the rules each enforces.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": tuple(name for name, _ in RULES),
}
_SYMBOLS = b"#*$%&|<>"
_BULLETS = (b"-", b"*", "•".encode())
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_PLAIN = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_WEIGHTS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text.

    A weighted sum of word numbers finds texts that may have a repeated window
    (equal windows have equal sums); only those are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    sums = np.zeros(n, np.uint64)
    for k in range(window):
        sums += ids[k : k + n] * _WEIGHTS[k % WINDOW]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    values, counts = np.unique(sums, return_counts=True)
    suspects = np.flatnonzero(np.isin(sums, values[counts > 1]))
    seen: dict[tuple, int] = {}
    hit = np.zeros(len(words), bool)
    for i in suspects.tolist():
        first = seen.setdefault(tuple(words[i : i + window]), i)
        if first != i:
            hit[first : first + window] = True
            hit[i : i + window] = True
    return int(hit.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at blank and \t to \r, nothing else
    word_bytes = sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    alphabetic = sum(1 for w in words if w.translate(None, _PLAIN))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    small = len(raw) - len(raw.translate(None, _SMALL))
    return (
        len(words),
        len(text) - (len(raw) - word_bytes),
        sum(raw.count(bytes([s])) for s in _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        alphabetic,
        capitals + small,
        capitals,
        sum(1 for line in lines if line.lstrip().startswith(_BULLETS)),
    )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, MEASURES...) for every row."""
    kind = docs.select(col(key)).schema[0].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in items:
            yield (k, *measure_text(t))

    schema = f"`{key}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_rows(docs.select(col(key), col(text).cast("string")), schema, rows)


def failure_bits(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """One bit for each rule that fails, as a long."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask_of(names: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> int:
    known = [name for name, _ in rules]
    unknown = set(names) - set(known)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return sum(1 << known.index(name) for name in set(names))


def ledger(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """(key, measurements, failed): the record of every rule on every row."""
    return measure(docs, key, text).withColumn("failed", failure_bits(rules))


def verdict(policy: str = "v2", rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """True where a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy], rules)).cast("long")) == 0


def ablations(
    entries: DataFrame, policy: str = "v2", rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without) for each rule of a policy.

    Rows are first counted per bit pattern; everything else reads the patterns.
    ``n_only`` rows fail this rule and no other, so the policy without it would
    keep them.
    """
    mask = mask_of(POLICIES[policy], rules)
    patterns = (
        entries.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
        .groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    )
    kept = F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0))
    parts = []
    for name in POLICIES[policy]:
        bit = F.lit(mask_of([name], rules)).cast("long")
        only = F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0))
        failing = F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
        parts.append(F.struct(
            F.lit(name).alias("rule"), F.coalesce(failing, F.lit(0)).alias("n_failed"),
            F.coalesce(only, F.lit(0)).alias("n_only"), F.coalesce(kept, F.lit(0)).alias("n_kept"),
            F.coalesce(kept + only, F.lit(0)).alias("n_kept_without"),
        ))
    return patterns.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
