"""Scalar cleaning: codes, numbers behind text, rates, row-wise means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for "no value" in the published school tables.
SENTINELS = ("SUPP", "NE", "LOWCOV", "NA", "#N/A", "NEW", "NP", "", "nan")

# Inspection grade (first character) to score, higher is better.
GRADE_SCORES = {"1": 4, "2": 3, "3": 2, "4": 1}

# Inspection grade to the text shown for it.
GRADE_LABELS = {
    "1": "Outstanding (1)",
    "2": "Good (2)",
    "3": "Requires Improvement (3)",
    "4": "Inadequate (4)",
    "4.0": "Inadequate (4)",
    "9": "Not Assessed",
    "nan": "N/A",
}

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_code(c: Column | str) -> Column:
    """Area code without surrounding blanks, upper case."""
    return F.upper(F.trim(_col(c)))


def norm_postcode(c: Column | str) -> Column:
    """Postcode without any blank, upper case."""
    return F.upper(F.replace(_col(c), F.lit(" "), F.lit("")))


def to_number(c: Column | str, sentinels: Sequence[str] = SENTINELS, strip: str = "%,") -> Column:
    """Double behind a text; sentinels and anything that is no number become NULL."""
    text = F.trim(_col(c).cast("string"))
    bare = F.trim(F.translate(text, strip, "")) if strip else text
    number = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.when(~text.isin(*sentinels), number) if sentinels else number


def nan_to_null(c: Column | str) -> Column:
    """NaN marks a missing value in files written from float frames; NULL does here."""
    return F.when(~F.isnan(_col(c)), _col(c))


def map_code(c: Column | str, mapping: Mapping[str, object], default: object = None) -> Column:
    """Constant lookup; unknown keys and NULL give ``default``."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), F.lit(default))


def grade_score(c: Column | str) -> Column:
    """Score of an inspection grade read from its first character."""
    return map_code(F.substring(_col(c), 1, 1), GRADE_SCORES)


def grade_label(c: Column | str, labels: Mapping[str, str] = GRADE_LABELS, default: str = "N/A") -> Column:
    """Shown text of a grade; the lookup ignores case."""
    return map_code(F.lower(_col(c)), labels, default)


def clip_to(c: Column | str, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Bound a value on either side; NULL stays NULL (``greatest`` would skip it)."""
    value = column = _col(c)
    if lo is not None:
        value = F.greatest(value, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        value = F.least(value, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(column.isNotNull(), value)


def rate_per(count: Column | str, population: Column | str, per: float = 1000.0) -> Column:
    """Rate per head; a population of zero or NULL counts as one person."""
    people = F.coalesce(F.nullif(_col(population).cast("double"), F.lit(0.0)), F.lit(1.0))
    return _col(count) / people * F.lit(float(per))


def plain_rate_per(count: Column | str, population: Column | str, per: float = 1000.0) -> Column:
    """Rate per head without the guard: NULL where the population is zero."""
    return F.try_divide(_col(count), _col(population)) * F.lit(float(per))


def row_sum(cols: Sequence[Column | str]) -> Column:
    """Sum across columns; NULL counts as zero."""
    return reduce(add, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_mean(cols: Sequence[Column | str]) -> Column:
    """Mean across columns over the values present; NULL when there are none."""
    present = reduce(add, [F.when(_col(c).isNotNull(), 1).otherwise(0) for c in cols])
    return F.try_divide(row_sum(cols), present.cast("double"))


def fraction_to_percent(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Multiply by 100 when the whole column lies within 0..1, else keep it."""
    top = df.agg(F.max(col)).scalar()
    value = F.when(top <= 1, F.col(col) * 100).otherwise(F.col(col))
    return df.withColumn(out or col, value)


def entity_id(c: Column | str) -> Column:
    """Identifier written as a float ("100.0") back to its whole-number text."""
    return _col(c).cast("string").try_cast("double").try_cast("long").cast("string")


def display_name(place: Column | str, number: Column | str) -> Column:
    return F.concat(_col(place), F.lit(" - Neighbourhood "), _col(number).cast("string"))


def name_number(name: Column | str) -> Column:
    """Running number at the end of a display name."""
    tail = F.element_at(F.split(_col(name), " - "), -1)
    return F.replace(tail, F.lit("Neighbourhood "), F.lit(""))


def month_of(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "MM")


def parse_month(text: Column | str, fmt: str = "yyyy-MM") -> Column:
    """First day of the month in a text; NULL when it does not parse."""
    return F.try_to_date(_col(text), fmt)


def period_text(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even, as float frames do."""
    return F.bround(_col(c), digits)


def matching_columns(
    df: DataFrame, prefixes: Sequence[str], metrics: Sequence[str], numeric: bool = True,
    without: Sequence[str] = (),
) -> list[str]:
    """Columns that start with one of ``prefixes`` and contain one of ``metrics``."""
    return [
        f.name for f in df.schema.fields
        if f.name.startswith(tuple(prefixes))
        and any(m in f.name for m in metrics)
        and not any(w in f.name for w in without)
        and (not numeric or isinstance(f.dataType, T.NumericType))
    ]


def non_empty_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of ``cols`` that hold at least one value; one pass over the data."""
    if not cols:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c] > 0]


def drop_missing(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how, subset=list(cols))


def keep_range(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows whose value lies within the closed range; NULL does not."""
    if lo is not None:
        df = df.where(F.col(col) >= lo)
    return df if hi is None else df.where(F.col(col) <= hi)
