"""The (area, year) panel: grid, joins of sources, gap filling, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaindex.functions.clean import row_mean, row_sum
from areaindex.operators.ordering import medians, with_position
from areaindex.session import checkpointed, join_null_safe, one_row


def make_grid(
    areas: DataFrame, years: Sequence[int] | DataFrame, area: str = "area_code", year: str = "year"
) -> DataFrame:
    """Every area in every year. ``years`` is a list, or a frame whose distinct years count.

    The years travel as one array, so the grid is an ``explode`` and no join.
    """
    if isinstance(years, DataFrame):
        span: Column = years.agg(F.array_sort(F.collect_set(F.col(year).cast("int")))).scalar()
    else:
        span = F.array(*[F.lit(int(y)) for y in years])
    return areas.select(area).distinct().withColumn(year, F.explode(span))


def keep_one(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False
) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    An aggregate rather than a window, so that most rows of a hot key are
    dropped before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    payload = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("__one"))
    best = df.groupBy(*keys).agg(pick(payload, rank).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return keep_one(df, keys, order, last=True)


@dataclass(frozen=True)
class Source:
    """One table to join to the panel. ``order`` settles duplicate keys."""

    name: str
    df: DataFrame | None
    on: Sequence[str] = ("area_code", "year")
    drop: Sequence[str] = ()
    order: Sequence[str] = ()


def assemble_panel(
    grid: DataFrame, sources: Sequence[Source], missing: str = "skip",
    years: Sequence[int] | None = None, year: str = "year",
) -> DataFrame:
    """Left-join every source after one row per key is left of it.

    ``missing`` says what an absent table (``df=None``) means: ``skip`` or ``fail``.
    """
    panel = grid
    for source in sources:
        if source.df is None:
            if missing == "fail":
                raise ValueError(f"source {source.name!r} is missing")
            continue
        table = source.df.drop(*source.drop)
        if years is not None and year in table.columns:
            table = table.where(F.col(year).isin(*years))
        order = source.order or [c for c in table.columns if c not in source.on] or source.on
        panel = panel.join(keep_one(table, list(source.on), order), list(source.on), "left")
    return panel


def join_suffixed(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("", "_y"), how: str = "left",
) -> DataFrame:
    """Join on ``on``; columns that both sides have, in any case, take the suffix of their side.

    A name that a suffix makes and a side already has is an error.
    """
    keys = {c.lower() for c in on}
    names = [[c for c in side.columns if c.lower() not in keys] for side in (left, right)]
    shared = {c.lower() for c in names[0]} & {c.lower() for c in names[1]}
    renamed = [{c: c + suffix for c in held if c.lower() in shared} for held, suffix in zip(names, suffixes)]
    final = [*on, *[new.get(c, c) for held, new in zip(names, renamed) for c in held]]
    doubled = sorted({c for c in final if [f.lower() for f in final].count(c.lower()) > 1})
    if doubled:
        raise ValueError(f"columns named twice: {', '.join(doubled)}")
    return left.withColumnsRenamed(renamed[0]).join(right.withColumnsRenamed(renamed[1]), list(on), how).select(*[F.col(f"`{c}`") for c in final])


def concordance(
    df: DataFrame, lookup: DataFrame, old: str, new: str, required: Sequence[str], keep: str = "min_old"
) -> DataFrame:
    """Move rows from old codes to new ones (one old code may feed several new ones).

    Several old codes may also meet in one new code: ``min_old`` keeps the row
    of the lowest old code, ``all`` keeps every row.
    """
    pairs = lookup.select(old, new).distinct()
    moved = pairs.join(df, old, "left").na.drop("any", subset=list(required))
    if keep == "min_old":
        moved = keep_one(moved, [new], [old])
    return moved.drop(old) if keep == "all" else moved


def active_only(dim: DataFrame, fact: DataFrame, key: str, period: str) -> DataFrame:
    """Entities that report in the latest period of ``fact``."""
    return dim.join(latest_snapshot(fact, period).select(key), key, "left_semi")


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the keys of ``other``; NULL keys stay out."""
    return df.where(F.col(key).isNotNull()).join(other.select(key), key, "left_anti")


def latest_snapshot(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the latest date."""
    return df.where(F.col(ts) == df.agg(F.max(ts)).scalar())


def rollup(
    df: DataFrame, keys: Sequence[str], aggs: Mapping[str, str], zero_fill: Sequence[str] = (), stored: bool = False,
) -> DataFrame:
    """Mean, sum or median per group of those columns that exist.

    Columns in ``zero_fill`` end as whole numbers with NULL as zero. ``stored``
    says that ``df`` is cheap to read twice, which medians do.
    """
    present = {c: how for c, how in aggs.items() if c in df.columns}
    simple = {"mean": F.avg, "sum": F.sum}
    plain = [simple[how](c).alias(c) for c, how in present.items() if how != "median"]
    middle = [c for c, how in present.items() if how == "median"]
    if middle and not plain:  # medians have a row for every group
        out = medians(df, middle, keys, stored)
    else:
        out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
        if middle:
            out = join_null_safe(out, medians(df, middle, keys, stored), list(keys), "left")
    for c in zero_fill:
        if c in present:
            out = out.withColumn(c, F.bround(F.coalesce(F.col(c), F.lit(0.0)), 0).cast("int"))
    return out.select(*keys, *present)


def rollup_levels(
    df: DataFrame, levels: Mapping[str, Sequence[str]], aggs: Mapping[str, str], zero_fill: Sequence[str] = (),
    level: str = "level",
) -> DataFrame:
    """``rollup`` of one input to several levels at once, each a name with its keys.

    Column ``level`` tells the levels apart; keys that a level lacks are NULL
    there, so an unknown key of a level that has it stays a group of its own.
    The input is read once: every row stands for one row per level, reduced
    before the shuffle. Medians read twice, so for them what they need is stored
    before it is multiplied.
    """
    keys = list(dict.fromkeys(k for held in levels.values() for k in held))
    present = {c: how for c, how in aggs.items() if c in df.columns}
    rows = df.select(*[F.col(c) for c in dict.fromkeys([*keys, *present])])
    if "median" in present.values():
        rows = checkpointed(rows)
    whole = rows.withColumn(level, F.explode(F.array(*[F.lit(name) for name in levels])))
    masked = whole.withColumns({
        k: F.when(F.col(level).isin(*[name for name, held in levels.items() if k in held]), F.col(k)) for k in keys
    })
    return rollup(masked, [level, *keys], present, zero_fill, stored=True)


def fill_within(
    df: DataFrame, key: str, order: str, cols: Sequence[str], direction: str = "both"
) -> DataFrame:
    """Carry values forward, backward or both along ``order`` inside each key.

    ``(key, order)`` is the key of the panel, so a window holds one row per year.
    """
    base = Window.partitionBy(key).orderBy(order)
    past = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = base.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = {}
    for c in cols:
        forward, backward = F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(future)
        filled[c] = {
            "ffill": forward, "bfill": backward, "both": F.coalesce(forward, backward),
        }[direction]
    return df.withColumns(filled)


def fill_group_median(
    df: DataFrame, group: Sequence[str], cols: Sequence[str], stored: bool = False
) -> DataFrame:
    """Replace NULL by the median of the group; ``stored`` says that ``df`` is cheap to read."""
    middle = medians(df, cols, group, stored).withColumnsRenamed({c: f"__m_{c}" for c in cols})
    out = join_null_safe(df, middle, list(group), "left")
    return (
        out.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols})
        .drop(*[f"__m_{c}" for c in cols])
    )


def cascade_fill(
    df: DataFrame, col: str, groups: Sequence[str], zero_is_missing: bool = True,
) -> DataFrame:
    """Fill by the median of each group level in turn, then of everything, then zero.

    Each level sees what the levels before it filled in. The result is cut to
    a whole number. The input is read some times per level, so it is stored first.
    """
    out = df.withColumn(col, F.col(col).cast("double"))
    if zero_is_missing:
        out = out.withColumn(col, F.nullif(F.col(col), F.lit(0.0)))
    out = checkpointed(out)
    for level, group in enumerate(groups):
        out = fill_group_median(out, [group], [col], stored=level == 0)
    overall = one_row(medians(out, [col], ())).getField(col)
    return out.withColumn(col, F.coalesce(F.col(col), overall, F.lit(0.0)).cast("int"))


def running_number(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], out: str = "neighbourhood_num",
) -> DataFrame:
    return with_position(df, [F.col(o) for o in order], partition, out)


# Which service columns feed which summary column, and how.
SUMMARY_SPEC = {
    "avg_gp_satisfaction": ("gp_", "satisfaction", "avg", "mean"),
    "avg_distance_to_gp_km": ("gp_", "distance", "avg", "mean"),
    "avg_childcare_quality_score": ("childcare_", "quality_score", "avg", "mean"),
    "avg_distance_to_childcare_km": ("childcare_", "distance", "avg", "mean"),
    "total_childcare_places_nearby": ("childcare_", "places", "total", "sum"),
}


def summarise_services(
    df: DataFrame, spec: Mapping[str, tuple[str, str, str, str]] = SUMMARY_SPEC
) -> DataFrame:
    """Row-wise mean or sum over the columns of the nearest services."""
    added = {}
    for out, (kind, metric, skip, how) in spec.items():
        cols = [c for c in df.columns if kind in c and metric in c and skip not in c]
        if cols:
            added[out] = row_mean(cols) if how == "mean" else row_sum(cols)
    return df.withColumns(added) if added else df
