"""Cleaning, incident feeds, price series, panel building."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from areaindex.functions import clean
from areaindex.operators import explore, panel, series
from areaindex.queries.base import AREAS_SQL, METRICS_SQL, area_metrics, areas, population, query, rounded, table
from areaindex.session import co_partitioned, ensure_checkpoint_dir
from areaindex.sources import tables
from areaindex.streaming.counts import monthly_counts_stream, read_open_counts, write_counts, write_open_counts

PRIORITIES = {
    "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low",
}
_PER_TYPE_SQL = ", ".join(
    f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS {name}" for p, name in PRIORITIES.items()
)


def _mid_feed(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("mid_code"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _feed(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("area_code"), "o_orderdate")


@query("monthly_counts_by_type", f"""
SELECT c_nationkey AS mid_code, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS monthly_count, {_PER_TYPE_SQL}
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def monthly_counts_by_type(spark, sf):
    feed = series.relevant_incidents(
        _mid_feed(spark, sf), ["mid_code", "o_orderdate"], "o_orderpriority", tuple(PRIORITIES)
    )
    counts = series.monthly_counts(feed, "mid_code", "o_orderdate", "o_orderpriority", tuple(PRIORITIES))
    return counts.withColumnsRenamed(PRIORITIES).withColumn("period", clean.period_text("period"))


_ANNUAL_SQL = """
yearly AS (
  SELECT o_custkey AS area_code, CAST(year(o_orderdate) AS INT) AS year, count(*) AS raw_count,
         count(DISTINCT month(o_orderdate)) AS months_of_data
  FROM orders GROUP BY 1, 2),
grid AS (
  SELECT c_custkey AS area_code, y.year FROM customer, (SELECT DISTINCT year FROM yearly) y),
annual AS (
  SELECT g.area_code, g.year, coalesce(raw_count, 0) AS raw_count, coalesce(months_of_data, 0) AS months_of_data,
         coalesce(raw_count / months_of_data * 12.0, 0)::DOUBLE AS annualised_count,
         coalesce(months_of_data, 0) = 12 AS is_full_year
  FROM grid g LEFT JOIN yearly USING (area_code, year))"""


def _annual(spark, sf, coverage="area"):
    feed = _feed(spark, sf)
    codes = table(spark, sf, "customer").select(F.col("c_custkey").alias("area_code"))
    grid = series.incident_grid(codes, feed, "area_code", "o_orderdate")
    return series.annualise(feed, "area_code", "o_orderdate", grid, coverage)


@query("annualised_incidents", f"""WITH {_ANNUAL_SQL}
SELECT area_code, year, raw_count, months_of_data, round(annualised_count, 6) AS annualised_count, is_full_year
FROM annual""")
def annualised_incidents(spark, sf):
    return rounded(_annual(spark, sf), "annualised_count")


@query("annualised_incidents_feed_months", f"""WITH {_ANNUAL_SQL},
feed AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT month(o_orderdate)) AS m FROM orders GROUP BY 1)
SELECT area_code, year, raw_count, CASE WHEN raw_count > 0 THEN m ELSE 0 END AS months_of_data,
       round(raw_count / m * 12.0::DOUBLE, 6) AS annualised_count, raw_count > 0 AND m = 12 AS is_full_year
FROM annual JOIN feed USING (year)""")
def annualised_incidents_feed_months(spark, sf):
    return rounded(_annual(spark, sf, "global"), "annualised_count")


def incident_rates(spark, sf):
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("area_code"), population(F.col("c_custkey")).alias("population")
    )
    return _annual(spark, sf).join(people, "area_code", "left").withColumns({
        "rate": clean.rate_per("annualised_count", "population"),
        "plain_rate": clean.plain_rate_per("annualised_count", "population"),
    })


@query("incident_rate", f"""WITH {AREAS_SQL}, {_ANNUAL_SQL}
SELECT area_code, year, round(annualised_count / CASE WHEN coalesce(population, 0) = 0 THEN 1 ELSE population END * 1000, 6) AS rate,
       round(annualised_count / nullif(population, 0) * 1000, 6) AS plain_rate
FROM annual JOIN areas USING (area_code)""")
def incident_rate(spark, sf):
    return rounded(incident_rates(spark, sf).select("area_code", "year", "rate", "plain_rate"), "rate", "plain_rate")


@query("median_series_mid", """
SELECT c_nationkey AS mid_code, strftime(o_orderdate, '%Y-%m') AS period,
       CAST(floor(quantile_cont(o_totalprice, 0.5)) AS INT) AS median_price
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def median_series_mid(spark, sf):
    priced = _mid_feed(spark, sf).select(
        "mid_code", clean.period_text("o_orderdate").alias("period"), F.col("o_totalprice").alias("median_price")
    )
    found = panel.rollup(priced, ["mid_code", "period"], {"median_price": "median"})
    return found.withColumn("median_price", F.col("median_price").cast("int"))


@query("median_series_region", """
SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(floor(quantile_cont(o_totalprice, 0.5)) AS INT) AS median_price
FROM orders GROUP BY 1""")
def median_series_region(spark, sf):
    priced = table(spark, sf, "orders").select(
        clean.period_text("o_orderdate").alias("period"), F.col("o_totalprice").alias("median_price")
    )
    found = panel.rollup(priced, ["period"], {"median_price": "median"})
    return found.withColumn("median_price", F.col("median_price").cast("int"))


@query("median_series_levels", """
SELECT CASE WHEN grouping(c_nationkey) = 0 THEN 'mid' WHEN grouping(n_regionkey) = 0 THEN 'top' ELSE 'region' END AS level,
       c_nationkey AS mid_code, n_regionkey AS top_code, strftime(o_orderdate, '%Y-%m') AS period,
       CAST(floor(quantile_cont(o_totalprice, 0.5)) AS INT) AS median_price, count(*) AS n_prices
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((c_nationkey, strftime(o_orderdate, '%Y-%m')), (n_regionkey, strftime(o_orderdate, '%Y-%m')),
                        (strftime(o_orderdate, '%Y-%m')))""")
def median_series_levels(spark, sf):
    """Median price and number of prices per month at three levels, from one pass over the prices."""
    parents = areas(spark, sf).select("mid_code", "top_code").distinct()
    priced = _mid_feed(spark, sf).join(parents, "mid_code").select(
        "mid_code", "top_code", clean.period_text("o_orderdate").alias("period"), F.col("o_totalprice").alias("median_price"),
        F.lit(1).alias("n_prices"),
    )
    levels = {"mid": ["mid_code", "period"], "top": ["top_code", "period"], "region": ["period"]}
    found = panel.rollup_levels(priced, levels, {"median_price": "median", "n_prices": "sum"})
    return found.withColumn("median_price", F.col("median_price").cast("int"))


@query("latest_price_cascade_fill", f"""WITH {AREAS_SQL},
yearly AS (
  SELECT o_custkey AS area_code, year(o_orderdate) AS year, quantile_cont(o_totalprice, 0.5) AS price
  FROM orders GROUP BY 1, 2),
latest AS (SELECT area_code, CASE WHEN area_code % 13 = 0 THEN 0 ELSE price END AS price
           FROM yearly WHERE year = (SELECT max(year) FROM yearly)),
s0 AS (SELECT a.area_code, mid_code, top_code, nullif(price, 0) AS p FROM areas a LEFT JOIN latest USING (area_code)),
m1 AS (SELECT mid_code, quantile_cont(p, 0.5) AS m FROM s0 GROUP BY 1),
s1 AS (SELECT area_code, top_code, coalesce(p, m) AS p FROM s0 LEFT JOIN m1 USING (mid_code)),
m2 AS (SELECT top_code, quantile_cont(p, 0.5) AS m FROM s1 GROUP BY 1),
s2 AS (SELECT area_code, coalesce(p, m) AS p FROM s1 LEFT JOIN m2 USING (top_code))
SELECT area_code, CAST(floor(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM s2), 0)) AS INT) AS latest_price FROM s2""")
def latest_price_cascade_fill(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("area_code"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price")
    )
    latest = panel.latest_snapshot(panel.rollup(orders, ["area_code", "year"], {"price": "median"}), "year")
    shown = F.when(F.col("area_code") % 13 == 0, F.lit(0.0)).otherwise(F.col("price"))
    base = areas(spark, sf).select("area_code", "mid_code", "top_code").join(
        latest.select("area_code", shown.alias("latest_price")), "area_code", "left"
    )
    return panel.cascade_fill(base, "latest_price", ["mid_code", "top_code"]).select("area_code", "latest_price")


_SPARSE_SQL = """
yearly AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INT) AS year,
         CASE WHEN (l_suppkey * 7 + year(l_shipdate) * 5) % 8 < 3 THEN NULL
              ELSE sum(CAST(round(l_quantity * 100) AS BIGINT)) / (count(*) * 100.0::DOUBLE) END AS quantity
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate)),
grid AS (SELECT s_suppkey AS entity, y.year FROM supplier, (SELECT DISTINCT year FROM yearly) y),
sparse AS (SELECT g.entity, g.year, quantity FROM grid g LEFT JOIN yearly USING (entity, year))"""


def _sparse(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("q"),
    )
    yearly = items.groupBy("entity", "year").agg((F.sum("q") / (F.count("q") * F.lit(100.0))).alias("quantity"))
    hole = (F.col("entity") * 7 + F.col("year") * 5) % 8 < 3
    yearly = yearly.withColumn("quantity", F.when(~hole, F.col("quantity")))
    grid = panel.make_grid(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity")), items, "entity")
    return grid.join(yearly, ["entity", "year"], "left")


@query("fill_within_area", f"""WITH {_SPARSE_SQL}
SELECT entity, year, round(coalesce(
  last_value(quantity IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(quantity IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), 6) AS quantity FROM sparse""")
def fill_within_area(spark, sf):
    return rounded(panel.fill_within(_sparse(spark, sf), "entity", "year", ["quantity"]), "quantity")


@query("fill_forward_then_year_median", f"""WITH {_SPARSE_SQL},
carried AS (SELECT entity, year, last_value(quantity IGNORE NULLS) OVER (
  PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM sparse),
mid AS (SELECT year, quantile_cont(q, 0.5) AS m FROM carried GROUP BY 1)
SELECT entity, year, round(coalesce(q, m), 6) AS quantity FROM carried JOIN mid USING (year)""")
def fill_forward_then_year_median(spark, sf):
    carried = panel.fill_within(_sparse(spark, sf), "entity", "year", ["quantity"], "ffill")
    return rounded(panel.fill_group_median(carried, ["year"], ["quantity"]), "quantity")


_PANEL_SQL = f"""WITH {_SPARSE_SQL},
sold AS (
  SELECT l_suppkey AS entity, CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT l_orderkey) AS orders
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
tax AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INT) AS year,
         sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 100.0::DOUBLE) AS tax FROM lineitem GROUP BY 1, 2)
SELECT s.entity, s.year, round(quantity, 6) AS gp_1_satisfaction, round(tax, 6) AS gp_2_satisfaction, orders,
       s_acctbal AS static_balance,
       round(CASE WHEN quantity IS NULL THEN tax WHEN tax IS NULL THEN quantity ELSE (quantity + tax) / 2 END, 6)
         AS avg_gp_satisfaction
FROM sparse s LEFT JOIN sold USING (entity, year) LEFT JOIN tax USING (entity, year)
LEFT JOIN supplier ON s_suppkey = s.entity"""


def _panel_sources(spark, sf):
    """(grid, sources) of the panel."""
    items = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    sold = (
        items.select("l_orderkey", F.col("l_suppkey").alias("entity")).distinct()
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("entity", "year").agg(F.count(F.lit(1)).alias("orders"))
    )
    tax = items.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / (F.count("l_tax") * F.lit(100.0))).alias("gp_2_satisfaction")
    )
    static = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("static_balance"), "s_name"
    )
    sparse = _sparse(spark, sf).withColumnRenamed("quantity", "gp_1_satisfaction")
    keys = ("entity", "year")
    return sparse.select(*keys), [
        panel.Source("satisfaction", sparse, keys),
        panel.Source("sold", sold, keys),
        panel.Source("tax", tax, keys),
        panel.Source("not there", None, keys),
        panel.Source("balance", static, ("entity",), drop=("s_name",)),
    ]


def _summarised(whole):
    return rounded(
        panel.summarise_services(whole), "gp_1_satisfaction", "gp_2_satisfaction", "avg_gp_satisfaction"
    )


@query("panel_assemble", _PANEL_SQL)
def panel_assemble(spark, sf):
    return _summarised(panel.assemble_panel(*_panel_sources(spark, sf)))


@query("panel_in_buckets", _PANEL_SQL)
def panel_in_buckets(spark, sf):
    """The panel from sources stored in buckets by entity, joined without a shuffle."""
    run, folder = uuid.uuid4().hex, ensure_checkpoint_dir(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(name, df):
        name = f"{name.replace(' ', '_')}_{run}"
        return tables.write_bucketed(df, f"default.{name}", ["entity"], buckets, f"{folder}/{name}")

    grid, sources = _panel_sources(spark, sf)
    grid = bucketed("grid", grid)
    held = [replace(s, df=bucketed(s.name, s.df)) for s in sources if s.df is not None]
    path = f"{folder}/panel_{run}"
    with co_partitioned(spark):
        tables.write_table(panel.assemble_panel(grid, held), path)
    for name in ("grid", *[s.name for s in held]):
        spark.sql(f"DROP TABLE default.{name}_{run}")
    return _summarised(spark.read.parquet(path))


@query("suffixed_join", """WITH m AS (
  SELECT c_nationkey AS mid_code, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS balance FROM customer GROUP BY 1)
SELECT c_nationkey AS mid_code, c_custkey AS area_code, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, m.balance AS balance_mid, n
FROM customer LEFT JOIN m ON c_nationkey = m.mid_code""")
def suffixed_join(spark, sf):
    """Areas beside their mid-level area; a column that both have is told apart by a suffix."""
    own = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("mid_code"), F.col("c_custkey").alias("area_code"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"),
    )
    mid = own.groupBy("mid_code").agg(F.count("*").alias("n"), F.sum("balance").alias("balance"))
    return panel.join_suffixed(own, mid, ["mid_code"], ("", "_mid"))


def _resample_sql(unit: str, months: int) -> str:
    return f"""WITH b AS (
  SELECT o_custkey AS area_code, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
span AS (SELECT area_code, min(s) AS lo, max(s) AS hi FROM b GROUP BY 1),
spine AS (
  SELECT area_code, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL {months} MONTH)) AS DATE) AS s FROM span)
SELECT area_code, strftime(s + INTERVAL {months} MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS bucket,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM spine LEFT JOIN b USING (area_code, s)"""


def _resampled(spark, sf, unit):
    feed = _feed(spark, sf).withColumn("n", F.lit(1).cast("long"))
    out = series.resample(feed, ["area_code"], "o_orderdate", "n", unit)
    return out.select("area_code", F.date_format("o_orderdate", "yyyy-MM-dd").alias("bucket"), "n")


@query("resample_quarter", _resample_sql("quarter", 3))
def resample_quarter(spark, sf):
    return _resampled(spark, sf, "quarter")


@query("resample_year", _resample_sql("year", 12))
def resample_year(spark, sf):
    return _resampled(spark, sf, "year")


@query("series_vs_region", """WITH a AS (
  SELECT o_custkey AS area_code, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS area_n FROM orders GROUP BY 1, 2),
low AS (SELECT area_code, period, area_n FROM a JOIN customer ON c_custkey = area_code
        WHERE c_nationkey = (SELECT min(c_nationkey) FROM customer)),
mine AS (SELECT period, sum(area_n) AS area_n FROM low GROUP BY 1),
whole AS (SELECT period, sum(area_n) AS region_n FROM a GROUP BY 1)
SELECT period, CAST(area_n AS BIGINT) AS area_n, CAST(region_n AS BIGINT) AS region_n
FROM mine FULL OUTER JOIN whole USING (period)""")
def series_vs_region(spark, sf):
    feed = _mid_feed(spark, sf).withColumn("period", clean.period_text("o_orderdate"))
    first = table(spark, sf, "customer").agg(F.min("c_nationkey")).scalar()
    mine = feed.where(F.col("mid_code") == first).groupBy("period").agg(F.count(F.lit(1)).alias("area_n"))
    whole = feed.groupBy("period").agg(F.count(F.lit(1)).alias("region_n"))
    return series.align(mine, whole, ["period"])


@query("wide_to_long_periods", """WITH b AS (
  SELECT c_nationkey AS mid_code, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS d,
         sum(CAST(round(o_totalprice) AS BIGINT)) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
grid AS (SELECT DISTINCT x.mid_code, y.d FROM b x, b y)
SELECT mid_code, strftime(d, '%Y-%m-%d') AS date, CAST(price AS DOUBLE) AS price
FROM grid LEFT JOIN b USING (mid_code, d)""")
def wide_to_long_periods(spark, sf):
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
    priced = _mid_feed(spark, sf).select(
        "mid_code", F.date_format(end, "MMM yyyy").alias("period"),
        F.round("o_totalprice").cast("long").alias("p"),
    )
    quarters = [r["period"] for r in priced.select("period").distinct().collect()]
    wide = priced.groupBy("mid_code").agg(*[
        F.format_number(F.sum(F.when(F.col("period") == q, F.col("p"))), 0).alias(f"Year ending {q}") for q in quarters
    ])
    long = series.periods_to_long(wide, ["mid_code"], value="price")
    return long.select(
        "mid_code", F.date_format("date", "yyyy-MM-dd").alias("date"), clean.to_number("price").alias("price")
    )


@query("type_totals_ranked", f"""WITH t AS (SELECT {_PER_TYPE_SQL} FROM orders)
SELECT type, total FROM (UNPIVOT t ON {", ".join(PRIORITIES.values())} INTO NAME type VALUE total)""")
def type_totals_ranked(spark, sf):
    return series.type_totals(monthly_counts_by_type(spark, sf), list(PRIORITIES.values()))


@query("yearly_means", f"""WITH {_SPARSE_SQL}
SELECT year, round(avg(quantity), 6) AS quantity FROM sparse GROUP BY 1 HAVING count(quantity) > 0""")
def yearly_means(spark, sf):
    return rounded(series.yearly_means(_sparse(spark, sf), "year", ["quantity"]), "quantity")


@query("latest_year_feed", """
SELECT o_custkey AS area_code, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1, 2""")
def latest_year_feed(spark, sf):
    feed = _feed(spark, sf)
    kept = series.in_year(feed, "o_orderdate", feed.agg(F.max(F.year("o_orderdate"))).scalar())
    return kept.groupBy("area_code", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("clean_sentinels", """WITH t AS (
  SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, value FROM events),
s AS (SELECT event_id, user_id, CASE
    WHEN event_id % 11 = 0 THEN 'SUPP' WHEN event_id % 11 = 1 THEN 'NE' WHEN event_id % 11 = 2 THEN 'x' || k
    WHEN event_id % 11 = 3 THEN k || '%' WHEN event_id % 11 = 4 THEN '1,' || lpad(k, 3, '0')
    WHEN event_id % 11 = 5 THEN '' WHEN event_id % 11 = 6 THEN 'nan' ELSE k END AS text FROM t)
SELECT event_id, CASE WHEN text IN ('SUPP', 'NE', '', 'nan') THEN NULL
  ELSE TRY_CAST(replace(replace(text, '%', ''), ',', '') AS DOUBLE) END AS number,
  upper(replace(' u' || user_id || ' 1a ', ' ', '')) AS postcode, upper(trim(' e' || user_id || ' ')) AS code FROM s""")
def clean_sentinels(spark, sf):
    k = F.get_json_object("props", "$.k")
    part = F.col("event_id") % 11
    text = (
        F.when(part == 0, "SUPP").when(part == 1, "NE").when(part == 2, F.concat(F.lit("x"), k))
        .when(part == 3, F.concat(k, F.lit("%"))).when(part == 4, F.concat(F.lit("1,"), F.lpad(k, 3, "0")))
        .when(part == 5, "").when(part == 6, "nan").otherwise(k)
    )
    user = F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        "event_id", clean.to_number(text).alias("number"),
        clean.norm_postcode(F.concat(F.lit(" u"), user, F.lit(" 1a "))).alias("postcode"),
        clean.norm_code(F.concat(F.lit(" e"), user, F.lit(" "))).alias("code"),
    )


@query("grade_scores", """WITH t AS (
  SELECT event_id, CAST(event_id % 11 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END AS g FROM events)
SELECT event_id,
  CASE substr(g, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 END AS score,
  CASE g WHEN '1' THEN 'Outstanding (1)' WHEN '2' THEN 'Good (2)' WHEN '3' THEN 'Requires Improvement (3)'
         WHEN '4' THEN 'Inadequate (4)' WHEN '4.0' THEN 'Inadequate (4)' WHEN '9' THEN 'Not Assessed' ELSE 'N/A' END AS label,
  CAST(event_id % 11 AS VARCHAR) AS entity FROM t""")
def grade_scores(spark, sf):
    grade = F.concat(
        (F.col("event_id") % 11).cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise("")
    )
    return table(spark, sf, "events").select(
        "event_id", clean.grade_score(grade).alias("score"), clean.grade_label(grade).alias("label"),
        clean.entity_id(grade).alias("entity"),
    )


@query("fraction_to_percent", """
SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS BIGINT) AS discount,
       round(CASE WHEN (SELECT max(l_quantity) FROM lineitem) <= 1 THEN l_quantity * 100 ELSE l_quantity END, 6) AS quantity
FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08""")
def fraction_to_percent(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    both = clean.fraction_to_percent(clean.fraction_to_percent(items, "l_discount", "discount"), "l_quantity", "quantity")
    kept = clean.keep_range(both, "l_discount", 0.02, 0.08)
    return rounded(kept.drop("l_discount", "l_quantity"), "quantity").withColumn("discount", F.round("discount").cast("long"))


@query("latest_per_entity", """
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_entity(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return rounded(panel.latest_per(events, ["user_id"], ["ts", "event_id"]).drop("ts"), "value")


@query("first_per_entity", """
SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def first_per_entity(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return panel.keep_one(events, ["user_id", "event_type"], ["event_id"])


_CONCORDANCE_SQL = f"""{METRICS_SQL},
lookup AS (
  SELECT area_code AS old_code, area_code - CASE WHEN area_code % 5 = 4 THEN 1 ELSE 0 END AS new_code FROM areas
  UNION SELECT area_code, area_code + 1000000 FROM areas WHERE area_code % 10 = 3),
moved AS (
  SELECT old_code, new_code, CASE WHEN area_code % 7 = 0 THEN NULL ELSE balance END AS score
  FROM lookup LEFT JOIN metrics ON area_code = old_code)"""


def _concordance(spark, sf, keep):
    scores = area_metrics(spark, sf).select(
        F.col("area_code").alias("old_code"), F.when(F.col("area_code") % 7 != 0, F.col("balance")).alias("score")
    )
    code = F.col("old_code")
    lookup = scores.select("old_code").withColumn("new_code", F.explode(F.filter(F.array(
        F.when(code % 5 == 4, code - 1).otherwise(code), F.when(code % 10 == 3, code + 1000000)
    ), lambda c: c.isNotNull())))
    return panel.concordance(scores, lookup, "old_code", "new_code", ["score"], keep)


@query("concordance_join", f"""WITH {_CONCORDANCE_SQL}
SELECT new_code, old_code, score FROM (
  SELECT *, row_number() OVER (PARTITION BY new_code ORDER BY old_code) AS rn FROM moved WHERE score IS NOT NULL)
WHERE rn = 1""")
def concordance_join(spark, sf):
    return _concordance(spark, sf, "min_old")


@query("concordance_join_all", f"""WITH {_CONCORDANCE_SQL}
SELECT new_code, score FROM moved WHERE score IS NOT NULL""")
def concordance_join_all(spark, sf):
    return _concordance(spark, sf, "all")


_SALES_SQL = "sales AS (SELECT DISTINCT l_partkey, CAST(year(l_shipdate) AS INT) AS year FROM lineitem)"


def _sales(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year")).distinct()


@query("active_semijoin", f"""WITH {_SALES_SQL}
SELECT p_partkey, p_name FROM part
WHERE p_partkey IN (SELECT l_partkey FROM sales WHERE year = (SELECT max(year) FROM sales))""")
def active_semijoin(spark, sf):
    sales = _sales(spark, sf).withColumnRenamed("l_partkey", "p_partkey")
    return panel.active_only(table(spark, sf, "part").select("p_partkey", "p_name"), sales, "p_partkey", "year")


@query("new_entities_antijoin", f"""WITH {_SALES_SQL}
SELECT p_partkey, p_name FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM sales WHERE year = (SELECT min(year) FROM sales))""")
def new_entities_antijoin(spark, sf):
    sales = _sales(spark, sf)
    early = sales.where(F.col("year") == sales.agg(F.min("year")).scalar())
    return panel.not_in(
        table(spark, sf, "part").select("p_partkey", "p_name"),
        early.select(F.col("l_partkey").alias("p_partkey")), "p_partkey",
    )


def _long_history(wide, entity, value):
    years = [c for c in wide.columns if c != entity]
    return wide.unpivot([entity], years, "year", value).withColumn("year", F.col("year").cast("int"))


@query("entity_history_pivot", """WITH m AS (
  SELECT p_brand, year(l_shipdate) AS year, CAST(round_even(avg(l_quantity), 1) AS DOUBLE) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, year, quantity FROM (SELECT DISTINCT p_brand FROM m) CROSS JOIN (SELECT DISTINCT year FROM m)
LEFT JOIN m USING (p_brand, year)""")
def entity_history_pivot(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _long_history(explore.history_pivot(joined, "p_brand", "year", "l_quantity", digits=1), "p_brand", "quantity")


@query("entity_history_labels", """WITH m AS (
  SELECT l_suppkey, year(l_shipdate) AS year, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, year, coalesce(flag, 'N/A') AS flag
FROM (SELECT DISTINCT l_suppkey FROM m) CROSS JOIN (SELECT DISTINCT year FROM m) LEFT JOIN m USING (l_suppkey, year)""")
def entity_history_labels(spark, sf):
    items = table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag")
    wide = explore.history_pivot(items, "l_suppkey", "year", "l_returnflag", agg="first", default="N/A")
    return _long_history(wide, "l_suppkey", "flag")


def _replayed(spark, sf, mode):
    """Run the stream to its end and read back what it wrote."""
    import uuid

    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    # a stream wants a folder or a pattern; this one fits just the table, be it a file or a folder
    feed = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    counts = monthly_counts_stream(feed, "user_id", "ts", "event_type", "2 days", unit="day")
    write = write_counts if mode == "append" else write_open_counts
    write(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = (
        spark.read.schema(counts.schema).parquet(f"{folder}/out") if mode == "append"
        else read_open_counts(spark, f"{folder}/out", ["user_id", "period", "event_type"])
    )
    return found.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("monthly_counts_stream", """WITH d AS (
  SELECT user_id, date_trunc('day', ts) AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT user_id, strftime(period, '%Y-%m-%d') AS period, event_type, n FROM d
WHERE period <= (SELECT max(period) FROM d) - INTERVAL 2 DAY""")
def stream_counts(spark, sf):
    """Closed periods, each written once."""
    return _replayed(spark, sf, "append")


@query("monthly_counts_stream_open", """
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, event_type, count(*) AS n
FROM events GROUP BY 1, 2, 3""")
def stream_open_counts(spark, sf):
    """All periods, those still open with what has arrived so far."""
    return _replayed(spark, sf, "update")


@query("sample_area_audit", """WITH drawn AS (
  SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5(o_custkey || ':0'), o_custkey LIMIT 5)
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM drawn)""")
def sample_area_audit(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    drawn = explore.sample_audit(orders, "o_custkey", 5, 0, ["o_orderdate", "o_orderkey"])
    return drawn.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
