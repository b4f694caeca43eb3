"""Rollups, rankings, comparisons, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaindex.functions import clean
from areaindex.operators import explore, normalise, ordering, panel
from areaindex.queries.base import AREAS_SQL, METRICS_SQL, area_metrics, areas, query, rounded, table

_ROLLUP = {
    "balance": "mean", "mean_price": "mean", "mean_quantity": "mean", "not_a_column": "mean",
    "population": "sum", "order_count": "mean",
}

_MID_SQL = f"""{METRICS_SQL},
mid AS (
  SELECT mid_code, mid_name, top_code, avg(balance) AS balance, avg(mean_price) AS mean_price,
         avg(mean_quantity) AS mean_quantity, sum(population) AS population,
         CAST(round_even(coalesce(avg(order_count), 0), 0) AS INT) AS order_count
  FROM metrics GROUP BY 1, 2, 3)"""


def mid_level(spark, sf):
    keys = ["mid_code", "mid_name", "top_code"]
    return panel.rollup(area_metrics(spark, sf), keys, _ROLLUP, zero_fill=["order_count"])


@query("mid_rollup", f"""WITH {_MID_SQL}
SELECT mid_code, mid_name, top_name, round(balance, 6) AS balance, round(mean_price, 4) AS mean_price,
       round(mean_quantity, 6) AS mean_quantity, round(population, 6) AS population, order_count
FROM mid JOIN (SELECT DISTINCT mid_code, top_name FROM areas) USING (mid_code)""")
def mid_rollup(spark, sf):
    names = areas(spark, sf).select("mid_code", "top_name").distinct()
    out = mid_level(spark, sf).drop("top_code").join(names, "mid_code", "left")
    return rounded(rounded(out, "balance", "mean_quantity", "population"), "mean_price", digits=4)


def _rates(spark, sf):
    metrics = area_metrics(spark, sf).select("area_code", "top_name", "order_count", "population")
    rate = clean.plain_rate_per("order_count", "population")
    return metrics.select("area_code", "top_name", rate.alias("rate"))


_RATES_SQL = f"""{METRICS_SQL},
rates AS (SELECT area_code, top_name, order_count / nullif(population, 0) * 1000 AS rate FROM metrics)"""


@query("rank_areas_top", f"""WITH {_RATES_SQL}
SELECT area_code, round(rate, 6) AS rate FROM rates ORDER BY rates.rate ASC NULLS LAST, area_code LIMIT 25""")
def rank_areas_top(spark, sf):
    found = explore.rank_areas(_rates(spark, sf), "rate", 25, "area_code", top=True, lower_is_better=True)
    return rounded(found.select("area_code", "rate"), "rate")


@query("rank_areas_bottom", f"""WITH {_RATES_SQL}
SELECT area_code, round(rate, 6) AS rate FROM rates WHERE top_name = 'ASIA'
ORDER BY rates.rate DESC NULLS LAST, area_code LIMIT 50""")
def rank_areas_bottom(spark, sf):
    found = explore.rank_areas(
        _rates(spark, sf), "rate", 50, "area_code", top=False, lower_is_better=True,
        within=F.col("top_name") == "ASIA",
    )
    return rounded(found.select("area_code", "rate"), "rate")


_COMPARED = (3, 7, 11, 19, 24)


@query("compare_areas", f"""WITH {_MID_SQL},
long AS (UNPIVOT (SELECT mid_code, balance, mean_price, mean_quantity, population FROM mid)
         ON balance, mean_price, mean_quantity, population INTO NAME indicator VALUE value)
SELECT indicator, {", ".join(f'round(max(value) FILTER (WHERE mid_code = {a}), 4) AS "{a}"' for a in _COMPARED)}
FROM long GROUP BY 1""")
def compare_areas(spark, sf):
    found = explore.compare_areas(
        mid_level(spark, sf), "mid_code", _COMPARED, ["balance", "mean_price", "mean_quantity", "population", "absent"]
    )
    return rounded(found, *[str(a) for a in _COMPARED], digits=4)


@query("area_year_table", f"""WITH {AREAS_SQL}
SELECT area_code AS "Area", CAST(year(o_orderdate) AS INT) AS "Year", count(*) AS "Orders"
FROM orders JOIN areas ON area_code = o_custkey WHERE mid_name = 'NATION_4' GROUP BY 1, 2""")
def area_year_table(spark, sf):
    orders = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("area_code"), F.year("o_orderdate").alias("year")
    ).agg(F.count(F.lit(1)).alias("orders"))
    joined = orders.join(areas(spark, sf).select("area_code", "mid_name"), "area_code")
    shown = {"area_code": "Area", "year": "Year", "orders": "Orders", "not_there": "Nothing"}
    return explore.area_years(joined, F.col("mid_name") == "NATION_4", shown)


@query("mid_name_options", "SELECT DISTINCT n_name AS mid_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def mid_name_options(spark, sf):
    return explore.options(areas(spark, sf), "mid_name")


@query("trend_ols", f"""WITH {METRICS_SQL}
SELECT round(regr_slope(mean_item_price, mean_quantity), 6) AS slope,
       round(regr_intercept(mean_item_price, mean_quantity), 3) AS intercept,
       round(regr_r2(mean_item_price, mean_quantity), 6) AS r2,
       count(*) FILTER (WHERE mean_item_price IS NOT NULL AND mean_quantity IS NOT NULL) AS n FROM metrics""")
def trend_ols(spark, sf):
    found = explore.trend(area_metrics(spark, sf), "mean_quantity", "mean_item_price")
    return rounded(rounded(found, "slope", "r2"), "intercept", digits=3)


@query("histogram_50", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 50) AS INT), 49) AS bin, count(*) AS n
      FROM lineitem, e GROUP BY 1)
SELECT s.bin, round(lo + s.bin * ((hi - lo) / 50), 4) AS lower, round(lo + (s.bin + 1) * ((hi - lo) / 50), 4) AS upper,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT CAST(unnest(range(50)) AS INT) AS bin) s LEFT JOIN b USING (bin), e""")
def histogram_50(spark, sf):
    found = explore.histogram(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", 50)
    return rounded(found, "lower", "upper", digits=4)


@query("percentile_rank", f"""WITH {METRICS_SQL},
v AS (SELECT area_code, top_code, order_count AS x FROM metrics),
r AS (SELECT *, rank() OVER (PARTITION BY top_code ORDER BY x) + (count(*) OVER (PARTITION BY top_code, x) - 1) / 2.0 AS rk,
             count(x) OVER (PARTITION BY top_code) AS n FROM v)
SELECT area_code, round(rk / n * 100, 6) AS percentile, round(100 - rk / n * 100, 6) AS lower_is_better FROM r""")
def percentile_rank(spark, sf):
    metrics = area_metrics(spark, sf).select("area_code", "top_code", "order_count")
    ranked = normalise.percentile_rank(metrics, "order_count", ["top_code"])
    ranked = ranked.withColumn("lower_is_better", 100 - F.col("percentile"))
    return rounded(ranked.select("area_code", "percentile", "lower_is_better"), "percentile", "lower_is_better")


@query("average_ranks", """
SELECT l_orderkey, l_linenumber, CAST(rank() OVER (ORDER BY l_quantity DESC)
       + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS DOUBLE) AS rank FROM lineitem""")
def average_ranks(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ordering.average_rank(items, "l_quantity").drop("l_quantity")


_DECILES_SQL = """p AS (
  SELECT *, row_number() OVER ({part} ORDER BY x, k) AS r, count(*) OVER ({part}) AS n FROM v WHERE x IS NOT NULL)"""


@query("deciles_reversed", f"""WITH {METRICS_SQL},
v AS (SELECT area_code AS k, top_code AS g, CASE WHEN area_code % 7 <> 0 THEN balance END AS x FROM metrics),
{_DECILES_SQL.format(part="PARTITION BY g")}
SELECT v.k AS area_code,
  CASE WHEN r IS NOT NULL THEN CAST(10 - len(list_filter(range(1, 10), lambda j: (r - 1) * 10 > (n - 1) * j)) AS INT) END AS decile
FROM v LEFT JOIN p ON v.k = p.k""")
def deciles_reversed(spark, sf):
    value = F.when(F.col("area_code") % 7 != 0, F.col("balance"))
    metrics = areas(spark, sf).select("area_code", "top_code", value.alias("x"))
    return normalise.deciles(metrics, "x", ["area_code"], ["top_code"]).select("area_code", "decile")


@query("deciles_whole_pool", f"""WITH v AS (
  SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS x FROM lineitem),
{_DECILES_SQL.format(part="")}
SELECT k, CAST(10 - len(list_filter(range(1, 10), lambda j: (r - 1) * 10 > (n - 1) * j)) AS INT) AS decile FROM p""")
def deciles_whole_pool(spark, sf):
    items = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity"
    )
    return normalise.deciles(items, "l_quantity", ["k"]).select("k", "decile")


@query("neighbourhood_number", f"""WITH {AREAS_SQL}
SELECT area_code, CAST(row_number() OVER (PARTITION BY mid_name ORDER BY area_code) AS INT) AS neighbourhood_num,
       mid_name || ' - Neighbourhood ' || row_number() OVER (PARTITION BY mid_name ORDER BY area_code) AS display_name,
       CAST(row_number() OVER (PARTITION BY mid_name ORDER BY area_code) AS VARCHAR) AS shown_number FROM areas""")
def neighbourhood_number(spark, sf):
    numbered = panel.running_number(areas(spark, sf).select("area_code", "mid_name"), ["mid_name"], ["area_code"])
    named = numbered.withColumn("display_name", clean.display_name("mid_name", "neighbourhood_num"))
    return named.withColumn("shown_number", clean.name_number("display_name")).drop("mid_name")


@query("describe_indicators", f"""WITH {METRICS_SQL},
long AS (UNPIVOT (SELECT balance, order_count, mean_price, mean_quantity FROM metrics)
         ON balance, order_count, mean_price, mean_quantity INTO NAME indicator VALUE v),
m AS (SELECT indicator, avg(v) AS mu FROM long GROUP BY 1),
c AS (SELECT indicator, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4
      FROM long JOIN m USING (indicator) GROUP BY 1),
s AS (SELECT indicator, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max FROM long GROUP BY 1)
SELECT indicator, round(mean, 4) AS mean, round(sd, 4) AS sd, round(min, 4) AS min, round(max, 4) AS max,
       round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM s JOIN c USING (indicator)""")
def describe_indicators(spark, sf):
    found = normalise.describe(area_metrics(spark, sf), ["balance", "order_count", "mean_price", "mean_quantity"])
    return rounded(rounded(found, "skewness", "kurtosis"), "mean", "sd", "min", "max", digits=4)


@query("winsor_bounds", f"""WITH {METRICS_SQL},
long AS (UNPIVOT (SELECT balance, mean_price, mean_discount FROM metrics)
         ON balance, mean_price, mean_discount INTO NAME indicator VALUE v),
q AS (SELECT indicator, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.975) AS high FROM long GROUP BY 1)
SELECT indicator, round(any_value(low), 6) AS low, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3, round(any_value(high), 6) AS high,
       count(*) FILTER (WHERE v < low) AS below, count(*) FILTER (WHERE v > high) AS above
FROM long JOIN q USING (indicator) GROUP BY 1""")
def winsor_bounds(spark, sf):
    found = normalise.winsor_bounds(area_metrics(spark, sf), ["balance", "mean_price", "mean_discount"])
    return rounded(found, "low", "q1", "median", "q3", "high")
