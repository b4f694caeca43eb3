"""Nearest services, distance-weighted results, listings of what is near."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaindex.operators import knn
from areaindex.queries.base import query, rounded, table

_X = "({k} * 7919) % 10007"
_Y = "({k} * 104729) % 10009"


def place(key: str) -> tuple:
    """Planar metres that follow from a key."""
    k = F.col(key)
    return ((k * 7919) % 10007).cast("double").alias("x"), ((k * 104729) % 10009).cast("double").alias("y")


def place_sql(key: str) -> str:
    return f"({_X.format(k=key)})::DOUBLE AS x, ({_Y.format(k=key)})::DOUBLE AS y"


_AREA_SQL = f"a AS (SELECT c_custkey AS area_code, {place_sql('(c_custkey + 17)')} FROM customer)"


def _area_points(spark, sf):
    keyed = table(spark, sf, "customer").select(F.col("c_custkey").alias("area_code"))
    return keyed.withColumn("k", F.col("area_code") + 17).select("area_code", *place("k"))


def _nearest_sql(points: str, by: str = "") -> str:
    part = f"{by}, " if by else ""
    return f"""{_AREA_SQL}, p AS ({points}),
d AS (SELECT area_code, {part}id, sqrt(pow(a.x - p.x, 2) + pow(a.y - p.y, 2)) AS d FROM a, p),
near AS (SELECT area_code, {part}id, d / 1000 AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY area_code{", " + by if by else ""} ORDER BY d, id) AS rank FROM d) WHERE rank <= 3)"""


_PARTS_SQL = f"SELECT p_partkey AS id, {place_sql('p_partkey')} FROM part"
_SUPPLIERS_SQL = f"SELECT s_suppkey AS id, {place_sql('s_suppkey')} FROM supplier"


@query("knn_three_nearest", f"""WITH {_nearest_sql(_PARTS_SQL)}
SELECT area_code, rank, id, round(distance, 6) AS distance FROM near""")
def knn_three_nearest(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *place("p_partkey"))
    return rounded(knn.knn_join(_area_points(spark, sf), parts, 3), "distance")


_OPEN_SQL = f"""SELECT s_suppkey AS id, year, {place_sql('s_suppkey')} FROM supplier JOIN (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year FROM lineitem
  GROUP BY l_suppkey, year(l_shipdate)) ON l_suppkey = s_suppkey"""


@query("knn_by_year", f"""WITH {_nearest_sql(_OPEN_SQL, "year")}
SELECT area_code, year, rank, id, round(distance, 6) AS distance FROM near""")
def knn_by_year(spark, sf):
    """The three nearest of the suppliers that delivered in each year."""
    open_ = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year")).distinct()
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), *place("s_suppkey"))
    found = knn.knn_join(_area_points(spark, sf), open_.join(suppliers, "id"), 3, by="year")
    return rounded(found, "distance")


def _near_suppliers(spark, sf, only=None):
    asked = _area_points(spark, sf)
    asked = asked if only is None else asked.join(only, "area_code", "left_semi")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), *place("s_suppkey"))
    return knn.knn_join(asked, suppliers, 3)


_RESULTS_SQL = """results AS (
  SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INT) AS year,
         CASE WHEN (l_suppkey + year(l_shipdate)) % 3 <> 0 THEN avg(l_quantity) END AS quantity,
         CASE WHEN l_suppkey % 2 = 0 THEN avg(l_tax) END AS tax FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"""


def _results(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year")
    ).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    return items.select(
        "id", "year", F.when((F.col("id") + F.col("year")) % 3 != 0, F.col("quantity")).alias("quantity"),
        F.when(F.col("id") % 2 == 0, F.col("tax")).alias("tax"),
    )


@query("distance_weighted_metric", f"""WITH {_nearest_sql(_SUPPLIERS_SQL)}, {_RESULTS_SQL}
SELECT area_code, year,
  round(sum(quantity / (distance + 0.1)) / sum(1 / (distance + 0.1)) FILTER (WHERE quantity IS NOT NULL), 6) AS quantity_weighted,
  round(sum(tax / (distance + 0.1)) / sum(1 / (distance + 0.1)) FILTER (WHERE tax IS NOT NULL), 6) AS tax_weighted
FROM near JOIN results USING (id) GROUP BY 1, 2""")
def distance_weighted_metric(spark, sf):
    joined = _near_suppliers(spark, sf).join(_results(spark, sf), "id")
    found = knn.distance_weighted(joined, ["area_code", "year"], ["quantity", "tax"])
    return rounded(found, "quantity_weighted", "tax_weighted")


_WIDE = [(r, m) for r in (1, 2, 3) for m in ("satisfaction", "distance", "gp_name")]
_WIDE_COL = {"satisfaction": "round(quantity, 6)", "distance": "round(distance, 6)", "gp_name": "s_name"}


@query("knn_wide", f"""WITH {_nearest_sql(_SUPPLIERS_SQL)}, {_RESULTS_SQL}
SELECT area_code, year, {", ".join(f'max({_WIDE_COL[m]}) FILTER (WHERE rank = {r}) AS gp_{r}_{m}' for r, m in _WIDE)}
FROM near JOIN results USING (id) JOIN supplier ON s_suppkey = id GROUP BY 1, 2""")
def knn_wide(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("gp_name"))
    joined = rounded(
        _near_suppliers(spark, sf).join(_results(spark, sf), "id").join(names, "id"), "quantity", "distance"
    )
    return knn.to_rank_wide(
        joined, ["area_code", "year"], "gp", ["quantity", "distance", "gp_name"], rename={"quantity": "satisfaction"}
    )


@query("knn_wide_to_long", f"""WITH {_nearest_sql(_PARTS_SQL)}
SELECT area_code, rank, id, round(distance, 6) AS distance FROM near""")
def knn_wide_to_long(spark, sf):
    wide = knn.to_rank_wide(knn_three_nearest(spark, sf), ["area_code"], "school", ["id", "distance"])
    return knn.to_rank_long(wide, ["area_code"], "school", ["id", "distance"])


def _listing_sql(test: str) -> str:
    return f"""WITH {_nearest_sql(_PARTS_SQL)}
SELECT p_name AS name, p_partkey AS id, p_retailprice AS price, p_type AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part
  WHERE p_partkey IN (SELECT id FROM near JOIN customer ON c_custkey = area_code WHERE c_nationkey = 4) AND {test})
WHERE rn = 1"""


def _listing(spark, sf, only):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("kind"),
    )
    inside = table(spark, sf, "customer").where("c_nationkey = 4").select(F.col("c_custkey").alias("area_code"))
    asked = _area_points(spark, sf).join(inside, "area_code", "left_semi")
    places = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *place("p_partkey"))
    near = knn.knn_join(asked, places, 3).select("id").join(parts, "id")
    return knn.nearby_entities(near, "name", "id", "price", ["price"], "kind", only, special="PROMO")


@query("nearby_special_entities", _listing_sql("upper(trim(p_type)) = 'PROMO'"))
def nearby_special_entities(spark, sf):
    return _listing(spark, sf, "special")


@query("nearby_other_entities", _listing_sql("upper(trim(p_type)) <> 'PROMO'"))
def nearby_other_entities(spark, sf):
    return _listing(spark, sf, "other")


@query("nearest_and_new_entities", f"""WITH {_nearest_sql(_SUPPLIERS_SQL)},
listed AS (SELECT DISTINCT s_name AS name FROM near JOIN customer ON c_custkey = area_code JOIN supplier ON s_suppkey = id
           WHERE c_nationkey = 4),
around AS (SELECT s_name AS name FROM supplier WHERE s_nationkey IN (3, 4, 5))
SELECT name FROM listed UNION SELECT name FROM around""")
def nearest_and_new_entities(spark, sf):
    supplier = table(spark, sf, "supplier")
    names = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    inside = table(spark, sf, "customer").where("c_nationkey = 4").select(F.col("c_custkey").alias("area_code"))
    listed = _near_suppliers(spark, sf, inside).join(names, "id").select("name")
    around = supplier.where(F.col("s_nationkey").isin(3, 4, 5)).select(F.col("s_name").alias("name"))
    return listed.unionByName(around).dropDuplicates(["name"]).orderBy("name")
