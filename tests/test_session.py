import pytest
from pyspark.sql import functions as F

from areaindex import session


def test_checkpoints_go_where_the_session_says(spark):
    wanted = spark.conf.get(session.CHECKPOINT_CONF)
    assert wanted in session.ensure_checkpoint_dir(spark)
    stored = session.checkpointed(spark.range(10).withColumn("v", F.rand(1)))
    assert stored.collect() == stored.collect()


@pytest.mark.parametrize("small_bytes,kind", [(10, "BroadcastHashJoin"), (session.BROADCAST_BYTES + 1, "SortMergeJoin")])
def test_measured_join(spark, small_bytes, kind):
    a, b = spark.range(50).withColumn("v", F.col("id")), spark.range(0, 50, 5).withColumn("w", F.col("id") * 2)
    joined = session.join_measured(a, b, ["id"], small_bytes)
    assert kind in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 10


def test_null_safe_join(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    assert sorted((r["v"], r["w"]) for r in session.join_null_safe(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]


def test_spread_leaves_large_tables(spark):
    df = spark.range(100).coalesce(1)
    assert session.spread(df, session.SMALL_ROWS + 1, "id") is df
    assert session.spread(df, 100, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
