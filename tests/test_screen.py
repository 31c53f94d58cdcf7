"""Skew-safe ranking against Spark's own window function on a literal fixture."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.screen import percentiles


def test_percent_rank_across_partitions_matches_window(spark):
    random.seed(4)
    rows = []
    for i in range(3000):
        peer = "hot" if i % 10 < 8 else random.choice(["a", "b", None])
        v = None if i % 97 == 0 else float(random.randint(0, 400))  # many ties
        rows.append((i, peer, v))
    rows.append((5000, "solo", 1.0))
    df = spark.createDataFrame(rows, "id long, peer string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.id: r.v_pctl for r in percentiles(df, ["v"], "peer").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {r.id: r.p for r in df.select("id", F.percent_rank().over(
        Window.partitionBy("peer").orderBy("v")).alias("p")).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
