"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two
shuffles each bucket by Fisher-Yates.  The buckets in order are one random permutation of the
table, dealt to the shards in turn, so that shard sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pinned

#: Buckets at least, so that small tables also spread over the executors.
LEAST_BUCKETS = 256
#: What a row takes in a bucket besides its size.
ROW_BYTES = 256


def shuffled(df: DataFrame, key: list[str], size_col: str, seed: int = 17, bucket_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with ``position`` (long, gapless from 0): its place in a seeded random order.

    The bucket of a record is a hash of its ``key`` columns and the number of its copy among
    equal keys of the input order, so a key held by a third of all rows spreads as well.  A
    bucket holds about ``bucket_bytes`` of ``size_col`` (nulls count 0) and ``ROW_BYTES`` a row, so
    rows without text do not swell it.  Rows with equal texts are dealt like any others: their
    keys scatter them.  Other columns are
    carried along (an input column called ``position`` is replaced); an empty table gives no
    rows.  The order depends only on the keys, the seed
    and the total size, except among rows with equal keys."""
    base = pinned(df.drop("position")
                  .withColumn("_shuf_h", F.xxhash64(F.lit(seed), *[F.col(k) for k in key]))
                  .withColumn("_shuf_copy", F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id())))
    total, rows = base.agg(F.sum(size_col), F.count(F.lit(1))).first()
    n = max(LEAST_BUCKETS, -(-((total or 0) + rows * ROW_BYTES) // bucket_bytes))
    # equal keys share a bucket, unless they are so many that they would fill it
    heavy = (base.groupBy("_shuf_h").count().filter(F.col("count") > max(1000, rows // n))
             .select("_shuf_h", F.lit(True).alias("_shuf_heavy")))
    mixed = F.when(F.col("_shuf_heavy"), F.xxhash64("_shuf_h", "_shuf_copy")).otherwise(F.xxhash64("_shuf_h"))
    scattered = (base.join(heavy, "_shuf_h", "left")
                 .withColumn("_shuf_bucket", F.pmod(mixed, F.lit(n)).cast("int")).drop("_shuf_heavy"))

    def fisher_yates(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf.assign(position=pd.Series(dtype="int64"))
        bucket = int(pdf["_shuf_bucket"].iloc[0])
        pdf = pdf.sort_values(["_shuf_h", "_shuf_copy"], kind="stable")
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(pdf))
        return pdf.iloc[order].assign(position=np.arange(len(pdf), dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema) + ", position long"
    inner = scattered.groupBy("_shuf_bucket").applyInPandas(fisher_yates, schema)
    counts = scattered.groupBy("_shuf_bucket").count()
    before = F.sum("count").over(Window.orderBy("_shuf_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_shuf_bucket", F.coalesce(before, F.lit(0)).alias("_shuf_first"))  # one row a bucket
    return (inner.join(offsets, "_shuf_bucket")
            .withColumn("position", F.col("position") + F.col("_shuf_first"))
            .drop("_shuf_h", "_shuf_copy", "_shuf_bucket", "_shuf_first"))


def assign_shards(df: DataFrame, key: list[str], size_col: str, shards: int = 24, seed: int = 17) -> DataFrame:
    """``shuffled`` rows dealt to ``shards`` shards in turn: ``shard`` int, ``slot`` long
    (gapless from 0 in each shard); shard sizes differ by one row at most."""
    out = shuffled(df.drop("shard", "slot"), key, size_col, seed)
    return (out.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
            .withColumn("slot", F.floor(F.col("position") / shards).cast("long")).drop("position"))


def write_shards(assigned: DataFrame, path: str, size_col: str, file_bytes: int = 256 << 20) -> None:
    """Write assigned rows, one folder a shard, in files of about ``file_bytes`` of ``size_col``: each
    file holds a run of slots in order, and the files of a shard follow each other by name.

    Rows are range-partitioned by (shard, slot), so a shard is written by as many tasks as it has
    files and no task holds more than about one file."""
    total, rows = assigned.agg(F.sum(size_col), F.count(F.lit(1))).first()
    files = max(1, -(-((total or 0) + rows * ROW_BYTES) // file_bytes))
    (assigned.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
