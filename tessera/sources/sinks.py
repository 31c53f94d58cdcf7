"""Sinks (SNK-01..04).  Writes are idempotent (overwrite, or append of a batch id that
is checked first), so a task or job retried after an executor loss does not duplicate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize
from tessera.sources.readers import path_exists


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-01 overwrite; CSV with a header, no index."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_by_ticker(df: DataFrame, path: str, key: str = "tic", order=("date",), fmt: str = "parquet") -> None:
    """SNK-02 one folder per ticker (``partitionBy``) with dynamic partition overwrite:
    only the tickers present in ``df`` are replaced.

    Rows are range-partitioned on (key, order): each task writes one or two tickers'
    contiguous date ranges, and a hot ticker is cut into as many tasks as its size needs
    (hash-partitioning on the key alone would give it one writer task)."""
    cols = [key] + [c for c in order if c in df.columns]
    (df.repartitionByRange(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).format(fmt).save(path))


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-03 append, creating the table if missing (CSV: each part file carries its own
    header; read back with header=True)."""
    w = df.write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def checkpoint_batches(df: DataFrame, path: str, batch_col: str, fmt: str = "parquet") -> None:
    """SNK-04 progress saving during long scoring: rows are written per batch value into
    ``batch_col`` partitions with dynamic overwrite, so a re-run replaces a half-written
    batch instead of appending it twice."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch_col).format(fmt).save(path))


def with_batch_id(df: DataFrame, n_batches: int, key: str, out: str = "batch") -> DataFrame:
    """Deterministic batch number from a key hash (stable across retries)."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.col(key)), F.lit(n_batches)))


def latest_versions(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """One row per ``key``: that of the largest ``version`` (null: the oldest; ties: the largest row).
    Versions are combined before the shuffle, so a key with many of them is not one task's."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("_v"), F.struct(*rest).alias("_r"))).alias("_m"))
    return g.select(*key, "_m._r.*").select(*df.columns)


def upsert(df: DataFrame, path: str, key: Sequence[str], version: str, partition: str) -> None:
    """SNK-02 / SNK-04 incremental merge into a table partitioned by ``partition``: of every ``key``
    the row of the largest ``version`` stays, wherever it was.

    Copy on write: the partitions to touch are those of the incoming rows and those where their
    keys live now (a scan of two columns); only they are read whole, merged and replaced
    (dynamic overwrite), and one that is left empty is removed.  Stale versions change nothing and
    a replayed batch, or one cut short and run again, gives the same table.  Rows with a null key
    are one key; the table is created if it is missing."""
    spark, key = df.sparkSession, list(key)
    new = materialize(latest_versions(df, key, version), pin=True)
    if not path_exists(spark, path):
        _replace(new, path, partition)
        return
    old = spark.read.schema(new.schema).parquet(path)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    ids = new.select(*[F.col(k).alias(f"_{k}") for k in key])
    home = old.select(*key, partition).join(ids, same, "left_semi").select(partition)
    touched = materialize(home.unionByName(new.select(partition)).distinct(), pin=True).withColumnRenamed(partition, "_p")
    here = old.join(touched, F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
    merged = materialize(latest_versions(here.unionByName(new), key, version), pin=True)
    _replace(merged, path, partition)
    left = merged.select(partition).distinct()
    gone = touched.join(left, F.col(partition).eqNullSafe(F.col("_p")), "left_anti")
    _drop_partitions(gone, path, partition)


def _replace(df: DataFrame, path: str, partition: str) -> None:
    (df.repartitionByRange(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def _drop_partitions(gone: DataFrame, path: str, partition: str) -> None:
    """Remove the folders of the partitions ``_p`` of ``gone`` (those that lost their last row)."""
    spark = gone.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in gone.select(F.col("_p").cast("string").alias("p")).toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if r["p"] is None else r["p"]
        folder = fs_path(path, f"{partition}={name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
