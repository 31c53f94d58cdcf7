"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once as a table under ``spark.checkpoint.dir`` and read back.  Cuts the
    lineage on shared storage, so a lost executor costs no earlier stage, and fixes values
    that depend on the physical layout (partition ids).  ``session.release_materialized``
    deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words (null: 0).  A word starts where a word character follows white space
    or the beginning, so one zero-width-free pass over the text is enough."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """60 seeded bits of an MD5 as a non-negative long: the same in every engine with MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
