"""The training-data pipeline over ``documents``: toxicity, near duplicates, personal data,
mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.mixing import mixed_rows
from tessera.llm.near_dedup import keep_one
from tessera.llm.packing_sos import pack_sum_of_squares
from tessera.llm.pii import personal_data, redacted
from tessera.llm.toxicity import score, train
from tessera.session import scratch_path

#: Rejected from this probability on.
TOXIC = 0.3
#: Rows of an Arrow batch: whole texts go to Python workers, and a batch is held on both sides.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of ``TOXIC`` or more go; null and empty texts stay."""
    _small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, out="_toxicity").filter(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 or more, the document of
    the smallest id stays; documents without words stay."""
    _small_batches(spark)
    return keep_one(docs, width=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and ``n_chars`` follows; all
    documents stay, null texts stay null."""
    found = personal_data(docs.select(F.struct("*").alias("row"), "text"))
    clean = found.select("row", "spans", redacted(F.col("text"), "spans").alias("text"))
    n = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n}
    return clean.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights (5, 2, 1 in turn): a document comes as often
    as the mix takes it, up to three times."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, with their ids."""
    _small_batches(spark)
    return pack_sum_of_squares(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("personal data", redact),
          ("mixing", mix_sources), ("packing", pack)]

#: The learner, the signatures and the tokenizer have no SQL; tests hold each stage against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
