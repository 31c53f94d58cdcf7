"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target: its share of the budget by weight, at most ``max_epochs`` times its
own size, the excess going to the others.  A source is taken whole as often as fits; the rest
of its target is met by the documents whose hash lies under a threshold.  Thresholds come from
histograms of size by (source, hash bucket): the first pass finds the bucket in which the
running sum passes the target, later passes look only at that boundary bucket, at finer
buckets of the hash.  Documents are then filtered; they are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pinned, unit_hash, word_count

#: Bits of the document hash, and bits that each pass of the refinement resolves.
HASH_BITS = 60
STEP_BITS = 12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.0,
                   max_epochs: int = 3) -> DataFrame:
    """``target`` (double) for each row of ``sizes`` (source, source_size; one row a source).

    Weights repeat over the sources in code point order, null last.  With water level x a
    source gets ``min(max_epochs * size, x * weight)``; x is found from the running sums over
    the sources ordered by the level at which they are full."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    s = sizes.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_full", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy(F.lit(0))
    fill = Window.orderBy("_full", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double") * F.lit(float(budget))
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)))
                     / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0))))
    # the level holds from the first source that it does not fill
    level = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(every)
    return s.select("source", "source_size", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"))


def _key(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(_k, _below): per source the hash bound under which its documents sum nearest to
    ``_left`` (documents of equal hash stay together).

    ``docs``: _k, size, _hash; ``budgets``: _k, _left.  A pass adds up at most
    ``2**STEP_BITS`` buckets a source and leaves one boundary bucket; the next pass reads only
    its documents.  Passes end when every boundary bucket holds a single hash."""
    live = docs.filter("size > 0")
    edge = budgets.select("_k", F.col("_left").cast("double").alias("_left"))
    for done in range(0, HASH_BITS, STEP_BITS):
        width = HASH_BITS - done - STEP_BITS
        hist = (live.groupBy("_k", F.shiftright("_hash", width).alias("_b"))
                .agg(F.sum("size").alias("_s"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi")))
        upto = F.sum("_s").over(Window.partitionBy("_k").orderBy("_b"))
        over = (hist.withColumn("_upto", upto).join(edge.select("_k", "_left"), "_k").filter("_upto > _left")
                .groupBy("_k").agg(F.min_by(F.struct("_b", "_s", "_lo", "_hi", (F.col("_upto") - F.col("_s")).alias("_before")),
                                            "_b").alias("c")))
        edge = pinned(edge.select("_k", "_left").join(over, "_k", "left").select(
            "_k", (F.col("_left") - F.coalesce("c._before", F.lit(0))).alias("_left"), F.col("c._b").alias("_b"),
            F.col("c._s").alias("_s"), F.col("c._lo").alias("_lo"), F.col("c._hi").alias("_hi")))
        if edge.filter("_lo < _hi").isEmpty():
            break
        here = edge.filter("_b IS NOT NULL").select("_k", F.col("_b").alias("_at"))
        live = live.join(here, "_k").filter(F.shiftright("_hash", width) == F.col("_at")).drop("_at")
    # the boundary hash is in if that brings the sum nearer; no boundary: everything fits
    return edge.select("_k", F.when(F.col("_b").isNull(), F.lit(1 << HASH_BITS))
                       .when(F.col("_s") < 2 * F.col("_left"), F.col("_hi") + 1).otherwise(F.col("_lo")).alias("_below"))


def mix(df: DataFrame, keep: list[str], weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.0, max_epochs: int = 3,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The ``keep`` columns of every row with ``size`` (words; null text: 0), ``source_size``,
    ``target`` and ``taken`` (words that the mix takes: the size times the whole epochs of its
    source, once more if its hash lies under the source's threshold).

    The hash is over id and text: rows equal in both are taken alike.  Null sources are one
    source, last; sources without words get a target of 0; an empty table gives no rows.
    ``keep`` columns named like the results are replaced."""
    keep = [c for c in keep if c not in ("size", "source_size", "target", "taken")]
    docs = pinned(df.select(
        *[F.col(c) for c in keep], F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"),
        unit_hash(F.col(id_col), F.col(text_col), seed=seed).alias("_hash")).withColumn("_k", _key(F.col("_source"))))
    sizes = docs.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = pinned(source_targets(sizes, weights, budget, max_epochs)
                  .withColumn("_k", _key(F.col("source"))).withColumn("_epochs", epochs.cast("long"))
                  .withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")))
    bounds = plan.join(thresholds(docs, plan), "_k").select("_k", "source_size", "target", "_epochs", "_below")
    once = (F.col("_hash") < F.col("_below")).cast("long")
    return (docs.join(pinned(bounds), "_k").withColumn("taken", F.col("size") * (F.col("_epochs") + once))
            .select(*keep, "size", "source_size", "target", "taken"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """``df``, each row as often as ``mix`` takes its words (rows that it leaves out go)."""
    names = [options.pop(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))]
    rows = df.select(F.struct("*").alias("row"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(names)])
    mixed = mix(rows, ["row"], id_col="_0", text_col="_1", source_col="_2", **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    once = mixed.withColumn("_times", times).filter("_times > 0")
    return once.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("row.*")
