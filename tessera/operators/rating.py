"""Text rating and few-shot classification (ML-14, ML-15).

The reference asks a remote language model for a 1..10 rating per story.  Here the scorer
is an injected callable ``pd.Series[str] -> pd.Series[int | None]`` run with
``mapInPandas`` (one scorer instance per partition, Arrow batches); the default is a small
word-list scorer so everything runs offline.  Failures stay null, up to a stated share, and are picked up by the
next run (anti join on already-rated ids).
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import truncate_words
from tessera.operators.joins import unrated

# Our own default word lists for the offline scorer.
POSITIVE = {"gain", "gains", "growth", "beat", "beats", "record", "strong", "upgrade", "profit", "rise", "rises",
            "surge", "bullish", "outperform", "positive", "higher"}
NEGATIVE = {"loss", "losses", "miss", "misses", "weak", "downgrade", "decline", "falls", "fall", "drop", "bearish",
            "underperform", "negative", "lower", "lawsuit", "recall"}


def lexicon_scorer(texts: pd.Series) -> pd.Series:
    """Rating 1..10 from positive minus negative word counts; 5 when neutral."""
    def one(t):
        if t is None:
            return None
        w = [x.strip(".,;:!?\"'()").lower() for x in t.split()]
        p = sum(x in POSITIVE for x in w)
        n = sum(x in NEGATIVE for x in w)
        return int(max(1, min(10, 5 + p - n)))
    return texts.map(one).astype("Int64")


def rate_text(df: DataFrame, scorer: Callable[[pd.Series], pd.Series] = lexicon_scorer, text: str = "body",
              id_col: str = "doc_id", done: DataFrame | None = None, max_words: int | None = None,
              max_failures: float = 0.0) -> DataFrame:
    """ML-14 rate only the rows not in ``done`` (id_col, rating) by their whole text, cut to
    ``max_words`` words only if asked.  Output: id_col, rating (INT).

    A batch that the scorer refuses is scored row by row; rows that fail stay null and are
    retried by the next run (they are not in ``done``).  A task whose failed rows pass the
    share ``max_failures`` raises (by default any failure does): a run that left rows out is not a
    finished one."""
    todo = df if done is None else unrated(df, done, id_col)
    t = todo.select(id_col, (truncate_words(text, max_words) if max_words else F.col(text)).alias("_t"))

    def rate(texts):
        try:
            return list(pd.Series(scorer(texts), dtype="Int64")), 0, None
        except Exception as e:  # noqa: BLE001 - told apart row by row below
            if len(texts) == 1:
                return [None], 1, e
        out, failed, last = [], 0, None
        for i in range(len(texts)):
            r, f, e = rate(texts.iloc[i:i + 1].reset_index(drop=True))
            out, failed, last = out + r, failed + f, e or last
        return out, failed, last

    def run(batches):
        rows = failures = 0
        last = None
        for b in batches:
            r, failed, error = rate(b["_t"])
            rows, failures, last = rows + len(b), failures + failed, error or last
            yield pd.DataFrame({id_col: b[id_col], "rating": pd.Series(r, dtype="Int64").to_numpy()})
        if failures > max_failures * rows:
            raise RuntimeError(f"the scorer failed on {failures} of {rows} rows") from last

    return t.mapInPandas(run, f"{id_col} long, rating int")


def centroids(labelled: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Per-class mean vector (label, c array<double>): aggregated by (label, dimension) first,
    so what meets per class is one row a dimension."""
    e = labelled.select(label, F.posexplode(vec).alias("dim", "x"))
    means = e.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("c"))


def few_shot(queries: DataFrame, labelled: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
             label: str = "label") -> DataFrame:
    """ML-15 nearest labelled centroid by cosine similarity (ties to the smaller label).  The
    centroids are one scalar subquery (classes x dimensions, bounded by the classes); every
    vector is compared in place, without an explode, a join or a shuffle of the queries."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, p: t + p)

    classes = centroids(labelled, vec, label).agg(F.collect_list(F.struct(label, "c")).alias("cs"))
    q = queries.filter(F.size(vec) > 0).select(id_col, F.col(vec).alias("_v")).withColumn("_cs", classes.scalar())
    q = q.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)))
    one = F.transform("_cs", lambda k: F.struct((dot(F.col("_v"), k["c"]) / (F.col("_n") * F.sqrt(dot(k["c"], k["c"])))).alias("cos"),
                                               (-k[label]).alias("nl"), k[label].alias("label")))
    best = q.select(id_col, F.array_max(one).alias("b"))
    return best.select(id_col, F.col("b.label").alias("predicted"), F.col("b.cos").alias("similarity"))
