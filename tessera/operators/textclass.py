"""ML-15 text form: classes of texts from their words, by multinomial naive Bayes over TF-IDF.

Everything is a table: terms of a text, document frequencies, and one log-likelihood per (class,
term) that occurs; no dense vector and no vocabulary leave Spark.  A text's score for a class is
its prior, plus what all its known terms would cost the class if it had never seen them, plus
the gain of those it has seen, so only occurring pairs are joined.  Terms that many texts hold
are broadcast (``joins.skew_parts``), so no term is one task's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import HOT_SHARE, skew_parts
from tessera.session import materialize

#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"
#: Classes at most; their priors come to the driver.
MAX_CLASSES = 1000


def terms(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, term, tf) and columns ``more`` of the lower-cased words of every whole text, or of an array of
    texts.  Words are counted within their row, so nothing is shuffled; rows of one id stay apart."""
    texts = F.col(text_col) if df.schema[text_col].dataType.typeName() == "array" else F.array(text_col)
    words = F.flatten(F.transform(texts, lambda t: F.coalesce(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))))
    d = df.select(F.col(id_col).alias("id"), *more, F.sort_array(words).alias("_words"))
    # where each term begins among the sorted words
    first = F.transform("_words", lambda w, i: F.when((i == 0) | (w != F.get("_words", i - 1)), i))
    d = d.withColumn("_first", F.filter(first, lambda i: i.isNotNull()))
    counts = F.transform("_first", lambda at, k: F.struct(F.get("_words", at).alias("term"), (
        F.coalesce(F.get("_first", k + 1), F.size("_words")) - at).cast("long").alias("tf")))
    return d.select("id", *more, F.inline(counts))


@dataclass
class TextModel:
    """``vocabulary`` (term, df, idf), ``gains`` (term, df, of: array of (class, gain)) and, per class, its
    prior and the log-likelihood of a term it has not seen."""

    vocabulary: DataFrame
    gains: DataFrame
    classes: list[tuple]
    label: str


def fit_text(df: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0) -> TextModel:
    """Learn from the rows of ``df`` with a label and a text; ids are unique.

    idf = ln((1 + N) / (1 + df)) + 1 over the N rows; a class gives a term the share of its
    weight ``tf * idf`` in the class, smoothed by ``alpha``.  More than ``MAX_CLASSES`` labels
    raise; without rows there are no classes and every text's class is null."""
    known = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    labels = known.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    counts = labels.groupBy("label").count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    n = sum(r["count"] for r in counts)
    # one shuffle of the texts; rows that share an id are one text, with the labels of all
    held = (known.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
            .agg(F.collect_list(text_col).alias("texts"), F.collect_list(label_col).alias("labels")))
    tf = terms(held, "id", "texts", "labels").select("term", "tf", F.explode("labels").alias("label"))
    # partial sums per (class, term) first: no term's rows meet before they are summed
    pairs = tf.groupBy("label", "term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    of = pairs.groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("label", "tf")).alias("of"))
    idf = F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1
    table = materialize(of.withColumn("idf", idf), pin=True)
    size = table.count()
    weights = {r["label"]: r["w"] for r in table.select("idf", F.explode("of").alias("o")).groupBy("o.label").agg(
        F.sum(F.col("o.tf") * F.col("idf")).alias("w")).collect()}  # a row per class
    classes = []
    for r in sorted(counts, key=lambda r: str(r["label"])):
        total = weights.get(r["label"], 0.0) + alpha * size
        classes.append((r["label"], math.log(r["count"] / n), math.log(alpha / total) if size else 0.0))
    gain = F.transform("of", lambda o: F.struct(o["label"].alias("label"),
                                                F.log((o["tf"] * F.col("idf") + alpha) / F.lit(alpha)).alias("gain")))
    return TextModel(table.select("term", "df", "idf"), table.select("term", "df", "idf", gain.alias("of")), classes, label_col)


def _sums(each: DataFrame, name: str) -> DataFrame:
    """(id, ``name``_w, ``name``_gains) of rows (id, tf, idf, _labels, _gains): the weight of the terms of
    a text, and a map of the gains by class."""
    w = F.col("tf") * F.col("idf")
    # the weight goes with the gains, under the null class
    of = F.concat(F.array(F.struct(F.get("_labels", F.lit(-1)).alias("label"), w.alias("g"))),
                  F.zip_with("_labels", "_gains", lambda x, g: F.struct(x.alias("label"), (w * g).alias("g"))))
    sums = each.select("id", F.inline(of)).groupBy("id", "label").agg(F.sum("g").alias("g"))
    return sums.groupBy("id").agg(
        F.max(F.when(F.col("label").isNull(), F.col("g"))).alias(f"{name}_w"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "g")))).alias(f"{name}_gains"))


def classify_text(df: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """(id, predicted, score) of every row of ``df``, whose ids are unique: the class of the largest
    log-posterior, rounded to ``digits`` (ties: the least class).

    A null text, or one without a known term, gets the class of the largest prior; repeated terms
    count by their number; an empty table gives no rows."""
    found = materialize(terms(df.filter(F.col(id_col).isNotNull()), id_col, text_col), pin=True)
    held = found.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    packed = model.gains.select("term", "idf", F.col("of.label").alias("_labels"), F.col("of.gain").alias("_gains"))
    table = materialize(packed.join(held, "term"), pin=True)
    # the more classes, the longer a term's row: 200,000 terms at most for ten, 10,000 from 200 on
    share = HOT_SHARE * min(1.0, max(10, len(model.classes)) / 200)
    hot, rest = skew_parts(found, table, ["term"], "_n", found.count(), share=share)
    # a text's rows of the broadcast terms lie together and are summed where they are; the others
    # go back to their text one row a term, and only there become one a class
    every = df.select(F.col(id_col).alias("id"))
    for part, each in (("hot", hot), ("rest", rest.select("id", "tf", "idf", "_labels", "_gains").repartition("id"))):
        every = every.join(_sums(each, part), "id", "left")
    if not model.classes:
        return every.select("id", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("score"))
    # base 10**digits integers: the order of the sums does not show
    unit = F.lit(10.0 ** digits)
    none = F.lit(0.0)
    weight = F.coalesce("hot_w", none) + F.coalesce("rest_w", none)
    seen = lambda label: F.coalesce(F.col("hot_gains")[F.lit(label)], none) + F.coalesce(F.col("rest_gains")[F.lit(label)], none)
    scores = [F.struct(F.round((F.lit(prior) + F.lit(unseen) * weight + seen(label)) * unit).alias("s"),
                       F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, (label, prior, unseen) in enumerate(model.classes)]
    best = F.array_max(F.array(*scores))
    return every.select("id", best["label"].alias("predicted"), (best["s"] / unit).alias("score"))
