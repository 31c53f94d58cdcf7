"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule accepts or rejects teach two smoothed variable-order Markov models.  The
counts of all their grams, under the grams themselves, are a Spark table that grows with the
input; a URL that no rule covers is judged by the length-normalised difference of
log-likelihoods against a threshold calibrated on held-out rule-covered URLs.  What one byte
adds to the difference depends on the last ``ORDER`` bytes alone: tasks hold the table while it
is small, and join the distinct windows of the URLs with it beyond that; terms are fixed-point,
so both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pinned

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Longest gram; its bytes and its length are packed into one long.
ORDER = 6
VERDICTS = ("allow", "block")
#: Rows of the count table that tasks hold (24 bytes each); a larger one is joined.
HELD_GRAMS = 1 << 20
#: Distinct grams that a task adds up before it passes them on, texts worked on at a time.
TASK_GRAMS, TEXTS = 1 << 20, 512
#: Fixed point of the terms: 32 bits after the point.
UNIT = float(1 << 32)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def gram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the grams of 1 to ``ORDER`` bytes that end at each byte, one row a length: the
    bytes, and the length above them.  The position of each text's first own byte; the lengths.
    Every text starts after ``ORDER`` start marks and ends with an end mark."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"".join(b"\x02" * ORDER + r + b"\x03" for r in raw), dtype=np.uint8).astype(np.int64)
    n = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    first = np.cumsum(n + ORDER) - n
    window = np.zeros_like(buf)
    for k in range(ORDER):
        window[k:] |= buf[:len(buf) - k] << (8 * k)
    return np.stack([gram(window, k + 1) for k in range(ORDER)]), first, n


def gram(window: np.ndarray, length: int) -> np.ndarray:
    """Key of the last ``length`` bytes of each window."""
    return (window & ((1 << 8 * length) - 1)) | (length << 8 * ORDER)


def needed(windows: np.ndarray) -> np.ndarray:
    """Keys whose counts give the terms of the windows: grams of 1 to ``ORDER`` bytes, then their
    contexts of 1 to ``ORDER`` - 1 bytes; one row a window."""
    bare = windows & ((1 << 8 * ORDER) - 1)
    return np.stack([*[gram(bare, k) for k in range(1, ORDER + 1)], *[gram(bare >> 8, k) for k in range(1, ORDER)]], axis=1)


def _own(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of all own bytes, text after text."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    for at in range(0, len(texts), TEXTS):
        yield texts[at:at + TEXTS]


class UrlModel:
    """Table of counts (gram, allow, block), the numbers of all bytes by verdict, and the
    calibrated threshold.  ``held``: the table as sorted arrays, if it is small."""

    def __init__(self, table: DataFrame, totals: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None, mass: float):
        self.table, self.totals, self.held, self.mass, self.threshold = table, totals, held, mass, 0.0

    def scorer(self) -> Scorer:
        return Scorer(self.totals, self.held, self.mass)


class Scorer:
    """What tasks need of a model."""

    def __init__(self, totals: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None, mass: float):
        self.totals, self.held, self.mass = totals, held, mass

    def terms(self, counts: np.ndarray) -> np.ndarray:
        """Fixed-point log-likelihood of each window's last byte under allow minus that under
        block, from the counts (verdict, window, ``needed`` key)."""
        logs = []
        for c, total in zip(counts, self.totals):
            # the longest context seen decides most; shorter ones smooth it
            p = (c[:, 0] + self.mass / 256) / (total + self.mass)
            for k in range(1, ORDER):
                p = (c[:, k] + self.mass * p) / (c[:, ORDER + k - 1] + self.mass)
            logs.append(np.log(np.minimum(p, 1.0)))
        return np.rint((logs[0] - logs[1]) * UNIT).astype(np.int64)

    def held_terms(self, windows: np.ndarray) -> np.ndarray:
        grams, counts = self.held
        keys = needed(windows)
        if not len(grams):
            return self.terms(np.zeros((len(VERDICTS), *keys.shape)))
        at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        return self.terms(np.where(grams[at] == keys, counts[:, at], 0))

    def ratio(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood a byte under allow minus that under block."""
        slots, first, n = gram_slots(texts)
        windows, inverse = np.unique(slots[-1][_own(first, n)], return_inverse=True)
        return np.add.reduceat(self.held_terms(windows)[inverse], np.cumsum(n) - n) / UNIT / n


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, allow, block) of all rows of ``urls`` (text, verdict); gram 0 counts all bytes.
    Tasks add up their own counts first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, dtype=np.int64), np.zeros((len(VERDICTS), 0), dtype=np.int64)
        for b in batches:
            texts, verdicts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, v in enumerate(VERDICTS):
                for part in _chunks([t for t, w in zip(texts, verdicts) if w == v]):
                    slots, first, n = gram_slots(part)
                    # contexts may end in a start mark
                    new, times = np.unique(np.concatenate([slots[:, _own(first, n)].ravel(), slots[:-1, first - 1].ravel(),
                                                           np.zeros(n.sum(), dtype=np.int64)]), return_counts=True)
                    both, inverse = np.unique(np.concatenate([grams, new]), return_inverse=True)
                    total = np.zeros((len(VERDICTS), len(both)), dtype=np.int64)
                    total[:, inverse[:len(grams)]] = counts
                    total[i, inverse[len(grams):]] += times
                    grams, counts = both, total
                    if len(grams) > TASK_GRAMS:
                        yield rows_of(grams, counts)
                        grams, counts = grams[:0], counts[:, :0]
        yield rows_of(grams, counts)

    def rows_of(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams), *[pa.array(c) for c in counts]], ["gram", *VERDICTS])

    return (urls.select("text", "verdict").mapInArrow(count, "gram long, allow long, block long")
            .groupBy("gram").agg(*[F.sum(v).alias(v) for v in VERDICTS]))


def train(urls: DataFrame, mass: float = 1.0, bins: int = 400) -> UrlModel:
    """Models from all rows of ``urls`` (text, verdict, fold): fold 0 calibrates, the others
    are counted.  At most ``HELD_GRAMS`` count rows come back."""
    table = pinned(gram_counts(urls.filter("fold > 0")))
    n, *totals = table.agg(F.count(F.lit(1)), *[F.coalesce(F.max(F.when(F.col("gram") == 0, F.col(v))), F.lit(0)) for v in VERDICTS]).first()
    held = None
    if n <= HELD_GRAMS:
        rows = table.toArrow()  # HELD_GRAMS rows at most
        order = np.argsort(rows["gram"].to_numpy())
        held = rows["gram"].to_numpy()[order], np.stack([rows[v].to_numpy()[order] for v in VERDICTS])
    model = UrlModel(table, np.array(totals, dtype=np.int64), held, mass)
    # calibration: the cut that is best for both verdicts alike, from a histogram of the ratios
    grid = F.least(F.greatest(F.floor((F.col("ratio") + 4) * (bins / 8)), F.lit(0)), F.lit(bins - 1)).cast("int")
    hist = (with_ratio(urls.filter("fold = 0"), model).groupBy(grid.alias("bin"))
            .agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in VERDICTS]).collect())  # `bins` rows
    seen = np.zeros((2, bins))
    for r in hist:
        seen[:, r["bin"]] = r["allow"], r["block"]
    if seen.sum(axis=1).all():
        below = np.concatenate([np.zeros((2, 1)), np.cumsum(seen, axis=1)], axis=1) / seen.sum(axis=1)[:, None]
        gain = below[1] - below[0]
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float(best[len(best) // 2] / (bins / 8) - 4)
    return model


def with_ratio(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` with the ratio of each text, the same whether tasks hold the counts or not."""
    return urls.join(joined_ratios(urls, model), "text") if model.held is None else held_ratios(urls, model)


def held_ratios(urls: DataFrame, model: UrlModel) -> DataFrame:
    scorer = model.scorer()

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(np.concatenate([*[scorer.ratio(part) for part in _chunks(t.tolist())], np.zeros(0)]))

    return urls.withColumn("ratio", ratio("text"))


def joined_ratios(urls: DataFrame, model: UrlModel) -> DataFrame:
    """(text, ratio) of the distinct texts.  Their windows are joined with the terms of all
    distinct windows, which are joined with the count table; no task holds it."""
    texts = pinned(urls.select("text").distinct().withColumn("id", F.monotonically_increasing_id()))
    scorer = model.scorer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                slots, first, n = gram_slots(texts[at:at + TEXTS])
                # the text's number in the part goes above the 51 bits of the window
                found, times = np.unique(slots[-1][_own(first, n)] | (np.repeat(np.arange(len(n)), n) << 51), return_counts=True)
                who = found >> 51
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + who]), pa.array(found & ((1 << 51) - 1)), pa.array(times),
                                                  pa.array(n[who])], ["id", "window", "times", "n"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows = b.column(0).to_numpy()
            keys = needed(windows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(windows, keys.shape[1])), pa.array(np.tile(np.arange(keys.shape[1]), len(windows))),
                 pa.array(keys.ravel())], ["window", "at", "gram"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([np.array(b.column(i + 1).to_pylist(), dtype=np.int64).reshape(b.num_rows, -1)
                               for i in range(len(VERDICTS))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.terms(counts))], ["window", "term"])

    pieces = pinned(texts.select("id", "text").mapInArrow(cut, "id long, window long, times long, n long"))
    keys = pieces.select("window").distinct().mapInArrow(asked, "window long, at long, gram long")
    met = keys.join(model.table, "gram", "left").groupBy("window").agg(*[
        F.array(*[F.coalesce(F.max(F.when(F.col("at") == k, F.col(v))), F.lit(0)) for k in range(2 * ORDER - 1)]).alias(v)
        for v in VERDICTS])
    worth = met.mapInArrow(terms, "window long, term long")
    sums = pieces.join(worth, "window").groupBy("id").agg((F.sum(F.col("times") * F.col("term")) / F.lit(UNIT)
                                                           / F.first("n")).alias("ratio"))
    return texts.join(sums, "id").select("text", "ratio")


def judge(df: DataFrame, url_col: str = "url", rules=RULES, folds: int = 5) -> DataFrame:
    """``df`` with host, path, rule, verdict and ratio of every row.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and are judged
    by their own text; empty texts are allowed.  If the rules cover no url of one verdict there
    is nothing to tell them by: the rest gets the other verdict (allow, if neither).  Repeated
    rows are judged alike; columns named like the results are replaced; an empty table gives
    no rows."""
    host, path = parsed(F.col(url_col))
    kept = [F.col(c) for c in df.columns if c not in ("host", "path", "rule", "verdict", "ratio")]
    base = df.select(F.struct(*kept, F.lit(0).alias("_end")).alias("_row"), F.col(url_col).alias("_url"),
                     host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    text = F.when(F.col("host") != "", F.concat("host", "path")).otherwise(F.coalesce(F.col("_url"), F.lit("")))
    base = base.withColumn("rule", rule).withColumn("_ruled", verdict).withColumn("text", text)
    known = base.filter("_ruled IS NOT NULL").select("text", F.col("_ruled").alias("verdict"),
                                                     F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold"))
    model = train(known)
    both = model.totals > 0
    method = F.when((F.col("text") == "") | (F.col("ratio") >= model.threshold), "allow").otherwise("block")
    if not both.all():
        method = F.lit("block" if both[1] else "allow")
    out = with_ratio(base, model).withColumn("verdict", F.coalesce("_ruled", method))
    return out.select("_row.*", "host", "path", "rule", "verdict", "ratio").drop("_end")
