"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Unigrams come with their stems, so that inflected forms teach each other.  A bounded, documented
sample of labelled rows is streamed through one online learner with per-coordinate learning
rates and L1 sparsity.  A first pass counts the rows of every feature: a feature of ``c`` rows is
updated ``c * epochs`` times by less than 1 each, so below ``l1`` such updates its weight is
exactly zero and it needs no state.  What is left are some (key, weight) pairs; up to
``HELD_WEIGHTS`` of them go to every task and scoring is a map without a shuffle, beyond that the
features of the rows are joined with them.  Both give the same scores to the last digit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pinned

#: Weights that tasks hold at most (16 bytes each); a larger model is joined.
HELD_WEIGHTS = 1 << 20
#: Weights are multiples of this, so that sums do not depend on their order.
UNIT = 2.0 ** -32
#: Counters of the first pass, as a power of two.
COUNTER_BITS = 26
#: Bytes of a word that tell its stem.
STEM = 6
#: Bytes to words: A-Z to lower case, other ASCII but letters and digits to spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def feature_keys(text: str | None) -> np.ndarray:
    """64-bit keys of all words, word pairs and pairs with one word between, and of the stems
    (first ``STEM`` bytes) of longer words; repeats stay."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    one = h * _ODD
    mixed = h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    two = (mixed[:-1] * np.uint64(3) + h[1:]) * _ODD
    skip = (mixed[:-2] * np.uint64(5) + h[2:]) * _ODD
    stems = [zlib.crc32(w[:STEM], 1) for w in words if len(w) > STEM]
    stem = (np.array(stems, dtype=np.uint64) ^ np.uint64(1 << 40)) * _ODD
    return np.concatenate([one, two, skip, stem])


class Slots:
    """Numbers of 64-bit keys, from 0 on in the order they come: open addressing that doubles."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.numbers = np.full(1 << bits, -1, dtype=np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of distinct ``keys``; new ones are entered."""
        while 2 * (self.size + len(keys)) > len(self.keys):
            full = self.numbers >= 0
            keys_now, numbers = self.keys[full], self.numbers[full]
            self.__init__(self.bits + 1)
            self._enter(keys_now, numbers)
        return self._enter(keys)

    def _enter(self, keys: np.ndarray, numbers: np.ndarray | None = None) -> np.ndarray:
        """Numbers of ``keys``; new ones get those of ``numbers``, or the next."""
        last = len(self.keys) - 1
        out = np.full(len(keys), -1, dtype=np.int32)
        at = ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            spot = at[todo]
            held = self.numbers[spot] >= 0
            hit = held & (self.keys[spot] == keys[todo])
            out[todo[hit]] = self.numbers[spot[hit]]
            # of the keys that want one free place the first gets it, the others look on
            free = np.flatnonzero(~held)
            _, first = np.unique(spot[free], return_index=True)
            mine = free[first]
            self.keys[spot[mine]] = keys[todo[mine]]
            new = self.size + np.arange(len(mine), dtype=np.int32) if numbers is None else numbers[todo[mine]]
            self.numbers[spot[mine]] = out[todo[mine]] = new
            self.size += len(mine)
            todo = todo[out[todo] < 0]
            # a place taken by an equal key is never passed: keys are distinct
            at[todo] = np.where(self.numbers[at[todo]] >= 0, (at[todo] + 1) & last, at[todo])
        return out


class Ftrl:
    """FTRL-proximal over binary features, a coordinate per key."""

    def __init__(self, base_rate: float, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.offset = float(np.log(base_rate / (1 - base_rate)))
        self.slots = Slots()
        self.z = np.zeros(1 << 10)
        self.n = np.zeros(1 << 10)

    def _weights(self, z, n):
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0, w)

    def learn(self, keys: np.ndarray, label: int) -> None:
        """One step over the distinct keys of a row."""
        slot = self.slots.of(keys)
        if self.slots.size > len(self.z):
            more = np.zeros(self.slots.size * 2 - len(self.z))
            self.z, self.n = np.concatenate([self.z, more]), np.concatenate([self.n, more])
        z, n = self.z[slot], self.n[slot]
        w = self._weights(z, n)
        g = 1 / (1 + np.exp(-np.clip(self.offset + w.sum(), -35, 35))) - label
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[slot] = z + g - sigma * w
        self.n[slot] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys with a weight, and their weights in units."""
        at = np.flatnonzero(self.slots.numbers >= 0)
        slot = self.slots.numbers[at]
        w = np.rint(self._weights(self.z[slot], self.n[slot]) / UNIT).astype(np.int64)
        return self.slots.keys[at][w != 0], w[w != 0]


class Learner:
    """One pass that counts the rows of the features, then ``epochs`` passes of FTRL over those that
    can get a weight.  Counters are shared by colliding features: they only err upwards."""

    def __init__(self, base_rate: float, epochs: int, alpha: float, beta: float, l1: float, l2: float):
        self.model = Ftrl(base_rate, alpha, beta, l1, l2)
        self.least = l1 / epochs
        self.rows = np.zeros(1 << COUNTER_BITS, dtype=np.uint8)

    def see(self, epoch: int, keys: np.ndarray, label: int) -> None:
        keys = np.unique(keys)
        at = (keys >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
        if epoch == 0:
            at = np.unique(at)
            self.rows[at] += self.rows[at] < 255
        else:
            self.model.learn(keys[self.rows[at] > min(self.least, 254)], label)


@dataclass
class ToxicityModel:
    table: DataFrame  # (key, weight), weights in units
    held: tuple[np.ndarray, np.ndarray] | None  # the same by ascending key, unless it is too large
    offset: float

    def rate(self, total: np.ndarray) -> np.ndarray:
        """Probabilities for sums of weights in units."""
        return 1 / (1 + np.exp(-np.clip(self.offset + total * UNIT, -35, 35)))

    def total(self):
        """A function text -> sum of weights in units, for tasks that hold the model."""
        keys, weights = self.held
        near = np.zeros(1 << 20, dtype=bool)
        near[(keys >> np.uint64(44)).astype(np.int64)] = True

        def total(text: str | None) -> int:
            k = feature_keys(text)
            k = np.unique(k[near[(k >> np.uint64(44)).astype(np.int64)]])
            if not len(k) or not len(keys):
                return 0
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return int(weights[at][keys[at] == k].sum())

        return total


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, epochs: int = 2, alpha: float = 3.0,
          beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> ToxicityModel:
    """Learn from ``sample_docs`` labelled texts (all, if fewer), those with the smallest hashes of
    id and text, ``epochs`` times over.

    Labels that are null are left out; an id labelled twice counts as its largest label; an id
    held by several rows teaches with each of its texts once.  Without labels the score is a
    constant 1/20."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
             .withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(sample_docs))
    # at most sample_docs rows of 20 bytes: a bounded broadcast, as is the next
    known = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_p")).join(F.broadcast(marks), "_id").distinct()
    sample = pinned(known.orderBy("_h", "_id", "_p").limit(sample_docs))
    rows = (docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_p"), text.alias("_t"))
            .join(F.broadcast(sample), ["_id", "_p"]).dropDuplicates(["_id", "_p"])
            .repartition(1).withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs))))
            .sortWithinPartitions("_epoch", "_h", "_id", "_p"))
    n, pos = sample.agg(F.count("_y"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    base = (pos + 0.5) / (n + 10)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(base, epochs, alpha, beta, l1, l2)
        for b in batches:
            for text, y, epoch in zip(b.column(0), b.column(1), b.column(2)):
                learner.see(epoch.as_py(), feature_keys(text.as_py()), y.as_py())
        keys, w = learner.model.sparse()
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)].view(np.int64)), pa.array(w[at:at + (1 << 16)])],
                                             ["key", "weight"])

    table = pinned(rows.select("_t", "_y", "_epoch").mapInArrow(learn, "key long, weight long"))
    held = None
    if table.count() <= HELD_WEIGHTS:
        got = table.toArrow()  # HELD_WEIGHTS rows at most
        keys = got["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        held = keys[order], got["weight"].to_numpy()[order]
    return ToxicityModel(table, held, float(np.log(base / (1 - base))))


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of every whole text (null: as empty)."""
    return joined_score(df, model, text_col, out) if model.held is None else held_score(df, model, text_col, out)


def held_score(df: DataFrame, model: ToxicityModel, text_col: str, out: str) -> DataFrame:
    slim = ToxicityModel(None, model.held, model.offset)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total = slim.total()
        for texts in batches:
            yield pd.Series(slim.rate(np.array([total(t) for t in texts], dtype=np.int64)), dtype="float64")

    return df.withColumn(out, toxic(F.col(text_col)))


def joined_score(df: DataFrame, model: ToxicityModel, text_col: str, out: str) -> DataFrame:
    """The same by a join: no task holds the model."""
    rows = pinned(df.select(F.struct("*").alias("_all"), F.col(text_col).cast("string").alias("_text"))
                  .withColumn("_row", F.monotonically_increasing_id()))
    slim = ToxicityModel(None, None, model.offset)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                k = np.unique(feature_keys(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row)), pa.array(k.view(np.int64))], ["_row", "key"])

    @F.pandas_udf("double")
    def rate(totals: pd.Series) -> pd.Series:
        return pd.Series(slim.rate(totals.to_numpy(dtype=np.int64)))

    sums = (rows.select("_row", "_text").mapInArrow(keys_of, "_row long, key long").join(model.table, "key")
            .groupBy("_row").agg(F.sum("weight").alias("_sum")))
    told = rows.join(sums, "_row", "left").withColumn("_score", rate(F.coalesce("_sum", F.lit(0).cast("long"))))
    keep = [F.col("_all").getField(c).alias(c) for c in df.columns if c != out]
    return told.select(*keep, F.col("_score").alias(out))


def held_out(doc_id: Column) -> Column:
    """Rows that must not teach: crc32 of the id as text, modulo 4, is 2 (null id: not)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
