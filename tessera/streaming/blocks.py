"""STM-04 on Spark's state store: last known value and EMA per ticker from blocks of time.

Two streams.  ``stream_blocks`` keeps the rows of every (ticker, block of event time) in the store
until an event-time timer closes the block, so rows that come late, in whatever order or
micro-batch, stand in their place and no ticker is one task's; a closed block leaves the store.
``stream_carries`` reads the one row that ends each closed block and keeps a ticker's scalars, with
a time to live.  ``block_ema`` puts both together natively.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
BLOCK_ROWS = "tic string, block long, ts timestamp, value double, i long, n long, last double, num double, den double"
CARRIES = "tic string, block long, last double, num double, den double"


class _Blocks(StatefulProcessor):
    """Rows of a (ticker, block) until its end has passed."""

    def __init__(self, decay: float, millis: int):
        self.decay, self.millis = decay, millis

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(t.to_pydatetime(), None if pd.isna(v) else float(v)) for pdf in rows for t, v in zip(pdf["ts"], pdf["value"])]
        self.rows.appendList(new)
        self.handle.registerTimer((int(key[1]) + 1) * self.millis)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(((r[0], r[1]) for r in self.rows.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        last, num, den, out = None, 0.0, 0.0, []
        for i, (ts, value) in enumerate(held):
            last = last if value is None else value
            num, den = self.decay * num + (value or 0.0), self.decay * den + (value is not None)
            out.append((key[0], int(key[1]), ts, value, i + 1, len(held), last, num, den))
        self.rows.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK_ROWS.split(", ")]).astype({"value": float, "last": float})

    def close(self) -> None:
        pass


class _Carries(StatefulProcessor):
    """A ticker's scalars from block to block."""

    def __init__(self, decay: float, ttl_ms: int):
        self.decay, self.ttl_ms = decay, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("scalars", "last double, num double, den double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, num, den = self.state.get() if self.state.exists() else (None, 0.0, 0.0)
        ends = pd.concat(list(rows)).sort_values("block")  # one row a block
        out = []
        for r in ends.itertuples():
            out.append((key[0], int(r.block), last, num, den))
            fade = self.decay ** int(r.n)
            last = last if pd.isna(r.last) else float(r.last)
            num, den = fade * num + float(r.num), fade * den + float(r.den)
        self.state.update((last, num, den))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CARRIES.split(", ")]).astype({"last": float})

    def close(self) -> None:
        pass


def stream_blocks(ticks: DataFrame, span: int = 12, block_seconds: int = 3600, delay: str = "1 hour", key: str = "tic") -> DataFrame:
    """Rows (``BLOCK_ROWS``) of the closed blocks of ``ticks`` (key, ts, value): their place in the block
    and the last known value, weighted sum and weight within it.

    A block is closed once the watermark, ``delay`` behind the newest row, has passed its end;
    later rows for it are dropped by the watermark.  NaN is null; rows of one time go by value;
    null tickers are one; rows without a time are left out."""
    millis = block_seconds * 1000
    d = ticks.select(F.col(key).cast("string").alias("tic"), F.col("ts").cast("timestamp").alias("ts"),
                     F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value")).filter("ts IS NOT NULL")
    d = d.withWatermark("ts", delay).withColumn("block", F.floor(F.unix_millis("ts") / millis).cast("long"))
    return d.groupBy("tic", "block").transformWithStateInPandas(_Blocks(1.0 - 2.0 / (span + 1), millis), BLOCK_ROWS, "append", "eventtime")


def stream_carries(closed: DataFrame, span: int = 12, ttl_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(``CARRIES``) what a ticker brings into each of its blocks, from the stream of ``stream_blocks``
    rows.  A ticker's blocks close in order, so do its carries; scalars not touched for ``ttl_ms``
    leave the store and the ticker starts anew."""
    ends = closed.filter("i = n").select("tic", "block", "n", "last", "num", "den")
    return ends.groupBy("tic").transformWithStateInPandas(_Carries(1.0 - 2.0 / (span + 1), ttl_ms), CARRIES, "append", "processingtime")


def block_ema(closed: DataFrame, carries: DataFrame, span: int = 12) -> DataFrame:
    """(tic, ts, value, last_known, ema) of the closed rows: their own sums plus what the ticker
    brought along, faded by one factor a row."""
    c = carries.select(F.col("tic").alias("_t"), F.col("block").alias("_b"), *[F.col(x).alias(f"_{x}") for x in ("last", "num", "den")])
    d = closed.join(c, F.col("tic").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")), "left")
    fade = F.pow(F.lit(1.0 - 2.0 / (span + 1)), F.col("i"))
    num = F.col("num") + fade * F.coalesce("_num", F.lit(0.0))
    den = F.col("den") + fade * F.coalesce("_den", F.lit(0.0))
    known = F.coalesce(F.nanvl("last", F.lit(None)), F.nanvl("_last", F.lit(None)))
    return d.select("tic", "ts", F.nanvl("value", F.lit(None)).alias("value"), known.alias("last_known"), F.when(den > 0, num / den).alias("ema"))


def run_blocks(ticks: DataFrame, path: str, span: int = 12, block_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Process what is available in both streams, checkpointed under ``path``, and return ``block_ema`` of
    all blocks closed so far.  The session's store provider is RocksDB for that time, as these
    operators require."""
    from tessera.streaming.streams import run_available_now
    spark = ticks.sparkSession
    before = {c: spark.conf.get(c) for c in (PROVIDER, EMPTY_BATCHES)}
    try:
        spark.conf.set(PROVIDER, ROCKSDB)
        run_available_now(stream_blocks(ticks, span, block_seconds, delay), path + "/blocks")
        closed = spark.readStream.schema(BLOCK_ROWS).parquet(path + "/blocks/out")
        # a time to live by the clock always wants one more empty batch: a finite run has none
        spark.conf.set(EMPTY_BATCHES, "false")
        run_available_now(stream_carries(closed, span), path + "/carries")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    return block_ema(spark.read.schema(BLOCK_ROWS).parquet(path + "/blocks/out"), spark.read.schema(CARRIES).parquet(path + "/carries/out"), span)
