"""Bar construction and quote statistics (AGG-11, AGG-12, SRC-14, WIN-12, WIN-13)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import resolve_start
from tessera.operators.screen import market_session

from tessera.functions.text import normalise_interval
from tessera.operators.series import IDX, fill, with_index
from tessera.session import broadcast_bounded

# normalised interval -> Spark window duration, or a calendar unit for date_trunc
_DURATION = {"1m": "1 minute", "2m": "2 minutes", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes",
             "60m": "60 minutes", "90m": "90 minutes", "1h": "1 hour", "1d": "1 day", "5d": "5 days"}
_CAL = {"1wk": "week", "1mo": "month", "3mo": "quarter"}
# vendor-style names accepted too
_ALIASES = {"5M": "5Min", "15M": "15Min", "30M": "30Min", "1MONTH": "1M"}


def bucket(ts: str, interval: str):
    """Start of the interval bucket of ``ts`` (tumbling, epoch aligned; calendar units
    truncate)."""
    name = _ALIASES.get(interval, interval)
    if " " in name:  # a plain Spark duration such as "4 hours"
        return F.window(F.col(ts), name).start
    iv = normalise_interval(name)
    if iv in _CAL:
        return F.date_trunc(_CAL[iv], F.col(ts))
    return F.window(F.col(ts), _DURATION[iv]).start


def resample(df: DataFrame, interval: str = "5Min", key: str = "tic", ts: str = "ts", price: str = "close",
             volume: str | None = "volume", tie: str | None = None, ohlc_in: bool = False) -> DataFrame:
    """AGG-11 OHLCV bars per interval: first / max / min / last price and summed volume.
    Input is ticks (``price``) or finer bars (``ohlc_in``: open/high/low/close)."""
    b = bucket(ts, interval)
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    d = df.withColumn("_b", b.cast("timestamp_ntz") if dict(df.dtypes)[ts] == "timestamp_ntz" else b)
    if ohlc_in:
        aggs = [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", order).alias("close")]
    else:
        aggs = [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                F.max_by(price, order).alias("close")]
    if volume:
        aggs.append(F.sum(volume).alias("volume"))
    else:
        aggs.append(F.count(F.lit(1)).cast("double").alias("volume"))
    return d.groupBy(key, F.col("_b").alias(ts)).agg(*aggs)


def candles(df: DataFrame, date_from: str, today, interval: str = "5Min", date_to=None, session: str = "ANY", ts: str = "ts",
            **options) -> DataFrame:
    """SRC-14 candles from a start date or a relative one (YTD, 1d, 5d, 1m; against ``today``)
    to ``date_to`` (inclusive), of any or only of the regular session."""
    relative = not re.match(r"\d{4}-\d{2}-\d{2}$", date_from)
    start = resolve_start(date_from, today) if relative else F.lit(date_from).cast("date")
    d = df.filter(F.col(ts) >= start.cast("timestamp_ntz"))
    if date_to is not None:
        d = d.filter(F.col(ts) < F.date_add(F.lit(str(date_to)).cast("date"), 1).cast("timestamp_ntz"))
    if session == "REGULAR":
        d = d.filter(market_session(F.col(ts)) == "REGULAR")
    elif session != "ANY":
        raise ValueError("session must be ANY or REGULAR")
    return resample(d, interval, ts=ts, **options)


def quote_stats(df: DataFrame, key: str = "tic", date: str = "date") -> DataFrame:
    """AGG-12 latest quote per ticker: last close, previous close, change, change %,
    50-row average close, 52-week (365-day) high / low, last volume.

    The last 50 rows of each key come from ``tail_per_key``, the 52-week extremes from the rows
    of the 365 days up to its last date: no history is indexed or rolled."""
    from tessera.operators.screen import tail_per_key
    tail = tail_per_key(df.select(key, date, "close", "volume"), 50, key, date, back="_b")
    newest = F.col("_b") == 1
    q = tail.groupBy(key).agg(F.max(date).alias(date), F.max(F.when(newest, F.col("close"))).alias("last"),
                              F.max(F.when(F.col("_b") == 2, F.col("close"))).alias("prev_close"), F.avg("close").alias("avg50"),
                              F.max(F.when(newest, F.col("volume"))).alias("volume"))
    last = df.groupBy(F.col(key).alias("_k")).agg(F.max(date).alias("_last"))
    yr = (df.join(broadcast_bounded(last), F.col(key).eqNullSafe(F.col("_k"))).filter(F.col(date) >= F.date_sub("_last", 365))
          .groupBy("_k").agg(F.max("high").alias("high52"), F.min("low").alias("low52")))
    q = q.join(yr, F.col(key).eqNullSafe(F.col("_k")))
    return q.select(key, date, "last", "prev_close", (F.col("last") - F.col("prev_close")).alias("change"),
                    (F.try_divide(F.col("last") - F.col("prev_close"), F.col("prev_close")) * 100).alias("change_pct"),
                    "avg50", "high52", "low52", "volume")


def gap_fill(df: DataFrame, keys: DataFrame, start, end, step: str, key: str = "tic", ts: str = "ts") -> DataFrame:
    """WIN-12 bars on a full grid ``sequence(start, end, step)`` per key (columns of
    ``keys`` or literals): a missing bar takes the previous close for O/H/L/C and volume
    0; a missing first bar takes the first valid close; all missing -> 0."""
    from tessera.operators.joins import spine_join
    d = spine_join(df, keys, start, end, step, ts).withColumns({"_c": F.col("close"), "_f": F.col("close")})
    # previous close forward, first close backward: one fused fill pass
    d = fill(d, ["_c"], ["_f"], key=key, order=ts, chunk=F.date_trunc("day", F.col(ts)))
    filler = F.coalesce(F.col("_c"), F.col("_f"), F.lit(0.0))
    return d.select(key, ts, *[F.coalesce(F.col(c), filler).alias(c) for c in ("open", "high", "low", "close")],
                    F.coalesce(F.col("volume"), F.lit(0.0)).alias("volume"))


def chrono_split(df: DataFrame, frac: float = 0.8, key: str = "tic", order: str = "date",
                 val: bool = True) -> DataFrame:
    """WIN-13 positional split per key: test from floor(frac*n); within train, val from
    floor(frac*floor(frac*n)).  Adds ``split`` in (train, val, test) and ``pos``."""
    added = IDX not in df.columns
    d = with_index(df, key, order) if added else df
    n = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, key)
    t0 = F.floor(F.col("_n") * frac)
    v0 = F.floor(t0 * frac)
    split = F.when(F.col(IDX) >= t0, "test")
    split = split.when(F.col(IDX) >= v0, "val" if val else "train").otherwise("train")
    d = d.withColumn("split", split).withColumn("pos", F.col(IDX)).drop("_n")
    return d.drop(IDX) if added else d
