"""Event and record operators: de-duplication, ingest cursors, source health,
earnings roll-ups, options summaries (AGG-03, 09, 10, 15..17, AGG-06 fragment join)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """AGG-03 keep the first row per ``keys`` in ``order`` (order must be total).

    The least ``order`` of every key is an aggregate: partial aggregation combines duplicates
    map-side, so a very frequent key never lands whole in one task.  Only these columns are
    aggregated; rows with others are fetched by a semi-join with the winners."""
    keys, order = list(keys), list(order)
    win = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])).alias("_w"))
    if set(df.columns) <= set(keys) | set(order):
        rest = [F.col("_w")[f"_o{i}"].alias(o) for i, o in enumerate(order) if o not in keys]
        return win.select(*keys, *rest).select(*df.columns)
    win = win.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_w.*")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    same += [F.col(o).eqNullSafe(F.col(f"_o{i}")) for i, o in enumerate(order) if o not in keys]
    return df.join(win, same, "left_semi")


def join_fragments(df: DataFrame, key: str | Sequence[str], order: str, text: str, sep: str = " ",
                   out: str = "body") -> DataFrame:
    """AGG-06 ordered string aggregation: the fragments of one item joined by ``sep`` in
    ``order``.  A group is one transcript, bounded by the size of the result text."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                   F.col(text).alias("t")))).alias("_f"))
    return g.select(*keys, F.array_join(F.col("_f.t"), sep).alias(out))


def ingest_cursor(df: DataFrame, to: str, key: str = "tic", created: str = "created", window_days: int = 30,
                  prev: DataFrame | None = None, step_days: int = 15) -> DataFrame:
    """AGG-09 fetch plan per ticker: next ``from`` = last created - 1 day; done when it is
    within ``window_days`` of ``to``; without progress since ``prev`` (key, next_from),
    advance by ``step_days``.  Emits the plan; fetching is outside Spark."""
    g = df.groupBy(key).agg(F.max(created).alias("last_created"), F.min(created).alias("first_created"))
    nxt = F.date_sub("last_created", 1)
    if prev is not None:
        p = prev.select(key, F.col("next_from").alias("_prev"))
        g = g.join(p, key, "left")
        nxt = F.when(F.col("_prev").isNotNull() & (nxt <= F.col("_prev")),
                     F.date_add("_prev", step_days)).otherwise(nxt)
    stop = F.date_sub(F.lit(to).cast("date"), window_days)
    g = g.withColumn("next_from", nxt).withColumn("done", F.col("next_from") >= stop)
    return g.drop("_prev") if prev is not None else g


def source_health(obs: DataFrame, requested: DataFrame, key: str = "tic") -> DataFrame:
    """AGG-10 per requested source: rows received and ok / failed; plus ``all_failed``
    over the whole request (one window over the small request table)."""
    counts = obs.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    r = requested.select(key).distinct().join(counts, key, "left").fillna(0, ["n_rows"])
    r = r.withColumn("ok", F.col("n_rows") > 0)
    w = Window.partitionBy()
    return r.withColumn("all_failed", ~F.max(F.col("ok").cast("int")).over(w).cast("boolean"))


def ttm(df: DataFrame, cols: Sequence[str], key: str = "tic", order: str = "fiscalDateEnding",
        periods: int = 4, suffix: str = "_ttm") -> DataFrame:
    """AGG-16 trailing-twelve-month sums of quarterly records; null until ``periods``
    quarters exist.  Quarterly series are short (4 rows a year), so a per-key window."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(periods - 1), 0)
    d = df.withColumn("_n", F.count(F.lit(1)).over(w))
    for c in cols:
        d = d.withColumn(c + suffix, F.when(F.col("_n") == periods, F.sum(c).over(w)))
    return d.drop("_n")


# The documented fields of an options-activity record, typed.
OPTION_FIELDS = {
    "id": "string", "date": "date", "time": "string", "ticker": "string", "description": "string", "updated": "bigint",
    "sentiment": "string", "aggressor_ind": "double", "option_symbol": "string", "underlying_type": "string",
    "cost_basis": "double", "put_call": "string", "strike_price": "double", "price": "double", "size": "bigint",
    "date_expiration": "date", "option_activity_type": "string", "trade_count": "bigint", "open_interest": "bigint",
    "volume": "bigint", "bid": "double", "ask": "double", "midpoint": "double",
}


def type_options(df: DataFrame) -> DataFrame:
    """SRC-09 options activity with every field as text -> typed columns (bad text -> null)."""
    cols = []
    for c, t in OPTION_FIELDS.items():
        if c in df.columns:
            cols.append(F.col(c).cast("string").try_cast(t).alias(c) if t != "string" else F.col(c))
    return df.select(*cols)


def option_summary(df: DataFrame) -> DataFrame:
    """AGG-17 per (ticker, expiry): call/put volume and open interest, put/call ratio,
    mean midpoint."""
    g = (df.groupBy("ticker", "date_expiration")
         .pivot("put_call", ["CALL", "PUT"])
         .agg(F.sum("volume").alias("volume"), F.sum("open_interest").alias("oi"), F.avg("midpoint").alias("mid")))
    return g.withColumn("put_call_ratio", F.try_divide(F.col("PUT_volume").cast("double"),
                                                       F.col("CALL_volume").cast("double")))
