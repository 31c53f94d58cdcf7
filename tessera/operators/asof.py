"""As-of joins and calendar alignment (JOIN-07, JOIN-08, JOIN-12).

Spark SQL has no ASOF JOIN.  All three are a tagged ``unionByName`` followed by the
chunked fills of ``tessera.operators.series``: one shuffle on (key, calendar bucket: month
for dates, day for timestamps), no range join, no per-key task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.series import bfill, ffill, running_max
from tessera.session import broadcast_bounded


def asof_backward(left: DataFrame, right: DataFrame, cols: Sequence[str], key="tic",
                  order="date", tie: Sequence[str] = ()) -> DataFrame:
    """JOIN-07: for each left row, the latest non-null value of each ``cols`` from
    ``right`` at or before the left row's ``order`` value (per column, like a forward
    fill).  Right rows sort before left rows of the same date; among right rows of one date
    the last by the ``tie`` columns of ``right`` wins (without any, an arbitrary one)."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(cols)
    l = left.withColumn("_tag", F.lit(1))
    ties = [f"_tie{i}" for i in range(len(tie))]
    r = right.select(*keys, order, *cols, *[F.col(c).alias(t) for c, t in zip(tie, ties)]).withColumn("_tag", F.lit(0))
    for c in cols:
        if c not in left.columns:
            l = l.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    u = r.unionByName(l, allowMissingColumns=True)
    # right-side values only: null them on left rows so a left column of the same name
    # is not taken as a known value
    u = u.withColumns({f"_r_{i}": F.when(F.col("_tag") == 0, F.col(c)) for i, c in enumerate(cols)})
    filled = ffill(u, [f"_r_{i}" for i in range(len(cols))], key=keys, order=[order, "_tag", *ties])
    out = filled.filter(F.col("_tag") == 1)
    out = out.withColumns({c: F.col(f"_r_{i}") for i, c in enumerate(cols)})
    return out.drop("_tag", *ties, *[f"_r_{i}" for i in range(len(cols))])


def session_roll(df: DataFrame, sessions: DataFrame, key="tic", date="date", out="session") -> DataFrame:
    """JOIN-08: attach ``out`` = the first session date at or after each row's date
    (a closed-day row belongs to the next open session); null after the last session.
    ``sessions`` has (key, date) of open sessions.  The days of ``df`` are rolled, one row per
    (key, date), and its rows look theirs up."""
    keys = [key] if isinstance(key, str) else list(key)
    s = sessions.select(*keys, date).distinct().withColumns({"_tag": F.lit(1), out: F.col(date)})
    days = df.select(*keys, date).distinct().withColumn("_tag", F.lit(0))
    u = days.unionByName(s, allowMissingColumns=True)
    rolled = bfill(u, [out], key=keys, order=[date, "_tag"]).filter(F.col("_tag") == 0)
    by = keys + [date]
    rolled = rolled.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], out)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    d = df.drop(out) if out in df.columns else df
    return d.join(broadcast_bounded(rolled), same, "left").select(*d.columns, out)


def point_in_time(facts: DataFrame, records: DataFrame, key, as_of: str, record_date: str, record_cols: Sequence[str],
                  tie: Sequence[str] = (), where: dict | None = None) -> DataFrame:
    """JOIN-12: for each fact row (key, as_of), the whole latest record with
    ``record_date <= as_of`` (record-wise, not column-wise).

    ``key``: one column or several (symbol, isin, cik); ``where``: values that a record must
    have (period, report type); ``tie``: among records of one date the last by these wins."""
    key = [key] if isinstance(key, str) else list(key)
    for c, v in (where or {}).items():
        records = records.filter(F.col(c) == v)
    ties = [f"_tie{i}" for i in range(len(tie))]
    rec = records.select(*key, F.col(record_date).alias("_d"), F.struct(*record_cols).alias("_rec"),
                         *[F.col(c).alias(t) for c, t in zip(tie, ties)])
    f = facts.withColumn("_d", F.col(as_of))
    u = f.withColumn("_tag", F.lit(1)).unionByName(rec.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    filled = ffill(u, ["_rec"], key=key, order=["_d", "_tag", *ties])
    out = filled.filter(F.col("_tag") == 1)
    return out.select(*facts.columns, *[F.col("_rec")[c].alias(c) for c in record_cols])


def known_as_of(facts: DataFrame, records: DataFrame, key, as_of: str, record_date: str, updated: str,
                record_cols: Sequence[str], tie: Sequence[str] = (), where: dict | None = None) -> DataFrame:
    """JOIN-12 over two time axes: for each fact row (key, as_of), the record that was the latest
    by ``record_date`` among those with ``record_date <= as_of`` that were known then
    (``updated <= as_of``); of one record date the last update wins, then the largest ``tie``
    (revision).

    A record comes into force at the later of its two dates, so one sweep in that order with a
    running best by (record date, update, tie) answers every fact; records of a day come before
    its facts.  The sweep runs in blocks (``running_max``).  Both dates have the type of
    ``as_of``; records without one of them are never known; facts without a date find none;
    repeated facts come back each; rows with a null key meet those with a null key."""
    key = [key] if isinstance(key, str) else list(key)
    for c, v in (where or {}).items():
        records = records.filter(F.col(c) == v)
    best = F.struct(F.col(record_date).alias("a"), F.col(updated).alias("u"), F.struct(*([F.col(c) for c in tie] or [F.lit(0)])).alias("t"),
                    F.struct(*record_cols).alias("r"))
    rec = (records.filter(F.col(record_date).isNotNull() & F.col(updated).isNotNull())
           .select(*key, F.greatest(record_date, updated).alias("_d"), best.alias("_best"), F.lit(0).alias("_tag")))
    f = facts.withColumns({"_d": F.col(as_of), "_tag": F.lit(1)})
    u = f.unionByName(rec, allowMissingColumns=True)
    swept = running_max(u, "_best", "_top", key=key, order=["_d", "_tag"])
    return swept.filter("_tag = 1").select(*facts.columns, *[F.col("_top.r")[c].alias(c) for c in record_cols])
