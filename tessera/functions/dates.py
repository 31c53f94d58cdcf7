"""Date and calendar functions (DAT-F1..F6, MTH-F1, PRJ-08)."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_bounded

# Exchange closings used for the session calendar check (2023-05 .. 2024-01).
HOLIDAYS = ["2023-05-29", "2023-06-19", "2023-07-04", "2023-09-04", "2023-11-23", "2023-12-25",
            "2024-01-01", "2024-01-15"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_parts(c) -> dict[str, Column]:
    """DAT-F1: year, month, day of month, day of week (Monday = 0)."""
    c = _c(c)
    return {"year": F.year(c), "month": F.month(c), "dom": F.dayofmonth(c), "dow": F.weekday(c)}


def add_days(c, n) -> Column:
    """DAT-F2: date plus n calendar days (n may be negative or a column)."""
    return F.date_add(_c(c), n if isinstance(n, Column) else F.lit(int(n)))


def iso(c) -> Column:
    """DAT-F3: ISO yyyy-MM-dd text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def daily_range(start, end) -> Column:
    """DAT-F4: array of every day from start to end inclusive."""
    return F.sequence(_c(start).cast("date"), _c(end).cast("date"), F.expr("INTERVAL 1 DAY"))


def session_minutes(session_date, tz: str = "America/New_York", open_hm: str = "09:30",
                    minutes: int = 390) -> Column:
    """DAT-F4: the 390 regular-session minute stamps of a date, local open 09:30 in ``tz``,
    as UTC TIMESTAMP_NTZ (daylight saving handled by the zone rules)."""
    local_open = F.to_timestamp_ntz(F.concat(F.date_format(_c(session_date), "yyyy-MM-dd"), F.lit(" " + open_hm)))
    # wall clock in ``tz`` -> UTC wall clock, both TIMESTAMP_NTZ: independent of the session time zone
    start = F.convert_timezone(F.lit(tz), F.lit("UTC"), local_open)
    return F.transform(F.sequence(F.lit(0), F.lit(minutes - 1)),
                       lambda i: start + F.make_dt_interval(mins=i))


def is_weekday(c) -> Column:
    return F.weekday(_c(c)) < 5


def session_calendar(spark: SparkSession, start, end, holidays: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """DAT-F5: one row per session day in [start, end]: weekdays minus holidays.
    ``start``/``end`` may be literals or a one-row DataFrame's columns via ``bounds``."""
    days = spark.range(1).select(F.explode(daily_range(F.lit(str(start)), F.lit(str(end)))).alias("date"))
    return sessions_of(days, spark, holidays)


def sessions_of(days: DataFrame, spark: SparkSession, holidays=None, col: str = "date") -> DataFrame:
    """Keep weekday rows of ``days`` that are not holidays (anti join, holiday list is
    a small fixed table)."""
    d = days.filter(is_weekday(col))
    if holidays is None:
        holidays = HOLIDAYS
    if not isinstance(holidays, DataFrame):
        holidays = spark.createDataFrame([(h,) for h in holidays], "h string").select(
            F.col("h").cast("date").alias(col))
    return d.join(broadcast_bounded(holidays), col, "left_anti")


def next_sessions(starts: DataFrame, spark: SparkSession, n: int, key: str = "tic", col: str = "date",
                  holidays=None) -> DataFrame:
    """DAT-F5 / ML-11: for each (key, start date), the next ``n`` sessions after it, numbered 1..n.

    The search spans ``n`` weekdays and as many more as there are holidays, so all ``n`` are found
    whatever the holiday list (a table of holidays is counted: one value)."""
    closed = holidays.count() if isinstance(holidays, DataFrame) else len(HOLIDAYS if holidays is None else holidays)
    span = 7 * (-(-(n + closed) // 5)) + 7
    cand = starts.select(key, F.col(col).alias("_start"),
                         F.explode(F.sequence(F.date_add(col, 1), F.date_add(col, span))).alias(col))
    s = sessions_of(cand, spark, holidays, col)
    w = Window.partitionBy(key, "_start").orderBy(col)
    return (s.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
            .select(key, F.col("_start").alias("start"), "k", col))


def resolve_start(name: str, today) -> Column:
    """DAT-F6: start date for a relative range name against ``today`` (a column or
    literal): YTD, -1W / 1w, 1d, 5d, 1m, 3m, 1y."""
    t = _c(today) if isinstance(today, (str, Column)) and not _is_date_text(today) else F.lit(str(today)).cast("date")
    key = name.strip().lower()
    if key == "ytd":
        return F.trunc(t, "year")
    sign = -1
    k = key.lstrip("-")
    num = int(k[:-1]) if k[:-1] else 1
    unit = k[-1]
    if unit == "d":
        return F.date_add(t, sign * num)
    if unit == "w":
        return F.date_add(t, sign * 7 * num)
    if unit == "m":
        return F.add_months(t, sign * num)
    if unit == "y":
        return F.add_months(t, sign * 12 * num)
    raise ValueError(f"unknown range {name!r}")


def _is_date_text(x) -> bool:
    return isinstance(x, str) and len(x) == 10 and x[4] == "-" and x[7] == "-"


def cyclic(c_value, period: float, prefix: str) -> dict[str, Column]:
    """MTH-F1: sin/cos of 2*pi*value/period."""
    a = 2 * math.pi * _c(c_value) / period
    return {f"{prefix}_sin": F.sin(a), f"{prefix}_cos": F.cos(a)}


def cyclic_dates(df: DataFrame, date: str = "date", day: str = "day") -> DataFrame:
    """MTH-F1: month/12, day-of-month/31 and weekday/5 as sin/cos pairs."""
    cols = {}
    cols.update(cyclic(F.month(date), 12, "month"))
    cols.update(cyclic(F.dayofmonth(date), 31, "day_of_month"))
    cols.update(cyclic(F.col(day) if day in df.columns else F.weekday(date), 5, "day_of_week"))
    return df.withColumns(cols)
