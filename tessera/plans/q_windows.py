"""Registered queries: windows, fills and indicators (WIN-*), on fixture B unless stated.

The oracle computes the recurrences (EMA, Wilder, K/D) with a DuckDB recursive CTE, row
by row, which is an independent check of the closed-form blocks used on Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round_half_even, round_half_up
from tessera.operators import indicators as I
from tessera.operators.series import bfill, ffill, with_index
from tessera.plans import daily as D
from tessera.plans.fixtures import Fixtures
from tessera.plans.oracle_fixtures import sql_round_even as RE
from tessera.plans.registry import query


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


SQL_IND = """WITH RECURSIVE base AS (
  SELECT tic, date, open, high, low, close, volume, day,
    row_number() OVER (PARTITION BY tic ORDER BY date) - 1 AS j,
    coalesce(greatest(close - lag(close) OVER (PARTITION BY tic ORDER BY date), 0.0), 0.0) AS gain,
    coalesce(greatest(lag(close) OVER (PARTITION BY tic ORDER BY date) - close, 0.0), 0.0) AS loss,
    min(low) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS lo9,
    max(high) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS hi9,
    avg(close) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma50,
    avg(close) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS ma200,
    close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS pct
  FROM bars_d),
b2 AS (SELECT *, CAST(CASE WHEN hi9 - lo9 <> 0 THEN (close - lo9) / (hi9 - lo9) * 100.0 ELSE 0.0 END AS DOUBLE) AS rsv
       FROM base),
rec AS (
  SELECT tic, j, CAST(close AS DOUBLE) AS n12, CAST(1 AS DOUBLE) AS d12, CAST(close AS DOUBLE) AS n26,
    CAST(1 AS DOUBLE) AS d26, CAST(gain AS DOUBLE) AS nu, CAST(1 AS DOUBLE) AS du, CAST(loss AS DOUBLE) AS nl,
    CAST(1 AS DOUBLE) AS dl,
    CAST(2 AS DOUBLE) / 3 * 50 + rsv / 3 AS k,
    CAST(2 AS DOUBLE) / 3 * 50 + (CAST(2 AS DOUBLE) / 3 * 50 + rsv / 3) / 3 AS d
  FROM b2 WHERE j = 0
  UNION ALL
  SELECT b.tic, b.j, CAST(11 AS DOUBLE) / 13 * r.n12 + b.close, CAST(11 AS DOUBLE) / 13 * r.d12 + 1,
    CAST(25 AS DOUBLE) / 27 * r.n26 + b.close, CAST(25 AS DOUBLE) / 27 * r.d26 + 1,
    CAST(13 AS DOUBLE) / 14 * r.nu + b.gain, CAST(13 AS DOUBLE) / 14 * r.du + 1,
    CAST(13 AS DOUBLE) / 14 * r.nl + b.loss, CAST(13 AS DOUBLE) / 14 * r.dl + 1,
    CAST(2 AS DOUBLE) / 3 * r.k + b.rsv / 3,
    CAST(2 AS DOUBLE) / 3 * r.d + (CAST(2 AS DOUBLE) / 3 * r.k + b.rsv / 3) / 3
  FROM rec r JOIN b2 b ON b.tic = r.tic AND b.j = r.j + 1),
ind AS (
  SELECT b.tic, b.date, b.open, b.high, b.low, b.close, b.volume, b.day, b.j, b.ma50, b.ma200, b.pct,
    r.n12 / r.d12 AS ema12, r.n26 / r.d26 AS ema26, r.n12 / r.d12 - r.n26 / r.d26 AS macd,
    r.k AS kdjk, r.d AS kdjd, 3 * r.k - 2 * r.d AS kdjj,
    CASE WHEN r.nl / r.dl = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + (r.nu / r.du) / (r.nl / r.dl)) END AS rsi
  FROM b2 b JOIN rec r ON b.tic = r.tic AND b.j = r.j)
"""


@query("win_05_sma", SQL_IND + "SELECT tic, date, round(ma50, 6) AS ma50, round(ma200, 6) AS ma200 FROM ind",
       ("bars_d",))
def win_05(spark, sf_dir):
    d = I.add_indicators(_fx(spark, sf_dir).bars_d, ["ma50", "ma200"])
    return d.select("tic", "date", round_half_up("ma50", 6).alias("ma50"), round_half_up("ma200", 6).alias("ma200"))


@query("win_06_ema_macd", SQL_IND + "SELECT tic, date, round(ema12, 3) AS ema12, round(ema26, 3) AS ema26, "
       "round(macd, 3) AS macd FROM ind", ("bars_d",))
def win_06(spark, sf_dir):
    d = I.add_indicators(_fx(spark, sf_dir).bars_d, ["ema12", "ema26", "macd"])
    return d.select("tic", "date", *[round_half_up(c, 3).alias(c) for c in ("ema12", "ema26", "macd")])


@query("win_07_kdj", SQL_IND + "SELECT tic, date, round(kdjk, 4) AS kdjk, round(kdjd, 4) AS kdjd, "
       "round(kdjj, 4) AS kdjj FROM ind", ("bars_d",))
def win_07(spark, sf_dir):
    d = I.kdj(_fx(spark, sf_dir).bars_d)
    return d.select("tic", "date", *[round_half_up(c, 4).alias(c) for c in ("kdjk", "kdjd", "kdjj")])


@query("win_08_rsi", SQL_IND + "SELECT tic, date, round(rsi, 4) AS rsi FROM ind", ("bars_d",))
def win_08(spark, sf_dir):
    d = I.rsi(_fx(spark, sf_dir).bars_d)
    return d.select("tic", "date", round_half_up("rsi", 4).alias("rsi"))


@query("win_09_indicator_list", SQL_IND + "SELECT tic, date, round(macd, 3) AS macd, round(kdjk, 4) AS kdjk, "
       "round(kdjd, 4) AS kdjd, round(kdjj, 4) AS kdjj, round(rsi, 4) AS rsi, round(ma50, 6) AS ma50, "
       "round(ma200, 6) AS ma200 FROM ind", ("bars_d",))
def win_09(spark, sf_dir):
    d = I.add_indicators(_fx(spark, sf_dir).bars_d, ["macd", "kdj", "rsi", "ma50", "ma200"])
    return d.select("tic", "date", round_half_up("macd", 3).alias("macd"),
                    *[round_half_up(c, 4).alias(c) for c in ("kdjk", "kdjd", "kdjj", "rsi")],
                    *[round_half_up(c, 6).alias(c) for c in ("ma50", "ma200")])


@query("win_10_pct_change", SQL_IND + "SELECT tic, date, round(pct, 6) AS pct FROM ind", ("bars_d",))
def win_10(spark, sf_dir):
    d = I.pct_change(_fx(spark, sf_dir).bars_d)
    return d.select("tic", "date", round_half_up("pct", 6).alias("pct"))


@query("win_14_row_index", "SELECT tic, date, row_number() OVER (PARTITION BY tic ORDER BY date) - 1 AS j FROM bars_d",
       ("bars_d",))
def win_14(spark, sf_dir):
    return with_index(_fx(spark, sf_dir).bars_d, name="j").select("tic", "date", "j")


SQL_RATED_BARS = """WITH rat AS (
  SELECT tic, created AS date, avg(TRY_CAST(trunc(TRY_CAST(trim(benz_rate) AS DOUBLE)) AS INTEGER)) AS rating
  FROM news GROUP BY tic, created),
rb AS (SELECT coalesce(b.tic, r.tic) AS tic, coalesce(b.date, r.date) AS date, b.close, r.rating
       FROM bars_d b FULL JOIN rat r ON b.tic = r.tic AND b.date = r.date)
"""


def _rated_bars(fx):
    rat = (fx.news.groupBy("tic", F.col("created").alias("date"))
           .agg(F.avg(F.trim("benz_rate").try_cast("double").try_cast("int")).alias("rating")))
    return fx.bars_d.select("tic", "date", "close").join(rat, ["tic", "date"], "full")


@query("win_01_forward_fill", SQL_RATED_BARS + """SELECT tic, date,
  last_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,
  last_value(rating IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rating
FROM rb""", ("bars_d", "news"))
def win_01(spark, sf_dir):
    return ffill(_rated_bars(_fx(spark, sf_dir)), ["close", "rating"]).select("tic", "date", "close", "rating")


@query("win_02_backward_fill", SQL_RATED_BARS + """SELECT tic, date,
  first_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close,
  rating
FROM rb""", ("bars_d", "news"))
def win_02(spark, sf_dir):
    return bfill(_rated_bars(_fx(spark, sf_dir)), ["close"]).select("tic", "date", "close", "rating")


@query("pipe_06_enrich_bars", SQL_IND + f""", vix AS (SELECT date, close AS vix FROM bars_d WHERE tic = '5-LOW'),
bonds AS (SELECT date, max(CASE WHEN tic = '1-URGENT' THEN close END) AS TLT,
            max(CASE WHEN tic = '2-HIGH' THEN close END) AS IEF, max(CASE WHEN tic = '3-MEDIUM' THEN close END) AS SHY
          FROM bars_d WHERE tic IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY date),
e AS (SELECT i.*, v.vix, o.TLT, o.IEF, o.SHY FROM ind i LEFT JOIN vix v ON i.date = v.date LEFT JOIN bonds o ON i.date = o.date)
SELECT tic, date, {RE("close", 3)} AS close, {RE("volume", 3)} AS volume, day,
  {RE(RE("macd", 3), 1)} AS macd, {RE("kdjk", 3)} AS kdjk, {RE("kdjd", 3)} AS kdjd, {RE("kdjj", 3)} AS kdjj,
  {RE("rsi", 3)} AS rsi, {RE("ma50", 3)} AS ma50, {RE("ma200", 3)} AS ma200,
  {RE("last_value(vix IGNORE NULLS) OVER w", 3)} AS vix, {RE("last_value(TLT IGNORE NULLS) OVER w", 3)} AS TLT,
  {RE("last_value(IEF IGNORE NULLS) OVER w", 3)} AS IEF, {RE("last_value(SHY IGNORE NULLS) OVER w", 3)} AS SHY
FROM e WINDOW w AS (PARTITION BY tic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ("bars_d",))
def pipe_06_check(spark, sf_dir):
    """PIPE-06 value check: the enriched bars with MACD compared at one digit (its
    magnitude is price-scale; the other columns at the pipeline's 3 digits)."""
    from tessera.plans.q_daily import _stand_in_dims
    fx = _fx(spark, sf_dir)
    vix, bonds = _stand_in_dims(fx)
    d = D.enrich_bars(fx.bars_d, vix, bonds)
    return d.select("tic", "date", "close", "volume", "day", round_half_even("macd", 1).alias("macd"), "kdjk", "kdjd",
                    "kdjj", "rsi", "ma50", "ma200", "vix", "TLT", "IEF", "SHY")
