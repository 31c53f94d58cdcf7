"""Registered queries: the daily cleaning and merge plans (PIPE-01..07) and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import daily as D
from tessera.plans.fixtures import MACRO_NAMES, TICKERS, Fixtures
from tessera.plans.registry import query

FIX_MACRO_NAMES = dict(zip(TICKERS, MACRO_NAMES))

# ---- shared oracle pieces (DuckDB) -------------------------------------------------------

SQL_RATINGS = """rat AS (
  SELECT tic, created AS date, round_even(avg(r), 4) AS benz_rate
  FROM (SELECT tic, created, TRY_CAST(trunc(TRY_CAST(trim(benz_rate) AS DOUBLE)) AS INTEGER) AS r FROM news) x
  WHERE r IS NOT NULL GROUP BY tic, created)"""

SQL_MACRO_DAILY = """md AS (
  SELECT name, CAST(unnest(generate_series(date, coalesce(nd - 1, date), INTERVAL 1 DAY)) AS DATE) AS date, value
  FROM (SELECT CASE series WHEN '1-URGENT' THEN 'NFP' WHEN '2-HIGH' THEN 'InterestRate'
                 WHEN '3-MEDIUM' THEN 'UnemploymentRate' WHEN '4-NOT SPECIFIED' THEN 'PPI' WHEN '5-LOW' THEN 'CPI' END AS name,
               date, value, lead(date) OVER (PARTITION BY series ORDER BY date) AS nd FROM macro_m) s),
macro AS (
  SELECT date, round_even(max(CASE WHEN name = 'NFP' THEN value END), 4) AS NFP,
    round_even(max(CASE WHEN name = 'InterestRate' THEN value END), 4) AS InterestRate,
    round_even(max(CASE WHEN name = 'UnemploymentRate' THEN value END), 4) AS UnemploymentRate,
    round_even(max(CASE WHEN name = 'PPI' THEN value END), 4) AS PPI,
    round_even(max(CASE WHEN name = 'CPI' THEN value END), 4) AS CPI
  FROM md GROUP BY date)"""

SQL_MACRO_CLEAN = """patch AS (
  SELECT CAST(unnest(generate_series(DATE '2023-04-01', DATE '2023-04-30', INTERVAL 1 DAY)) AS DATE) AS date,
    CAST(155673.0 AS DOUBLE) AS NFP, CAST(4.83 AS DOUBLE) AS InterestRate, CAST(3.4 AS DOUBLE) AS UnemploymentRate,
    CAST(257.381 AS DOUBLE) AS PPI, CAST(302.918 AS DOUBLE) AS CPI),
macro2 AS (
  SELECT date, NFP, InterestRate, UnemploymentRate, PPI, CPI FROM macro WHERE date NOT IN (SELECT date FROM patch)
  UNION ALL SELECT * FROM patch)"""

SQL_EARN_CLEAN = """er AS (
  SELECT tic, reportedDate AS date, reportedEPS, estimatedEPS,
    round(CASE WHEN estimatedEPS = 0 THEN NULL ELSE surprise / abs(estimatedEPS) END * 100, 4) AS surprisePct
  FROM earnings)"""


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def merged(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    macro = D.clean_macro(spark, D.macro_daily(fx.macro_m, FIX_MACRO_NAMES))
    return D.merge_daily(D.clean_bars(fx.bars_d), macro, D.clean_news(fx.news), D.clean_earnings(fx.earnings))


@query("pipe_01_clean_news", f"WITH {SQL_RATINGS} SELECT * FROM rat", ("news",))
def pipe_01(spark, sf_dir):
    return D.clean_news(_fx(spark, sf_dir).news)


@query("pipe_03_clean_earnings", f"WITH {SQL_EARN_CLEAN} SELECT * FROM er", ("earnings",))
def pipe_03(spark, sf_dir):
    return D.clean_earnings(_fx(spark, sf_dir).earnings)


@query("pipe_07_macro_daily", f"WITH {SQL_MACRO_DAILY} SELECT * FROM macro", ("macro_m",))
def pipe_07(spark, sf_dir):
    return D.macro_daily(_fx(spark, sf_dir).macro_m, FIX_MACRO_NAMES)


@query("pipe_04_clean_macro", f"WITH {SQL_MACRO_DAILY}, {SQL_MACRO_CLEAN} SELECT * FROM macro2", ("macro_m",))
def pipe_04(spark, sf_dir):
    return D.clean_macro(spark, D.macro_daily(_fx(spark, sf_dir).macro_m, FIX_MACRO_NAMES))


@query("win_03_upsample_daily", """
SELECT series, CAST(unnest(generate_series(date, coalesce(nd - 1, date), INTERVAL 1 DAY)) AS DATE) AS date, value
FROM (SELECT series, date, value, lead(date) OVER (PARTITION BY series ORDER BY date) AS nd FROM macro_m) s""",
       ("macro_m",))
def win_03(spark, sf_dir):
    return D.upsample_daily(_fx(spark, sf_dir).macro_m)


@query("join_03_outer_series_pivot", f"WITH {SQL_MACRO_DAILY} SELECT * FROM macro", ("macro_m",))
def join_03(spark, sf_dir):
    """n-ary full outer join of the series on date, expressed as union + pivot."""
    return D.macro_daily(_fx(spark, sf_dir).macro_m, FIX_MACRO_NAMES)


SQL_MERGE = f"""WITH {SQL_RATINGS}, {SQL_MACRO_DAILY}, {SQL_MACRO_CLEAN}, {SQL_EARN_CLEAN},
u AS (
  SELECT coalesce(b.tic, r.tic) AS tic, coalesce(b.date, r.date) AS date, b.date AS sess0, r.benz_rate
  FROM (SELECT tic, date FROM bars_d) b FULL JOIN rat r ON b.tic = r.tic AND b.date = r.date),
u2 AS (
  SELECT tic, date,
    last_value(benz_rate IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rf,
    first_value(sess0 IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sess
  FROM u),
rs AS (SELECT tic, sess AS date, round_even(avg(rf), 3) AS benz_rate FROM u2 WHERE sess IS NOT NULL GROUP BY tic, sess),
s AS (
  SELECT b.tic, b.date, b.close, b.volume, b.day, m.NFP, m.InterestRate, m.UnemploymentRate, m.PPI, m.CPI, rs.benz_rate,
    CAST(NULL AS DOUBLE) AS reportedEPS, CAST(NULL AS DOUBLE) AS estimatedEPS, CAST(NULL AS DOUBLE) AS surprisePct, 1 AS tag
  FROM bars_d b LEFT JOIN macro2 m ON b.date = m.date LEFT JOIN rs ON rs.tic = b.tic AND rs.date = b.date
  UNION ALL
  SELECT tic, date, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reportedEPS, estimatedEPS, surprisePct, 0 FROM er),
f AS (
  SELECT tic, date, tag,
    last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume,
    last_value(day IGNORE NULLS) OVER w AS day, last_value(NFP IGNORE NULLS) OVER w AS NFP,
    last_value(InterestRate IGNORE NULLS) OVER w AS InterestRate,
    last_value(UnemploymentRate IGNORE NULLS) OVER w AS UnemploymentRate,
    last_value(PPI IGNORE NULLS) OVER w AS PPI, last_value(CPI IGNORE NULLS) OVER w AS CPI,
    last_value(benz_rate IGNORE NULLS) OVER w AS benz_rate, last_value(reportedEPS IGNORE NULLS) OVER w AS reportedEPS,
    last_value(estimatedEPS IGNORE NULLS) OVER w AS estimatedEPS, last_value(surprisePct IGNORE NULLS) OVER w AS surprisePct
  FROM s WINDOW w AS (PARTITION BY tic ORDER BY date, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT tic, date, close, volume, day, NFP, InterestRate, UnemploymentRate, PPI, CPI, benz_rate,
  reportedEPS, estimatedEPS, surprisePct
FROM f WHERE tag = 1"""


@query("pipe_05_merge_daily", SQL_MERGE, ("bars_d", "macro_m", "news", "earnings"))
def pipe_05(spark, sf_dir):
    return merged(spark, sf_dir)


@query("pipe_05_merge_daily_parity", SQL_MERGE, ("bars_d", "macro_m", "news", "earnings"))
def pipe_05_parity(spark, sf_dir):
    """Same merge with the literal (close, volume, day) rating key; fixture B's key is
    unique per ticker, so both agree."""
    fx = _fx(spark, sf_dir)
    macro = D.clean_macro(spark, D.macro_daily(fx.macro_m, FIX_MACRO_NAMES))
    return D.merge_daily(D.clean_bars(fx.bars_d), macro, D.clean_news(fx.news), D.clean_earnings(fx.earnings),
                         parity=True)


def _stand_in_dims(fx):
    """vix and bond ETF stand-ins: the closes of other tickers by date."""
    b = fx.bars_d
    vix = b.filter(F.col("tic") == "5-LOW").select("date", F.col("close").alias("vix"))
    bonds = (b.filter(F.col("tic").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
             .groupBy("date").pivot("tic", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.first("close"))
             .withColumnsRenamed({"1-URGENT": "TLT", "2-HIGH": "IEF", "3-MEDIUM": "SHY"}))
    return vix, bonds


@query("prj_07_constant_days", f"WITH {SQL_MACRO_DAILY}, {SQL_MACRO_CLEAN} SELECT * FROM macro2", ("macro_m",))
def prj_07(spark, sf_dir):
    """The constant patch month (one row per day, fixed values) appended to the daily
    macro table; patch rows win on a shared date."""
    return D.clean_macro(spark, D.macro_daily(_fx(spark, sf_dir).macro_m, FIX_MACRO_NAMES))
