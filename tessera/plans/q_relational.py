"""Registered queries: joins, aggregations, sorting, set operations and screens
(JOIN-*, AGG-*, SRT-*, SET-01, FLT-07..12, WIN-04, WIN-12, WIN-13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.numeric import round_half_up
from tessera.operators import asof as A
from tessera.operators import bars as B
from tessera.operators import events as EV
from tessera.operators import joins as J
from tessera.operators import screen as S
from tessera.operators.features import lead_target
from tessera.operators.indicators import pct_change
from tessera.plans import daily as D
from tessera.plans.fixtures import Fixtures
from tessera.plans.q_daily import FIX_MACRO_NAMES, SQL_EARN_CLEAN, SQL_MACRO_DAILY, SQL_RATINGS
from tessera.plans.registry import query


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def _ratings(fx):
    return D.clean_news(fx.news)


# ---- joins -----------------------------------------------------------------------------

@query("join_01_left_on_date", f"""WITH {SQL_MACRO_DAILY}
SELECT b.tic, b.date, b.close, m.NFP, m.CPI FROM bars_d b LEFT JOIN macro m ON b.date = m.date""", ("bars_d", "macro_m"))
def join_01(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    m = D.macro_daily(fx.macro_m, FIX_MACRO_NAMES).select("date", "NFP", "CPI")
    return J.left_on_date(fx.bars_d.select("tic", "date", "close"), m)


@query("join_02_full_outer", f"""WITH {SQL_RATINGS}
SELECT coalesce(b.tic, r.tic) AS tic, coalesce(b.date, r.date) AS date, b.close, r.benz_rate
FROM bars_d b FULL JOIN rat r ON b.tic = r.tic AND b.date = r.date""", ("bars_d", "news"))
def join_02(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return J.full_on_key(fx.bars_d.select("tic", "date", "close"), _ratings(fx))


@query("join_04_keep_sessions", """SELECT doc_id, tic, created FROM news n
WHERE EXISTS (SELECT 1 FROM bars_d b WHERE b.tic = n.tic AND b.date = n.created)""", ("bars_d", "news"))
def join_04(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    n = fx.news.select("doc_id", "tic", F.col("created"))
    return J.keep_sessions(n.withColumnRenamed("created", "date"), fx.bars_d).withColumnRenamed("date", "created")


@query("join_05_inner_on_ts", """
SELECT h.tic, h.ts, h.close, m.mkt_volume FROM bars_h h
JOIN (SELECT ts, sum(volume) AS mkt_volume FROM bars_h GROUP BY ts) m ON h.ts = m.ts""", ("bars_h",))
def join_05(spark, sf_dir):
    h = _fx(spark, sf_dir).bars_h
    m = h.groupBy("ts").agg(F.sum("volume").alias("mkt_volume"))
    return h.select("tic", "ts", "close").join(m, "ts")


@query("join_06_left_composite_key", """
SELECT h.tic, h.ts, h.close, x.n_users FROM bars_h h LEFT JOIN
  (SELECT event_type AS tic, date_trunc('hour', ts) AS ts, count(DISTINCT user_id) AS n_users FROM events
   WHERE value > 50 GROUP BY 1, 2) x ON h.tic = x.tic AND h.ts = x.ts""", ("bars_h",))
def join_06(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    x = (fx.events.filter(F.col("value") > 50)
         .groupBy(F.col("event_type").alias("tic"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
         .agg(F.countDistinct("user_id").alias("n_users")))
    return fx.bars_h.select("tic", "ts", "close").join(x, ["tic", "ts"], "left")


@query("join_07_asof_backward", f"""WITH {SQL_EARN_CLEAN},
u AS (SELECT tic, date, 1 AS tag, NULL::DOUBLE AS reportedEPS, NULL::DOUBLE AS estimatedEPS, NULL::DOUBLE AS surprisePct FROM bars_d
      UNION ALL SELECT tic, date, 0, reportedEPS, estimatedEPS, surprisePct FROM er),
f AS (SELECT tic, date, tag,
  last_value(reportedEPS IGNORE NULLS) OVER w AS reportedEPS, last_value(estimatedEPS IGNORE NULLS) OVER w AS estimatedEPS,
  last_value(surprisePct IGNORE NULLS) OVER w AS surprisePct
  FROM u WINDOW w AS (PARTITION BY tic ORDER BY date, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT tic, date, reportedEPS, estimatedEPS, surprisePct FROM f WHERE tag = 1""", ("bars_d", "earnings"))
def join_07(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    e = D.clean_earnings(fx.earnings)
    return A.asof_backward(fx.bars_d.select("tic", "date"), e, ["reportedEPS", "estimatedEPS", "surprisePct"])


@query("join_08_session_roll", """
SELECT doc_id, tic, created AS date, (SELECT min(b.date) FROM bars_d b WHERE b.tic = n.tic AND b.date >= n.created) AS session
FROM news n""", ("bars_d", "news"))
def join_08(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    n = fx.news.select("doc_id", "tic", F.col("created").alias("date"))
    return A.session_roll(n, fx.bars_d.select("tic", "date"))


@query("join_12_point_in_time", """
SELECT b.tic, b.date, e.fiscalDateEnding, e.reportedEPS, e.estimatedEPS
FROM bars_d b ASOF LEFT JOIN earnings e ON b.tic = e.tic AND b.date >= e.reportedDate""", ("bars_d", "earnings"))
def join_12(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return A.point_in_time(fx.bars_d.select("tic", "date"), fx.earnings, "tic", "date", "reportedDate",
                           ["fiscalDateEnding", "reportedEPS", "estimatedEPS"])


_SQL_REVISIONS = """rev AS (SELECT tic, fiscalDateEnding, reportedDate, CAST(k AS INT) AS revision,
    reportedDate + CAST(k * (25 + month(fiscalDateEnding) * 11 % 90) AS INT) AS updated, round(reportedEPS * (1 + k * 0.01), 4) AS eps
  FROM earnings, (VALUES (0), (1), (2)) t(k))"""


@query("join_12_known_as_of", f"""WITH {_SQL_REVISIONS},
k AS (SELECT b.tic, b.date, arg_max(struct_pack(f := r.fiscalDateEnding, n := r.revision, e := r.eps), (r.reportedDate, r.updated, r.revision)) AS best
  FROM bars_d b JOIN rev r ON b.tic = r.tic AND r.reportedDate <= b.date AND r.updated <= b.date GROUP BY b.tic, b.date)
SELECT b.tic, b.date, best.f AS fiscalDateEnding, best.n AS revision, best.e AS eps
FROM bars_d b LEFT JOIN k ON b.tic = k.tic AND b.date = k.date""", ("bars_d", "earnings"))
def join_12_known(spark, sf_dir):
    """For every bar the latest report that had come out by then, in the revision known that day."""
    fx = _fx(spark, sf_dir)
    k = F.col("revision")
    rev = fx.earnings.withColumn("revision", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rev = rev.withColumns({"updated": F.date_add("reportedDate", (k * (25 + F.month("fiscalDateEnding") * 11 % 90)).cast("int")),
                           "eps": F.round(F.col("reportedEPS") * (1 + k * 0.01), 4)})
    return A.known_as_of(fx.bars_d.select("tic", "date"), rev, "tic", "date", "reportedDate", "updated",
                         ["fiscalDateEnding", "revision", "eps"], tie=["revision"])


@query("join_09_spine", """
SELECT k.tic, g.ts, h.close FROM (SELECT DISTINCT tic FROM bars_h) k
CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM bars_h), (SELECT max(ts) FROM bars_h), INTERVAL 1 HOUR)) AS ts) g
LEFT JOIN bars_h h ON h.tic = k.tic AND h.ts = g.ts""", ("bars_h",))
def join_09(spark, sf_dir):
    h = _fx(spark, sf_dir).bars_h
    keys = h.select("tic").distinct().withColumns({"_lo": h.select(F.min("ts")).scalar(), "_hi": h.select(F.max("ts")).scalar()})
    return J.spine_join(h.select("tic", "ts", "close"), keys, "_lo", "_hi", "1 HOUR", "ts")


@query("join_10_cross_params", """
SELECT t.tic, g.layers, g.lr FROM (SELECT DISTINCT tic FROM bars_d) t
CROSS JOIN (VALUES (2, 0.01::DOUBLE), (4, 0.01::DOUBLE), (6, 0.01::DOUBLE), (6, 0.001::DOUBLE)) g(layers, lr)""", ("bars_d",))
def join_10(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    grid = [{"layers": 2, "lr": 0.01}, {"layers": 4, "lr": 0.01}, {"layers": 6, "lr": 0.01},
            {"layers": 6, "lr": 0.001}]
    return J.cross_params(fx.bars_d.select("tic").distinct(), grid)


@query("join_11_unrated", """SELECT doc_id, tic FROM news WHERE doc_id NOT IN
  (SELECT doc_id FROM news WHERE TRY_CAST(trunc(TRY_CAST(trim(benz_rate) AS DOUBLE)) AS INTEGER) IS NOT NULL)""", ("news",))
def join_11(spark, sf_dir):
    from tessera.operators.clean import parse_rating
    n = _fx(spark, sf_dir).news
    done = n.filter(parse_rating("benz_rate").isNotNull()).select("doc_id")
    return J.unrated(n.select("doc_id", "tic"), done)


# ---- aggregations ------------------------------------------------------------------------

@query("agg_01_daily_mean_rating", f"WITH {SQL_RATINGS} SELECT * FROM rat", ("news",))
def agg_01(spark, sf_dir):
    return D.clean_news(_fx(spark, sf_dir).news)


@query("agg_02_group_mean_to_rows", """
WITH r AS (SELECT doc_id, tic, created, TRY_CAST(trunc(TRY_CAST(trim(benz_rate) AS DOUBLE)) AS INTEGER) AS rating,
  (SELECT min(b.date) FROM bars_d b WHERE b.tic = n.tic AND b.date >= n.created) AS session FROM news n)
SELECT doc_id, tic, session, rating,
  CASE WHEN session IS NULL THEN NULL ELSE round(avg(rating) OVER (PARTITION BY tic, session), 6) END AS session_mean FROM r""",
       ("bars_d", "news"))
def agg_02(spark, sf_dir):
    from tessera.operators.clean import parse_rating
    fx = _fx(spark, sf_dir)
    n = fx.news.select("doc_id", "tic", F.col("created").alias("date"), parse_rating("benz_rate").alias("rating"))
    r = A.session_roll(n, fx.bars_d.select("tic", "date"))
    m = r.filter(F.col("session").isNotNull()).groupBy("tic", "session").agg(F.avg("rating").alias("_m"))
    return r.join(m, ["tic", "session"], "left").select(
        "doc_id", "tic", "session", "rating", round_half_up("_m", 6).alias("session_mean"))


@query("agg_03_dedupe_keep_first", """
SELECT doc_id, created, title FROM (SELECT doc_id, created, title,
  row_number() OVER (PARTITION BY title ORDER BY created, doc_id) AS rk FROM news) x WHERE rk = 1""", ("news",))
def agg_03(spark, sf_dir):
    n = _fx(spark, sf_dir).news.select("doc_id", "created", "title")
    return EV.dedupe_first(n, ["title"], ["created", "doc_id"])


@query("agg_04_pivot_wide", """
SELECT date, """ + ", ".join(f"max(CASE WHEN tic = 'Brand#{k}' THEN close END) AS \"Brand#{k}\""
                             for k in range(1, 26)) + """ FROM bars_x GROUP BY date""", ("bars_x",))
def agg_04(spark, sf_dir):
    """Close by ticker per date, one column for every ticker of the data."""
    from tessera.operators.risk import wide
    return wide(_fx(spark, sf_dir).bars_x)


@query("agg_05_extent", """SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS n_dates,
  count(DISTINCT tic) AS n_tickers FROM bars_h""", ("bars_h",))
def agg_05(spark, sf_dir):
    h = _fx(spark, sf_dir).bars_h
    return h.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.countDistinct(F.col("ts").cast("date")).alias("n_dates"), F.countDistinct("tic").alias("n_tickers"))


@query("agg_06_join_fragments", """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations
GROUP BY conv_id""")
def agg_06(spark, sf_dir):
    return EV.join_fragments(_fx(spark, sf_dir).conversations, "conv_id", "turn", "text")


@query("agg_07_mae_mse", """SELECT tic, round(avg(abs(prediction - observed)), 4) AS mae,
  round(avg((prediction - observed) * (prediction - observed)), 2) AS mse, count(*) AS n
FROM preds WHERE prediction IS NOT NULL AND observed IS NOT NULL GROUP BY tic""", ("preds",))
def agg_07(spark, sf_dir):
    from tessera.operators.model import evaluate
    e = evaluate(_fx(spark, sf_dir).preds, ["tic"])
    return e.select("tic", round_half_up("mae", 4).alias("mae"), round_half_up("mse", 2).alias("mse"), "n")


SQL_RET_X = """rx AS (SELECT tic, date, close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret FROM bars_x)"""


@query("agg_08_covariance", f"""WITH {SQL_RET_X}
SELECT a.tic AS tic_a, b.tic AS tic_b, round(covar_samp(a.ret, b.ret) * 1e6, 6) AS cov
FROM rx a JOIN rx b ON a.date = b.date GROUP BY a.tic, b.tic""", ("bars_x",))
def agg_08(spark, sf_dir):
    from tessera.operators.risk import covariance
    r = pct_change(_fx(spark, sf_dir).bars_x, "close", "ret")
    c = covariance(r)
    return c.select("tic_a", "tic_b", round_half_up(F.col("cov") * 1e6, 6).alias("cov"))


@query("agg_09_ingest_cursor", """SELECT tic, max(created) AS last_created, min(created) AS first_created,
  max(created) - 1 AS next_from, max(created) - 1 >= DATE '2000-01-01' - 30 AS done FROM news GROUP BY tic""", ("news",))
def agg_09(spark, sf_dir):
    return EV.ingest_cursor(_fx(spark, sf_dir).news, "2000-01-01")


@query("agg_10_source_health", """
WITH req AS (SELECT DISTINCT p_brand AS tic FROM part UNION ALL VALUES ('Brand#00'), ('Brand#99')),
obs AS (SELECT tic, count(*) AS n FROM bars_x WHERE date >= DATE '1994-01-01' AND date < DATE '1997-01-01' GROUP BY tic),
r AS (SELECT req.tic, coalesce(obs.n, 0) AS n_rows, coalesce(obs.n, 0) > 0 AS ok FROM req LEFT JOIN obs ON req.tic = obs.tic)
SELECT tic, n_rows, ok, NOT bool_or(ok) OVER () AS all_failed FROM r""", ("bars_x",))
def agg_10(spark, sf_dir):
    """Rows of every requested ticker over the whole requested range; two have none."""
    fx = _fx(spark, sf_dir)
    x = fx.bars_x.filter((F.col("date") >= "1994-01-01") & (F.col("date") < "1997-01-01"))
    more = spark.createDataFrame([("Brand#00",), ("Brand#99",)], "tic string")
    return EV.source_health(x, fx.part.select(F.col("p_brand").alias("tic")).unionByName(more))


@query("agg_11_resample_4h", """
SELECT tic, time_bucket(INTERVAL 4 HOUR, ts) AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low,
  max_by(close, ts) AS close, sum(volume) AS volume FROM bars_h GROUP BY tic, time_bucket(INTERVAL 4 HOUR, ts)""",
       ("bars_h",))
def agg_11(spark, sf_dir):
    return B.resample(_fx(spark, sf_dir).bars_h, "4 hours", ohlc_in=True)


@query("src_14_bars_5min", """
SELECT event_type AS tic, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, min_by(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, max_by(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts)""")
def src_14(spark, sf_dir):
    """Candles at the default 5-minute interval from raw events (ticks)."""
    ev = _fx(spark, sf_dir).events.withColumnRenamed("event_type", "tic")
    return B.resample(ev, "5Min", key="tic", ts="ts", price="value", volume=None, tie="event_id")


@query("src_14_bars_weekly", """
SELECT tic, CAST(date_trunc('week', date) AS DATE) AS date, min_by(open, date) AS open, max(high) AS high, min(low) AS low,
  max_by(close, date) AS close, sum(volume) AS volume FROM bars_d GROUP BY tic, date_trunc('week', date)""", ("bars_d",))
def src_14_w(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d
    r = B.resample(b, "1W", key="tic", ts="date", ohlc_in=True)
    return r.withColumn("date", F.col("date").cast("date"))


@query("agg_12_quote_stats", """
WITH last AS (SELECT tic, max(date) AS d FROM bars_d GROUP BY tic),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.tic ORDER BY date DESC) AS rk FROM bars_d b)
SELECT r.tic, r.date, r.close AS last, p.close AS prev_close, r.close - p.close AS change,
  round((r.close - p.close) / p.close * 100, 6) AS change_pct,
  round((SELECT avg(close) FROM r r2 WHERE r2.tic = r.tic AND r2.rk <= 50), 6) AS avg50,
  (SELECT max(high) FROM bars_d b WHERE b.tic = r.tic AND b.date >= last.d - 365) AS high52,
  (SELECT min(low) FROM bars_d b WHERE b.tic = r.tic AND b.date >= last.d - 365) AS low52, r.volume
FROM r JOIN last ON r.tic = last.tic LEFT JOIN r p ON p.tic = r.tic AND p.rk = 2 WHERE r.rk = 1""", ("bars_d",))
def agg_12(spark, sf_dir):
    q = B.quote_stats(_fx(spark, sf_dir).bars_d)
    return q.withColumns({"change_pct": round_half_up("change_pct", 6), "avg50": round_half_up("avg50", 6)})


@query("agg_13_peer_percentiles", """SELECT symbol_id, sector, round(percent_rank() OVER (PARTITION BY sector ORDER BY close), 6) AS close_pctl,
  round(percent_rank() OVER (PARTITION BY sector ORDER BY marketcap), 6) AS marketcap_pctl FROM universe""", ("universe",))
def agg_13(spark, sf_dir):
    u = S.percentiles(_fx(spark, sf_dir).universe, ["close", "marketcap"], "sector")
    return u.select("symbol_id", "sector", round_half_up("close_pctl", 6).alias("close_pctl"),
                    round_half_up("marketcap_pctl", 6).alias("marketcap_pctl"))


SQL_RET_D = """rd AS (SELECT tic, date, close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret FROM bars_d)"""


@query("agg_14_alpha_beta", f"""WITH {SQL_RET_D}, m AS (SELECT date, avg(ret) AS mkt FROM rd GROUP BY date)
SELECT tic, round(regr_slope(ret, mkt), 6) AS beta, round(regr_intercept(ret, mkt), 6) AS alpha, CAST(regr_count(ret, mkt) AS BIGINT) AS n
FROM rd JOIN m ON rd.date = m.date GROUP BY tic""", ("bars_d",))
def agg_14(spark, sf_dir):
    r = pct_change(_fx(spark, sf_dir).bars_d, "close", "ret")
    ab = S.alpha_beta(r)
    return ab.select("tic", round_half_up("beta", 6).alias("beta"), round_half_up("alpha", 6).alias("alpha"),
                     F.col("n").cast("long").alias("n"))


@query("agg_15_surprise_pct", """SELECT tic, fiscalDateEnding, reportedEPS - estimatedEPS AS surprise_calc,
  round(CASE WHEN estimatedEPS = 0 THEN NULL ELSE (reportedEPS - estimatedEPS) / abs(estimatedEPS) END * 100, 4) AS surprisePercentage
FROM earnings""", ("earnings",))
def agg_15(spark, sf_dir):
    e = _fx(spark, sf_dir).earnings.select("tic", "fiscalDateEnding", "reportedEPS", "estimatedEPS")
    s = D.surprise_pct(e, surprise="surprise_calc")
    return s.select("tic", "fiscalDateEnding", "surprise_calc", "surprisePercentage")


@query("agg_16_ttm", """SELECT tic, fiscalDateEnding,
  CASE WHEN count(*) OVER w = 4 THEN round(sum(reportedEPS) OVER w, 4) END AS reportedEPS_ttm
FROM earnings WINDOW w AS (PARTITION BY tic ORDER BY fiscalDateEnding ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
       ("earnings",))
def agg_16(spark, sf_dir):
    t = EV.ttm(_fx(spark, sf_dir).earnings, ["reportedEPS"])
    return t.select("tic", "fiscalDateEnding", round_half_up("reportedEPS_ttm", 4).alias("reportedEPS_ttm"))


def _options(fx):
    """Options-activity stand-in with every field as text, derived from events."""
    ev = fx.events
    k = F.col("event_id")
    return ev.select(k.cast("string").alias("id"), F.col("ts").cast("date").cast("string").alias("date"),
                     F.col("event_type").alias("ticker"),
                     F.when(k % 2 == 0, "CALL").otherwise("PUT").alias("put_call"),
                     F.col("value").cast("string").alias("strike_price"),
                     F.date_add(F.col("ts").cast("date"), (k % 4 * 7).cast("int")).cast("string").alias("date_expiration"),
                     F.col("value").cast("string").alias("midpoint"),
                     (F.col("user_id") * 10).cast("string").alias("volume"),
                     F.when(k % 97 == 0, "n/a").otherwise((k % 50).cast("string")).alias("open_interest"))


@query("agg_17_option_summary", """
WITH o AS (SELECT event_type AS ticker, CAST(ts AS DATE) + CAST((event_id % 4) * 7 AS INT) AS date_expiration,
  CASE WHEN event_id % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS put_call, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS midpoint,
  CAST(user_id * 10 AS BIGINT) AS volume, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 50 END AS open_interest FROM events)
SELECT ticker, date_expiration,
  CAST(sum(volume) FILTER (WHERE put_call = 'CALL') AS BIGINT) AS CALL_volume, CAST(sum(open_interest) FILTER (WHERE put_call = 'CALL') AS BIGINT) AS CALL_oi,
  round(avg(midpoint) FILTER (WHERE put_call = 'CALL'), 6) AS CALL_mid,
  CAST(sum(volume) FILTER (WHERE put_call = 'PUT') AS BIGINT) AS PUT_volume, CAST(sum(open_interest) FILTER (WHERE put_call = 'PUT') AS BIGINT) AS PUT_oi,
  round(avg(midpoint) FILTER (WHERE put_call = 'PUT'), 6) AS PUT_mid,
  round(CAST(sum(volume) FILTER (WHERE put_call = 'PUT') AS DOUBLE)
    / CASE WHEN sum(volume) FILTER (WHERE put_call = 'CALL') = 0 THEN NULL
      ELSE CAST(sum(volume) FILTER (WHERE put_call = 'CALL') AS DOUBLE) END, 6) AS put_call_ratio
FROM o GROUP BY ticker, date_expiration""")
def agg_17(spark, sf_dir):
    t = EV.type_options(_options(_fx(spark, sf_dir)))
    s = EV.option_summary(t)
    return s.select("ticker", "date_expiration", F.col("CALL_volume").cast("long").alias("CALL_volume"),
                    F.col("CALL_oi").cast("long").alias("CALL_oi"), round_half_up("CALL_mid", 6).alias("CALL_mid"),
                    F.col("PUT_volume").cast("long").alias("PUT_volume"), F.col("PUT_oi").cast("long").alias("PUT_oi"),
                    round_half_up("PUT_mid", 6).alias("PUT_mid"), round_half_up("put_call_ratio", 6).alias("put_call_ratio"))


@query("src_09_options_typed", """SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date, event_type AS ticker,
  CASE WHEN event_id % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS put_call, value AS strike_price,
  CAST(ts AS DATE) + CAST((event_id % 4) * 7 AS INT) AS date_expiration, value AS midpoint,
  CAST(user_id * 10 AS BIGINT) AS volume, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 50 END AS open_interest
FROM events""")
def src_09(spark, sf_dir):
    return EV.type_options(_options(_fx(spark, sf_dir)))


# ---- windows via joins -------------------------------------------------------------------

@query("win_04_lead_target", """SELECT tic, date, close, lead(close, 90) OVER (PARTITION BY tic ORDER BY date) AS target
FROM bars_d""", ("bars_d",))
def win_04(spark, sf_dir):
    """Target = close 90 rows (3 months x 30) ahead."""
    b = _fx(spark, sf_dir).bars_d.select("tic", "date", "close")
    return lead_target(b, 90)


@query("ml_16_next_day_label", """SELECT tic, date, lead(close, 1) OVER (PARTITION BY tic ORDER BY date) AS target
FROM bars_d""", ("bars_d",))
def ml_16(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.select("tic", "date", "close")
    return lead_target(b, 1).drop("close")


@query("win_13_chrono_split", """SELECT tic, date, CASE WHEN j >= floor(n * 0.8) THEN 'test'
  WHEN j >= floor(floor(n * 0.8) * 0.8) THEN 'val' ELSE 'train' END AS split
FROM (SELECT tic, date, row_number() OVER (PARTITION BY tic ORDER BY date) - 1 AS j, count(*) OVER (PARTITION BY tic) AS n
      FROM bars_d) x""", ("bars_d",))
def win_13(spark, sf_dir):
    return B.chrono_split(_fx(spark, sf_dir).bars_d.select("tic", "date")).select("tic", "date", "split")


@query("win_12_gap_fill", """
WITH k AS (SELECT DISTINCT tic FROM bars_h),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM bars_h), (SELECT max(ts) FROM bars_h), INTERVAL 1 HOUR)) AS ts),
s AS (SELECT k.tic, g.ts, h.open, h.high, h.low, h.close, h.volume FROM k CROSS JOIN g LEFT JOIN bars_h h ON h.tic = k.tic AND h.ts = g.ts),
f AS (SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS fill FROM s)
SELECT tic, ts, coalesce(open, fill) AS open, coalesce(high, fill) AS high, coalesce(low, fill) AS low,
  coalesce(close, fill) AS close, coalesce(volume, 0.0) AS volume FROM f""", ("bars_h",))
def win_12(spark, sf_dir):
    h = _fx(spark, sf_dir).bars_h
    keys = h.select("tic").distinct().withColumns({"_lo": h.select(F.min("ts")).scalar(), "_hi": h.select(F.max("ts")).scalar()})
    return B.gap_fill(h, keys, "_lo", "_hi", "1 HOUR")


# ---- sort, limit, set ----------------------------------------------------------------------

@query("srt_01_sort", "SELECT tic, date, close FROM bars_d ORDER BY date, tic", ("bars_d",))
def srt_01(spark, sf_dir):
    return _fx(spark, sf_dir).bars_d.select("tic", "date", "close").orderBy("date", "tic")


@query("srt_02_head", "SELECT tic, date, close FROM bars_d ORDER BY date, tic LIMIT 10", ("bars_d",))
def srt_02(spark, sf_dir):
    from tessera.operators.clean import snapshot
    return snapshot(_fx(spark, sf_dir).bars_d.select("tic", "date", "close"), ["date", "tic"], 10)


@query("srt_03_tail_per_key", """SELECT tic, date, close FROM (SELECT tic, date, close,
  row_number() OVER (PARTITION BY tic ORDER BY date DESC) AS rk FROM bars_d) x WHERE rk <= 5""", ("bars_d",))
def srt_03(spark, sf_dir):
    return S.tail_per_key(_fx(spark, sf_dir).bars_d.select("tic", "date", "close"), 5)


SQL_CHANGE = """ch AS (SELECT tic, min_by(close, date) AS first, max_by(close, date) AS last,
  (max_by(close, date) - min_by(close, date)) / min_by(close, date) * 100 AS change_pct
  FROM bars_x WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY tic)"""


@query("flt_10_movers", f"""WITH {SQL_CHANGE}
SELECT tic, first, last, round(change_pct, 6) AS change_pct, side FROM (
  (SELECT *, 'gainer' AS side FROM ch ORDER BY change_pct DESC, tic LIMIT 5)
  UNION ALL (SELECT *, 'loser' AS side FROM ch ORDER BY change_pct ASC, tic LIMIT 5)) x""", ("bars_x",))
def flt_10(spark, sf_dir):
    m = S.movers(_fx(spark, sf_dir).bars_x, "1996-01-01", "1996-12-31", k=5)
    return m.withColumn("change_pct", round_half_up("change_pct", 6))


@query("flt_10_movers_filtered", f"""WITH u AS (SELECT p_brand AS tic, max(p_retailprice) AS close, sum(p_retailprice * p_size) AS marketcap
  FROM part GROUP BY p_brand),
{SQL_CHANGE.replace('bars_x', '(SELECT * FROM bars_x WHERE tic IN (SELECT tic FROM u WHERE marketcap > 100000 AND marketcap < 2200000 AND close > 910))')}
SELECT tic, first, last, round(change_pct, 6) AS change_pct, side FROM (
  (SELECT *, 'gainer' AS side FROM ch ORDER BY change_pct DESC, tic LIMIT 5)
  UNION ALL (SELECT *, 'loser' AS side FROM ch ORDER BY change_pct ASC, tic LIMIT 5)) x""", ("bars_x",))
def flt_10_f(spark, sf_dir):
    """Movers among tickers of a market cap and a close price."""
    fx = _fx(spark, sf_dir)
    u = fx.table("part").groupBy(F.col("p_brand").alias("tic")).agg(
        F.max("p_retailprice").alias("close"), F.sum(F.col("p_retailprice") * F.col("p_size")).alias("marketcap"))
    m = S.movers(fx.bars_x, "1996-01-01", "1996-12-31", k=5, universe=u, market_cap_gt="100k", market_cap_lt="2.2m", close_gt=910)
    return m.withColumn("change_pct", round_half_up("change_pct", 6))


@query("flt_11_autocomplete_exchange", """SELECT * FROM universe WHERE lower(symbol) LIKE 'p1%'
  AND exchange IN ('Brand#1', 'Brand#13') ORDER BY symbol LIMIT 10""", ("universe",))
def flt_11_exchange(spark, sf_dir):
    return S.autocomplete(_fx(spark, sf_dir).universe, "P1", "symbol", 10, exchanges=["Brand#1", "Brand#13"])


@query("src_14_candles_session", """
SELECT event_type AS tic, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, min_by(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, max_by(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events WHERE ts >= DATE '2024-01-01' AND hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959
GROUP BY event_type, time_bucket(INTERVAL 15 MINUTE, ts)""")
def src_14_session(spark, sf_dir):
    """Candles of the regular session since the start of the year."""
    ev = _fx(spark, sf_dir).events.withColumnRenamed("event_type", "tic")
    return B.candles(ev, "YTD", "2024-01-31", "15Min", session="REGULAR", price="value", volume=None, tie="event_id")


@query("srt_04_top_k", f"""WITH {SQL_CHANGE}
SELECT tic, round(change_pct, 6) AS change_pct FROM ch ORDER BY change_pct DESC, tic LIMIT 3""", ("bars_x",))
def srt_04(spark, sf_dir):
    ch = S.change_over(_fx(spark, sf_dir).bars_x, "1996-01-01", "1996-12-31")
    return ch.orderBy(F.col("change_pct").desc(), "tic").limit(3).select(
        "tic", round_half_up("change_pct", 6).alias("change_pct"))


@query("srt_05_page_offset", "SELECT * FROM feed ORDER BY id LIMIT 25 OFFSET 50", ("feed",))
def srt_05(spark, sf_dir):
    return S.page(_fx(spark, sf_dir).feed, ["id"], size=25, number=2)


@query("srt_05_page_keyset", "SELECT * FROM feed WHERE id > 4321 ORDER BY id LIMIT 25", ("feed",))
def srt_05k(spark, sf_dir):
    return S.page(_fx(spark, sf_dir).feed, ["id"], size=25, last_id=4321)


@query("srt_06_first_match", """SELECT tic, doc_id, title FROM (SELECT tic, doc_id, title,
  row_number() OVER (PARTITION BY tic ORDER BY doc_id) AS rk FROM news WHERE contains(lower(title), 'e')) x WHERE rk = 1""",
       ("news",))
def srt_06(spark, sf_dir):
    n = _fx(spark, sf_dir).news.filter(F.lower("title").contains("e")).select("tic", "doc_id", "title")
    return EV.dedupe_first(n, ["tic"], ["doc_id"])


@query("set_01_union_by_name", """
SELECT tic, date, 'train' AS split, prediction, observed FROM preds WHERE date < DATE '1998-01-01'
UNION ALL SELECT tic, date, 'test', prediction, observed FROM preds WHERE date >= DATE '1998-01-01'
UNION ALL SELECT tic, CAST(unnest(generate_series(d + 1, d + 5, INTERVAL 1 DAY)) AS DATE), 'new', NULL, NULL
  FROM (SELECT tic, max(date) AS d FROM preds GROUP BY tic) m""", ("preds",))
def set_01(spark, sf_dir):
    p = _fx(spark, sf_dir).preds
    train = p.filter(F.col("date") < "1998-01-01").withColumn("split", F.lit("train"))
    test = p.filter(F.col("date") >= "1998-01-01").withColumn("split", F.lit("test"))
    new = (p.groupBy("tic").agg(F.max("date").alias("d"))
           .select("tic", F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", 5))).alias("date"))
           .withColumn("split", F.lit("new")))
    u = train.unionByName(test).unionByName(new, allowMissingColumns=True)
    return u.select("tic", "date", "split", "prediction", "observed")


# ---- feed filters / screens --------------------------------------------------------------

@query("flt_07_importance", "SELECT * FROM feed WHERE importance = 3", ("feed",))
def flt_07(spark, sf_dir):
    return S.by_importance(_fx(spark, sf_dir).feed, 3)


@query("flt_08_calendar_query", """SELECT * FROM feed WHERE date >= DATE '2024-01-05' AND date <= DATE '2024-01-20'
  AND ticker IN ('click', 'purchase') AND action = 'Upgrades' AND yield >= 20.0""", ("feed",))
def flt_08(spark, sf_dir):
    return S.calendar_query(_fx(spark, sf_dir).feed, date_from="2024-01-05", date_to="2024-01-20",
                            tickers=["click", "purchase"], action="Upgrades", yield_op="gte", yield_value=20.0)


@query("flt_09_screener", """SELECT * FROM universe WHERE marketcap > 1e10 AND marketcap < 4e10 AND close > 950
  AND sector IN ('PROMO', 'SMALL')""", ("universe",))
def flt_09(spark, sf_dir):
    return S.screener(_fx(spark, sf_dir).universe, cap_gt="10b", cap_lt="40b", close_gt=950,
                      sector_in=["PROMO", "SMALL"],
                      sort="marketcap", direction="desc")


@query("flt_11_autocomplete_symbol", "SELECT * FROM universe WHERE lower(symbol) LIKE 'p12%' ORDER BY symbol LIMIT 10",
       ("universe",))
def flt_11(spark, sf_dir):
    return S.autocomplete(_fx(spark, sf_dir).universe, "P12", "symbol", 10)


@query("flt_11_autocomplete_name", """SELECT * FROM universe WHERE lower(symbol) LIKE 'bo%'
  OR len(list_filter(string_split(lower(name), ' '), lambda w: starts_with(w, 'bo'))) > 0 ORDER BY symbol LIMIT 20""",
       ("universe",))
def flt_11n(spark, sf_dir):
    return S.autocomplete(_fx(spark, sf_dir).universe, "bo", "symbol_name", 20)


@query("flt_11_autocomplete_within", "SELECT * FROM universe WHERE contains(lower(symbol), '77') ORDER BY symbol LIMIT 15",
       ("universe",))
def flt_11w(spark, sf_dir):
    return S.autocomplete(_fx(spark, sf_dir).universe, "77", "symbol_within", 15)


def _looked_up(spark, sf_dir, q, method):
    """Matches of a lookup by the written posting table of the universe."""
    from tessera.sources.sinks import write_table
    from tessera.session import scratch_path
    u = _fx(spark, sf_dir).universe
    path = scratch_path(spark, "lookup")
    write_table(S.lookup_index(u), path)
    return u.join(S.lookup(spark.read.parquet(path), q, method), "symbol", "left_semi")


@query("flt_11_lookup_symbol", "SELECT * FROM universe WHERE starts_with(lower(symbol), 'p12')", ("universe",))
def flt_11_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir, "P12", "symbol")


@query("flt_11_lookup_name", """SELECT * FROM universe WHERE starts_with(lower(symbol), 'bo')
  OR len(list_filter(string_split(lower(name), ' '), lambda w: starts_with(w, 'bo'))) > 0""", ("universe",))
def flt_11_lookup_name(spark, sf_dir):
    return _looked_up(spark, sf_dir, "bo", "symbol_name")


@query("flt_11_lookup_within", "SELECT * FROM universe WHERE contains(lower(symbol), '11')", ("universe",))
def flt_11_lookup_within(spark, sf_dir):
    return _looked_up(spark, sf_dir, "11", "symbol_within")


@query("flt_12_ticker_selection", """SELECT * FROM bars_d WHERE tic IN ('1-URGENT', '3-MEDIUM', '5-LOW')""", ("bars_d",))
def flt_12(spark, sf_dir):
    return _fx(spark, sf_dir).bars_d.filter(F.col("tic").isin("1-URGENT", "3-MEDIUM", "5-LOW"))


@query("src_04_load_bars", """SELECT tic, date, open, high, low, close, volume, CAST(isodow(date) - 1 AS INT) AS day
FROM bars_d WHERE tic IN ('1-URGENT', '3-MEDIUM', '5-LOW') AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01'""",
       ("bars_d",))
def src_04(spark, sf_dir):
    from tessera.sources.readers import load_bars
    return load_bars(_fx(spark, sf_dir).bars_d.drop("day"), ["1-URGENT", "3-MEDIUM", "5-LOW"], "1996-01-01",
                     "1998-01-01")


@query("str_f6_named_interval", """
SELECT tic, date_trunc('day', ts) AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low,
  max_by(close, ts) AS close, sum(volume) AS volume FROM bars_h GROUP BY tic, date_trunc('day', ts)""", ("bars_h",))
def str_f6(spark, sf_dir):
    """Bars at a vendor-style interval name ('1D' -> '1d'); unknown names raise."""
    return B.resample(_fx(spark, sf_dir).bars_h, "1D", ohlc_in=True)
