"""Registered queries: scalar functions, projections, filters and quality checks
(STR-F*, DAT-F*, MTH-F*, ARR-F1, JSN-F1, PRJ-*, FLT-01..06, QLT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates as DT
from tessera.functions import text as TX
from tessera.functions.numeric import round_half_even, round_half_up
from tessera.operators import clean as C
from tessera.plans import daily as D
from tessera.plans.fixtures import Fixtures
from tessera.plans.oracle_fixtures import sql_round_even as RE
from tessera.plans.registry import query

WS = TX.WS_CLASS


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


# ---- text -----------------------------------------------------------------------------

@query("str_f1_normalise_text",
       f"SELECT doc_id, trim(regexp_replace(replace(text, '\"', ''), '{WS}', ' ', 'g')) AS text FROM documents")
def str_f1(spark, sf_dir):
    return _fx(spark, sf_dir).documents.select("doc_id", TX.normalise_text("text").alias("text"))


SQL_STRIP = (f"regexp_replace(regexp_replace(html, '{TX.HTML_DROP}', '', 'g'), '{TX.HTML_TAG_SQL}', '', 'g')")


@query("str_f2_html_strip_tags",
       f"SELECT page_id, trim(regexp_replace(replace({SQL_STRIP}, '\"', ''), '{WS}', ' ', 'g')) AS text FROM pages")
def str_f2(spark, sf_dir):
    return _fx(spark, sf_dir).pages.select(
        "page_id", TX.html_to_text("html", decode_entities=False).alias("text"))


@query("str_f2_html_to_text", f"SELECT page_id, {TX.html_text_sql('html')} AS text FROM pages")
def str_f2_full(spark, sf_dir):
    """Tags removed and entities decoded (Arrow UDF for the entity table)."""
    return _fx(spark, sf_dir).pages.select("page_id", TX.html_to_text("html").alias("text"))


@query("str_f3_truncate_words", f"""
SELECT doc_id, CASE WHEN len(w) > 1500 THEN array_to_string(w[1:1500], ' ') || '...' ELSE text END AS text
FROM (SELECT doc_id, text, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, ' ') END AS w
      FROM (SELECT doc_id, text, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS t FROM documents) a) b""")
def str_f3(spark, sf_dir):
    return _fx(spark, sf_dir).documents.select("doc_id", TX.truncate_words("text", 1500).alias("text"))


@query("str_f4_format_prompt", f"""SELECT doc_id, printf('{TX.PROMPT_TEMPLATE}', title, body) AS prompt FROM news""",
       ("news",))
def str_f4(spark, sf_dir):
    return _fx(spark, sf_dir).news.select("doc_id", TX.format_prompt("title", "body").alias("prompt"))


@query("str_f5_string_basics", """
SELECT doc_id, contains(benz_rate, 'AI language model') AS refused, CAST(length(body) AS INT) AS n_chars,
  trim(title) AS title, substr(body, 1, 10) AS head10, concat_ws(':', tic, strftime(created, '%Y-%m-%d')) AS tag
FROM news""", ("news",))
def str_f5(spark, sf_dir):
    n = _fx(spark, sf_dir).news
    return n.select("doc_id", F.col("benz_rate").contains("AI language model").alias("refused"),
                    F.length("body").alias("n_chars"), F.trim("title").alias("title"),
                    F.substring("body", 1, 10).alias("head10"),
                    F.concat_ws(":", "tic", DT.iso("created")).alias("tag"))


@query("str_f7_parse_amount", """
SELECT symbol_id, txt, CASE WHEN suf = 'k' THEN num * 1e3 WHEN suf = 'm' THEN num * 1e6 WHEN suf = 'b' THEN num * 1e9
  ELSE num END AS amount
FROM (SELECT symbol_id, txt, CAST(regexp_extract(txt, '^([0-9]+)([kmbt]?)$', 1) AS DOUBLE) AS num,
        regexp_extract(txt, '^([0-9]+)([kmbt]?)$', 2) AS suf
      FROM (SELECT p_partkey AS symbol_id, CAST(p_size AS VARCHAR) || CASE p_size % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'm'
              WHEN 2 THEN 'b' ELSE '' END AS txt FROM part) a) b""")
def str_f7(spark, sf_dir):
    p = _fx(spark, sf_dir).part
    suf = (F.when(F.col("p_size") % 4 == 0, "k").when(F.col("p_size") % 4 == 1, "m")
           .when(F.col("p_size") % 4 == 2, "b").otherwise(""))
    t = p.select(F.col("p_partkey").alias("symbol_id"), F.concat(F.col("p_size").cast("string"), suf).alias("txt"))
    return t.select("symbol_id", "txt", TX.parse_amount("txt").alias("amount"))


# ---- dates ------------------------------------------------------------------------------

@query("dat_f1_date_parts", """
SELECT tic, date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS dom,
  CAST(isodow(date) - 1 AS INT) AS dow FROM bars_d""", ("bars_d",))
def dat_f1(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d
    return b.select("tic", "date", *[c.alias(k) for k, c in DT.date_parts("date").items()])


@query("dat_f2_add_days", """SELECT tic, date, date + 30 AS plus30, date - 1 AS minus1,
  CAST(date + 180 AS DATE) AS plus180 FROM bars_d""", ("bars_d",))
def dat_f2(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d
    return b.select("tic", "date", DT.add_days("date", 30).alias("plus30"), DT.add_days("date", -1).alias("minus1"),
                    DT.add_days("date", 180).alias("plus180"))


@query("dat_f3_iso_format_parse", """SELECT id, strftime(date, '%Y-%m-%d') AS iso,
  CAST(strftime(date, '%Y-%m-%d') AS DATE) AS parsed FROM feed""", ("feed",))
def dat_f3(spark, sf_dir):
    f = _fx(spark, sf_dir).feed
    return f.select("id", DT.iso("date").alias("iso"), F.to_date(DT.iso("date")).alias("parsed"))


@query("dat_f4_session_minutes", """
SELECT date, CAST(timezone('UTC', timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE))
  + to_minutes(CAST(m AS BIGINT)) AS TIMESTAMP) AS minute_utc
FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) <= 5) d, range(390) r(m)""")
def dat_f4(spark, sf_dir):
    d = (_fx(spark, sf_dir).events.select(F.col("ts").cast("date").alias("date")).filter(DT.is_weekday("date"))
         .distinct())
    return d.select("date", F.explode(DT.session_minutes("date")).alias("minute_utc"))


@query("dat_f4_daily_range", """
SELECT tic, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT tic, min(date) AS lo, max(date) AS hi FROM bars_d GROUP BY tic) t""", ("bars_d",))
def dat_f4_days(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.groupBy("tic").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return b.select("tic", F.explode(DT.daily_range("lo", "hi")).alias("date"))


SQL_HOLIDAYS = "(" + ", ".join(f"DATE '{h}'" for h in DT.HOLIDAYS) + ")"


@query("dat_f5_session_calendar", f"""
SELECT tic, date FROM (
  SELECT tic, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT tic, min(date) AS lo, max(date) AS hi FROM bars_d GROUP BY tic) t) d
WHERE isodow(date) <= 5 AND date NOT IN {SQL_HOLIDAYS}""", ("bars_d",))
def dat_f5(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.groupBy("tic").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = b.select("tic", F.explode(DT.daily_range("lo", "hi")).alias("date"))
    return DT.sessions_of(days, spark)


@query("ml_11_future_sessions", f"""
SELECT tic, start, CAST(k AS INT) AS k, date FROM (
  SELECT tic, start, date, row_number() OVER (PARTITION BY tic, start ORDER BY date) AS k FROM (
    SELECT tic, start, CAST(unnest(generate_series(start + 1, start + 374, INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT tic, max(date) AS start FROM bars_d GROUP BY tic) s) c
  WHERE isodow(date) <= 5 AND date NOT IN {SQL_HOLIDAYS}) r
WHERE k <= 180""", ("bars_d",))
def ml_11(spark, sf_dir):
    """Next 180 sessions after each ticker's last bar (prediction dates)."""
    last = _fx(spark, sf_dir).bars_d.groupBy("tic").agg(F.max("date").alias("date"))
    return DT.next_sessions(last, spark, 180)


@query("dat_f6_relative_ranges", """
SELECT tic, today, CAST(date_trunc('year', today) AS DATE) AS ytd, today - 5 AS d5, CAST(today - INTERVAL 1 MONTH AS DATE) AS m1,
  today - 7 AS w1, CAST(today - INTERVAL 1 YEAR AS DATE) AS y1
FROM (SELECT tic, max(date) AS today FROM bars_d GROUP BY tic) t""", ("bars_d",))
def dat_f6(spark, sf_dir):
    t = _fx(spark, sf_dir).bars_d.groupBy("tic").agg(F.max("date").alias("today"))
    return t.select("tic", "today", DT.resolve_start("YTD", "today").alias("ytd"),
                    DT.resolve_start("5d", "today").alias("d5"), DT.resolve_start("1m", "today").alias("m1"),
                    DT.resolve_start("-1W", "today").alias("w1"), DT.resolve_start("1y", "today").alias("y1"))


@query("prj_08_day_ordinal", """SELECT tic, date, CAST(date - DATE '1970-01-01' AS INT) AS days,
  DATE '1970-01-01' + CAST(date - DATE '1970-01-01' AS INT) AS back FROM bars_d""", ("bars_d",))
def prj_08(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d
    return b.select("tic", "date", C.day_ordinal("date").alias("days"),
                    C.from_day_ordinal(C.day_ordinal("date")).alias("back"))


# ---- math --------------------------------------------------------------------------------

@query("mth_f1_cyclic_dates", """
SELECT tic, date, round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos,
  round(sin(2 * pi() * day(date) / 31), 6) AS day_of_month_sin, round(cos(2 * pi() * day(date) / 31), 6) AS day_of_month_cos,
  round(sin(2 * pi() * day / 5), 6) AS day_of_week_sin, round(cos(2 * pi() * day / 5), 6) AS day_of_week_cos
FROM bars_d""", ("bars_d",))
def mth_f1(spark, sf_dir):
    d = DT.cyclic_dates(_fx(spark, sf_dir).bars_d)
    cols = ["month_sin", "month_cos", "day_of_month_sin", "day_of_month_cos", "day_of_week_sin", "day_of_week_cos"]
    return d.select("tic", "date", *[round_half_up(c, 6).alias(c) for c in cols])


@query("mth_f2_numeric_checks", """
SELECT tic, date, round(abs(prediction - observed), 4) AS abs_err, coalesce(isnan(prediction), false) AS is_nan, isinf(prediction) AS is_inf,
  prediction = 0 AS is_zero,
  round((observed - min(observed) OVER (PARTITION BY tic)) / (max(observed) OVER (PARTITION BY tic) - min(observed) OVER (PARTITION BY tic)), 6) AS scaled
FROM preds""", ("preds",))
def mth_f2(spark, sf_dir):
    p = _fx(spark, sf_dir).preds
    ext = p.groupBy("tic").agg(F.min("observed").alias("_lo"), F.max("observed").alias("_hi"))
    p = p.join(ext, "tic")
    lo, hi = F.col("_lo"), F.col("_hi")
    return p.select("tic", "date", round_half_up(F.abs(F.col("prediction") - F.col("observed")), 4).alias("abs_err"),
                    F.isnan("prediction").alias("is_nan"),
                    (F.abs(F.col("prediction")) == F.lit(float("inf"))).alias("is_inf"),
                    (F.col("prediction") == 0).alias("is_zero"),
                    round_half_up((F.col("observed") - lo) / (hi - lo), 6).alias("scaled"))


# ---- arrays and json --------------------------------------------------------------------

@query("arr_f1_side_by_side", """
SELECT date, list(tic ORDER BY tic) AS tics, list(close ORDER BY tic) AS closes, list(volume ORDER BY tic) AS volumes
FROM bars_x GROUP BY date""", ("bars_x",))
def arr_f1(spark, sf_dir):
    """Per date, the tickers' values side by side (arrays ordered by ticker).  One group
    per date holds one entry per ticker of the universe, so its size is bounded."""
    b = _fx(spark, sf_dir).bars_x
    g = b.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("tic", "close", "volume"))).alias("a"))
    return g.select("date", F.col("a.tic").alias("tics"), F.col("a.close").alias("closes"),
                    F.col("a.volume").alias("volumes"))


@query("jsn_f1_json_paths", """
SELECT id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.missing') IS NOT NULL AS has_missing
FROM feed""", ("feed",))
def jsn_f1(spark, sf_dir):
    f = _fx(spark, sf_dir).feed
    s = F.from_json("props", "k INT")
    return f.select("id", F.get_json_object("props", "$.k").alias("k_text"), s["k"].alias("k"),
                    F.get_json_object("props", "$.k").isNotNull().alias("has_k"),
                    F.get_json_object("props", "$.missing").isNotNull().alias("has_missing"))


# ---- projections -------------------------------------------------------------------------

@query("prj_01_select_drop", "SELECT tic, date, observed FROM preds", ("preds",))
def prj_01(spark, sf_dir):
    return C.drop_cols(C.select_cols(_fx(spark, sf_dir).preds, ["tic", "date", "prediction", "observed"]),
                       ["prediction"])


@query("prj_02_rename", """SELECT tic, date AS day_date, open AS o, high AS h, low AS l, close AS c, volume AS v,
  day AS dow FROM bars_d""", ("bars_d",))
def prj_02(spark, sf_dir):
    b = C.rename(_fx(spark, sf_dir).bars_d, {"open": "o", "high": "h", "low": "l", "close": "c"})
    return C.rename(b, ["tic", "day_date", "o", "h", "l", "c", "v", "dow"])


@query("prj_03_derived_columns", """SELECT tic, date, close, high - low AS spread, 'bars' AS source,
  close AS adj_close FROM bars_d""", ("bars_d",))
def prj_03(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d
    d = b.withColumns({"spread": F.col("high") - F.col("low"), "source": F.lit("bars"),
                       "adj_close": F.col("close")})
    return d.select("tic", "date", "close", "spread", "source", "adj_close")


@query("prj_04_parse_dates", """
SELECT id, CAST(txt AS DATE) AS strict_date, TRY_CAST(lenient AS DATE) AS lenient_date
FROM (SELECT id, strftime(date, '%Y-%m-%d') AS txt,
        CASE WHEN id % 3 = 0 THEN 'not a date ' || CAST(id AS VARCHAR) ELSE strftime(date, '%Y-%m-%d') END AS lenient
      FROM feed) f""", ("feed",))
def prj_04(spark, sf_dir):
    f = _fx(spark, sf_dir).feed
    t = f.select("id", DT.iso("date").alias("txt"),
                 F.when(F.col("id") % 3 == 0, F.concat(F.lit("not a date "), F.col("id").cast("string")))
                 .otherwise(DT.iso("date")).alias("lenient"))
    return t.select("id", C.parse_date("txt", strict=True).alias("strict_date"),
                    C.parse_date("lenient", strict=False).alias("lenient_date"))


@query("prj_05_parse_rating", """SELECT doc_id, benz_rate,
  TRY_CAST(trunc(TRY_CAST(trim(benz_rate) AS DOUBLE)) AS INTEGER) AS rating FROM news""", ("news",))
def prj_05(spark, sf_dir):
    n = _fx(spark, sf_dir).news
    return n.select("doc_id", "benz_rate", C.parse_rating("benz_rate").alias("rating"))


@query("prj_06_round_even", f"""
SELECT symbol_id, symbol, {RE('close * 1.23456789', 3)} AS px, {RE('marketcap / 7.0', 3)} AS cap7,
  {RE('close / 3.0', 3)} AS third FROM universe""", ("universe",))
def prj_06(spark, sf_dir):
    u = _fx(spark, sf_dir).universe
    t = u.select("symbol_id", "symbol", (F.col("close") * 1.23456789).alias("px"),
                 (F.col("marketcap") / 7.0).alias("cap7"), (F.col("close") / 3.0).alias("third"))
    return C.round_even(t, 3, exclude=("symbol_id",))


# ---- filters -----------------------------------------------------------------------------

@query("flt_01_drop_nulls", """SELECT doc_id, tic, created, benz_rate FROM news WHERE benz_rate IS NOT NULL""",
       ("news",))
def flt_01(spark, sf_dir):
    n = _fx(spark, sf_dir).news.select("doc_id", "tic", "created", "benz_rate")
    return C.drop_nulls(n, ["benz_rate"])


@query("flt_01_drop_any_null", """SELECT * FROM earnings WHERE tic IS NOT NULL AND fiscalDateEnding IS NOT NULL
  AND reportedDate IS NOT NULL AND reportedEPS IS NOT NULL AND estimatedEPS IS NOT NULL AND surprise IS NOT NULL""",
       ("earnings",))
def flt_01_any(spark, sf_dir):
    return C.drop_nulls(_fx(spark, sf_dir).earnings)


@query("flt_03_date_window", """SELECT tic, date, close FROM bars_d
  WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""", ("bars_d",))
def flt_03(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d
    return b.filter(C.date_window("date", "1996-01-01", "1996-12-31")).select("tic", "date", "close")


@query("flt_04_05_blank_ratings", """
SELECT doc_id, CASE WHEN length(r1) <= 4 THEN r1 END AS benz_rate
FROM (SELECT doc_id, CASE WHEN NOT coalesce(contains(benz_rate, 'AI language model'), false) THEN benz_rate END AS r1
      FROM news) n""", ("news",))
def flt_04_05(spark, sf_dir):
    n = _fx(spark, sf_dir).news
    return n.select("doc_id", C.blank_long(C.blank_refusals("benz_rate"), 4).alias("benz_rate"))


@query("flt_06_split_labelled", """
SELECT d.doc_id, l.quality, l.quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def flt_06(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    d = fx.documents.select("doc_id").join(fx.labels.select("doc_id", "quality"), "doc_id", "left")
    lab, unl = C.split_labelled(d, "quality")
    return lab.withColumn("labelled", F.lit(True)).unionByName(unl.withColumn("labelled", F.lit(False)))


_FLT02_FEATS = ["macd", "kdjk", "kdjd", "kdjj", "rsi", "ma50", "ma200", "vix", "TLT", "IEF", "SHY"]
_FLT02_BAD = " OR ".join(f"{c} IS NULL OR isnan({c}) OR isinf({c})" for c in _FLT02_FEATS)
_FLT02_ZERO = " OR ".join(f"{c} = 0" for c in _FLT02_FEATS)


def _flt02_sql():
    from tessera.plans.q_windows import SQL_IND
    w = "OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return SQL_IND + f""", vix AS (SELECT date, close AS vix FROM bars_d WHERE tic = '5-LOW'),
bonds AS (SELECT date, max(CASE WHEN tic = '1-URGENT' THEN close END) AS TLT,
            max(CASE WHEN tic = '2-HIGH' THEN close END) AS IEF, max(CASE WHEN tic = '3-MEDIUM' THEN close END) AS SHY
          FROM bars_d WHERE tic IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY date),
e AS (SELECT i.*, v.vix, o.TLT, o.IEF, o.SHY FROM ind i LEFT JOIN vix v ON i.date = v.date LEFT JOIN bonds o ON i.date = o.date),
en AS (SELECT tic, date, j, {", ".join(f"{RE(c, 3)} AS {c}" for c in _FLT02_FEATS[:7])},
  {", ".join(f"{RE(f'last_value({c} IGNORE NULLS) {w}', 3)} AS {c}" for c in _FLT02_FEATS[7:])} FROM e)
SELECT tic, date FROM en WHERE NOT ({_FLT02_BAD} OR (j < 10 AND coalesce({_FLT02_ZERO}, false)))"""


@query("flt_02_drop_invalid", _flt02_sql(), ("bars_d",))
def flt_02(spark, sf_dir):
    """Enriched bars minus rows with NaN/inf/null features or a zero in the warm-up
    rows (macd is 0 on each ticker's first row)."""
    from tessera.plans.q_daily import _stand_in_dims
    fx = _fx(spark, sf_dir)
    vix, bonds = _stand_in_dims(fx)
    e = D.enrich_bars(fx.bars_d, vix, bonds)
    return D.clean_bars(e).select("tic", "date")


@query("pipe_02_clean_bars", _flt02_sql().replace("SELECT tic, date FROM en WHERE", "SELECT en.tic, en.date, b.close, b.volume, b.day, en.macd, en.rsi "
                                                  "FROM en JOIN bars_d b ON en.tic = b.tic AND en.date = b.date WHERE"), ("bars_d",))
def pipe_02(spark, sf_dir):
    """Enriched bars without open, high and low, and without rows whose indicators are invalid."""
    from tessera.plans.q_daily import _stand_in_dims
    fx = _fx(spark, sf_dir)
    d = D.clean_bars(D.enrich_bars(fx.bars_d, *_stand_in_dims(fx)))
    return d.select("tic", "date", F.round("close", 6).alias("close"), "volume", "day", "macd", "rsi")


# ---- quality ------------------------------------------------------------------------------

CONTRACT = {"id": "bigint", "date": "date", "ticker": "string", "importance": "int", "yield": "double",
            "props": "int", "absent_col": "string"}


@query("qlt_01_check_contract", """
SELECT * FROM (VALUES ('id', 'bigint', true, (SELECT count(*) FILTER (WHERE id IS NOT NULL AND TRY_CAST(CAST(id AS VARCHAR) AS BIGINT) IS NULL) FROM feed)),
  ('date', 'date', true, (SELECT count(*) FILTER (WHERE date IS NOT NULL AND TRY_CAST(CAST(date AS VARCHAR) AS DATE) IS NULL) FROM feed)),
  ('ticker', 'string', true, CAST(0 AS BIGINT)),
  ('importance', 'int', true, (SELECT count(*) FILTER (WHERE importance IS NOT NULL AND TRY_CAST(CAST(importance AS VARCHAR) AS INTEGER) IS NULL) FROM feed)),
  ('yield', 'double', true, (SELECT count(*) FILTER (WHERE yield IS NOT NULL AND TRY_CAST(CAST(yield AS VARCHAR) AS DOUBLE) IS NULL) FROM feed)),
  ('props', 'int', true, (SELECT count(*) FILTER (WHERE props IS NOT NULL AND TRY_CAST(props AS INTEGER) IS NULL) FROM feed)),
  ('absent_col', 'string', false, CAST(0 AS BIGINT))) t("column", declared, present, violations)""", ("feed",))
def qlt_01(spark, sf_dir):
    return C.check_contract(_fx(spark, sf_dir).feed, CONTRACT)


@query("qlt_02_null_profile", """
SELECT * FROM (VALUES ('tic', (SELECT count(*) FILTER (WHERE tic IS NULL) FROM earnings)),
  ('fiscalDateEnding', (SELECT count(*) FILTER (WHERE fiscalDateEnding IS NULL) FROM earnings)),
  ('reportedDate', (SELECT count(*) FILTER (WHERE reportedDate IS NULL) FROM earnings)),
  ('reportedEPS', (SELECT count(*) FILTER (WHERE reportedEPS IS NULL) FROM earnings)),
  ('estimatedEPS', (SELECT count(*) FILTER (WHERE estimatedEPS IS NULL) FROM earnings)),
  ('surprise', (SELECT count(*) FILTER (WHERE surprise IS NULL) FROM earnings))) t("column", nulls)""", ("earnings",))
def qlt_02(spark, sf_dir):
    return C.null_profile(_fx(spark, sf_dir).earnings)


@query("qlt_03_shape", "SELECT count(*) AS n_rows, 8 AS n_cols FROM bars_d", ("bars_d",))
def qlt_03(spark, sf_dir):
    return C.shape(_fx(spark, sf_dir).bars_d)


@query("qlt_03_head_snapshot", "SELECT * FROM bars_d ORDER BY tic, date LIMIT 5", ("bars_d",))
def qlt_03_head(spark, sf_dir):
    return C.snapshot(_fx(spark, sf_dir).bars_d, ["tic", "date"], 5)


@query("qlt_04_distinct_values", "SELECT DISTINCT benz_rate FROM news", ("news",))
def qlt_04(spark, sf_dir):
    return C.distinct_values(_fx(spark, sf_dir).news, "benz_rate")
