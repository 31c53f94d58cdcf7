"""Registered queries: streaming re-aims (STM-01..05), sources (SRC-*) and sinks (SNK-*).

Streaming queries drain the whole table with ``availableNow`` into a sink under the
checkpoint dir and return the sink read back.  Bars (STM-02/03) and keyed state (STM-04)
have oracle SQL for the final state of the stream; de-duplication within the watermark
(STM-01, which copy survives is arrival order) and the injected scorer (STM-05) are
rows-only and compared with the batch operators in the tests.  Sink queries write and
read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.functions.numeric import round_half_up
from tessera.operators import screen as S
from tessera.plans import daily as D
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query
from tessera.sources import feeds as FD
from tessera.sources import readers as RD
from tessera.sources import sinks as SK
from tessera.plans.q_model import lexicon_sql
from tessera.streaming import blocks as BL
from tessera.streaming import streams as ST

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def _news_expr(d):
    """Fixture E's row-wise definition, applied to a streaming documents frame."""
    k = F.col("doc_id")
    tic = (F.when(k % 5 == 0, "1-URGENT").when(k % 5 == 1, "2-HIGH").when(k % 5 == 2, "3-MEDIUM")
           .when(k % 5 == 3, "4-NOT SPECIFIED").otherwise("5-LOW"))
    offs = (((k * 7) % 200) * 12 + F.floor(k / 400) % 3).cast("int")
    return d.select("doc_id", tic.alias("tic"), F.date_add(F.lit("1995-01-01").cast("date"), offs).alias("created"),
                    F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), F.col("text").alias("body"))


@query("stm_01_stream_news_dedupe", None)
def stm_01(spark, sf_dir):
    s = _news_expr(ST.file_stream(spark, sf_dir, "documents", DOCS_SCHEMA))
    path = ST.scratch(spark, "stm01")
    ST.run_available_now(ST.stream_news(s), path)
    return spark.read.parquet(path + "/out").select("doc_id", "tic", "created", "title")


@query("stm_01_stream_news_keys", "SELECT DISTINCT created, title FROM news", ("news",))
def stm_01_keys(spark, sf_dir):
    """The (created, title) that the stream let through: each once, as in the batch form."""
    return stm_01(spark, sf_dir).select("created", "title")


# One landed file per table: the stream runs one data batch, then a no-data batch moves
# the watermark to max(ts) - 10 minutes and closes every window that ends by then.
SQL_STREAM_BARS = """SELECT event_type AS tic, date_trunc('hour', ts) AS ts, min_by(value, ts) AS open, max(value) AS high,
  min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@query("stm_02_stream_bars", SQL_STREAM_BARS)
def stm_02(spark, sf_dir):
    s = ST.file_stream(spark, sf_dir, "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    path = ST.scratch(spark, "stm02")
    ST.run_available_now(ST.stream_bars(s, "1 hour", "10 minutes"), path)
    return spark.read.parquet(path + "/out")


@query("stm_03_stream_enrich", f"""WITH b AS ({SQL_STREAM_BARS}),
st AS (SELECT CAST(ts AS DATE) AS date, count(*) AS day_events, avg(value) AS day_mean FROM events GROUP BY 1)
SELECT b.*, CAST(b.ts AS DATE) AS date, st.day_events, st.day_mean FROM b LEFT JOIN st ON CAST(b.ts AS DATE) = st.date""")
def stm_03(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    static = (fx.events.groupBy(F.col("ts").cast("date").alias("date"))
              .agg(F.count(F.lit(1)).alias("day_events"), F.avg("value").alias("day_mean")))
    s = ST.file_stream(spark, sf_dir, "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    path = ST.scratch(spark, "stm03")
    ST.run_available_now(ST.stream_enrich(ST.stream_bars(s, "1 hour", "10 minutes"), static), path)
    return spark.read.parquet(path + "/out")


def _stories(d):
    """Stories with a time of publication among the events, from a documents frame."""
    kinds = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return d.select(F.col("doc_id").alias("story_id"), kinds[(F.col("doc_id") % len(EVENT_TYPES)).cast("int")].alias("tic"),
                    (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") * 37 % 43200).cast("int"))).alias("published"))


# The five event types, the tickers of the intraday bars.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SQL_STORIES = """SELECT doc_id AS story_id, (['click', 'error', 'purchase', 'signup', 'view'])[doc_id % 5 + 1] AS tic,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 37 % 43200 AS INT)) AS published FROM documents"""


@query("stm_03_stream_reports", f"""WITH s AS ({SQL_STORIES}),
wm AS (SELECT least((SELECT max(ts) FROM events) - INTERVAL 10 MINUTE, (SELECT max(published) FROM s) - INTERVAL 2 HOUR) AS wm)
SELECT e.event_id, e.event_type AS tic, e.ts, s.story_id, s.published FROM events e
LEFT JOIN s ON s.tic = e.event_type AND e.ts >= s.published AND e.ts <= s.published + INTERVAL 1 HOUR
WHERE s.story_id IS NOT NULL OR e.ts <= (SELECT wm FROM wm)""")
def stm_03_reports(spark, sf_dir):
    """Every event with the stories of the hour before it, both as streams that may be late."""
    events = ST.file_stream(spark, sf_dir, "events", EVENTS_SCHEMA).select("event_id", F.col("event_type").alias("tic"), "ts")
    stories = _stories(ST.file_stream(spark, sf_dir, "documents", DOCS_SCHEMA))
    path = ST.scratch(spark, "stm03r")
    ST.run_available_now(ST.stream_reports(events, stories, packed=True), path)
    return ST.unpack_reports(spark.read.parquet(path + "/out"))


@query("stm_04_stream_state", """WITH RECURSIVE b AS (
  SELECT event_type AS tic, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS j FROM events),
r AS (SELECT tic, j, ts, value, value AS last_known, CAST(coalesce(value, 0.0) AS DOUBLE) AS num,
        CAST(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS den FROM b WHERE j = 1
  UNION ALL
  SELECT b.tic, b.j, b.ts, b.value, coalesce(b.value, r.last_known), (1.0 - 2.0 / 13) * r.num + coalesce(b.value, 0.0),
    (1.0 - 2.0 / 13) * r.den + CASE WHEN b.value IS NULL THEN 0.0 ELSE 1.0 END
  FROM r JOIN b ON b.tic = r.tic AND b.j = r.j + 1)
SELECT tic, ts, value, last_known, CASE WHEN den > 0 THEN num / den END AS ema FROM r""")
def stm_04(spark, sf_dir):
    s = ST.file_stream(spark, sf_dir, "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    path = ST.scratch(spark, "stm04")
    ST.run_available_now(ST.stream_state(s), path)
    # back to the wall-clock type of the input
    return spark.read.parquet(path + "/out").drop("batch_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stm_04_block_state", """WITH RECURSIVE b AS (
  SELECT event_type AS tic, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS j FROM events),
r AS (SELECT tic, j, ts, value, value AS last_known, CAST(coalesce(value, 0.0) AS DOUBLE) AS num,
        CAST(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS den FROM b WHERE j = 1
  UNION ALL
  SELECT b.tic, b.j, b.ts, b.value, coalesce(b.value, r.last_known), (1.0 - 2.0 / 13) * r.num + coalesce(b.value, 0.0),
    (1.0 - 2.0 / 13) * r.den + CASE WHEN b.value IS NULL THEN 0.0 ELSE 1.0 END
  FROM r JOIN b ON b.tic = r.tic AND b.j = r.j + 1)
SELECT tic, ts, value, last_known, CASE WHEN den > 0 THEN num / den END AS ema FROM r
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stm_04_blocks(spark, sf_dir):
    """The same from state store blocks of a day, for all days that have closed."""
    s = ST.file_stream(spark, sf_dir, "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    d = BL.run_blocks(s, ST.scratch(spark, "stm04b"), block_seconds=86400)
    return d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stm_05_stream_rate", f"""SELECT doc_id, {lexicon_sql('body')} AS rating, 0 AS batch_id FROM news""", ("news",))
def stm_05(spark, sf_dir):
    s = _news_expr(ST.file_stream(spark, sf_dir, "documents", DOCS_SCHEMA))
    path = ST.scratch(spark, "stm05")
    ST.run_available_now(s, path, foreach_batch=ST.rate_batches(path))
    return spark.read.parquet(path + "/out")


# ---- sources -----------------------------------------------------------------------------

@query("src_01_read_table", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def src_01(spark, sf_dir):
    return RD.read_table(spark, f"{sf_dir}/orders.parquet",
                         "o_orderkey bigint, o_orderdate timestamp_ntz, o_totalprice double")


@query("src_02_read_optional", """SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS missing_value FROM region""")
def src_02(spark, sf_dir):
    present = RD.read_optional(spark, f"{sf_dir}/region.parquet")
    absent = RD.read_optional(spark, f"{sf_dir}/no_such_source.parquet")
    out = present.select("r_regionkey", "r_name")
    if absent is None:
        out = RD.null_columns(out, "missing_value double")
    return out


@query("src_03_read_by_ticker", "SELECT r_regionkey, r_name, 'region' AS tic FROM region")
def src_03(spark, sf_dir):
    return RD.read_by_ticker(spark, f"{sf_dir}/regio*.parquet").select("r_regionkey", "r_name", "tic")


@query("src_05_explode_payload", """
SELECT event_id, r.k AS k FROM (SELECT event_id,
  unnest(from_json(CASE WHEN event_id % 10 = 0 THEN '{"other": []}' ELSE '{"items": [' || props || ']}' END,
                   '{"items": [{"k": "INTEGER"}]}').items) AS r FROM events) x""")
def src_05(spark, sf_dir):
    ev = _fx(spark, sf_dir).events
    p = ev.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit('{"other": []}'))
                  .otherwise(F.concat(F.lit('{"items": ['), F.col("props"), F.lit("]}"))).alias("payload"))
    return RD.explode_payload(p, "payload", "items", "k: int", keep=["event_id"]).filter(F.col("k").isNotNull())


@query("src_06_load_news", f"""
SELECT TRY_CAST(CAST(created AS VARCHAR) AS DATE) AS created, replace(title, '"', '') AS title,
  {TX.html_text_sql('body')} AS body FROM news""", ("news",))
def src_06(spark, sf_dir):
    return RD.load_news(_fx(spark, sf_dir).news)


@query("src_06_load_news_html", f"""
SELECT DATE '2024-01-01' AS created, url AS title, {TX.html_text_sql('html')} AS body FROM pages""")
def src_06_html(spark, sf_dir):
    """Story bodies as web pages: tags removed, character references decoded."""
    p = _fx(spark, sf_dir).table("pages")
    return RD.load_news(p.select(F.lit("2024-01-01").alias("created"), F.col("url").alias("title"), F.col("html").alias("body")))


def _feed_values(schema: str) -> list[tuple[str, str, str]]:
    """(field, Spark SQL, DuckDB SQL) of a value for every field, derived from the feed rows."""
    out = []
    for field, kind in (f.split(None, 1) for f in schema.split(", ")):
        name = field.rstrip(":")
        one, duck = {
            "int": ("importance", "importance"), "bigint": ("CAST(id * 10 AS BIGINT)", "CAST(id * 10 AS BIGINT)"),
            "double": ("CAST(id AS DOUBLE) / 4", "CAST(id AS DOUBLE) / 4"), "boolean": ("importance > 2", "importance > 2"),
            "array<string>": ("array(ticker, action)", "[ticker, action]"),
        }.get(kind, (f"concat('{name}-', id)", f"concat('{name}-', id)"))
        out.append((name, one, duck))
    return out


def _feed_query(feed: str, schema: str, key: str | None):
    values = _feed_values(schema)

    def run(spark, sf_dir):
        """Payloads that fill every documented field, typed by the registry: no null is left."""
        rec = F.struct(*[F.expr(one).alias(name) for name, one, _ in values])
        body = F.to_json(F.struct(F.array(rec).alias(key))) if key else F.to_json(F.array(rec))
        return FD.load_feed(_fx(spark, sf_dir).feed.select(body.alias("payload")), feed)

    sql = "SELECT " + ", ".join(f'{duck} AS "{name}"' for name, _, duck in values) + " FROM feed"
    kind = "src_07" if key else "src_10"
    query(f"{kind}_{feed.replace('-', '_')}", sql, ("feed",))(run)


for _name, (_key, _schema) in FD.CALENDAR_FEEDS.items():
    _feed_query(_name, _schema, _key)
for _name in ("security", "logos", "quote"):
    _feed_query(_name, FD.REFERENCE_FEEDS[_name], None)


@query("src_07_calendar_feed", "SELECT " + ", ".join(
    {"id": "CAST(id AS VARCHAR) AS id", "date": "CAST(date AS VARCHAR) AS date", "ticker": "ticker",
     "importance": "importance", "action_company": "action AS action_company",
     "pt_current": "printf('%.2f', yield) AS pt_current"}.get(f, f'CAST(NULL AS {"BIGINT" if f == "updated" else "VARCHAR"}) AS {f}')
    for f in FD.CALENDAR_FIELDS["ratings"][1].split()) + " FROM feed", ("feed",))
def src_07(spark, sf_dir):
    """Ratings-calendar payloads that hold only some of the documented fields."""
    f = _fx(spark, sf_dir).feed
    rec = F.struct(F.col("id").cast("string").alias("id"), F.col("date").cast("string").alias("date"),
                   F.col("ticker"), F.col("importance"), F.col("action").alias("action_company"),
                   F.format_string("%.2f", "yield").alias("pt_current"))
    return FD.load_feed(f.select(F.to_json(F.struct(F.array(rec).alias("ratings"))).alias("payload")), "ratings")


@query("src_08_fundamentals", """SELECT 'valuation-ratios' AS feed, symbol, CAST(NULL AS VARCHAR) AS isin,
  CAST(NULL AS VARCHAR) AS cik, '2024-01-31' AS "asOf", DATE '2024-01-31' AS as_of,
  '{"symbol":"' || symbol || '","asOf":"2024-01-31","sector":"' || sector || '"}' AS record FROM universe""", ("universe",))
def src_08(spark, sf_dir):
    rec = F.to_json(F.struct(F.col("symbol"), F.lit("2024-01-31").alias("asOf"), F.col("sector")))
    return FD.load_fundamentals(_fx(spark, sf_dir).universe.select(F.to_json(F.array(rec)).alias("payload")), "valuation-ratios")


def _fundamentals_query(feed: str):
    def run(spark, sf_dir):
        u = _fx(spark, sf_dir).universe
        rec = F.to_json(F.struct("symbol", F.col("name").alias("isin"), F.col("exchange").alias("cik"),
                                 F.lit("2024-01-31").alias("asOf")))
        return FD.load_fundamentals(u.select(F.to_json(F.array(rec)).alias("payload")), feed)

    query(f"src_08_feed_{feed.replace('-', '_')}", f"""SELECT '{feed}' AS feed, symbol, name AS isin, exchange AS cik,
  '2024-01-31' AS "asOf", DATE '2024-01-31' AS as_of,
  '{{"symbol":"' || symbol || '","isin":"' || name || '","cik":"' || exchange || '","asOf":"2024-01-31"}}' AS record
FROM universe""", ("universe",))(run)


for _name in FD.FUNDAMENTAL_FEEDS:
    _fundamentals_query(_name)


def _fundamental_records(fx):
    """Records of all thirteen feeds, each with attributes of its own: (feed, record)."""
    names = F.array(*[F.lit(f) for f in FD.FUNDAMENTAL_FEEDS])
    i = F.col("symbol_id") % len(FD.FUNDAMENTAL_FEEDS)
    common = [F.col("symbol"), F.lit("2024-01-31").alias("asOf")]
    ratio = F.struct(*common, F.round("close", 2).alias("value"), F.col("symbol_id").alias("count"))
    nested = F.struct(*common, F.struct(F.col("sector").alias("name"), (F.col("symbol_id") % 7).alias("level")).alias("class"),
                      F.array("exchange", "sector").alias("tags"))
    mixed = F.struct(*common, F.when(i % 2 == 0, F.col("symbol_id").cast("string")).otherwise(F.lit("n/a")).alias("score"), (F.col("close") > 1000).alias("large"))
    text = F.when(i < 5, F.to_json(ratio)).when(i < 9, F.to_json(nested)).otherwise(F.to_json(mixed))
    # among the ratios every third record has a text where the others have a number
    text = F.when((i < 5) & (F.col("symbol_id") % 3 == 0), F.regexp_replace(text, '"count":([0-9]+)', '"count":"n$1"')).otherwise(text)
    return fx.universe.select("symbol_id", names[i.cast("int")].alias("feed"), text.alias("record"))


_FEEDS_SQL = "[" + ", ".join(f"'{f}'" for f in FD.FUNDAMENTAL_FEEDS) + "]"


@query("src_08_feed_fields", f"""SELECT DISTINCT ({_FEEDS_SQL})[CAST(symbol_id % 13 + 1 AS INT)] AS feed, f.field, f.type FROM universe, (VALUES
  (0, 'symbol', 'string'), (0, 'asOf', 'string'), (0, 'value', 'double'), (0, 'count', 'string'),
  (1, 'symbol', 'string'), (1, 'asOf', 'string'), (1, 'class', 'struct<level:bigint,name:string>'), (1, 'tags', 'array<string>'),
  (2, 'symbol', 'string'), (2, 'asOf', 'string'), (2, 'score', 'string'), (2, 'large', 'boolean')) f(kind, field, type)
WHERE f.kind = CASE WHEN symbol_id % 13 < 5 THEN 0 WHEN symbol_id % 13 < 9 THEN 1 ELSE 2 END""", ("universe",))
def src_08_fields(spark, sf_dir):
    """The fields of the thirteen fundamentals feeds, inferred from their records."""
    found = FD.infer_fields(_fundamental_records(_fx(spark, sf_dir)), "record", "feed")
    rows = [(feed, n, t) for feed, fields in found.items() for n, t in fields.items()]
    return spark.createDataFrame(rows, "feed string, field string, type string")


@query("src_08_typed_records", """SELECT symbol_id, symbol, '2024-01-31' AS "asOf", round(close, 2) AS value,
  CASE WHEN symbol_id % 3 <> 0 THEN symbol_id END AS count, CASE WHEN symbol_id % 3 = 0 THEN 'n' || symbol_id END AS rescued_count
FROM universe WHERE symbol_id % 13 < 5""", ("universe",))
def src_08_typed(spark, sf_dir):
    """Ratio feeds typed; a count that is no number is rescued as text."""
    r = _fundamental_records(_fx(spark, sf_dir)).filter(F.col("feed").isin(FD.FUNDAMENTAL_FEEDS[:5]))
    d = FD.typed_records(r, "record", {"symbol": "string", "asOf": "string", "value": "double", "count": "bigint"})
    return d.select("symbol_id", "symbol", "asOf", "value", "count", F.col("rescued")["count"].alias("rescued_count"))


@query("src_10_reference_quote", """SELECT symbol, close AS last, CAST(NULL AS DOUBLE) AS previousClose,
  CAST(NULL AS DOUBLE) AS change, CAST(NULL AS DOUBLE) AS changePercent, CAST(NULL AS DOUBLE) AS fiftyDayAveragePrice,
  CAST(NULL AS DOUBLE) AS fiftyTwoWeekHigh, CAST(NULL AS DOUBLE) AS fiftyTwoWeekLow, CAST(trunc(marketcap) AS BIGINT) AS volume
FROM universe""", ("universe",))
def src_10(spark, sf_dir):
    u = _fx(spark, sf_dir).universe
    rec = F.struct(F.col("symbol"), F.col("close").alias("last"), F.col("marketcap").cast("long").alias("volume"))
    p = u.select(F.to_json(F.array(rec)).alias("payload"))
    return FD.load_feed(p, "quote")


@query("src_10_ticker_detail", """SELECT symbol, exchange, sector, industry, marketcap, m.metric, m.value FROM (
  SELECT symbol, exchange, sector, name AS industry, marketcap, unnest([struct_pack(metric := 'close', value := round(cp, 6)),
    struct_pack(metric := 'marketcap', value := round(mp, 6))]) AS m
  FROM (SELECT *, percent_rank() OVER (PARTITION BY sector ORDER BY close) AS cp,
          percent_rank() OVER (PARTITION BY sector ORDER BY marketcap) AS mp FROM universe) r) d""", ("universe",))
def src_10_detail(spark, sf_dir):
    """Ticker details with their peer percentiles, one row per (symbol, metric)."""
    u = S.percentiles(_fx(spark, sf_dir).universe, ["close", "marketcap"], "sector")
    pct = F.array(*[F.struct(F.lit(m).alias("metric"), round_half_up(f"{m}_pctl", 6).alias("value")) for m in ("close", "marketcap")])
    rec = F.struct("symbol", "exchange", "sector", F.col("name").alias("industry"), "marketcap", pct.alias("percentile"))
    d = FD.load_feed(u.select(F.to_json(F.array(rec)).alias("payload")), "ticker-detail")
    return d.select(*[c for c in d.columns if c != "percentile"], F.inline("percentile"))


@query("src_11_load_videos", """SELECT event_id, CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS created FROM events
WHERE CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def src_11(spark, sf_dir):
    ev = _fx(spark, sf_dir).events.select("event_id", F.col("ts").cast("string").alias("publishedAt"))
    return RD.load_videos(ev, "2024-01-05", "2024-01-20").select("event_id", "created")


@query("src_12_macro_series", """SELECT series AS series_id, date, value, CASE series WHEN '1-URGENT' THEN 'NFP'
  WHEN '2-HIGH' THEN 'InterestRate' WHEN '3-MEDIUM' THEN 'UnemploymentRate' END AS name FROM macro_m
  WHERE series IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""", ("macro_m",))
def src_12(spark, sf_dir):
    m = _fx(spark, sf_dir).macro_m.withColumnRenamed("series", "series_id")
    return RD.load_macro_series(m, {"1-URGENT": "NFP", "2-HIGH": "InterestRate", "3-MEDIUM": "UnemploymentRate"})


@query("src_13_resume_scan", """SELECT doc_id, tic, created, CASE WHEN doc_id % 2 = 0 THEN benz_rate END AS benz_rate FROM news""", ("news",))
def src_13(spark, sf_dir):
    """A landed table that holds the ratings of every second story, completed from the raw one."""
    n = _fx(spark, sf_dir).news.select("doc_id", "tic", "created", "benz_rate")
    path = ST.scratch(spark, "src13")
    SK.write_table(n.filter("doc_id % 2 = 0"), path)
    return RD.resume_scan(RD.read_optional(spark, path, fmt="parquet"), n.drop("benz_rate"), on="doc_id")


@query("src_13_resume_scan_first_run", "SELECT doc_id, tic, created, CAST(NULL AS VARCHAR) AS benz_rate FROM news", ("news",))
def src_13_first(spark, sf_dir):
    """No rated table yet: the raw one with an empty rating."""
    n = _fx(spark, sf_dir).news.select("doc_id", "tic", "created")
    return RD.resume_scan(RD.read_optional(spark, f"{sf_dir}/no_such_ratings.parquet"), n, on="doc_id")


# ---- sinks ---------------------------------------------------------------------------------

_SQL_RAT = """SELECT tic, created AS date, round_even(avg(r), 4) AS benz_rate
  FROM (SELECT tic, created, TRY_CAST(trunc(TRY_CAST(trim(benz_rate) AS DOUBLE)) AS INTEGER) AS r FROM news) x
  WHERE r IS NOT NULL GROUP BY tic, created"""


@query("snk_01_write_table_csv", _SQL_RAT, ("news",))
def snk_01(spark, sf_dir):
    r = D.clean_news(_fx(spark, sf_dir).news)
    path = ST.scratch(spark, "snk01")
    SK.write_table(r, path, "csv")
    return RD.read_table(spark, path, "tic string, date date, benz_rate double", fmt="csv")


@query("snk_02_write_by_ticker", _SQL_RAT, ("news",))
def snk_02(spark, sf_dir):
    r = D.clean_news(_fx(spark, sf_dir).news)
    path = ST.scratch(spark, "snk02")
    SK.write_by_ticker(r, path)
    return spark.read.parquet(path).select("tic", "date", "benz_rate")


@query("snk_03_append_table", _SQL_RAT, ("news",))
def snk_03(spark, sf_dir):
    r = D.clean_news(_fx(spark, sf_dir).news)
    path = ST.scratch(spark, "snk03")
    SK.append_table(r.filter(F.col("date") < "1996-01-01"), path)
    SK.append_table(r.filter(F.col("date") >= "1996-01-01"), path)
    return spark.read.parquet(path)


@query("snk_04_checkpoint_batches", _SQL_RAT, ("news",))
def snk_04(spark, sf_dir):
    r = SK.with_batch_id(D.clean_news(_fx(spark, sf_dir).news), 4, "date")
    path = ST.scratch(spark, "snk04")
    SK.checkpoint_batches(r, path, "batch")
    SK.checkpoint_batches(r.filter(F.col("batch") == 1), path, "batch")  # replayed batch replaces itself
    return spark.read.parquet(path).select("tic", "date", "benz_rate")


_SQL_VERSIONS = """WITH v AS (SELECT id, date, ticker, importance, CAST(id * 10 AS BIGINT) AS updated FROM feed
  UNION ALL SELECT id, date + 1, ticker, importance + 10, CAST(id * 10 + 5 AS BIGINT) FROM feed WHERE id % 3 = 0
  UNION ALL SELECT id, date + 2, ticker, importance + 20, CAST(id * 10 - 5 AS BIGINT) FROM feed WHERE id % 5 = 0
  UNION ALL SELECT id + 1000000000, date, ticker, importance, CAST(7 AS BIGINT) FROM feed WHERE id % 50 = 0)"""


@query("snk_02_upsert", _SQL_VERSIONS + """
SELECT id, date, ticker, importance, updated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC) AS rk FROM v) x WHERE rk = 1""",
       ("feed",))
def snk_02_upsert(spark, sf_dir):
    """A feed table kept current by batches of newer, older and new records; one batch comes twice."""
    f = _fx(spark, sf_dir).feed.select(F.col("id").cast("long").alias("id"), "date", "ticker", "importance", (F.col("id") * 10).cast("long").alias("updated"))
    newer = f.filter("id % 3 = 0").withColumns({"date": F.date_add("date", 1), "importance": F.col("importance") + 10, "updated": F.col("updated") + 5})
    older = f.filter("id % 5 = 0").withColumns({"date": F.date_add("date", 2), "importance": F.col("importance") + 20, "updated": F.col("updated") - 5})
    added = f.filter("id % 50 = 0").withColumns({"id": F.col("id") + 1000000000, "updated": F.lit(7).cast("long")})
    path = ST.scratch(spark, "snk02u")
    for batch in (f, newer, older.unionByName(added), newer):
        SK.upsert(batch, path, ["id"], "updated", "date")
    return spark.read.parquet(path).select("id", "date", "ticker", "importance", "updated")
