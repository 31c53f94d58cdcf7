"""Fixture views over the driver's test tables (FIXTURES.md A–M), Spark side.

Each view has exactly one definition; ``tessera.plans.oracle_fixtures`` holds the same
definitions as DuckDB SQL.  The views stand in for the market inputs: daily bars,
intraday bars, macro series, news, earnings, feeds and a security master.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The five ticker stand-ins (o_orderpriority) and the macro series
# names they map to, in order (FIXTURES.md D).
TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MACRO_NAMES = ["NFP", "InterestRate", "UnemploymentRate", "PPI", "CPI"]


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    # A: intraday bars, tic × hour
    @cached_property
    def bars_h(self) -> DataFrame:
        ev = self.table("events")
        return (ev.groupBy(F.col("event_type").alias("tic"),
                           F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
                .agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
                     F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
                     F.count(F.lit(1)).cast("double").alias("volume")))

    # B: daily bars, weekdays only
    @cached_property
    def bars_d(self) -> DataFrame:
        o = (self.table("orders")
             .withColumn("date", F.col("o_orderdate").cast("date"))
             .withColumn("day", F.weekday("o_orderdate").cast("int"))
             .filter(F.col("day") < 5))
        return (o.groupBy(F.col("o_orderpriority").alias("tic"), "date", "day")
                .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                     F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
                     F.max_by("o_totalprice", "o_orderkey").alias("close"),
                     F.count(F.lit(1)).cast("double").alias("volume"))
                .select("tic", "date", "open", "high", "low", "close", "volume", "day"))

    # C: 25 tickers with long history
    @cached_property
    def bars_x(self) -> DataFrame:
        li = self.table("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        p = self.table("part").select("p_partkey", "p_brand")
        return (li.join(p, li.l_partkey == p.p_partkey)
                .groupBy(F.col("p_brand").alias("tic"), F.col("l_shipdate").cast("date").alias("date"))
                .agg(F.max("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume")))

    # D: monthly macro series (long form)
    @cached_property
    def macro_m(self) -> DataFrame:
        o = self.table("orders").filter(
            ~((F.col("o_orderpriority") == "5-LOW")
              & (F.col("o_orderdate") >= F.lit("2001-05-01 00:00:00").cast("timestamp_ntz"))))
        return (o.groupBy(F.col("o_orderpriority").alias("series"),
                          F.date_trunc("month", "o_orderdate").cast("date").alias("date"))
                .agg(F.round(F.avg("o_totalprice"), 4).alias("value")))

    # E: dated news with raw ratings
    @cached_property
    def news(self) -> DataFrame:
        d = self.table("documents")
        k = F.col("doc_id")
        tic = (F.when(k % 5 == 0, "1-URGENT").when(k % 5 == 1, "2-HIGH").when(k % 5 == 2, "3-MEDIUM")
               .when(k % 5 == 3, "4-NOT SPECIFIED").otherwise("5-LOW"))
        offs = (((k * 7) % 200) * 12 + F.floor(k / 400) % 3).cast("int")
        rate = (F.when(k % 11 == 0, F.lit(None).cast("string"))
                .when(k % 17 == 0, "As an AI language model I cannot say")
                .when(k % 13 == 0, "Rate: 8")
                .otherwise((1 + (k * 3 + F.col("n_chars")) % 10).cast("string")))
        return d.select("doc_id", tic.alias("tic"),
                        F.date_add(F.lit("1995-01-01").cast("date"), offs).alias("created"),
                        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), F.col("text").alias("body"),
                        rate.alias("benz_rate"))

    # F: quarterly earnings
    @cached_property
    def earnings(self) -> DataFrame:
        q = (self.table("orders")
             .groupBy(F.col("o_orderpriority").alias("tic"),
                      F.date_trunc("quarter", "o_orderdate").cast("date").alias("fiscal"))
             .agg(F.round(F.avg("o_totalprice") / 10000, 4).alias("eps")))
        w = Window.partitionBy("tic").orderBy("fiscal")
        est = (F.when((F.month("fiscal") == 7) & (F.year("fiscal") == 1997), F.lit(None).cast("double"))
               .otherwise(F.lag("eps").over(w)))
        e = q.select("tic", "fiscal", "eps", est.alias("est"))
        return e.select("tic", F.col("fiscal").alias("fiscalDateEnding"),
                        F.date_add("fiscal", (20 + (F.month("fiscal") * 7) % 15).cast("int")).alias("reportedDate"),
                        F.col("eps").alias("reportedEPS"), F.col("est").alias("estimatedEPS"),
                        F.round(F.col("eps") - F.col("est"), 4).alias("surprise"))

    # J: naive predictions (previous close) against observed
    @cached_property
    def preds(self) -> DataFrame:
        from tessera.operators.indicators import prev_value
        b = prev_value(self.bars_d.select("tic", "date", "close"), "close", "prediction")
        return b.select("tic", "date", "prediction", F.col("close").alias("observed"))

    # L: calendar-feed stand-in
    @cached_property
    def feed(self) -> DataFrame:
        ev = self.table("events")
        k = F.col("event_id")
        action = F.when(k % 3 == 0, "Upgrades").when(k % 3 == 1, "Downgrades").otherwise("Maintains")
        return ev.select(k.alias("id"), F.col("ts").cast("date").alias("date"),
                         F.col("event_type").alias("ticker"), (k % 6).cast("int").alias("importance"),
                         action.alias("action"), F.col("value").alias("yield"), "props")

    # M: security master / screener universe
    @cached_property
    def universe(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("symbol_id"),
                        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
                        F.col("p_name").alias("name"), F.col("p_type").alias("sector"),
                        F.col("p_brand").alias("exchange"), F.col("p_retailprice").alias("close"),
                        (F.col("p_retailprice") * F.col("p_size") * 1000000).alias("marketcap"))
