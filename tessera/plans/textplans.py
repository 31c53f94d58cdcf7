"""News, rating, transcript and snapshot plans (PIPE-08..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import html_to_text
from tessera.operators import bars as B
from tessera.operators import clean as C
from tessera.operators.events import dedupe_first, join_fragments
from tessera.operators.indicators import sma
from tessera.sources.readers import load_videos


def news_batch(raw: DataFrame) -> DataFrame:
    """PIPE-08 every ticker's stories cleaned (quotes out of titles; bodies without HTML tags
    and entities, white space normalised), one table; of stories with one title within a
    ticker the first stays, then of those with one (created, title) over all tickers.

    Only ids, dates and titles are compared and shuffled; the bodies are read once, for the
    stories that stay."""
    d = raw.withColumn("title", F.regexp_replace("title", '"', "")).na.drop(subset=["created", "title", "body"])
    keys = d.select("doc_id", "tic", "created", "title")
    first = dedupe_first(keys, ["tic", "title"], ["created", "doc_id"])
    first = dedupe_first(first, ["created", "title"], ["created", "doc_id"]).select("doc_id")
    return d.join(first, "doc_id", "left_semi").select("doc_id", "tic", "created", "title", html_to_text("body").alias("body"))


def clean_ratings(df: DataFrame, col: str = "benz_rate") -> DataFrame:
    """PIPE-09 refusals and over-long answers blanked (null), ready for PIPE-01."""
    return df.withColumn(col, C.blank_long(C.blank_refusals(col), 4))


def transcripts(videos: DataFrame, fragments: DataFrame, start: str, end: str) -> DataFrame:
    """PIPE-10 videos published in [start, end] with their transcript text (fragments
    joined in turn order); a video without a transcript keeps a null body."""
    v = load_videos(videos, start, end)
    t = join_fragments(fragments, "conv_id", "turn", "text").withColumnRenamed("conv_id", "video_id")
    return v.join(t, "video_id", "left").select("video_id", "title", "created", "body")


def latest_snapshot(ticks: DataFrame, minutes: int = 100, ma: int = 20) -> DataFrame:
    """PIPE-11 minute bars over the last ``minutes`` minutes on a full grid, gaps filled,
    a moving average, and the latest row per ticker.  The grid ends at the latest minute of any
    ticker; ticks before its start are filtered at the scan, and a ticker without any in it is
    filled with zeros."""
    hi = F.date_trunc("minute", ticks.select(F.max("ts")).scalar()).cast("timestamp_ntz")
    lo = hi - F.make_dt_interval(mins=F.lit(minutes - 1))
    bars = (ticks.filter(F.col("ts") >= lo).groupBy("tic", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.max_by("close", F.struct("ts", "event_id")).alias("close")))
    keys = ticks.select("tic").distinct().withColumns({"_lo": lo, "_hi": hi})
    b = bars.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"),
                          "volume": F.lit(0.0)})
    g = B.gap_fill(b, keys, "_lo", "_hi", "1 MINUTE")
    s = sma(g.select("tic", "ts", "close"), "close", ma, f"ma{ma}", order="ts")
    last = s.groupBy("tic").agg(F.max_by(F.struct("ts", "close", f"ma{ma}"), "ts").alias("r"))
    return last.select("tic", "r.*")
