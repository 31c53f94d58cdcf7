"""The daily cleaning and merge plans (PIPE-01..07): one lazy DataFrame plan each."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import round_half_even, round_half_up
from tessera.operators import clean as C
from tessera.operators.indicators import add_indicators
from tessera.operators.series import ffill, fill
from tessera.session import broadcast_bounded

# The macro patch the cleaner appends (every day of April 2023).
MACRO_PATCH_START = "2023-04-01"
MACRO_PATCH_END = "2023-04-30"
MACRO_PATCH = {"NFP": 155673.0, "InterestRate": 4.83, "UnemploymentRate": 3.4, "PPI": 257.381, "CPI": 302.918}
MACRO_KEEP = ["NFP", "InterestRate", "UnemploymentRate", "PPI", "CPI"]

# Macro series ids and their names, in the order they are fetched.
MACRO_SERIES = {
    "PAYEMS": "NFP", "FEDFUNDS": "InterestRate", "UNRATE": "UnemploymentRate", "PPIACO": "PPI",
    "CPIAUCSL": "CPI", "PCE": "PCE", "INDPRO": "IPI", "UMCSENT": "ConsumerSentiment",
    "RSAFS": "RetailSales", "HOUST": "HousingStarts", "CSUSHPINSA": "HPI",
}

BAR_FEATURES = ["macd", "kdjk", "kdjd", "kdjj", "rsi", "ma50", "ma200", "vix", "TLT", "IEF", "SHY"]


def clean_news(news: DataFrame, key: str = "tic") -> DataFrame:
    """PIPE-01: (key, created, benz_rate text) -> (key, date, benz_rate = mean rating
    per day, half-even 4).  Ratings that are not numbers are dropped."""
    r = news.select(key, F.col("created").cast("date").alias("date"),
                    C.parse_rating("benz_rate").alias("r")).filter(F.col("r").isNotNull())
    return r.groupBy(key, "date").agg(round_half_even(F.avg("r"), 4).alias("benz_rate"))


def clean_bars(bars: DataFrame, features: Sequence[str] | None = None, warmup: int = 10,
               key: str = "tic") -> DataFrame:
    """PIPE-02: drop open/high/low, ISO date, drop invalid feature rows (FLT-02)."""
    d = bars.drop("open", "high", "low").withColumn("date", F.col("date").cast("date"))
    feats = [c for c in (features if features is not None else BAR_FEATURES) if c in d.columns]
    if feats:
        d = C.drop_invalid(d, feats, warmup=warmup, key=key, order="date")
    return d


def surprise_pct(df: DataFrame, reported="reportedEPS", estimated="estimatedEPS", surprise="surprise",
                 out="surprisePercentage") -> DataFrame:
    """AGG-15: surprise % = surprise / |estimate| * 100 (4 digits); null for a null or 0
    estimate.  ``surprise`` is computed as reported - estimated if absent."""
    d = df
    if surprise not in d.columns:
        d = d.withColumn(surprise, F.col(reported) - F.col(estimated))
    return d.withColumn(out, round_half_up(F.try_divide(F.col(surprise), F.abs(F.col(estimated))) * 100, 4))


def clean_earnings(earnings: DataFrame, key: str = "tic") -> DataFrame:
    """PIPE-03: (key, date=reportedDate, reportedEPS, estimatedEPS, surprisePct)."""
    e = earnings if "surprisePercentage" in earnings.columns else surprise_pct(earnings)
    return e.select(key, F.col("reportedDate").cast("date").alias("date"), "reportedEPS", "estimatedEPS",
                    F.col("surprisePercentage").alias("surprisePct"))


def upsample_daily(long: DataFrame, series="series", date="date", value="value") -> DataFrame:
    """WIN-03: daily rows with forward-filled value, each series only between its own
    first and last observation.  One explode per observation, no fill window."""
    w = Window.partitionBy(series).orderBy(date)
    nxt = F.lead(date).over(w)
    d = long.select(series, F.col(date).cast("date").alias(date), value, nxt.alias("_next"))
    end = F.coalesce(F.date_sub("_next", 1), F.col(date))
    return d.select(series, F.explode(F.sequence(F.col(date), end)).alias(date), value)


def macro_daily(long: DataFrame, names: Mapping[str, str] | None = None, series="series",
                date="date", value="value") -> DataFrame:
    """PIPE-07 / JOIN-03: long (series id, date, value) -> wide daily table, one column per
    series name (n-ary outer join as a pivot), half-even 4.  ``names`` maps id -> name
    (default: the fixed macro map)."""
    names = dict(names or MACRO_SERIES)
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    d = long.withColumn("_name", m[F.col(series)]).filter(F.col("_name").isNotNull())
    up = upsample_daily(d.select(F.col("_name").alias(series), date, value), series, date, value)
    cols = list(dict.fromkeys(names.values()))
    wide = up.groupBy(date).pivot(series, cols).agg(F.first(value))
    return C.round_even(wide, 4, cols=cols)


def clean_macro(spark: SparkSession, macro: DataFrame, patch: Mapping[str, float] | None = None,
                start: str = MACRO_PATCH_START, end: str = MACRO_PATCH_END,
                keep: Sequence[str] = MACRO_KEEP) -> DataFrame:
    """PIPE-04: append the constant patch month (patch rows win, one row per date) and
    keep date + the five series."""
    p = C.constant_days(spark, start, end, patch or MACRO_PATCH)
    base = macro.select("date", *keep).join(p.select("date"), "date", "left_anti")
    return base.unionByName(p.select("date", *keep))


def merge_daily(bars: DataFrame, macro: DataFrame | None, ratings: DataFrame | None,
                earnings: DataFrame | None, key: str = "tic", parity: bool = False) -> DataFrame:
    """PIPE-05 merge one row per session with macro, news rating and earnings.

    Semantics (per ticker): bars left-join macro on date; news ratings are forward filled
    over calendar days, then each session's rating is the mean of its own and the closed
    days rolled into it (half-even 3); earnings and every other column are carried forward
    as-of the session (column-wise, an earnings row sorts before a session on the same
    date); only session dates are kept.  ``parity=True`` groups ratings by the literal
    (close, volume, day) key instead of the session.

    Plan: bars (+ broadcast macro) FULL JOIN daily ratings, UNION earnings rows, ONE fused
    fill pass (forward: rating, macro, earnings; backward: the session date), one
    aggregate for the session rating, one join back.
    """
    bar_cols = [c for c in bars.columns if c not in (key, "date")]
    b = bars.withColumn("_sess0", F.col("date"))
    macro_cols: list[str] = []
    if macro is not None:
        macro_cols = [c for c in macro.columns if c != "date"]
        # the daily macro table has one row per calendar day: bounded by the date range
        b = b.join(broadcast_bounded(macro), "date", "left")
    if ratings is not None:
        u = b.join(ratings.select(key, "date", F.col("benz_rate").alias("_rf")), [key, "date"], "full")
    else:
        u = b.withColumn("_rf", F.lit(None).cast("double"))
    u = u.withColumn("_tag", F.lit(1))
    earn_cols: list[str] = []
    if earnings is not None:
        earn_cols = [c for c in earnings.columns if c not in (key, "date")]
        u = u.unionByName(earnings.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    gk = ["close", "volume", "day"] if parity else ["_sess"]
    u = u.withColumn("_sess", F.col("_sess0"))
    back = ["_sess"] + (gk if parity else [])
    u = fill(u, ["_rf"] + macro_cols + earn_cols, back, key=key, order=["date", "_tag"])
    rows = u.filter((F.col("_tag") == 1) & F.col("_sess").isNotNull())
    rate = rows.groupBy(key, *gk).agg(round_half_even(F.avg("_rf"), 3).alias("benz_rate"))
    s = u.filter((F.col("_tag") == 1) & F.col("_sess0").isNotNull())
    s = s.join(rate, [key, *gk], "left")
    return s.select(key, "date", *bar_cols, *macro_cols, "benz_rate", *earn_cols)


def enrich_bars(bars: DataFrame, vix: DataFrame | None = None, bonds: DataFrame | None = None,
                indicators: Sequence[str] = ("macd", "kdj", "rsi", "ma50", "ma200"),
                key: str = "tic") -> DataFrame:
    """PIPE-06: indicators per ticker -> vix left join + forward fill -> bonds left join +
    forward fill -> round half-even 3 (all but date and key).  ``vix`` is (date, vix);
    ``bonds`` is (date, TLT, IEF, SHY)."""
    d = add_indicators(bars, indicators, key=key, order="date")
    fills = []
    for dim in (vix, bonds):
        if dim is not None:
            d = d.join(broadcast_bounded(dim), "date", "left")
            fills += [c for c in dim.columns if c != "date"]
    if fills:
        d = ffill(d, fills, key=key, order="date")
    return C.round_even(d, 3, exclude=(key, "date"))
