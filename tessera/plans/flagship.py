"""The flagship plan behind ``entry()``: the daily merge of every ticker followed by the
model feature frame (ML-01/02/05).  ``tickers`` narrows it to a chosen list (the form of
the reference takes three) when a caller asks for that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.plans import daily as D
from tessera.plans.fixtures import Fixtures
from tessera.plans.q_daily import FIX_MACRO_NAMES

HORIZON_ROWS = 90  # 3 months x 30 rows

FEATURE_BASE = ["volume", "NFP", "InterestRate", "UnemploymentRate", "PPI", "CPI", "benz_rate", "reportedEPS",
                "estimatedEPS", "surprisePct", "month_sin", "month_cos", "day_of_month_sin", "day_of_month_cos",
                "day_of_week_sin", "day_of_week_cos", "Year", "Day"]
MONTHS = [f"Month_{k}" for k in range(1, 13)]


def feature_frame(merged: DataFrame, horizon: int = HORIZON_ROWS) -> DataFrame:
    """ML-01/02/05 on the merged daily table: calendar features, lead target, labelled
    flag, z-scores fitted on labelled rows (population std), feature array."""
    d = FE.add_calendar_features(merged)
    d = FE.lead_target(d, horizon, "close", "target")
    d = d.withColumn("labelled", F.col("target").isNotNull())
    d = FE.standardise(d, FEATURE_BASE + MONTHS, fit_mask="labelled")
    d = FE.assemble(d, ["close"] + FEATURE_BASE + MONTHS, "features", digits=4)
    return d.select("tic", "date", "close", "target", "labelled", "features")


def flagship(spark: SparkSession, sf_dir: str, tickers=None) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    bars, news, earn = fx.bars_d, fx.news, fx.earnings
    if tickers is not None:
        keep = F.col("tic").isin(list(tickers))
        bars, news, earn = bars.filter(keep), news.filter(keep), earn.filter(keep)
    bars = D.clean_bars(bars)
    macro = D.clean_macro(spark, D.macro_daily(fx.macro_m, FIX_MACRO_NAMES))
    merged = D.merge_daily(bars, macro, D.clean_news(news), D.clean_earnings(earn))
    return feature_frame(merged)
