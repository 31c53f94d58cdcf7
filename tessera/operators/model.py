"""Per-ticker model dataflow (ML-06..13).

The reference trains a neural network per ticker on one machine; the network itself is
not rebuilt.  What is rebuilt is the data flow around it: a closed-form ridge per (ticker,
parameter set) from sufficient statistics (XtX, Xty folded per partition in numpy and
summed natively, so no ticker's rows meet in one task), a coefficients table that can be
stored and re-used, native batch scoring, the prediction / observation alignment and the
per-split evaluation.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import shift
from tessera.session import materialize

COEF_SCHEMA = "tic string, lam double, intercept double, coef array<double>, val_mae double, n_train long"


_STATS_SCHEMA = "tic string, s string, i int, j int, v double"


def _train_stats(d: DataFrame) -> DataFrame:
    """Per ticker sufficient statistics of the train rows, long form (s, i, j, v): xtx,
    xty, sx, sy, n.  Each partition folds its rows with numpy; the partials are summed
    natively, so no key's rows are ever gathered in one place.  They do not depend on the
    ridge penalty, so a parameter grid reuses them."""
    def part(batches):
        acc: dict = {}
        for b in batches:
            for tic, g in b.groupby("tic", sort=False):
                x = np.vstack(g["features"].to_numpy())
                y = g["target"].to_numpy(dtype=float)
                st = (x.T @ x, x.T @ y, x.sum(axis=0), y.sum(), float(len(y)))
                a = acc.get(tic)
                acc[tic] = st if a is None else tuple(p + q for p, q in zip(a, st))
        rows = []
        for tic, (xtx, xty, sx, sy, n) in acc.items():
            k = len(sx)
            rows += [(tic, "xtx", i, j, float(xtx[i, j])) for i in range(k) for j in range(k)]
            rows += [(tic, "xty", i, 0, float(xty[i])) for i in range(k)]
            rows += [(tic, "sx", i, 0, float(sx[i])) for i in range(k)]
            rows += [(tic, "sy", 0, 0, float(sy)), (tic, "n", 0, 0, n)]
        if rows:
            yield pd.DataFrame(rows, columns=["tic", "s", "i", "j", "v"])

    t = d.filter(F.col("split") == "train").select("tic", "features", "target")
    return t.mapInPandas(part, _STATS_SCHEMA).groupBy("tic", "s", "i", "j").agg(F.sum("v").alias("v"))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ridge with an unpenalised intercept from the sufficient statistics of one key
    (a (k+1)^2-row group)."""
    lam = float(pdf["lam"].iloc[0])
    k = int(pdf.loc[pdf["s"] == "sx", "i"].max()) + 1
    xtx = np.zeros((k, k))
    xty, sx = np.zeros(k), np.zeros(k)
    for s_, i, j, v in pdf[["s", "i", "j", "v"]].itertuples(index=False):
        if s_ == "xtx":
            xtx[i, j] = v
        elif s_ == "xty":
            xty[i] = v
        elif s_ == "sx":
            sx[i] = v
    n = float(pdf.loc[pdf["s"] == "n", "v"].iloc[0])
    sy = float(pdf.loc[pdf["s"] == "sy", "v"].iloc[0])
    xm, ym = sx / n, sy / n
    a = xtx - n * np.outer(xm, xm) + lam * np.eye(k)
    w = np.linalg.lstsq(a, xty - n * xm * ym, rcond=None)[0]
    return pd.DataFrame({"tic": [pdf["tic"].iloc[0]], "lam": [lam], "intercept": [float(ym - xm @ w)],
                         "coef": [w.tolist()], "n_train": [int(n)]})


def _fit_ridge(d: DataFrame, lams: Sequence[float]) -> DataFrame:
    """Fits for every penalty in ``lams``: the statistics are computed once and only that
    small table ((k+1)^2 rows per ticker) is fanned out over the grid; validation rows
    are paired with each ticker's fits (grid size) to score them.  ``d`` is cut once: statistics
    and validation read the same table."""
    d = materialize(d)
    grid = F.array(*[F.lit(float(x)) for x in lams])
    stats = _train_stats(d).withColumn("lam", F.explode(grid))
    coefs = stats.groupBy("tic", "lam").applyInPandas(
        _solve, "tic string, lam double, intercept double, coef array<double>, n_train long")
    val = d.filter(F.col("split") == "val").join(coefs, "tic")
    dot = F.aggregate(F.zip_with("features", "coef", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    mae = (val.withColumn("_e", F.abs(dot + F.col("intercept") - F.col("target")))
           .groupBy("tic", "lam").agg(F.avg("_e").alias("val_mae")))
    return coefs.join(mae, ["tic", "lam"], "left").select("tic", "lam", "intercept", "coef", "val_mae", "n_train")


def fit_per_ticker(df: DataFrame, lam: float = 1.0) -> DataFrame:
    """ML-06 one ridge model per ticker from labelled rows (tic, features, target, split):
    trained on ``train`` from sufficient statistics, validation MAE on ``val`` scored
    natively.  Returns the coefficients table (tic, lam, intercept, coef, val_mae,
    n_train)."""
    d = df.filter(F.col("target").isNotNull() & F.col("split").isin("train", "val"))
    return _fit_ridge(d.select("tic", "features", "target", "split"), [lam])


def grid_search(df: DataFrame, lams: Sequence[float]) -> DataFrame:
    """ML-07 every ticker x every penalty fitted in parallel from one pass of sufficient
    statistics; the best penalty per ticker by validation MAE (``min_by``)."""
    d = df.filter(F.col("target").isNotNull() & F.col("split").isin("train", "val"))
    allfits = _fit_ridge(d.select("tic", "features", "target", "split"), lams)
    best = allfits.groupBy("tic").agg(F.min_by(F.struct(*[c for c in allfits.columns if c != "tic"]),
                                               F.struct("val_mae", "lam")).alias("b"))
    return best.select("tic", "b.*")


def load_or_fit(df: DataFrame, store: DataFrame | None, lam: float = 1.0) -> DataFrame:
    """ML-08 re-use stored coefficients; fit only the tickers missing from the store."""
    if store is None:
        return fit_per_ticker(df, lam)
    df = df.filter(F.col("target").isNotNull() & F.col("split").isin("train", "val")).select("tic", "features", "target", "split")
    missing = df.join(store.select("tic"), "tic", "left_anti")
    return store.unionByName(fit_per_ticker(missing, lam))


def score(df: DataFrame, coefs: DataFrame, out: str = "prediction") -> DataFrame:
    """ML-09 batch scoring: dot(features, coef) + intercept, native (``zip_with`` +
    ``aggregate``), the coefficient table joined on the ticker."""
    d = df.join(coefs.select("tic", "intercept", "coef"), "tic", "left")
    dot = F.aggregate(F.zip_with("features", "coef", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return d.withColumn(out, dot + F.col("intercept")).drop("intercept", "coef")


def align_predictions(df: DataFrame, n: int, parity: bool = False, key: str = "tic", date: str = "date",
                      out: str = "target_date") -> DataFrame:
    """ML-10 the date a prediction refers to: the date n rows (sessions) ahead, or with
    ``parity`` the row date + n calendar days."""
    if parity:
        return df.withColumn(out, F.date_add(date, n))
    return shift(df, [date], n, key=key, order=date, suffix="__a").withColumnRenamed(date + "__a", out)


def timeline(preds: DataFrame) -> DataFrame:
    """ML-12 all splits in one frame (train, test, new predictions), observed 0 where
    there is no observation yet."""
    return preds.withColumn("observed", F.coalesce(F.col("observed"), F.lit(0.0)))


def evaluate(preds: DataFrame, keys: Sequence[str] = ("tic", "split")) -> DataFrame:
    """ML-13 / AGG-07 MAE, MSE and row count per key over rows with both values."""
    d = preds.filter(F.col("prediction").isNotNull() & F.col("observed").isNotNull())
    err = F.col("prediction") - F.col("observed")
    return d.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                                F.count(F.lit(1)).alias("n"))
