"""Cross-ticker risk: covariance of returns (AGG-08) and the turbulence index (WIN-11)."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_bounded, materialize

#: Tickers of a tile and days of a date block of the covariance.
TILE, DAYS = 128, 512


def tickers(df: DataFrame, key: str = "tic") -> list[str]:
    """All tickers of ``df`` in order: the column list of the wide forms.  One row a ticker
    comes to the driver; a null ticker has no column and raises."""
    found = [r[0] for r in df.select(key).distinct().collect()]
    if None in found:
        raise ValueError("rows without a ticker have no place in a wide table")
    return sorted(found)


def _only(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``df``; a ticker outside ``columns`` fails the job instead of vanishing."""
    known = F.col(key).isin(list(columns))
    told = F.when(known, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("ticker not in the list: "), F.coalesce(key, F.lit("null")))))
    return df.withColumn(key, told)


def wide(df: DataFrame, columns: Sequence[str] | None = None, key: str = "tic", date: str = "date",
         value: str = "close") -> DataFrame:
    """AGG-04 long -> wide: one column per ticker.  Without ``columns`` all tickers of the data
    are taken; with a list, a ticker outside it fails the job instead of vanishing."""
    if columns is None:
        return df.groupBy(date).pivot(key, tickers(df, key)).agg(F.first(value))
    return _only(df, columns, key).groupBy(date).pivot(key, list(columns)).agg(F.first(value))


def _grid(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tickers, dates, values, rows) of long rows (_k, _d, _v): values by (date, ticker), NaN where
    there is none, and whether there is a row."""
    names, col = np.unique(pdf["_k"].to_numpy(dtype=object).astype(str), return_inverse=True)
    days, row = np.unique(pdf["_d"].to_numpy(), return_inverse=True)
    x = np.full((len(days), len(names)), np.nan)
    here = np.zeros(x.shape, dtype=bool)
    x[row, col] = pdf["_v"].to_numpy(dtype=float)
    here[row, col] = True
    return names, days, x, here


def covariance(returns: DataFrame, columns: Sequence[str] | None = None, key: str = "tic", date: str = "date",
               ret: str = "ret", tile: int = TILE, days: int = DAYS) -> DataFrame:
    """AGG-08 pairwise-complete sample covariance of returns: (tic_a, tic_b, cov) for every two
    tickers that have rows on a common date; null with fewer than two common returns.

    Tickers are hashed to tiles and dates cut into blocks of ``days``.  A cell holds two tiles
    over one block; its task pivots at most ``days`` x 2 ``tile`` returns, centred per ticker, and
    emits the counts, sums and cross sums of its pairs, which are added up natively.  No task sees
    more than two tiles, no pair of rows is formed and no ticker list leaves Spark.  Rows without
    a ticker or date are left out; of repeated (ticker, date) rows one counts; an empty table gives
    no rows."""
    if columns is not None:
        returns = _only(returns, columns, key)
    r = returns.select(F.col(key).alias("_k"), F.datediff(date, F.lit("1970-01-01").cast("date")).alias("_d"),
                       F.nanvl(F.col(ret).cast("double"), F.lit(None).cast("double")).alias("_v")).dropna(subset=["_k", "_d"])
    r = materialize(r)
    mu = r.groupBy("_k").agg(F.avg("_v").alias("_mu"))
    tiles = -(-mu.count() // tile) or 1
    mine = F.pmod(F.xxhash64("_k"), F.lit(tiles)).cast("int")
    cells = (r.join(broadcast_bounded(mu), "_k").select("_k", "_d", (F.col("_v") - F.col("_mu")).alias("_v"), mine.alias("_t"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
             .select("_k", "_d", "_v", "_t", F.least("_t", "_o").alias("_lo"), F.greatest("_t", "_o").alias("_hi"),
                     F.floor(F.col("_d") / days).alias("_b")))

    def partials(pdf: pd.DataFrame) -> pd.DataFrame:
        names, _, x, here = _grid(pdf)
        of = dict(zip(pdf["_k"].astype(str), pdf["_t"]))
        side = np.array([of[n] for n in names])
        m = ~np.isnan(x)
        z, mf, hf = np.where(m, x, 0.0), m.astype(float), here.astype(float)
        lo, hi = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
        both = hf.T @ hf > 0
        both &= np.triu(np.ones_like(both)) if lo == hi else side[:, None] != side[None, :]
        i, j = np.nonzero(both & (np.arange(len(names))[:, None] <= np.arange(len(names))[None, :]))
        n, si, p = mf.T @ mf, z.T @ mf, z.T @ z
        return pd.DataFrame({"tic_a": names[i], "tic_b": names[j], "n": n[i, j], "sa": si[i, j], "sb": si[j, i], "p": p[i, j]})

    parts = cells.groupBy("_b", "_lo", "_hi").applyInPandas(partials, "tic_a string, tic_b string, n double, sa double, sb double, p double")
    tot = parts.groupBy("tic_a", "tic_b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "p")])
    cov = F.when(F.col("n") > 1, (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1))
    ends = F.array_distinct(F.array(F.struct("tic_a", "tic_b"), F.struct(F.col("tic_b").alias("tic_a"), F.col("tic_a").alias("tic_b"))))
    return tot.select(cov.alias("cov"), F.explode(ends).alias("e")).select("e.tic_a", "e.tic_b", "cov")


def date_positions(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, _p): the place of every distinct date.  Months are numbered in their own tasks; the
    number of dates of each month comes to the driver (1,200 rows a century)."""
    dates = df.select(date).filter(F.col(date).isNotNull()).distinct().withColumn("_m", F.trunc(date, "month"))
    sizes = {r["_m"]: r["count"] for r in dates.groupBy("_m").count().collect()}
    before, at = [], 0
    for m in sorted(sizes):
        before += [F.lit(m), F.lit(at)]
        at += sizes[m]
    place = F.row_number().over(Window.partitionBy("_m").orderBy(date)) - 1
    offset = F.create_map(*before)[F.col("_m")] if before else F.lit(0)
    return dates.withColumn("_p", (offset + place).cast("long")).drop("_m")


def turbulence(returns: DataFrame, columns: Sequence[str] | None = None, lookback: int = 252, key: str = "tic",
               date: str = "date", ret: str = "ret") -> DataFrame:
    """WIN-11 turbulence per date: for the i-th date (i >= lookback), with H the
    ``lookback`` earlier dates of returns (leading rows up to the fewest gaps of any
    ticker dropped, then every ticker with a gap left dropped), d = today's returns -
    mean(H): ``d . pinv(cov(H)) . d``; non-positive -> 0; the first two positive values
    are forced to 0; the first ``lookback`` dates are 0.

    Dates are cut into blocks of ``lookback`` consecutive dates; each block's task also
    receives the previous block as its look-back halo, so every row is shipped at most
    twice and each task holds at most 2 x lookback x N returns.  Rows without a ticker or date
    are left out; an empty table gives no rows.
    """
    if columns is not None:
        returns = _only(returns, columns, key)
    lb = int(lookback)
    r = returns.select(F.col(key).cast("string").alias("_k"), F.col(date), F.col(ret).cast("double").alias("_v"))
    r = materialize(r.filter(F.col(date).isNotNull() & F.col("_k").isNotNull()))
    dpos = materialize(date_positions(r, date))
    blk = F.floor(F.col("_p") / lb)
    rows = (r.join(broadcast_bounded(dpos), date).withColumn("_b", F.explode(F.array(blk, blk + 1)))
            .select("_k", F.col("_p").alias("_d"), "_v", "_b"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["_b"].iat[0])
        _, pos, x, _ = _grid(pdf)
        out_p, out_v = [], []
        for k in np.nonzero((pos // lb) == b)[0]:
            p = pos[k]
            if p < lb:
                continue
            h = x[(pos >= p - lb) & (pos < p)]
            ht = h[int(np.isnan(h).sum(axis=0).min()):]
            keep = ~np.isnan(ht).any(axis=0) if ht.size else np.zeros(x.shape[1], bool)
            hk, ck = ht[:, keep], x[k][keep]
            val = 0.0
            if hk.shape[0] > 1 and hk.shape[1] > 0 and not np.isnan(ck).any():
                dv = ck - hk.mean(axis=0)
                val = float(dv @ np.linalg.pinv(np.atleast_2d(np.cov(hk, rowvar=False))) @ dv.T)
            out_p.append(int(p))
            out_v.append(val)
        return pd.DataFrame({"_p": pd.Series(out_p, dtype="int64"), "raw": pd.Series(out_v, dtype="float64")})

    raw = materialize(rows.groupBy("_b").applyInPandas(score, "_p long, raw double"), pin=True)
    # the warm-up rule needs the place of the second positive value only
    early = [x["_p"] for x in raw.filter("raw > 0").select("_p").orderBy("_p").limit(2).collect()]
    warm = early[-1] if len(early) == 2 else None
    kept = F.when((F.col("raw") > 0) & (F.col("_p") > F.lit(warm)), F.col("raw")) if warm is not None else F.lit(None).cast("double")
    return (dpos.join(broadcast_bounded(raw), "_p", "left")
            .select(date, F.coalesce(kept, F.lit(0.0)).alias("turbulence")))
