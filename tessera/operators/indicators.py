"""Technical indicators per ticker (WIN-05..10).

Published definitions (the reference delegates these to a library and fixes only RSI 14
and SMA 50/200):

* SMA(n): mean of the last n rows, partial frames at the start.
* EMA(span): normalised exponential mean, alpha = 2 / (span + 1),
  ``sum (1-alpha)^k x_{t-k} / sum (1-alpha)^k``.
* MACD = EMA(12) - EMA(26) of close.
* Stochastic KDJ(9): RSV = 100 * (close - min(low, 9)) / (max(high, 9) - min(low, 9)),
  0 when the range is 0; K = 2/3 K' + 1/3 RSV, D = 2/3 D' + 1/3 K, both seeded at 50;
  J = 3K - 2D.
* RSI(14): change = close - previous close (the first row counts as no change); gains and losses
  smoothed with Wilder's alpha = 1/14 (normalised); RSI = 100 - 100 / (1 + up / down),
  100 when down = 0.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.series import (IDX, ewm_finish, ewm_specs, linear_recurrences, rolling,
                                      with_index)


def _indexed(df: DataFrame, key, order):
    return (df, False) if IDX in df.columns else (with_index(df, key, order), True)


def _done(df: DataFrame, added: bool) -> DataFrame:
    return df.drop(IDX) if added else df


# Each indicator is split into: rolling frames it needs (no join), recurrence specs that
# share one fused pass, an optional second dependent pass, and a final expression.  Any
# list of indicators therefore costs one index, one rolling pass per frame size and at
# most two recurrence passes, whatever its length.

def _rsv(n):
    rng = F.col("_hi") - F.col("_lo")
    return F.when(rng != 0, (F.col("close") - F.col("_lo")) / rng * 100.0).otherwise(F.lit(0.0))


def _gain(col):
    chg = F.col(col) - F.col("_prev")
    return F.coalesce(F.greatest(chg, F.lit(0.0)), F.lit(0.0))


def _loss(col):
    chg = F.col(col) - F.col("_prev")
    return F.coalesce(F.greatest(-chg, F.lit(0.0)), F.lit(0.0))


class _Plan:
    def __init__(self):
        self.rolls: dict[int, dict[str, Column]] = {}
        self.pre: dict[str, Column] = {}
        self.pass1: list = []
        self.ewm1: list[str] = []
        self.pass2: list = []
        self.chains: list = []
        self.post: list[tuple[str, Column]] = []
        self.tmp: set[str] = set()

    def roll(self, n, name, agg):
        self.rolls.setdefault(n, {})[name] = agg
        self.tmp.add(name)

    def ewm(self, src: Column, out: str, alpha: float, tmp=True):
        self.pre[f"_src_{out}"] = src
        self.pass1 += ewm_specs(f"_src_{out}", out, alpha)
        self.ewm1.append(out)
        self.tmp.add(f"_src_{out}")
        if tmp:
            self.tmp.add(out)

    def run(self, df: DataFrame, key, order) -> DataFrame:
        d = df
        if self.rolls:
            frames = {name: (n, agg) for n, aggs in self.rolls.items() for name, agg in aggs.items()}
            d = rolling(d, max(self.rolls), frames, key=key, order=order)
        if self.pre:
            d = d.withColumns(self.pre)
        if self.pass1:
            chains = [(out, [sp[0] for sp in self.pass1].index(src), seed) for out, src, seed in self.chains]
            d = linear_recurrences(d, self.pass1, key=key, order=order, chains=chains)
            for out in self.ewm1:
                d = ewm_finish(d, out)
        if self.pass2:
            d = linear_recurrences(d, self.pass2, key=key, order=order)
        for name, c in self.post:
            d = d.withColumn(name, c)
        return d.drop(*self.tmp)


def _plan_sma(p: _Plan, col="close", n=50, out=None):
    p.roll(n, out or f"ma{n}", F.avg(col))
    p.tmp.discard(out or f"ma{n}")


def _plan_ema(p: _Plan, col="close", span=12, out=None):
    p.ewm(F.col(col), out or f"ema{span}", 2.0 / (span + 1), tmp=False)


def _plan_macd(p: _Plan, col="close", fast=12, slow=26, out="macd"):
    p.ewm(F.col(col), f"_ema_{fast}_{out}", 2.0 / (fast + 1))
    p.ewm(F.col(col), f"_ema_{slow}_{out}", 2.0 / (slow + 1))
    p.post.append((out, F.col(f"_ema_{fast}_{out}") - F.col(f"_ema_{slow}_{out}")))


def _plan_kdj(p: _Plan, n=9):
    p.roll(n, "_lo", F.min("low"))
    p.roll(n, "_hi", F.max("high"))
    p.pre["_rsv"] = _rsv(n)
    p.tmp.add("_rsv")
    p.pass1.append(("kdjk", F.col("_rsv") / 3.0, 2.0 / 3.0, 50.0))
    p.chains.append(("kdjd", "kdjk", 50.0))  # D = 2/3 D' + 1/3 K, same pass
    p.post.append(("kdjj", 3 * F.col("kdjk") - 2 * F.col("kdjd")))


def _plan_prev(p: _Plan, col):
    p.roll(2, "_pv", F.first(col))
    p.roll(2, "_pc", F.count(F.lit(1)))
    p.pre["_prev"] = F.when(F.col("_pc") == 2, F.col("_pv"))
    p.tmp.add("_prev")


def _plan_rsi(p: _Plan, n=14, col="close", out="rsi"):
    _plan_prev(p, col)
    p.ewm(_gain(col), "_up", 1.0 / n)
    p.ewm(_loss(col), "_dn", 1.0 / n)
    p.post.append((out, F.when(F.col("_dn") == 0, F.lit(100.0))
                   .otherwise(100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_dn")))))


def _plan_pct(p: _Plan, col="close", out="pct"):
    _plan_prev(p, col)
    p.post.append((out, F.try_divide(F.col(col), F.col("_prev")) - 1))


def _single(plan_fn, df, key, order, **kw):
    d, added = _indexed(df, key, order)
    p = _Plan()
    plan_fn(p, **kw)
    return _done(p.run(d, key, order), added)


def sma(df: DataFrame, col: str = "close", n: int = 50, out: str | None = None,
        key="tic", order="date") -> DataFrame:
    """WIN-05 simple moving average over n rows, partial windows allowed."""
    return _single(_plan_sma, df, key, order, col=col, n=n, out=out)


def ema(df: DataFrame, col: str = "close", span: int = 12, out: str | None = None,
        key="tic", order="date") -> DataFrame:
    """WIN-06 exponential moving average with span."""
    return _single(_plan_ema, df, key, order, col=col, span=span, out=out)


def macd(df: DataFrame, col: str = "close", fast: int = 12, slow: int = 26, out: str = "macd",
         key="tic", order="date") -> DataFrame:
    """WIN-06 MACD line = EMA(fast) - EMA(slow)."""
    return _single(_plan_macd, df, key, order, col=col, fast=fast, slow=slow, out=out)


def kdj(df: DataFrame, n: int = 9, key="tic", order="date") -> DataFrame:
    """WIN-07 stochastic K, D, J (columns kdjk, kdjd, kdjj)."""
    return _single(_plan_kdj, df, key, order, n=n)


def rsi(df: DataFrame, n: int = 14, col: str = "close", out: str = "rsi", key="tic", order="date") -> DataFrame:
    """WIN-08 relative strength index with Wilder smoothing."""
    return _single(_plan_rsi, df, key, order, n=n, col=col, out=out)


def pct_change(df: DataFrame, col: str = "close", out: str = "pct", key="tic", order="date") -> DataFrame:
    """WIN-10 ``col / previous col - 1``; null on the first row or a zero base."""
    return _single(_plan_pct, df, key, order, col=col, out=out)


def prev_value(df: DataFrame, col: str, out: str, key="tic", order="date") -> DataFrame:
    """Value of ``col`` on the previous row of the key (null on the first row); runs on
    blocks so a long key is split."""
    d, added = _indexed(df, key, order)
    d = rolling(d, 2, {"_pv": F.first(col), "_pc": F.count(F.lit(1))}, key=key, order=order)
    d = d.withColumn(out, F.when(F.col("_pc") == 2, F.col("_pv"))).drop("_pv", "_pc")
    return _done(d, added)


# WIN-09: indicator registry, name -> planner
INDICATORS: dict[str, Callable[[_Plan], None]] = {
    "macd": lambda p: _plan_macd(p),
    "kdj": lambda p: _plan_kdj(p),
    "rsi": lambda p: _plan_rsi(p),
    "ma50": lambda p: _plan_sma(p, n=50),
    "ma200": lambda p: _plan_sma(p, n=200),
    "ema12": lambda p: _plan_ema(p, span=12),
    "ema26": lambda p: _plan_ema(p, span=26),
    "pct": lambda p: _plan_pct(p),
}


def add_indicators(df: DataFrame, names: Sequence[str] = ("macd", "kdj", "rsi", "ma50", "ma200"),
                   key="tic", order="date") -> DataFrame:
    """WIN-09 apply a named indicator list per ticker, fused into shared passes."""
    d, added = _indexed(df, key, order)
    p = _Plan()
    for n in names:
        if n not in INDICATORS:
            raise ValueError(f"unknown indicator {n!r}; known: {sorted(INDICATORS)}")
        INDICATORS[n](p)
    return _done(p.run(d, key, order), added)
