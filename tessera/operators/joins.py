"""Equi, semi, anti, spine and parameter-grid joins (JOIN-01..06, 09..11), and
row shifts by key position (WIN-04 lead / lag) expressed as joins on the row index."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.series import IDX, with_index
from tessera.session import broadcast_bounded

#: Rows of a block of a shift by position.
SHIFT_BLOCK = 4096

# Dimension tables keyed by calendar date (macro, vix, bonds, holidays) have at most one
# row per day (about 36,500 rows per century); the broadcast is still size-checked
# (``broadcast_bounded``) and left to AQE beyond the limit.


def left_on_date(facts: DataFrame, dim: DataFrame, on: str | Sequence[str] = "date") -> DataFrame:
    """JOIN-01 facts LEFT JOIN a per-date dimension (broadcast when its size estimate is small)."""
    return facts.join(broadcast_bounded(dim), on, "left")


def full_on_key(a: DataFrame, b: DataFrame, on: Sequence[str] = ("tic", "date")) -> DataFrame:
    """JOIN-02 full outer join; join keys come out coalesced (``using`` semantics)."""
    return a.join(b, list(on), "full")


def keep_sessions(df: DataFrame, sessions: DataFrame, on: Sequence[str] = ("tic", "date")) -> DataFrame:
    """JOIN-04 left semi join: keep rows whose key is a session."""
    return df.join(sessions.select(*on), list(on), "left_semi")


def unrated(df: DataFrame, done: DataFrame, on: Sequence[str] | str = "doc_id") -> DataFrame:
    """JOIN-11 left anti join: rows not yet in ``done``."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(done.select(*on), on, "left_anti")


def spine_join(df: DataFrame, keys: DataFrame, start, end, step: str, col: str) -> DataFrame:
    """JOIN-09 full grid LEFT JOIN observations: every key gets every point of the grid
    ``sequence(start, end, step)`` (``start``/``end`` are columns of ``keys``, so a key
    may carry its own span, or literals), generated per key with ``explode``, then an
    equi-join on (key, grid point)."""
    k = [c for c in keys.columns if c not in ("_lo", "_hi")]
    lo = start if not isinstance(start, str) or start in keys.columns else F.lit(start)
    hi = end if not isinstance(end, str) or end in keys.columns else F.lit(end)
    spine = keys.select(*k, F.explode(F.sequence(F.col(lo) if isinstance(lo, str) else lo,
                                                 F.col(hi) if isinstance(hi, str) else hi,
                                                 F.expr(f"INTERVAL {step}"))).alias(col))
    return spine.join(df, k + [col], "left")


def cross_params(df: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """JOIN-10 every row x every hyper-parameter set: the literal parameter sets are
    exploded onto each row (no join); output columns are the parameter names."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in g.items()]) for g in grid])
    return df.withColumn("_ps", F.explode(sets)).select(*df.columns, "_ps.*")


def shift(df: DataFrame, cols: Sequence[str], n: int, key="tic", order="date", suffix: str | None = None) -> DataFrame:
    """WIN-04: value of ``cols`` ``n`` rows ahead (n > 0, lead) or behind (n < 0, lag)
    within the key.  Rows are cut into blocks by position; those within ``n`` of the next block
    are copied there once as a halo and an ordinary window runs per (key, block): one shuffle, no
    self-join, and a long key is spread over all tasks."""
    keys = [key] if isinstance(key, str) else list(key)
    added = IDX not in df.columns
    d = with_index(df, keys, order) if added else df
    sfx = suffix if suffix is not None else (f"_lead{n}" if n > 0 else f"_lag{-n}")
    block = max(SHIFT_BLOCK, abs(n))
    home = F.floor(F.col(IDX) / block)
    d = d.withColumn("_home", home).withColumn("_blk", F.explode(F.array_distinct(F.array("_home", F.floor((F.col(IDX) - n) / block)))))
    kk = [f"_sk{i}" for i in range(len(keys))]
    d = d.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for k, c in zip(kk, keys)})
    w = Window.partitionBy(*kk, "_blk").orderBy(IDX)
    d = d.withColumns({c + sfx: F.lead(c, n).over(w) if n >= 0 else F.lag(c, -n).over(w) for c in cols})
    out = d.filter(F.col("_blk") == F.col("_home")).drop("_home", "_blk", *kk)
    return out.drop(IDX) if added else out


#: Keys with more than this share of all rows are met by broadcast: at most its inverse many.
HOT_SHARE = 1e-4


def skew_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int,
              how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, ``weight`` = rows of the key in ``rows``,
    ``total`` = all of them; both read several times) with no key in one task: the few keys with
    more than ``HOT_SHARE`` of all rows are broadcast, the others shuffled.  ``weight`` is not
    returned; ``how`` is inner or left; null keys meet nothing."""
    hot, rest = skew_parts(rows, table, keys, weight, total, how)
    return hot.unionByName(rest)


def skew_parts(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int,
               how: str = "inner", share: float = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``skew_join``: the rows of the broadcast keys, those with more than ``share`` of
    all rows, left where they are, and the others."""
    hot = F.col(weight) > F.lit(total * share)
    few = F.broadcast(table.filter(hot).drop(weight))
    rest = rows.join(few.select(*keys), list(keys), "left_anti").join(table.filter(~hot).drop(weight), list(keys), how)
    return rows.join(few, list(keys)), rest
