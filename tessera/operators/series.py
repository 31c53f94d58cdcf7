"""Ordered-series building blocks that split a long or hot key across many tasks.

A plain ``Window.partitionBy('tic').orderBy('date')`` runs one task per ticker.  That is
fine for a few thousand daily bars but not when one ticker holds a third of all rows
(minute bars, ticks).  The helpers here never put a whole key into one window:

* ``with_index`` - global 0-based row position per key.  Rows are numbered inside
  calendar buckets (``chunk``), bucket sizes are prefix-summed over the small bucket table.
* ``ffill`` / ``bfill`` - fill inside buckets, then a carry from the small bucket table.
* ``rolling`` - n-row frames: each row is also copied into the next block as a halo
  (at most one extra copy because blocks are at least n rows), then an ordinary
  window runs per (key, block).
* ``linear_recurrence`` - ``s_t = a * s_{t-1} + b_t`` in closed form inside blocks of
  rows whose size keeps ``a**-i`` finite; the carry into a block is folded from the
  few preceding block summaries whose weight is not exactly 0.0, and joined back.

All work is native expressions; no Python runs per row.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

IDX = "_j"


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def default_chunk(order: str, df: DataFrame | None = None) -> Column:
    """Calendar bucket used to split a key: the month of a date order column (about 21
    daily bars), the day of a timestamp one (intraday bars and ticks: a month of a hot
    ticker's ticks would be one task)."""
    kind = dict(df.dtypes).get(order) if df is not None else None
    unit = "day" if kind in ("timestamp", "timestamp_ntz") else "month"
    return F.date_trunc(unit, F.col(order))


def _safe_keys(df: DataFrame, key: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the key columns as strings that are never null, and their names: windows,
    aggregates and joins on them share one partitioning and keep rows with null keys."""
    names = [f"{prefix}{i}" for i in range(len(key))]
    return df.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("\x00null")) for n, k in zip(names, key)}), names


def _chunked(df: DataFrame, ch: Column) -> DataFrame:
    """``df`` with ``_chunk``; rows without an order value form a chunk before all others, as
    windows sort nulls first."""
    d = df.withColumn("_chunk", ch)
    kind = dict(d.dtypes)["_chunk"]
    low = {"string": F.lit("")}.get(kind, F.lit("0001-01-01").cast(kind) if kind.startswith(("date", "timestamp"))
                                    else F.lit(-(1 << 30)).cast(kind))
    return d.withColumn("_chunk", F.coalesce("_chunk", low))


def with_index(df: DataFrame, key="tic", order="date", chunk: Column | None = None,
               name: str = IDX) -> DataFrame:
    """Add ``name`` = 0-based row position within ``key`` ordered by ``order``.

    ``order`` must be unique within a key (add a tie-break column if needed).  The
    chunk expression must be monotone in ``order`` (default: month of the first
    order column).  Rows with a null key form one key of their own; rows with a null order
    come first in their key.
    """
    key, order = _cols(key), _cols(order)
    ch = chunk if chunk is not None else default_chunk(order[0], df)
    d, kk = _safe_keys(_chunked(materialize(df), ch), key, "_wk")
    local = d.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*kk, "_chunk").orderBy(*order)))
    sizes = local.groupBy(*kk, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.partitionBy(*kk).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_cnt")
    return (local.join(offs, on=kk + ["_chunk"])
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_chunk", "_rn", "_off", *kk))


def fill(df: DataFrame, forward: Sequence[str] = (), backward: Sequence[str] = (), key="tic", order="date",
         chunk=None) -> DataFrame:
    """Forward fill ``forward`` columns and backward fill ``backward`` columns in ONE pass:
    fills inside calendar buckets, carries from the small (key, bucket) summary table,
    one join back."""
    key, order = _cols(key), _cols(order)
    items = [(c, True) for c in forward] + [(c, False) for c in backward]
    if not items:
        return df
    ch = chunk if chunk is not None else default_chunk(order[0], df)
    d, kk = _safe_keys(_chunked(materialize(df), ch), key, "_fk")
    base = Window.partitionBy(*kk, "_chunk").orderBy(*order)
    wf = base.rowsBetween(Window.unboundedPreceding, 0)
    wb = base.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({f"_l_{i}": (F.last(c, ignorenulls=True).over(wf) if fw else
                                   F.first(c, ignorenulls=True).over(wb)) for i, (c, fw) in enumerate(items)})
    ordkey = F.struct(*order)
    summ = d.groupBy(*kk, "_chunk").agg(*[(F.max_by if fw else F.min_by)(f"_l_{i}", ordkey).alias(f"_s_{i}")
                                           for i, (c, fw) in enumerate(items)])
    wc = Window.partitionBy(*kk).orderBy("_chunk")
    wcf = wc.rowsBetween(Window.unboundedPreceding, -1)
    wcb = wc.rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select(*kk, "_chunk", *[(F.last(f"_s_{i}", ignorenulls=True).over(wcf) if fw else
                                           F.first(f"_s_{i}", ignorenulls=True).over(wcb)).alias(f"_c_{i}")
                                          for i, (c, fw) in enumerate(items)])
    out = d.join(carry, on=kk + ["_chunk"], how="left")
    out = out.withColumns({c: F.coalesce(F.col(f"_l_{i}"), F.col(f"_c_{i}")) for i, (c, fw) in enumerate(items)})
    return out.drop("_chunk", *kk, *[f"_l_{i}" for i in range(len(items))], *[f"_c_{i}" for i in range(len(items))])


def _fill(df: DataFrame, cols: Sequence[str], key, order, chunk, forward: bool) -> DataFrame:
    cols = list(cols)
    return fill(df, cols if forward else (), () if forward else cols, key, order, chunk)


def ffill(df: DataFrame, cols: Sequence[str], key="tic", order="date", chunk=None) -> DataFrame:
    """Forward fill (WIN-01): each null takes the last non-null earlier value of its key.
    Leading nulls stay null."""
    return _fill(df, cols, key, order, chunk, forward=True)


def bfill(df: DataFrame, cols: Sequence[str], key="tic", order="date", chunk=None) -> DataFrame:
    """Backward fill (WIN-02): each null takes the next non-null value of its key."""
    return _fill(df, cols, key, order, chunk, forward=False)


def running_max(df: DataFrame, col: str, out: str, key="tic", order="date", chunk=None) -> DataFrame:
    """``out`` = the largest ``col`` (any comparable type, structs too; nulls are passed over) of the
    rows of the key up to this one.  Maxima run inside calendar buckets, the carry is the
    running maximum of the small bucket table."""
    key, order = _cols(key), _cols(order)
    ch = chunk if chunk is not None else default_chunk(order[0], df)
    d, kk = _safe_keys(_chunked(materialize(df), ch), key, "_mk")
    so_far = Window.partitionBy(*kk, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_l", F.max(col).over(so_far))
    top = d.groupBy(*kk, "_chunk").agg(F.max(col).alias("_s"))
    before = Window.partitionBy(*kk).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = top.select(*kk, "_chunk", F.max("_s").over(before).alias("_c"))
    d = d.join(carry, on=kk + ["_chunk"], how="left")
    return d.withColumn(out, F.greatest("_l", "_c")).drop("_l", "_c", "_chunk", *kk)


def rolling(df: DataFrame, n: int, aggs: dict, key="tic", order="date",
            block: int = 4096) -> DataFrame:
    """Trailing row-frame aggregates (partial frames at the start, like pandas
    ``rolling(n, min_periods=1)``).  ``aggs`` maps output name -> aggregate Column (frame
    of ``n`` rows) or -> (rows, Column) for its own frame size.  All frames share one
    block layout: blocks of at least the largest frame, each row copied once more into
    the next block as a halo, so one shuffle serves every frame.
    """
    key = _cols(key)
    spec = {k: (v if isinstance(v, tuple) else (n, v)) for k, v in aggs.items()}
    nmax = max(m for m, _ in spec.values())
    b = max(int(block), nmax)
    have_idx = IDX in df.columns
    d = df if have_idx else with_index(df, key, order)
    j = F.col(IDX)
    d = d.withColumn("_home", F.floor(j / b)).withColumn(
        "_blk", F.explode(F.sequence(F.col("_home"), F.floor((j + (nmax - 1)) / b))))
    base = Window.partitionBy(*key, "_blk").orderBy(IDX)
    d = d.withColumns({name: agg.over(base.rowsBetween(-(m - 1), 0)) for name, (m, agg) in spec.items()})
    d = d.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")
    return d if have_idx else d.drop(IDX)


def block_size(a: float, cap: int = 4096) -> int:
    """Rows per closed-form block so that ``a**-i`` stays below 1e150."""
    if a <= 0 or a >= 1:
        return cap
    return max(8, min(cap, int(150 * math.log(10) / -math.log(a))))


def linear_recurrences(df: DataFrame, specs: Sequence[tuple[str, Column, float, float]],
                       key="tic", order="date", chains: Sequence[tuple[str, int, float]] = ()) -> DataFrame:
    """Several recurrences ``out_t = a * out_{t-1} + b_t`` (``out_{-1} = seed``) per key in
    row order, computed in ONE pass: one block window, one fold, one join.

    ``specs`` = [(out, b, a, seed), ...].  ``chains`` = [(out, k, seed), ...] adds
    ``out_t = a * out_{t-1} + (1 - a) * s_t`` driven by spec ``k``'s output ``s`` with the
    same ``a`` (stochastic D from K) in the same pass.

    Inside a block of C rows ``L_i = a**i * sum_{j<=i} a**-j * b_j``; a chained output
    adds ``(1-a) * a**i * sum_{j<=i} (i-j+1) a**-j b_j``.  The carry into a block is the
    state at the end of the previous block, folded over the block table
    (``_carry_scan``).  Exact up to float rounding: history older than the fold's
    lookback is weighted by exactly 0.0.
    """
    key = _cols(key)
    specs, chains = list(specs), list(chains)
    have_idx = IDX in df.columns
    d = materialize(df) if have_idx else with_index(df, key, order)
    d, kk = _safe_keys(d, key, "_rk")
    c = min(block_size(a) for _, _, a, _ in specs)
    d = d.withColumn("_q", F.floor(F.col(IDX) / c)).withColumn("_i", (F.col(IDX) % c).cast("double"))
    wq = Window.partitionBy(*kk, "_q").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    i = F.col("_i")
    cols = {}
    for k, (_, b, a, _) in enumerate(specs):
        la = F.lit(float(a))
        bb = F.coalesce(b.cast("double"), F.lit(0.0))
        cols[f"_L{k}"] = F.pow(la, i) * F.sum(bb * F.pow(la, -i)).over(wq)
    for p, (_, k, _) in enumerate(chains):
        _, b, a, _ = specs[k]
        la = F.lit(float(a))
        bb = F.coalesce(b.cast("double"), F.lit(0.0))
        m = F.pow(la, i) * F.sum(i * bb * F.pow(la, -i)).over(wq)
        cols[f"_M{p}"] = (1.0 - a) * ((i + 1) * F.col(f"_L{k}") - m)
    d = d.withColumns({n: e for n, e in cols.items() if n.startswith("_L")})
    d = d.withColumns({n: e for n, e in cols.items() if n.startswith("_M")})
    ks, ps = range(len(specs)), range(len(chains))
    summ = d.groupBy(*kk, "_q").agg(F.count(F.lit(1)).alias("_n"),
                                     *[F.max_by(f"_L{k}", IDX).alias(f"_T{k}") for k in ks],
                                     *[F.max_by(f"_M{p}", IDX).alias(f"_U{p}") for p in ps])
    folded = _carry_scan(summ, kk, specs, chains, c)
    d = d.join(folded, on=kk + ["_q"], how="left")
    # block 0 has no carry row: its carry is the seed
    carry = {f"c{k}": F.coalesce(F.col(f"c{k}"), F.lit(float(seed))) for k, (_, _, _, seed) in enumerate(specs)}
    carry.update({f"e{p}": F.coalesce(F.col(f"e{p}"), F.lit(float(seed))) for p, (_, _, seed) in enumerate(chains)})
    d = d.withColumns(carry)
    outs = {}
    for k, (out, _, a, _) in enumerate(specs):
        outs[out] = F.col(f"_L{k}") + F.pow(F.lit(float(a)), i + 1) * F.col(f"c{k}")
    for p, (out, k, _) in enumerate(chains):
        a = float(specs[k][2])
        ai1 = F.pow(F.lit(a), i + 1)
        outs[out] = F.col(f"_M{p}") + ai1 * F.col(f"e{p}") + (1.0 - a) * (i + 1) * ai1 * F.col(f"c{k}")
    d = d.withColumns(outs)
    d = d.drop("_q", "_i", *kk, *[f"_L{k}" for k in ks], *[f"c{k}" for k in ks],
               *[f"_M{p}" for p in ps], *[f"e{p}" for p in ps])
    return d if have_idx else d.drop(IDX)


def _lookback_blocks(a: float, c: int, chained: bool) -> int:
    """Blocks of history that reach a state: the smallest power of two K for which the
    multiplier of K full blocks (``a**(c*K)``, and the chained term) is exactly 0.0 in
    double arithmetic.  Anything older than K blocks adds exact zeros, so the carry into a
    block is a fold over the K block summaries before it."""
    x = a ** c
    y = (1.0 - a) * c * x if chained else 0.0
    k = 1
    for _ in range(13):
        if x == 0.0 and y == 0.0:
            return k
        x, y, k = x * x, 2 * x * y, k * 2
    raise ValueError("recurrence coefficient too close to 1 for a bounded block lookback")


def _carry_scan(summ: DataFrame, key: list[str], specs, chains, c: int) -> DataFrame:
    """Carry into every block: the state at the end of the previous block.

    Block q is the affine map s -> x*s + t (x = a**n rows; a chained pair adds
    e -> y*s + x*e + u with y = (1-a) n a**n).  The state after block q is the fold of
    the last K maps (``_lookback_blocks``) starting from the seed when the frame reaches
    block 0 and from 0 otherwise (its weight is exactly 0.0).  That is a trailing frame of
    K rows over the small block table, run by ``rolling`` (blocks of blocks with a halo:
    no key is gathered in one task) and folded with ``aggregate``: one shuffle, no
    self-joins, no lineage cut.
    """
    ks, ps = range(len(specs)), range(len(chains))
    n = F.col("_n").cast("double")
    cols = [*key, F.col("_q").cast("long").alias(IDX)]
    for k in ks:
        a = float(specs[k][2])
        cols += [F.pow(F.lit(a), n).alias(f"x{k}"), F.col(f"_T{k}").alias(f"t{k}")]
    for p, (_, k, _) in enumerate(chains):
        a = float(specs[k][2])
        cols += [((1.0 - a) * n * F.pow(F.lit(a), n)).alias(f"y{p}"), F.col(f"_U{p}").alias(f"u{p}")]
    blocks = summ.select(*cols)
    look = max(_lookback_blocks(float(specs[k][2]), c, any(ch[1] == k for ch in chains)) for k in ks)
    fields = [f"x{k}" for k in ks] + [f"t{k}" for k in ks] + [f"y{p}" for p in ps] + [f"u{p}" for p in ps]
    win = rolling(blocks, look, {"_win": F.collect_list(F.struct(IDX, *fields))}, key=key, order=IDX,
                  block=max(4096, look))
    arr = F.array_sort(F.col("_win"))
    at0 = arr[0][IDX] == 0
    init = F.struct(*[F.when(at0, F.lit(float(specs[k][3]))).otherwise(F.lit(0.0)).alias(f"s{k}") for k in ks],
                    *[F.when(at0, F.lit(float(seed))).otherwise(F.lit(0.0)).alias(f"e{p}")
                      for p, (_, _, seed) in enumerate(chains)])

    def step(acc, b):
        nxt = [(b[f"x{k}"] * acc[f"s{k}"] + b[f"t{k}"]).alias(f"s{k}") for k in ks]
        nxt += [(b[f"y{p}"] * acc[f"s{k}"] + b[f"x{k}"] * acc[f"e{p}"] + b[f"u{p}"]).alias(f"e{p}")
                for p, (_, k, _) in enumerate(chains)]
        return F.struct(*nxt)

    st = win.select(*key, (F.col(IDX) + 1).alias("_q"), F.aggregate(arr, init, step).alias("_st"))
    # state at the end of block q is the carry into block q + 1
    return st.select(*key, "_q", *[F.col("_st")[f"s{k}"].alias(f"c{k}") for k in ks],
                     *[F.col("_st")[f"e{p}"].alias(f"e{p}") for p in ps])


def linear_recurrence(df: DataFrame, b: Column, a: float, out: str, seed: float = 0.0,
                      key="tic", order="date") -> DataFrame:
    """One recurrence ``out_t = a * out_{t-1} + b_t``; see ``linear_recurrences``."""
    return linear_recurrences(df, [(out, b, a, seed)], key=key, order=order)


def ewm_specs(col: str, out: str, alpha: float) -> list[tuple[str, Column, float, float]]:
    """Recurrence specs for a normalised exponential mean (numerator, denominator)."""
    x = F.col(col)
    a = 1.0 - alpha
    return [(f"_{out}_n", x, a, 0.0),
            (f"_{out}_d", F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)), a, 0.0)]


def ewm_finish(df: DataFrame, out: str) -> DataFrame:
    n, d = F.col(f"_{out}_n"), F.col(f"_{out}_d")
    return df.withColumn(out, F.when(d > 0, n / d)).drop(f"_{out}_n", f"_{out}_d")


def ewm_means(df: DataFrame, items: Sequence[tuple[str, str, float]], key="tic", order="date") -> DataFrame:
    """Normalised exponential means (pandas ``ewm(alpha, adjust=True)``) for several
    (col, out, alpha) in one pass: ``sum (1-alpha)^k x_{t-k} / sum (1-alpha)^k`` over
    non-null x; null until the first value."""
    specs = [s for col, out, alpha in items for s in ewm_specs(col, out, alpha)]
    d = linear_recurrences(df, specs, key=key, order=order)
    for _, out, _ in items:
        d = ewm_finish(d, out)
    return d


def ewm_mean(df: DataFrame, col: str, out: str, alpha: float, key="tic", order="date") -> DataFrame:
    return ewm_means(df, [(col, out, alpha)], key=key, order=order)
