"""Screening, calendar-feed filters, paging and cross-sectional statistics
(FLT-07..12, SRT-02..06, AGG-13, AGG-14)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import parse_amount

from tessera.functions.text import SUFFIX
from tessera.operators.joins import skew_join
from tessera.operators.series import _chunked, _safe_keys, default_chunk
from tessera.session import broadcast_bounded, materialize

_OPS = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "eq": lambda c, v: c == v,
        "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}


def amount(v) -> float | None:
    """Driver-side amount text ('1b', '250m', 1e9) -> float."""
    if v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    t = str(v).strip().lower()
    if t and t[-1] in SUFFIX:
        return float(t[:-1]) * SUFFIX[t[-1]]
    return float(t)


def _and(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def by_importance(df: DataFrame, importance: int | None, col: str = "importance") -> DataFrame:
    """FLT-07 importance equality on a calendar feed (no filter when None)."""
    return df if importance is None else df.filter(F.col(col) == importance)


def calendar_query(df: DataFrame, as_of=None, date_from=None, date_to=None, tickers: Sequence[str] | None = None,
                   updated_since=None, country: str | None = None, action: str | None = None,
                   yield_op: str | None = None, yield_value: float | None = None, importance: int | None = None,
                   date_col: str = "date", ticker_col: str = "ticker") -> DataFrame:
    """FLT-08 optional conjuncts of a calendar feed query; ``None`` leaves a filter out.
    ``as_of`` means a single date; ``yield_op`` is one of gt/gte/eq/lte/lt."""
    c: list[Column] = []
    d = F.col(date_col)
    if as_of is not None:
        c.append(d == F.lit(str(as_of)).cast("date"))
    if date_from is not None:
        c.append(d >= F.lit(str(date_from)).cast("date"))
    if date_to is not None:
        c.append(d <= F.lit(str(date_to)).cast("date"))
    if tickers:
        c.append(F.col(ticker_col).isin(list(tickers)))
    if updated_since is not None:
        c.append(F.col("updated") >= F.lit(updated_since))
    if country is not None:
        c.append(F.col("country") == country)
    if action is not None:
        c.append(F.col("action") == action)
    if yield_op is not None:
        if yield_op not in _OPS:
            raise ValueError(f"yield_op must be one of {sorted(_OPS)}")
        c.append(_OPS[yield_op](F.col("yield"), F.lit(float(yield_value))))
    if importance is not None:
        c.append(F.col("importance") == importance)
    return df.filter(_and(c))


def screener(df: DataFrame, cap_gt=None, cap_lt=None, close_gt=None, sector_in: Sequence[str] | None = None,
             sort: str | None = None, direction: str = "asc") -> DataFrame:
    """FLT-09 market-cap / close / sector screen; amounts accept suffixes ('1b')."""
    c = []
    if cap_gt is not None:
        c.append(F.col("marketcap") > amount(cap_gt))
    if cap_lt is not None:
        c.append(F.col("marketcap") < amount(cap_lt))
    if close_gt is not None:
        c.append(F.col("close") > float(close_gt))
    if sector_in:
        c.append(F.col("sector").isin(list(sector_in)))
    out = df.filter(_and(c))
    if sort:
        out = out.orderBy(F.col(sort).desc() if direction == "desc" else F.col(sort).asc())
    return out


def change_over(df: DataFrame, start, end, key: str = "tic", date: str = "date", price: str = "close") -> DataFrame:
    """First and last price per key within [start, end] and the change in percent."""
    w = df.filter(F.col(date).between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    g = w.groupBy(key).agg(F.min_by(price, date).alias("first"), F.max_by(price, date).alias("last"))
    return g.withColumn("change_pct", F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100)


def movers(df: DataFrame, start, end, k: int = 10, key: str = "tic", date: str = "date", universe: DataFrame | None = None,
           market_cap_gt: str | None = None, market_cap_lt: str | None = None, close_gt: float | None = None,
           sector: str | None = None, industry: str | None = None, session: str | None = None) -> DataFrame:
    """FLT-10 / SRT-04 top-k gainers and losers by change % over [start, end]
    (``side``, ``rank``); each side is a TakeOrdered, no full sort.

    The filters look at ``universe`` (key, marketcap, close, sector, industry; one row a
    ticker): market caps as amounts ("1b"), a least close, a sector, an industry.  ``session``
    keeps the rows of one session of an intraday ``date`` column."""
    if session is not None:
        df = df.filter(market_session(F.col(date)) == session)
    wanted = []
    for name, op, value in (("marketcap", "gt", market_cap_gt), ("marketcap", "lt", market_cap_lt), ("close", "gt", close_gt)):
        if value is not None:
            bound = parse_amount(F.lit(str(value)))
            wanted.append(F.col(name) > bound if op == "gt" else F.col(name) < bound)
    wanted += [F.col(c) == v for c, v in (("sector", sector), ("industry", industry)) if v is not None]
    if wanted:
        if universe is None:
            raise ValueError("the filters need a universe")
        for cond in wanted:
            universe = universe.filter(cond)
        df = df.join(universe.select(key).distinct(), key, "left_semi")
    ch = change_over(df, start, end, key, date)
    g = ch.orderBy(F.col("change_pct").desc(), F.col(key)).limit(k).withColumn("side", F.lit("gainer"))
    losers = ch.orderBy(F.col("change_pct").asc(), F.col(key)).limit(k).withColumn("side", F.lit("loser"))
    return g.unionByName(losers)


def market_session(ts) -> Column:
    """Session of a wall-clock timestamp: PRE_MARKET before 9:30, REGULAR to 16:00, AFTER_MARKET."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(minute < 570, "PRE_MARKET").when(minute < 960, "REGULAR").otherwise("AFTER_MARKET")


def autocomplete(df: DataFrame, q: str, method: str = "symbol", limit: int = 10, symbol: str = "symbol",
                 name: str = "name", exchanges: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """FLT-11 symbol lookup: ``symbol`` prefix; ``symbol_name`` prefix of the symbol or of
    any word of the name; ``symbol_within`` substring of the symbol.  Case-insensitive,
    ordered by symbol, first ``limit``; only the given exchanges and types, if any."""
    ql = q.lower()
    s = F.lower(F.col(symbol))
    if method == "symbol":
        cond = s.startswith(ql)
    elif method == "symbol_name":
        cond = s.startswith(ql) | F.exists(F.split(F.lower(F.col(name)), " "), lambda w: w.startswith(ql))
    elif method == "symbol_within":
        cond = s.contains(ql)
    else:
        raise ValueError("method must be symbol, symbol_name or symbol_within")
    for column, values in (("exchange", exchanges), ("type", types)):
        if values is not None:
            cond = cond & F.col(column).isin(list(values))
    return df.filter(cond).orderBy(symbol).limit(limit)


def lookup_index(df: DataFrame, symbol: str = "symbol", name: str = "name") -> DataFrame:
    """FLT-11 posting table (kind, gram, word, symbol) of a security master: under every prefix of
    one to three characters of the symbol (kind ``s``) and of the words of the name (``w``), and
    under every piece of one to three characters of the symbol (``g``).  Written sorted by
    (kind, gram), a lookup reads the row groups of its grams only.  Rows without a symbol are left
    out, a null name has no words; repeated rows are one."""
    def prefixes(w):
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(w))), lambda n: F.substring(w, F.lit(1), n))

    def posted(kind, grams, w):
        return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram"), w.alias("word")))

    # repeats go before the rows multiply: a symbol, and a symbol with a word, give each posting once
    rows = df.filter(F.col(symbol).isNotNull() & (F.col(symbol) != "")).select(F.col(symbol).alias("symbol"), F.col(name).alias("name")).distinct()
    sym = F.lower("symbol")
    pieces = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(
        F.when(F.length(sym) >= n, F.sequence(F.lit(1), F.length(sym) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(sym, i, n))))
    own = rows.select("symbol").distinct().select(
        "symbol", F.explode(F.concat(posted("s", prefixes(sym), sym), posted("g", F.array_distinct(pieces), sym))).alias("p"))
    word = F.explode(F.filter(F.split(F.lower("name"), " "), lambda w: w != ""))
    words = rows.select("symbol", word.alias("w")).distinct().select("symbol", F.explode(posted("w", prefixes(F.col("w")), F.col("w"))).alias("p"))
    index = own.unionByName(words).select("p.*", "symbol")
    return index.repartitionByRange("kind", "gram", "symbol").sortWithinPartitions("kind", "gram", "symbol")


def lookup(index: DataFrame, q: str, method: str = "symbol") -> DataFrame:
    """(symbol) of the matches of ``autocomplete`` by the postings of the grams of ``q``, each verified
    on the posted word: no scan of the master.  An empty ``q`` raises."""
    ql = q.lower()
    if not ql:
        raise ValueError("nothing to look up")
    if method in ("symbol", "symbol_name"):
        kinds = ["s"] if method == "symbol" else ["s", "w"]
        met = index.filter(F.col("kind").isin(kinds) & (F.col("gram") == ql[:3])).filter(F.col("word").startswith(ql))
        return met.select("symbol").distinct()
    if method != "symbol_within":
        raise ValueError("method must be symbol, symbol_name or symbol_within")
    grams = sorted({ql[i:i + 3] for i in range(len(ql) - 2)} or {ql})
    met = index.filter((F.col("kind") == "g") & F.col("gram").isin(grams)).filter(F.col("word").contains(ql))
    return met.groupBy("symbol").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("symbol")


def page(df: DataFrame, order: Sequence[str], size: int, number: int = 0, last_id=None,
         id_col: str = "id") -> DataFrame:
    """SRT-05 one page: offset paging (page ``number`` of ``size``) or key-set paging
    after ``last_id`` (preferred at scale: a filter plus a TakeOrdered)."""
    if last_id is not None:
        return df.filter(F.col(id_col) > last_id).orderBy(id_col).limit(size)
    return df.orderBy(*order).offset(number * size).limit(size)


def tail_per_key(df: DataFrame, n: int, key: str = "tic", order: str = "date", back: str | None = None) -> DataFrame:
    """SRT-03 last ``n`` rows per key; ``back`` names a column with their place from the end (1: last).

    Rows are counted per (key, calendar bucket); only buckets with fewer than ``n`` rows behind
    them are read whole and numbered, each in its own task: neither the history nor a long key is
    sorted.  Null keys are one key, null orders come first in it."""
    d, kk = _safe_keys(_chunked(df, default_chunk(order, df)), [key], "_tk")
    sizes = d.groupBy(*kk, "_chunk").agg(F.count(F.lit(1)).alias("_c"))
    behind = Window.partitionBy(*kk).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("_later", F.coalesce(F.sum("_c").over(behind), F.lit(0))).filter(F.col("_later") < n).drop("_c")
    rows = d.join(broadcast_bounded(wanted), kk + ["_chunk"])
    place = F.row_number().over(Window.partitionBy(*kk, "_chunk").orderBy(F.desc(order))) + F.col("_later")
    out = rows.withColumn("_place", place).filter(F.col("_place") <= n)
    return out.select(*df.columns, *([F.col("_place").alias(back)] if back else []))


def percentiles(df: DataFrame, metrics: Sequence[str], peer: str) -> DataFrame:
    """AGG-13 percentile rank (0..1, ``percent_rank``: ties share the lowest rank, nulls
    first) of each metric within its peer group."""
    out = df
    for m in metrics:
        out = percent_rank(out, m, peer, f"{m}_pctl")
    return out


def percent_rank(df: DataFrame, metric: str, peer: str, out: str) -> DataFrame:
    """``percent_rank() OVER (PARTITION BY peer ORDER BY metric)`` without a per-peer task.

    Ranks are those of values: rows are counted per (peer, value), and the counts, one row per
    distinct value however many rows hold it, are range-partitioned and prefix-summed (the
    partition id is pinned by a lineage cut).  Rows fetch the rank of their value; values that
    many rows share, null included, are broadcast (``skew_join``)."""
    # keys that are never null; -0.0 and 0.0 are one value
    number = dict(df.dtypes)[metric] in ("double", "float")
    value = F.col(metric) + 0.0 if number else F.col(metric)
    key = {"_kp": F.coalesce(F.concat(F.lit("="), F.col(peer).cast("string")), F.lit("null")),
           "_kv": F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))}
    d = materialize(df.withColumns(key))
    counts = d.groupBy("_kp", "_kv").agg(F.count(F.lit(1)).alias("_c"), F.first(value).alias("_v"))
    counts = materialize(counts.repartitionByRange("_kp", F.asc_nulls_first("_v")).withColumn("_pid", F.spark_partition_id()), pin=True)
    local = Window.partitionBy("_pid", "_kp").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    part = counts.groupBy("_pid", "_kp").agg(F.sum("_c").alias("_pc"))
    before = Window.partitionBy("_kp").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = part.select("_pid", "_kp", F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_off"),
                       F.sum("_pc").over(Window.partitionBy("_kp")).alias("_n"))
    ranks = (counts.withColumn("_r", F.coalesce(F.sum("_c").over(local), F.lit(0))).join(broadcast_bounded(offs), ["_pid", "_kp"])
             .select("_kp", "_kv", "_c", F.when(F.col("_n") > 1, (F.col("_off") + F.col("_r")) / (F.col("_n") - 1))
                     .otherwise(F.lit(0.0)).cast("double").alias(out)))
    ranks = materialize(ranks, pin=True)
    total = ranks.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    return skew_join(d, ranks, ["_kp", "_kv"], "_c", total).select(*df.columns, out)


def alpha_beta(returns: DataFrame, key: str = "tic", date: str = "date", ret: str = "ret") -> DataFrame:
    """AGG-14 textbook regression of each ticker's returns on the market return (the
    equal-weight mean return of all tickers that day): beta = slope, alpha = intercept."""
    mkt = returns.groupBy(date).agg(F.avg(ret).alias("mkt"))
    j = returns.join(mkt, date)
    return j.groupBy(key).agg(F.regr_slope(ret, "mkt").alias("beta"), F.regr_intercept(ret, "mkt").alias("alpha"),
                              F.regr_count(ret, "mkt").alias("n"))
