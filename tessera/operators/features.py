"""Feature frame construction (ML-01..05, ML-16, WIN-04)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import round_half_up

from tessera.functions.dates import cyclic_dates
from tessera.operators.joins import shift
from tessera.session import broadcast_bounded, materialize


def one_hot_month(df: DataFrame, date: str = "date", prefix: str = "Month_") -> DataFrame:
    """ML-01 always the 12 columns Month_1..Month_12 (0/1), whatever months are present."""
    m = F.month(date)
    return df.withColumns({f"{prefix}{k}": (m == k).cast("int") for k in range(1, 13)})


def lead_target(df: DataFrame, n: int, col: str = "close", out: str = "target", key: str = "tic",
                order: str = "date") -> DataFrame:
    """WIN-04 / ML-16: ``col`` n rows ahead within the key (null for the last n rows)."""
    return shift(df, [col], n, key=key, order=order, suffix="__t").withColumnRenamed(col + "__t", out)


def add_calendar_features(df: DataFrame, date: str = "date", day: str = "day") -> DataFrame:
    """ML-05 date features of the model frame: cyclic encodings, Year, Day, one-hot month."""
    d = cyclic_dates(df, date, day)
    d = d.withColumn("Year", F.year(date)).withColumn("Day", F.dayofmonth(date))
    return one_hot_month(d, date)


def standardise(df: DataFrame, cols: Sequence[str], key: str = "tic", fit_mask: str | None = None,
                suffix: str = "") -> DataFrame:
    """ML-02 z-score per key with the POPULATION std (zero variance -> divide by 1),
    fitted on rows where ``fit_mask`` is true (all rows when None) and applied to all.
    One aggregate pass, joined back on the key."""
    cols = list(cols)
    df = materialize(df)
    m = F.col(fit_mask) if fit_mask else F.lit(True)
    stats = df.groupBy(key).agg(*[F.avg(F.when(m, F.col(c))).alias(f"_mu_{i}") for i, c in enumerate(cols)],
                                *[F.stddev_pop(F.when(m, F.col(c))).alias(f"_sd_{i}") for i, c in enumerate(cols)])
    d = df.join(stats, key, "left")
    for i, c in enumerate(cols):
        sd = F.col(f"_sd_{i}")
        d = d.withColumn(c + suffix, (F.col(c) - F.col(f"_mu_{i}")) / F.when((sd == 0) | sd.isNull(), 1.0).otherwise(sd))
    return d.drop(*[f"_mu_{i}" for i in range(len(cols))], *[f"_sd_{i}" for i in range(len(cols))])


def minmax(df: DataFrame, cols: Sequence[str], key: str = "tic") -> DataFrame:
    """ML-03 min-max scale to [0, 1] per key; constant columns -> 0."""
    cols = list(cols)
    df = materialize(df)
    stats = df.groupBy(key).agg(*[F.min(c).alias(f"_lo_{i}") for i, c in enumerate(cols)],
                                *[F.max(c).alias(f"_hi_{i}") for i, c in enumerate(cols)])
    d = df.join(stats, key, "left")
    for i, c in enumerate(cols):
        rng = F.col(f"_hi_{i}") - F.col(f"_lo_{i}")
        d = d.withColumn(c, F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_lo_{i}")) / rng))
    return d.drop(*[f"_lo_{i}" for i in range(len(cols))], *[f"_hi_{i}" for i in range(len(cols))])


def hash_split(df: DataFrame, keys: Sequence[str], fractions: Sequence[float] = (0.9, 0.1),
               names: Sequence[str] = ("train", "test"), seed: int = 42, out: str = "split") -> DataFrame:
    """ML-04 deterministic split by a hash of the row key (stable under re-partitioning,
    unlike ``randomSplit``): bucket = first 32 bits of md5(seed|key...) mod 1000.  md5 is
    the same in every SQL engine, so the split can be reproduced outside Spark; keys are
    hashed in their string form (strings, integers, dates)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    b = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1000
    edges, acc = [], 0.0
    for f in fractions:
        acc += f
        edges.append(int(round(acc * 1000)))
    expr = None
    for e, name in zip(edges, names):
        expr = F.when(b < e, name) if expr is None else expr.when(b < e, name)
    return df.withColumn(out, expr.otherwise(names[-1]))


def _digits(text, width: int = 5) -> list:
    """``width`` digits of 12 bits (three hexadecimal characters each) of the MD5 of ``text``."""
    return [F.substring(F.md5(text.cast("binary")), 3 * i + 1, 3) for i in range(width)]


def exact_split(df: DataFrame, group: Sequence[str], keys: Sequence[str], share: float = 0.1,
                names: Sequence[str] = ("train", "test"), seed: int = 42, out: str = "split") -> DataFrame:
    """ML-04 split with exact counts: of the ``n`` rows of every ``group``, ``ceil(n * share)`` get
    ``names[1]``, those with the largest seeded MD5 of ``keys``; the same rows on every run unless
    keys repeat.

    No sort: rows are counted by the first 12 bits of the hash, the bucket that holds the cut is
    counted by the next 12, and so on, until the cut falls between two buckets; a later pass reads
    the rows of one bucket a group.  Rows that agree in 60 bits are told apart by their place in
    a written copy of the table.  Null groups are a group, null keys read as empty; an empty table
    gives no rows."""
    group = list(group)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    place = F.monotonically_increasing_id().cast("string")
    safe = F.to_json(F.array(*[F.col(g).cast("string") for g in group])) if group else F.lit("")
    d = materialize(df.withColumns({"_g": safe, "_h": F.concat(*_digits(text)), "_i": F.concat(*_digits(F.concat(place, F.lit("#"))))}), pin=True)
    path = F.concat("_h", "_i")
    sizes = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    cut = materialize(sizes.select("_g", (F.col("_n") - F.ceil(F.round(F.col("_n") * share, 6))).alias("_need"), F.lit("").alias("_cut"),
                                   F.lit(True).alias("_open")), pin=True)
    for level in range(10):
        if cut.filter("_open").isEmpty():
            break
        live = cut.filter("_open")
        at = (d.select("_g", path.alias("_path")).join(broadcast_bounded(live), "_g")
              .filter(F.col("_path").startswith(F.col("_cut"))))
        hist = at.groupBy("_g", F.substring("_path", 3 * level + 1, 3).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        # 4096 buckets a group at most
        upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_b"))
        met = hist.withColumn("_u", upto).join(live, "_g").filter(F.col("_u") > F.col("_need"))
        first = met.groupBy("_g").agg(F.min_by(F.struct("_b", "_c", "_u"), "_b").alias("_f"))
        told = live.join(first, "_g", "left")
        left = F.col("_need") - (F.col("_f._u") - F.col("_f._c"))
        step = told.select("_g", F.coalesce(left, F.lit(0)).alias("_need"),
                           # no bucket beyond: the cut lies behind all rows of this one
                           F.when(F.col("_f").isNull(), F.concat("_cut", F.lit("~"))).otherwise(F.concat("_cut", "_f._b")).alias("_cut"),
                           (F.col("_f").isNotNull() & (left > 0)).alias("_open"))
        cut = materialize(step.unionByName(cut.filter("NOT _open")), pin=True)
    told = d.join(broadcast_bounded(cut.select("_g", "_cut")), "_g")
    return told.withColumn(out, F.when(path < F.col("_cut"), names[0]).otherwise(names[1])).select(*df.columns, out)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", digits: int | None = None) -> DataFrame:
    """ML-05 feature vector as ARRAY<DOUBLE> (the length-1 time axis of the reference's
    3-D arrays carries nothing and is dropped); ``digits`` rounds every element, so that the
    order of summation in the statistics does not show."""
    one = [F.col(c).cast("double") for c in cols]
    return df.withColumn(out, F.array(*[round_half_up(c, digits) if digits is not None else c for c in one]))
