"""Projections, casts, filters and data-quality checks (PRJ-*, FLT-01..06, QLT-*)."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import round_half_even
from tessera.operators.series import IDX, with_index

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-01 keep the named columns in order."""
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-01 drop the named columns."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """PRJ-02 rename by map, or by a whole new list of names."""
    if isinstance(mapping, Mapping):
        return df.withColumnsRenamed(dict(mapping))
    return df.toDF(*mapping)


def round_even(df: DataFrame, n: int, cols: Sequence[str] | None = None,
               exclude: Iterable[str] = ()) -> DataFrame:
    """PRJ-06 round half-even to ``n`` digits: the given columns, or every numeric column
    except ``exclude`` (pandas ``round``: half-even on the scaled double)."""
    targets = list(cols) if cols is not None else numeric_columns(df, exclude)
    types = dict(df.dtypes)
    return df.withColumns({c: (round_half_even(c, n) if types[c] in ("double", "float")
                               else F.col(c)) for c in targets})


def parse_date(c: Column | str, strict: bool = True) -> Column:
    """PRJ-04 ISO date parse; strict raises on a bad value (ANSI), lenient gives null."""
    c = F.col(c) if isinstance(c, str) else c
    if strict:
        return F.to_date(c)
    return F.to_date(F.try_to_timestamp(c.cast("string")))


def parse_rating(c: Column | str) -> Column:
    """PRJ-05 rating text -> truncated INT; text that is not a number -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string")).try_cast("double").try_cast("int")


def constant_days(spark: SparkSession, start: str, end: str, values: Mapping[str, float],
                  date_col: str = "date") -> DataFrame:
    """PRJ-07 one row per day in [start, end] with constant columns."""
    row = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(date_col))
    return row.select(date_col, *[F.lit(float(v)).alias(k) for k, v in values.items()])


def day_ordinal(c: Column | str) -> Column:
    """PRJ-08 days since 1970-01-01."""
    return F.unix_date(F.col(c) if isinstance(c, str) else c)


def from_day_ordinal(c: Column | str) -> Column:
    """PRJ-08 inverse of ``day_ordinal``."""
    return F.date_from_unix_date(F.col(c) if isinstance(c, str) else c)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """FLT-01 drop rows with a null in any column (or in ``subset``)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def is_bad_number(c: Column | str) -> Column:
    """null, NaN or +-infinity."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def drop_invalid(df: DataFrame, cols: Sequence[str], warmup: int = 10, key="tic", order="date") -> DataFrame:
    """FLT-02 drop rows with null / NaN / +-inf in any of ``cols``, or with a zero in any
    of ``cols`` within the first ``warmup`` rows of the key (indicator warm-up)."""
    bad = reduce(lambda a, b: a | b, [is_bad_number(c) for c in cols])
    zero = reduce(lambda a, b: a | b, [F.col(c) == 0 for c in cols])
    added = IDX not in df.columns
    d = with_index(df, key, order) if added else df
    d = d.filter(~(bad | ((F.col(IDX) < warmup) & F.coalesce(zero, F.lit(False)))))
    return d.drop(IDX) if added else d


def date_window(c: Column | str, start, end) -> Column:
    """FLT-03 inclusive date range predicate (prunes partitions when ``c`` is a partition column)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def blank_refusals(c: Column | str, marker: str = "AI language model") -> Column:
    """FLT-04 a rating that contains the refusal marker becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.coalesce(c.contains(marker), F.lit(False)), c)


def blank_long(c: Column | str, n: int = 4) -> Column:
    """FLT-05 a rating longer than ``n`` characters becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) <= n, c)


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """FLT-06 (rows with a target, rows without)."""
    return df.filter(F.col(target).isNotNull()), df.filter(F.col(target).isNull())


# --- quality -------------------------------------------------------------------------

def check_contract(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """QLT-01 one aggregate pass: for each contracted column, the number of non-null values
    that do not convert to the declared type, and whether the column is present.
    Result columns: column, declared, present, violations."""
    present = set(df.columns)
    aggs = []
    for c, t in types.items():
        if c in present:
            v = F.sum(F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull(), 1)
                      .otherwise(0))
        else:
            v = F.lit(None)
        aggs.append(F.coalesce(v.cast("long"), F.lit(0)).alias(f"v_{len(aggs)}"))
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("declared"),
                      F.lit(c in present).alias("present"), F.col(f"v_{i}").alias("violations"))
             for i, (c, t) in enumerate(types.items())]
    return row.select(F.inline(F.array(*items)))


def null_profile(df: DataFrame) -> DataFrame:
    """QLT-02 number of nulls per column, one row per column (single aggregate pass)."""
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    items = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"n_{i}"), F.lit(0)).alias("nulls"))
             for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*items)))


def snapshot(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """QLT-03 / SRT-02 head ``n`` rows in a stated order (TakeOrdered, no full sort)."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """QLT-03 (rows, columns) of a frame in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """QLT-04 distinct values of a column."""
    return df.select(col).distinct()


def today() -> dt.date:
    return dt.date.today()
