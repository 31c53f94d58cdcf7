"""Scans of landed data (SRC-01..06, SRC-11..13).

Fetching from vendors is outside the library: landed files (CSV, JSON, parquet) are the
boundary.  Every reader returns a lazy DataFrame with a declared schema, so filters and
projections reach the scan.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import html_to_text


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """SRC-01 headered CSV (empty and the text ``None`` are null) or parquet/json by
    extension; ``schema`` is declared, never inferred, for CSV."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else
                  "json" if path.endswith((".json", ".ndjson")) else "csv")
    r = spark.read
    if fmt == "csv":
        r = r.option("header", True).option("nullValue", "None").option("emptyValue", None)
        if schema is not None:
            r = r.schema(schema)
        return r.csv(path)
    if fmt == "json":
        return (r.schema(schema) if schema is not None else r).json(path)
    df = r.parquet(path)
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields])
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the session (works for any
    scheme the cluster is configured for)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def read_optional(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame | None:
    """SRC-02 a missing source is reported and becomes ``None`` (later joins skip it)."""
    if not path_exists(spark, path):
        print(f"source not found: {path}")
        return None
    return read_table(spark, path, schema, fmt)


def null_columns(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks as typed nulls (stable schema when
    an optional source is absent)."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in st.fields if f.name not in df.columns})


def read_by_ticker(spark: SparkSession, glob: str, pattern: str = r"([^/]+?)(?:_[a-z]+)?\.[a-z]+$",
                   schema=None, fmt: str | None = None, col: str = "tic") -> DataFrame:
    """SRC-03 per-ticker files matched by ``glob`` -> one table, ``tic`` taken from the
    file name (``_metadata.file_path``)."""
    df = read_table(spark, glob, schema, fmt)
    return df.withColumn(col, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def load_bars(raw: DataFrame, tickers: Sequence[str], start: str, end: str, adjusted: str | None = None) -> DataFrame:
    """SRC-04 landed daily bars -> requested tickers, start <= date < end, close :=
    adjusted close when given, day of week (Monday = 0), rows with any null dropped.
    Raises if no requested ticker has a row (a look at one row); single empty tickers are told by
    ``source_health`` (AGG-10)."""
    d = raw.filter(F.col("tic").isin(list(tickers)) & (F.col("date") >= F.lit(start).cast("date"))
                   & (F.col("date") < F.lit(end).cast("date")))
    if adjusted:
        d = d.withColumn("close", F.col(adjusted)).drop(adjusted)
    d = d.withColumn("day", F.weekday("date")).na.drop(how="any")
    if d.isEmpty():
        raise ValueError(f"no rows for any of {list(tickers)} in [{start}, {end})")
    return d


def explode_payload(df: DataFrame, json_col: str, key: str, record_schema: str | T.StructType,
                    keep: Sequence[str] = ()) -> DataFrame:
    """SRC-05 a JSON object holding one named array of records -> one row per record.
    A payload without ``key`` yields no rows (and ``payload_missing_key`` counts them)."""
    st = ("struct<" + ddl_fields(record_schema) + ">") if isinstance(record_schema, str) \
        else record_schema.simpleString()
    arr = F.from_json(F.col(json_col), f"struct<`{key}`: array<{st}>>")[key]
    return df.select(*keep, F.inline_outer(F.coalesce(arr, F.array().cast(f"array<{st}>"))))


def ddl_fields(schema: str) -> str:
    """'a string, b: int, c array<string>' -> 'a: string, b: int, c: array<string>'."""
    parts, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    out = []
    for p in parts:
        p = p.strip()
        if not p:
            continue
        head = p.split("<", 1)[0]
        name, typ = (x.strip() for x in (p.split(":", 1) if ":" in head else p.split(None, 1)))
        out.append(f"`{name}`: {typ}")
    return ", ".join(out)


def payload_missing_key(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """SRC-05 message side: number of payloads without the named key."""
    return df.agg(F.sum(F.get_json_object(json_col, f"$.{key}").isNull().cast("long")).alias("missing"))


def load_news(raw: DataFrame, created: str = "created", title: str = "title", body: str = "body") -> DataFrame:
    """SRC-06 story records -> (created DATE, title, body): lenient timestamp parse, quotes
    removed from titles, HTML bodies to clean text, rows missing any of the three dropped."""
    d = raw.select(F.to_date(F.try_to_timestamp(F.col(created).cast("string"))).alias("created"),
                   F.regexp_replace(F.col(title), '"', "").alias("title"),
                   html_to_text(F.col(body)).alias("body"))
    return d.na.drop(subset=["created", "title", "body"])


def load_videos(raw: DataFrame, start: str, end: str, published: str = "publishedAt") -> DataFrame:
    """SRC-11 video items: created = first 10 characters of the timestamp as a date,
    kept when start <= created <= end (inclusive)."""
    c = F.to_date(F.substring(F.col(published).cast("string"), 1, 10))
    return raw.withColumn("created", c).filter(c.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def load_macro_series(raw: DataFrame, names: Mapping[str, str], series: str = "series_id") -> DataFrame:
    """SRC-12 long (series_id, date, value) restricted to the wanted ids, named."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return raw.filter(F.col(series).isin(list(names))).withColumn("name", m[F.col(series)])


def resume_scan(rated: DataFrame | None, raw: DataFrame, rating: str = "benz_rate", on: str | None = None) -> DataFrame:
    """SRC-13 the already-rated table if present, else the raw table with an empty
    rating column.  With ``on`` a present table is completed: the raw rows whose ``on`` it lacks
    follow with an empty rating (null ids are never taken for rated)."""
    empty = F.lit(None).cast("string")
    if rated is None:
        return raw.withColumn(rating, empty)
    if on is None:
        return rated
    rest = raw.join(rated.select(on), on, "left_anti").withColumn(rating, empty)
    return rated.unionByName(rest.select(*rated.columns))
