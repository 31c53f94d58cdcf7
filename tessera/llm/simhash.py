"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other have a point in the middle, within half
the radius of both.  So every distinct fingerprint emits all its variants within half the
radius (65 for a radius of 2) and a shuffle on the variants brings the pairs together.  A
variant's list holds at most one entry per mask, whatever the data: no list is hot.  Members of
one list are linked with each other, so a star around the smallest stands for all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pinned
from tessera.llm.components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: A class with more than this share of all rows is met by broadcast: at most its inverse many.
HOT_SHARE = 1e-4
_UP = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: bytes | None, width: int) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    words = (text or b"").translate(_UP).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row: the 64-bit SimHash, as a signed long, of the ``width``-word shingles
    of the whole text, repeats counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    slim = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return slim.mapInArrow(run, "id long, fp long")


def ball(half: int) -> list[int]:
    """All masks of at most ``half`` of the 64 bits, as signed longs."""
    masks = [sum(1 << i for i in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    return np.array(masks, dtype=np.uint64).view(np.int64).tolist()


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Spanning edges (a, b) of the graph of the fingerprints of ``distinct`` (fp) that differ in
    ``radius`` bits or fewer; ``radius`` is even."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4")
    posts = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("mask"))
    posts = posts.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = posts.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> low")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("low")))
    return met.filter(apart <= radius).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def near_fingerprints(df: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, fp, component): per row its fingerprint and the smallest id that it reaches over
    fingerprints that differ in at most ``radius`` bits.

    Null and empty texts, and texts of white space, have the fingerprint 0 and are linked like any
    other; null ids are larger than any other (a component of null ids only is null); repeated
    rows share a fingerprint and come back each; other columns are ignored; an empty table gives
    no rows."""
    rows = pinned(fingerprints(df, width, id_col, text_col))
    classes = pinned(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = pinned(components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp"))
    first = classes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("reached"))
    linked = roots.join(first, "root").select("fp", "reached")
    # a class of one row without links is its own component and needs no entry
    told = classes.join(linked, "fp", "left").filter("n > 1 OR reached IS NOT NULL")
    told = pinned(told.select("fp", "n", F.coalesce("reached", "first").alias("component")))
    hot = F.col("n") > F.lit(rows.count() * HOT_SHARE)
    few = F.broadcast(told.filter(hot).select("fp", "component"))
    rest = rows.join(few.select("fp"), "fp", "left_anti").join(told.filter(~hot).select("fp", "component", F.lit(True).alias("_met")), "fp", "left")
    rest = rest.withColumn("component", F.when(F.col("_met"), F.col("component")).otherwise(F.col("id")))
    out = ["id", "fp", "component"]
    return rows.join(few, "fp").select(*out).unionByName(rest.select(*out))


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
