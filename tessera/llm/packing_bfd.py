"""Best-fit-decreasing packing into id matrices.

Each task takes its input split in blocks of about ``block_tokens`` ids.  Documents longer
than a window are split losslessly into full windows and a remainder; the remainders of a
block, longest first, go into the open window with the least room that still holds them,
found by a segment tree over capacities.  The windows of a block are written as matrices of
up to ``matrix_rows`` rows with cumulative segment lengths and position resets.  No shuffle;
memory is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.tokens import WordEncoder, default_tokenizer

SCHEMA = ("matrix_id long, n_rows int, n_cols int, input_ids binary, position_ids binary, "
          "cu_seqlens array<int>, doc_ids array<long>, starts array<long>, doc_tokens array<long>")
IDS_PER_TASK = 1 << 40


class CapacityTree:
    """Maximum segment tree over capacities: leaf ``c`` is set while a window has room ``c``.
    ``best(size)`` walks to the smallest set leaf of at least ``size``."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.full = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        if not room:
            return
        self.windows[room].append(window)
        k = room + self.leaves
        while k and not self.full[k]:
            self.full[k] = True
            k >>= 1

    def best(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window that holds ``size``, taken out of the tree."""
        k = size + self.leaves
        while not self.full[k]:
            while k & 1:  # no right sibling below this ancestor
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.full[2 * k] else 2 * k + 1
        room = k - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.full[k] = False
            k >>= 1
            while k and not (self.full[2 * k] or self.full[2 * k + 1]):
                self.full[k] = False
                k >>= 1
        return room, window


def best_fit_decreasing(sizes: list[int], window: int) -> list[list[int]]:
    """Windows as lists of indexes into ``sizes`` (each 1 to ``window``)."""
    tree, windows = CapacityTree(window), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.best(sizes[i])
        if found is None:
            room, w = window, len(windows)
            windows.append([])
        else:
            room, w = found
        windows[w].append(i)
        tree.add(room - sizes[i], w)
    return windows


def _matrix(windows: list[list[tuple]], window: int, pad_id: int, matrix_id: int) -> dict:
    """One output row.  ``cu_seqlens`` runs over the flattened matrix: a padded tail is a
    segment of its own, with null document and start."""
    parts, sizes, docs, starts, totals = [], [], [], [], []
    for pieces in windows:
        room = window
        for doc, start, piece, total in pieces:
            parts.append(piece)
            sizes.append(len(piece))
            docs.append(doc)
            starts.append(start)
            totals.append(total)
            room -= len(piece)
        if room:
            parts.append(np.full(room, pad_id, dtype="<u4"))
            sizes.append(room)
            docs.append(None)
            starts.append(None)
            totals.append(None)
    cu = np.concatenate([[0], np.cumsum(sizes)])
    pos = np.arange(cu[-1]) - np.repeat(cu[:-1], sizes)
    return {"matrix_id": matrix_id, "n_rows": len(windows), "n_cols": window,
            "input_ids": np.concatenate(parts).astype("<u4", copy=False).tobytes(), "position_ids": pos.astype("<u2").tobytes(),
            "cu_seqlens": cu.tolist(), "doc_ids": docs, "starts": starts, "doc_tokens": totals}


_ARROW = pa.schema([("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("n_cols", pa.int32()),
                    ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                    ("doc_tokens", pa.list_(pa.int64()))])


def pack_best_fit(df: DataFrame, window: int = 2048, end_id: int = 1, pad_id: int = 0, tokenizer: str | None = None,
                  matrix_rows: int = 64, block_tokens: int = 4_000_000, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per id matrix (``SCHEMA``; ids little-endian uint32, positions uint16, so windows of
    up to 65,536; both row by row).

    Null and empty texts hold only ``end_id``; null ids stay null (their pieces keep a start);
    repeated rows are packed each; every id of every document lies in exactly one segment;
    other columns are ignored; an empty table gives no rows."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(pieces: list[tuple], next_id: int) -> Iterator[pa.RecordBatch]:
        whole = [[p] for p in pieces if len(p[2]) == window]
        part = [p for p in pieces if len(p[2]) < window]
        windows = whole + [[part[i] for i in w] for w in best_fit_decreasing([len(p[2]) for p in part], window)]
        for at in range(0, len(windows), matrix_rows):
            row = _matrix(windows[at:at + matrix_rows], window, pad_id, next_id)
            next_id += 1
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(path)
        pieces, tokens, next_id = [], 0, TaskContext.get().partitionId() * IDS_PER_TASK
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.frombuffer(enc.encode(text) + end, dtype="<u4")
                    pieces += [(doc, s, ids[s:s + window], len(ids)) for s in range(0, len(ids), window)]
                    tokens += len(ids)
                    if tokens >= block_tokens:
                        for out in flush(pieces, next_id):
                            next_id += 1
                            yield out
                        pieces, tokens = [], 0
        if pieces:
            yield from flush(pieces, next_id)

    return df.select(df[id_col].cast("long"), df[text_col].cast("string")).mapInArrow(run, SCHEMA)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Write the packed matrices as Parquet files of binary rows (any store Spark can write)."""
    matrices.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of written matrices: doc_id, start, ids (binary), doc_tokens; padding is
    left out.  The inverse of ``pack_best_fit`` up to the order of rows."""
    return segments(spark.read.parquet(path))


def segments(matrices: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    one = matrices.select(
        "matrix_id", "input_ids", F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")), "cu_seqlens")
    lo, hi = F.get("cu_seqlens", F.col("pos")), F.get("cu_seqlens", F.col("pos") + 1)
    return (one.filter(F.col("col.starts").isNotNull())
            .select(F.col("col.doc_ids").alias("doc_id"), F.col("col.starts").alias("start"),
                    F.substring("input_ids", lo * 4 + 1, (hi - lo) * 4).alias("ids"),
                    F.col("col.doc_tokens").alias("doc_tokens"), "matrix_id"))
