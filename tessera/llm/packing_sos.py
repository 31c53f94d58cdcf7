"""Sum-of-squares online packing into fixed token windows.

Each task packs the documents of its own input split as they come.  A document is cut into
full windows plus a remainder; the remainder goes into the fill level that minimises the sum
of squared counts of partially filled windows, tracked in an array with one entry per level.
No shuffle, no driver state; memory is one batch of texts plus at most ``max_open`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.tokens import WordEncoder, default_tokenizer

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
#: Sequence ids of a task start at its partition id times this.
IDS_PER_TASK = 1 << 40


class SumOfSquares:
    """Open windows by fill level.  ``place`` returns the pieces of windows that are full;
    ``drain`` closes all others, cutting pieces so that at most one window is left short."""

    def __init__(self, window: int, max_open: int, first_id: int):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.n_open = 0
        self.next_id = first_id

    def _close(self, pieces: list) -> list[tuple]:
        sid, off, rows = self.next_id, 0, []
        self.next_id += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, ids, total, sid, off))
            off += n
        return rows

    def level_for(self, size: int) -> int:
        """Level (0: a new window) whose use for ``size`` gives the least sum of squares;
        ties go to the fullest window."""
        c, w = self.counts, self.window
        # twice (N[h+size] - N[h] + 1); a window that gets full leaves the array: one less
        delta = 2 * (c[size + 1:w + 1] - c[1:w - size + 1]) + 2
        if len(delta):
            delta[-1] = 1 - 2 * c[w - size]
            delta = np.where(c[1:w - size + 1] > 0, delta, np.iinfo(np.int64).max)
            k = len(delta) - 1 - int(np.argmin(delta[::-1]))
            if delta[k] <= 2 * c[size] + 1:
                return k + 1
        return 0

    def place(self, doc, ids: bytes) -> list[tuple]:
        total, rows, at = len(ids) // 4, [], 0
        while total - at >= self.window:
            rows += self._close([(doc, at, ids[4 * at:4 * (at + self.window)], total)])
            at += self.window
        size = total - at
        if size:
            h = self.level_for(size)
            pieces = self.open[h].pop() if h else []
            pieces.append((doc, at, ids[4 * at:], total))
            self.counts[h] -= h > 0
            self.n_open -= h > 0
            if h + size == self.window:
                rows += self._close(pieces)
            else:
                self.open.setdefault(h + size, []).append(pieces)
                self.counts[h + size] += 1
                self.n_open += 1
                if self.n_open >= self.max_open:
                    rows += self.drain()
        return rows

    def drain(self) -> list[tuple]:
        """Fill the fullest windows with pieces cut from the emptiest."""
        left = [(lv, p) for lv in sorted(self.open, reverse=True) for p in self.open[lv]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        rows, lo = [], len(left) - 1
        spare = list(left[lo][1]) if left else []
        for hi, (level, pieces) in enumerate(left):
            if hi >= lo:
                break
            gap = self.window - level
            while gap and lo > hi:
                doc, start, ids, total = spare.pop()
                n = len(ids) // 4
                if n > gap:
                    spare.append((doc, start, ids[:4 * (n - gap)], total))
                    pieces.append((doc, start + n - gap, ids[4 * (n - gap):], total))
                    gap = 0
                else:
                    pieces.append((doc, start, ids, total))
                    gap -= n
                if not spare:
                    lo -= 1
                    spare = list(left[lo][1]) if lo > hi else []
            if lo <= hi:  # this window took the last spare pieces: it is the short one
                rows += self._close(pieces)
                return rows
            rows += self._close(pieces)
        if spare:
            rows += self._close(spare)
        return rows


def pack_sum_of_squares(df: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None,
                        id_col: str = "doc_id", text_col: str = "text", max_open: int = 4096) -> DataFrame:
    """Pieces (``SCHEMA``) of every row of ``df`` packed into windows of ``window`` ids.

    Null and empty texts hold only ``end_id``; null ids stay null; repeated rows are packed
    each; longer documents are cut, every id lies in exactly one piece; other columns are
    ignored; an empty table gives no rows.  A task leaves at most one short window per
    ``max_open`` opened."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(path)
        packer = SumOfSquares(window, max_open, TaskContext.get().partitionId() * IDS_PER_TASK)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows += packer.place(doc, enc.encode(text) + end)
                if rows:
                    yield to_batch(rows)
        rows = packer.drain()
        for at in range(0, len(rows), 1024):
            yield to_batch(rows[at:at + 1024])

    return df.select(df[id_col].cast("long"), df[text_col].cast("string")).mapInArrow(run, SCHEMA)
