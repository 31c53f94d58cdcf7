"""Ranked lexical search over K2-treaps of the term-document grid.

``build`` cuts the documents of a task into blocks and writes one row per block: its terms
(grid rows, most frequent first), its documents (grid columns) and the quadtree of the cells
that hold a term in a document, as packed child masks by level with the term counts at the
leaves.  ``search`` gives every quadtree cell the largest impact below it and, item by item,
walks the row paths of the item's terms down together: document ranges are taken best first by
the weighted sum of their cells' maxima and halved, until no range left can reach the k-th
score.  A task carries each item's best from block to block, so later blocks are cut sooner.
Impacts depend on the corpus (N, L), so the maxima are set when a block is read and an index
stays right as tables grow.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pinned

#: A block is full with so many documents or words.
BLOCK_DOCS, BLOCK_WORDS = 4096, 1 << 20
#: Items searched at once hold at most so many bytes of text; they come to the driver and go to the tasks.
ITEM_BYTES = 4 << 20
#: Document ranges halved in one step.
STEP = 256
SCHEMA = ("doc_ids array<long>, lengths array<int>, terms array<binary>, dfs array<int>, "
          "masks array<binary>, tfs binary, held long, words long")
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: By child mask and quadrant: whether the child is there, and how many come before it.
_HAS = np.array([[m >> q & 1 for q in range(4)] for m in range(16)], dtype=bool)
_RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], dtype=np.int32)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and digits and of all other characters, only
    A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit integers moved to the even places of 64."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def quadtree(rows: np.ndarray, cols: np.ndarray, height: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Child masks by level, root first, of the occupied cells (no cell twice) of a grid of side
    ``2**height``, and the order that brings the cells to that of the leaves."""
    code = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(code, kind="stable")
    code, masks = code[order], []
    for _ in range(height):
        bit = np.left_shift(np.uint8(1), (code & np.uint64(3)).astype(np.uint8))
        code = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        masks.append(np.bitwise_or.reduceat(bit, first) if len(code) else bit)
        code = code[first]
    return masks[::-1], order


def _packed(mask: np.ndarray) -> bytes:
    if len(mask) % 2:
        mask = np.append(mask, np.uint8(0))
    return (mask[::2] | mask[1::2] << 4).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    two = np.frombuffer(data, dtype=np.uint8)
    return np.stack([two & 15, two >> 4], axis=1).ravel()[:n]


class _Numbers(dict):
    """Numbers by term, in the order they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Block:
    """Documents gathered until the block is full."""

    def __init__(self, max_docs: int, max_words: int):
        self.max_docs, self.max_words = max_docs, max_words
        self.numbers, self.ids, self.lengths, self.parts = _Numbers(), [], [], []
        self.words = 0

    def add(self, doc_id, text: bytes | None) -> None:
        terms = terms_of(text)
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, terms), dtype=np.int64, count=len(terms)))
        self.words += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= self.max_docs or self.words >= self.max_words

    def row(self) -> pa.RecordBatch:
        n, lengths = len(self.ids), np.array(self.lengths, dtype=np.int64)
        cells = np.concatenate(self.parts) * n + np.repeat(np.arange(n), lengths)
        cells, tf = np.unique(cells, return_counts=True)
        term, doc = np.divmod(cells, n)
        df = np.bincount(term, minlength=len(self.numbers))
        by_df = np.argsort(-df, kind="stable")
        place = np.empty(len(df), dtype=np.int64)
        place[by_df] = np.arange(len(df))
        height = max(1, (max(len(df), n) - 1).bit_length())
        masks, order = quadtree(place[term], doc, height)
        tf = tf[order]
        tfs = tf.astype("u1" if len(tf) == 0 or tf.max() < 256 else "<u4").tobytes()
        names = list(self.numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.lengths], pa.list_(pa.int32())),
             pa.array([[names[i] for i in by_df.tolist()]], pa.list_(pa.binary())),
             pa.array([df[by_df].tolist()], pa.list_(pa.int32())),
             pa.array([[_packed(m) for m in masks]], pa.list_(pa.binary())), pa.array([tfs], pa.binary()),
             pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([self.words], pa.int64())],
            [c.split()[0] for c in SCHEMA.split(", ")])


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The index (``SCHEMA``) of every row of ``df``: one row per block of documents.

    Null and empty texts are columns without cells; null ids stay null; repeated rows are a
    column each; other columns are ignored; an empty table has no blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(block_docs, block_words)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                block.add(i, text.as_py())
                if block.full():
                    yield block.row()
                    block = _Block(block_docs, block_words)
        if block.ids:
            yield block.row()

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, SCHEMA)


class Treap:
    """A block of the index with the impact maxima of its cells for a corpus of ``n_docs``
    documents with a term and ``n_words`` words."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.none = np.array([i is None for i in row["doc_ids"]], dtype=bool)
        self.doc_ids = np.array([i or 0 for i in row["doc_ids"]], dtype=np.int64)
        lengths = np.array(row["lengths"], dtype=np.int64)
        self.masks, n = [], 1 if row["tfs"] else 0
        for data in row["masks"]:
            self.masks.append(_unpacked(data, n))
            n = int(_HAS[self.masks[-1]].sum())
        self.height = len(self.masks)
        self.first = []
        for mask in self.masks:
            kids = _HAS[mask].sum(axis=1)
            self.first.append((np.cumsum(kids) - kids).astype(np.int32))
        tf = np.frombuffer(row["tfs"], dtype="u1" if len(row["tfs"]) == n else "<u4").astype(np.int64)
        m = 50 + (50 * lengths * n_docs) // max(n_words, 1)
        leaf = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self._leaf_docs(n)]) if n else tf
        self.high = [leaf.astype(np.int32)]  # at most 10**6
        for first in self.first[::-1]:
            self.high.append(np.maximum.reduceat(self.high[-1], first) if len(first) else first)
        self.high.reverse()

    def _leaf_docs(self, n: int) -> np.ndarray:
        """Document of each of the ``n`` leaves, from the paths that lead to them."""
        docs = np.zeros(1, dtype=np.int64)
        for mask in self.masks:
            node, quadrant = np.nonzero(_HAS[mask])
            docs = 2 * docs[node] + (quadrant & 1)
        return docs[:n]

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """The ``k`` best (scores, null flags, ids) of ``found`` and of this block's documents, for the
        terms in the grid rows ``rows``; equal scores by ascending id, null ids last."""
        scores, none, ids = found
        if not len(rows) or not len(self.high[0]):
            return found
        weights = weights.astype(np.int64)
        floor = int(scores.min()) if len(scores) >= k else 1
        top = int(weights.sum() * int(self.high[0][0]))
        heap, tie = [(-top, 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32), np.array([top]))], 0
        while heap and -heap[0][0] >= floor:
            _, _, level, ranges, node, bound = heapq.heappop(heap)
            live = bound >= floor
            ranges, node = ranges[live], node[live]
            half = 2 * (rows >> (self.height - 1 - level) & 1)
            mask = np.where(node >= 0, self.masks[level][node], 0)
            start = self.first[level][node]
            kids = [np.where(_HAS[mask, half + c], start + _RANK[mask, half + c], -1) for c in (0, 1)]
            node = np.concatenate(kids)
            ranges = np.concatenate([2 * ranges, 2 * ranges + 1])
            bound = np.where(node >= 0, self.high[level + 1][node], 0).astype(np.int64) @ weights
            live = np.flatnonzero(bound >= floor)
            live = live[np.argsort(-bound[live], kind="stable")]
            if level + 1 == self.height:  # single documents: the bound is the score
                scores = np.concatenate([scores, bound[live]])
                none = np.concatenate([none, self.none[ranges[live]]])
                ids = np.concatenate([ids, self.doc_ids[ranges[live]]])
                order = np.lexsort((ids, none, -scores))[:k]
                scores, none, ids = scores[order], none[order], ids[order]
                floor = int(scores[-1]) if len(scores) >= k else 1
                continue
            for at in range(0, len(live), STEP):
                part = live[at:at + STEP]
                tie += 1
                heapq.heappush(heap, (-int(bound[part[0]]), tie, level + 1, ranges[part], node[part], bound[part]))
        return scores, none, ids


def _frequencies(index: DataFrame, names: list[bytes]) -> np.ndarray:
    """Number of documents that hold each term of ``names``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(names, pa.binary()), np.zeros(len(names), dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                at = pc.index_in(wanted, value_set=b.column(0)[i].values)
                hit = np.flatnonzero(np.asarray(at.is_valid()))
                total[hit] += np.asarray(b.column(1)[i].values)[np.asarray(at.drop_null())]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["term", "df"])

    found = index.select("terms", "dfs").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(names), dtype=np.int64)
    for r in found.collect():  # at most the terms of a chunk of items
        out[r["term"]] = r["df"]
    return out


def _search_chunk(index: DataFrame, items: list[tuple], n_docs: int, n_words: int, k: int) -> DataFrame:
    numbers = _Numbers()
    of_item = [np.array(sorted({numbers[t] for t in terms_of(text)}), dtype=np.int64) for _, text in items]
    names = list(numbers)
    df = _frequencies(index, names)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    item_ids = [i for i, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, no = pa.array(names, pa.binary()), np.zeros(0, dtype=np.int64)
        found = [(no, no.astype(bool), no)] * len(of_item)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("doc_ids", "lengths", "masks", "tfs")}
                at = pc.index_in(wanted, value_set=b.column("terms")[i].values).fill_null(-1).to_numpy()
                treap = Treap(row, n_docs, n_words)
                for j, terms in enumerate(of_item):
                    met = terms[(at[terms] >= 0) & (weights[terms] > 0)]
                    found[j] = treap.best(at[met].astype(np.int64), weights[met], k, found[j])
        for j, (scores, none, ids) in enumerate(found):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), j, dtype=np.int32)), pa.array([item_ids[j]] * len(ids), pa.int64()),
                     pa.array(ids, mask=none), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    near = index.select("doc_ids", "lengths", "terms", "masks", "tfs").mapInArrow(
        run, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``index`` with a score above 0 for
    each row of ``items``, best first, equal scores by ascending id (null ids last).

    Items are worked on in chunks of at most ``ITEM_BYTES`` of text.  Repeated rows of ``items`` are
    one item, items that share an id are ranked apart; a null or empty item, and one whose terms
    no document holds, has no rows; an empty index gives no rows."""
    stats = index.agg(F.sum("held"), F.sum("words")).first()
    n_docs, n_words = stats[0] or 0, stats[1] or 0
    text = F.col(text_col).cast("string").cast("binary")
    slim = items.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).filter("t IS NOT NULL").distinct()
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks = -(-size // ITEM_BYTES) or 1
    out = None
    for c in range(chunks):
        part = slim.filter(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == c).collect()
        found = _search_chunk(index, sorted(((r["i"], bytes(r["t"])) for r in part), key=str), n_docs, n_words, k)
        out = found if out is None else out.unionByName(found)
    return out


def ranked(df: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` over an index of ``df`` that is written once."""
    return search(pinned(build(df)), items, k)
