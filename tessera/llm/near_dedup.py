"""Near-duplicates by an inverted join of MinHash signature coordinates.

Equal shingle sets are one class.  Every class is posted under its coordinate-value pairs; a
pair of classes as similar as asked for matches in at least ``t`` of ``k`` coordinates (up to a
stated chance), so it shares one of the ``k - t + 1`` rarest pairs of either, and only those
prefixes are merged; a class with more unique pairs than that is skipped.  Within a posting
list collisions are counted over the whole signatures, and what is above the threshold is
passed on as a spanning forest, never as all pairs.  Long lists are split into block pairs.
The clusters that arise are checked on full shingle sets, again block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pinned
from tessera.llm.components import components
from tessera.llm.shingles import MinHash, match_floor, set_key, shingle_set
from tessera.operators.joins import skew_join

#: Coordinates of a signature; chance that a pair right at the threshold is not a candidate.
COORDINATES, MISS = 48, 1e-7
#: Rows of a block of a posting list, and of a cluster whose full sets are compared.
LIST_BLOCK, SET_BLOCK = 1024, 512


def described(df: DataFrame, id_col: str, text_col: str, width: int, k: int = COORDINATES) -> DataFrame:
    """(id, n, key, sig, print) of every row: shingles, 128-bit key and signature of its set, and
    a hash of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinHash(k)
        for b in batches:
            ns, keys, sigs = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), width)
                ns.append(len(s))
                keys.append(set_key(s))
                sigs.append(sign(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())),
                 b.column(2)],
                ["id", "n", "key", "sig", "print"])

    text = F.col(text_col).cast("string")
    slim = df.select(F.col(id_col).cast("long"), text, F.xxhash64(text))
    return slim.mapInArrow(run, "id long, n long, key binary, sig array<int>, print long")


def _by_cell(df: DataFrame, cell: list[str], work: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """Edges (a, b) that ``work`` finds in each cell.  Tasks stream over their sorted cells and
    hold one Arrow batch (bounded in bytes by Spark) and one cell at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> list[tuple]:
            rows = pa.Table.from_batches(held)
            return work(rows.to_pandas()) if len(rows) > 1 else []

        for b in batches:
            keys = pd.DataFrame({c: b.column(c).to_pandas() for c in cell})
            new = (keys.to_numpy()[1:] != keys.to_numpy()[:-1]).any(axis=1)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys)]]).tolist()
            out = []
            for lo, hi in zip(edges, edges[1:]):
                here = tuple(keys.iloc[lo]) if hi > lo else at
                if here != at:
                    out += found() if held else []
                    at, held = here, []
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
            if out:
                yield _edge_batch(out)
        out = found() if held else []
        if out:
            yield _edge_batch(out)

    return (df.repartition(*[F.col(c) for c in cell]).sortWithinPartitions(*cell)
            .mapInArrow(run, "a binary, b binary"))


def _edge_batch(edges: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _forest(linked: np.ndarray, keys: list) -> list[tuple]:
    """Stars that span the components of a boolean adjacency matrix, each around its smallest
    key: lists that find the same component agree on it."""
    todo, out = np.ones(len(keys), dtype=bool), []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        if not todo[i]:
            continue
        todo[i] = False
        front, group = [i], [i]
        while front:
            new = np.flatnonzero(linked[front.pop()] & todo)
            todo[new] = False
            front += new.tolist()
            group += new.tolist()
        root = min(keys[x] for x in group)
        out += [(keys[x], root) for x in group if keys[x] != root]
    return out


def _mask(block: np.ndarray, lo: int, hi: int) -> np.ndarray | None:
    """Pairs that belong to this cell: across the two blocks, or all within the one."""
    return None if lo == hi else block[:, None] != block[None, :]


def _similar_size(n: np.ndarray, percent: int) -> np.ndarray:
    return (np.minimum(n[:, None], n[None, :]) * 100 >= percent * np.maximum(n[:, None], n[None, :]))


def _linked(inside: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    inside = inside if mask is None else inside & mask
    np.fill_diagonal(inside, False)
    return inside


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of incidence matrices a slice at a time."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    distinct, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    column, owner = renumber[column[shared]], owner[shared]
    out = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _blocked(df: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows dealt to the block pairs (lo, hi) of their group: one cell for groups of up to
    ``block`` rows, each row to one cell per block otherwise."""
    g = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.col("_g")).cast("int")
    return (df.withColumn("_g", g).withColumn("blk", mine)
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
            .withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o")).drop("_g", "_o", size))


def candidate_edges(classes: DataFrame, percent: int, k: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """Spanning edges (a, b) of the graph of classes whose signatures match in at least
    ``match_floor`` coordinates and whose sizes allow the similarity."""
    t = match_floor(k, percent / 100, miss)
    post = (F.col("pos").cast("long") * (1 << 32)) + F.col("col").bitwiseAND(F.lit(0xFFFFFFFF))
    posts = classes.select("key", F.posexplode("sig")).select("key", post.alias("post"))
    shared = posts.groupBy("post").count().filter("count > 1")
    # rarest first; pairs that no other class has are the rarest of all and meet nobody
    lists = (posts.join(shared, "post").groupBy("key")
             .agg(F.sort_array(F.collect_list(F.struct("count", "post"))).alias("_p"))  # at most k
             .withColumn("_take", F.lit(k - t + 1) - (F.lit(k) - F.size("_p"))).filter("_take > 0")
             .select("key", F.slice(F.col("_p.post"), F.lit(1), F.col("_take")).alias("posts")))
    lists = pinned(lists)
    each = lists.select("key", F.explode("posts").alias("post"))
    met = each.groupBy("post").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    rows = each.join(met, "post").join(classes.select("key", "n", "sig"), "key")
    cells = _blocked(rows, "post", "m", LIST_BLOCK)

    def collide(pdf: pd.DataFrame) -> list[tuple]:
        keys, n = pdf["key"].tolist(), pdf["n"].to_numpy()
        sig = np.stack(pdf["sig"].to_numpy())
        same = np.zeros((len(n), len(n)), dtype=np.uint8 if k < 256 else np.uint16)
        for c in range(k):
            same += sig[:, c, None] == sig[None, :, c]
        mask = _mask(pdf["blk"].to_numpy(), pdf["lo"].iat[0], pdf["hi"].iat[0])
        return _forest(_linked((same >= t) & _similar_size(n, percent), mask), keys)

    return _by_cell(cells, ["post", "lo", "hi"], collide)


def class_texts(df: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``members`` (id, print, ...) with the text ``_t`` of the rows that hold that id and a text of
    that hash: an id, or a null id, that many rows hold brings none of its other texts along."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("_i"), F.xxhash64(text).alias("_p"), text.alias("_t"))
    return docs.join(members, F.col("_i").eqNullSafe(F.col("id")) & (F.col("_p") == F.col("print"))).drop("_i", "_p")


def confirmed_edges(df: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int,
                    percent: int) -> DataFrame:
    """Spanning edges (a, b) of the true links within each cluster of ``members`` (id, print, key,
    root): full sets with ``100 * intersection >= percent * union``."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    texts = class_texts(df, members.join(sizes, "root"), id_col, text_col).select("root", "key", "m", "_t")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keep, sets = [], []
            for i, key in enumerate(b.column(1).to_pylist()):
                if key == last:  # copies of a row come together: one set of a class is enough
                    continue
                s = shingle_set(b.column(3)[i].as_py(), width)
                if set_key(s) == key:  # the hash of another text of the id may be the same
                    last = key
                    keep.append(i)
                    sets.append(s.tobytes())
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())],
                ["root", "key", "m", "members"])

    sets = texts.mapInArrow(to_sets, "root binary, key binary, m long, members binary")
    cells = _blocked(sets, "root", "m", SET_BLOCK)

    def confirm(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.drop_duplicates("key")
        keys = pdf["key"].tolist()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["members"]]
        n = np.array([len(s) for s in sets])
        both = intersections(sets)
        inside = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        mask = _mask(pdf["blk"].to_numpy(), pdf["lo"].iat[0], pdf["hi"].iat[0])
        return _forest(_linked(inside, mask), keys)

    return _by_cell(cells, ["root", "lo", "hi"], confirm)


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n, key, print, component, first_key): per row the shingles of its text, the key of its
    set, a hash of the text and the smallest id, with that row's key, that it reaches over links
    of at least ``percent`` similarity.

    Null and empty texts have no shingles, a null key and themselves as component; null ids are
    larger than any other (a component of null ids only is null, its first key the smallest);
    repeated rows are equal sets; other columns are ignored; an empty table gives no rows."""
    rows = pinned(described(df, id_col, text_col, width))
    classes = pinned(rows.filter("key IS NOT NULL").groupBy("key")
                     .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("f"),
                          F.first("n").alias("n"), F.first("sig").alias("sig"))
                     .select("key", "f.id", "f.print", "n", "sig"))
    clusters = components(candidate_edges(classes, percent))
    members = pinned(classes.select("key", "id", "print").join(clusters.withColumnRenamed("node", "key"), "key"))
    links = components(confirmed_edges(df, members, id_col, text_col, width, percent))
    whole = members.select("key", "id").join(links.withColumnRenamed("node", "key"), "key")
    first = whole.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("f"))
    moved = whole.select("key", "root").join(first, "root").select("key", "f")
    of_class = (classes.select("key", "id").join(moved, "key", "left")
                .select("key", F.when(F.col("f").isNull(), F.col("id")).otherwise(F.col("f.id")).alias("component"),
                        F.coalesce("f.key", "key").alias("first_key")))
    # a class that holds very many rows is met by broadcast
    of_class = pinned(of_class.join(rows.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("_rows")), "key"))
    total = rows.filter("key IS NOT NULL").count()
    out = skew_join(rows.select("id", "n", "key", "print"), of_class, ["key"], "_rows", total, "left")
    return out.select("id", "n", "key", "print", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
                      .alias("component"), "first_key")


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the row of the smallest id (null
    ids last), one of its copies if it is repeated.  Rows without words all stay."""
    found = near_duplicates(df, width, percent, id_col, text_col)
    kept = (found.filter("key IS NOT NULL").filter(F.col("id").eqNullSafe(F.col("component")) & (F.col("key") == F.col("first_key")))
            .groupBy("id", "key").agg(F.min("print").alias("print"), F.count(F.lit(1)).alias("copies")))
    kept = pinned(kept.select("id", "print", "copies"))
    text = F.col(text_col).cast("string")
    worded = F.coalesce(F.rtrim(text, F.lit(" \t\n\x0b\f\r")) != "", F.lit(False))
    told = (df.filter(worded).select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(text).alias("_p"))
            .join(kept, F.col("_i").eqNullSafe(F.col("id")) & (F.col("_p") == F.col("print"))))
    once = told.filter("copies = 1")
    # copies of one row meet in a partial aggregate before the shuffle
    many = told.filter("copies > 1").dropDuplicates(["_i", "_p"])
    return df.filter(~worded).unionByName(once.unionByName(many).select("row.*"))
