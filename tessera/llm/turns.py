"""Repair of conversation structure by survivor-coalescence Viterbi.

The rows of a conversation are read in order by an automaton of the roles ``(s?(ua)+)?``.  A
survivor per state holds the cheapest edits that lead there, in a tree of back pointers with
reference counts; edits are settled once all survivors share them.  Ties go to the least string
of edits.  Survivors' strings end with the edit of one row, so none is a prefix of another: the
order of the complete unresolved strings is carried from row to row as a rank, and equal costs
are told apart without reading them again.

No conversation is one task's: rows are numbered by a range partitioning and cut into segments
of ``SEGMENT`` rows.  A segment whose conversation goes on beyond it is solved for every state
it may be entered in, and one row per (entry, exit) is composed along the conversation by the
same survivors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pinned

#: Rows of a segment, as a power of two; rows between two settlements.
SEGMENT_BITS, SETTLE = 12, 64
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERT = {START: (USER, "I"), SYSTEM: (USER, "I"), USER: (ASSISTANT, "i"), ASSISTANT: (USER, "I")}
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: A survivor is hopeless if another one is cheaper by more than what imitating its edits may cost.
_IMITATE = [(SYSTEM, ASSISTANT, 0), (START, ASSISTANT, DELETE), (ASSISTANT, START, 0), (USER, START, DELETE),
            (USER, ASSISTANT, DELETE), (ASSISTANT, USER, INSERT)]
_SPACE = " \t\n\x0b\f\r"


def _moves(initial: str, truncated: bool) -> list[tuple]:
    """(from, to, cost, edits) of a row.  ``I`` and ``R`` make a user turn, ``i`` and ``r`` one of
    the assistant.  Nothing is inserted before a deletion: behind it is the lesser string."""
    out, extra = [], TRUNCATED if truncated else 0
    for q in range(4):
        out.append((q, q, DELETE, "D"))
        at, cost, edits = q, extra, ""
        for _ in range(3):
            if (at, initial) in _KEEP:
                out.append((q, _KEEP[at, initial], cost, edits + "K"))
            to, turn = _INSERT[at]
            out.append((q, to, cost + REROLE, edits + ("R" if turn == "I" else "r")))
            at, cost, edits = to, cost + INSERT, edits + turn
    return out


class _Moves(dict):
    def __missing__(self, key):
        self[key] = moves = _moves(*key)
        return moves


class _Node:
    __slots__ = ("parent", "piece", "refs")

    def __init__(self, parent, piece):
        self.parent, self.piece, self.refs = parent, piece, 1


class Survivors:
    """The cheapest way into every state; ``settled`` takes the pieces all of them share."""

    def __init__(self, costs: dict[int, int]):
        self.costs = costs
        self.root = _Node(None, None)
        self.root.refs = len(costs)
        self.heads = dict.fromkeys(costs, self.root)
        self.rank = dict.fromkeys(costs, 0)
        self.settled: list = []
        self.steps = 0

    def step(self, moves: Iterable[tuple], edits=lambda piece: piece) -> None:
        """Take for every state the cheapest of ``moves`` (from, to, cost, piece), then the one with
        the least edits."""
        best: dict = {}
        for q, to, cost, piece in moves:
            if q in self.costs:
                key = (self.costs[q] + cost, self.rank[q], edits(piece).upper())
                if to not in best or key < best[to][0]:
                    best[to] = (key, q, piece)
        for loser, other, most in _IMITATE:
            if loser in best and other in best and best[loser][0][0] > best[other][0][0] + most:
                del best[loser]
        old, self.heads = self.heads, {}
        for to, (_, q, piece) in best.items():
            self.heads[to] = _Node(old[q], piece)
            old[q].refs += 1
        for node in old.values():
            self._release(node)
        order = sorted(best, key=lambda to: best[to][0][1:])
        self.costs = {to: best[to][0][0] for to in best}
        self.rank = {to: k for k, to in enumerate(order)}
        self.steps += 1
        if self.steps % SETTLE == 0:
            self.settle()

    def all(self, cost: int, piece: str) -> None:
        """One forced edit for all."""
        for q, node in self.heads.items():
            self.heads[q] = _Node(node, piece)
            self.costs[q] += cost
        self.steps += 1
        if self.steps % SETTLE == 0:
            self.settle()

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def _path(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def settle(self) -> None:
        for node in self._path(next(iter(self.heads.values()))):
            if self.root.refs > 1:
                return
            self.settled.append(node.piece)
            node.parent = None
            self.root = node

    def pieces(self, state: int) -> list:
        """All unsettled pieces on the way into ``state``."""
        return [n.piece for n in self._path(self.heads[state])]

    def best_end(self) -> tuple[int, int, str]:
        """(state, cost, last inserts) of the cheapest legal end."""
        last = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "i"), SYSTEM: (2 * INSERT, "Ii")}
        q = min(self.costs, key=lambda s: (self.costs[s] + last[s][0], self.rank[s]))
        return q, self.costs[q] + last[q][0], last[q][1]


def solved(rows: list[tuple], entry: int) -> Survivors:
    """Survivors after ``rows`` (initial, must go, truncated, copies) entered in one state.  A copy
    repeats the row before it, must go, and is told as ``*n`` behind the row's edit."""
    out = Survivors({entry: 0})
    for initial, gone, truncated, copies in rows:
        if gone:
            out.all(DELETE, "D")
        else:
            out.step(MOVES[initial, truncated])
        if copies > 1:
            out.all(DELETE * (copies - 1), f"*{copies - 1}")
    return out


MOVES = _Moves()


def audit(edits: str) -> str:
    """Initials of the edits, copies included."""
    return re.sub(r"\*(\d+)", lambda m: "D" * int(m[1]), edits).upper()


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user.
    Nulls are read as one space, in the CRC too; null ids and turns stay null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                     F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1)
    return (rows.withColumns({"text": text, "role": role}).withColumn("_n", F.explode(F.array_repeat(F.lit(1), times)))
            .select("conv_id", "turn", "role", "text"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


KEY = ("conv_id", "turn", "role", "digest")


def placed(rows: DataFrame) -> DataFrame:
    """The distinct rows of ``rows`` (conv_id, turn, role, text), in the order of their
    conversations: (conv_id, turn, role, digest, copies, blank, again, truncated, pos).

    A row's place is its turn, nulls first, then its role and a digest of its text; ``pos`` grows
    along all conversations and is dense within a task.  ``again``: an equal role and text stands
    earlier in the conversation."""
    core = F.rtrim(F.col("text"), F.lit(_SPACE))
    slim = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), (core == "").alias("blank"),
                       (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("truncated"))
    groups = pinned(slim.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"),
                                           F.first("truncated").alias("truncated")))
    text = F.struct("conv_id", "role", "digest")
    heard = groups.filter("NOT blank").groupBy(F.xxhash64("conv_id", "role", "digest").alias("_h"), text.alias("_t")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    here = F.struct(F.col("turn").isNotNull(), "turn")
    flagged = (groups.withColumn("_k", F.xxhash64("conv_id", "role", "digest"))
               .join(heard, (F.col("_k") == F.col("_h")) & text.eqNullSafe(F.col("_t")), "left")
               .withColumn("again", F.coalesce(~here.eqNullSafe(F.col("_first")), F.lit(False)) & F.col("_t").isNotNull()))
    order = [F.asc_nulls_first(c) for c in KEY]
    return pinned(flagged.select(*KEY, "copies", "blank", "again", "truncated").repartitionByRange(*order)
                  .sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))


_PART = "conv_id long, seg long, start long, first string, last string, illegal long, closed boolean, entry int, exit int, cost long, edits string"


def _runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """(conv_id, seg, start, rows, closed) of every conversation in every segment; closed: the
    conversation begins and ends within the segment."""
    at, rows = None, []
    for b in batches:
        for conv, seg, pos, *row in zip(*(c.to_pylist() for c in b.columns)):
            if at is not None and (at[0], at[1]) != (conv, seg):
                # another conversation in the same segment follows: this one has no more rows
                yield *at, rows, at[1] == seg and at[2] & ((1 << bits) - 1) > 0
                at, rows = None, []
            if at is None:
                at = (conv, seg, pos)
            rows.append(tuple(row))
    if at is not None:
        yield *at, rows, False


def segments(rows: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """The survivors (``_PART``) of every segment of ``placed`` rows."""
    names = [c.split()[0] for c in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, seg, start, rows, closed in _runs(batches, bits):
            begins = start & ((1 << bits) - 1) > 0
            spoken = [x for initial, _, _, copies in rows for x in [initial] * min(copies, 2)]
            wrong = illegal_pairs(spoken) + sum(max(0, c - 2) for *_, c in rows)
            for entry in [START] if begins else range(4):
                end = solved(rows, entry)
                same = "".join(end.settled)
                if closed:
                    q, cost, last = end.best_end()
                    ends = [(q, cost, last)]
                else:
                    ends = [(q, cost, "") for q, cost in end.costs.items()]
                out += [(conv, seg, start, spoken[0], spoken[-1], wrong, closed, entry, q, cost,
                         same + "".join(end.pieces(q)) + last) for q, cost, last in ends]
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _PART.split(", ")])
    slim = rows.select("conv_id", F.shiftright("pos", bits).alias("seg"), "pos", F.substring("role", 1, 1).alias("initial"),
                       (F.col("blank") | F.col("again")).alias("gone"), "truncated", "copies")
    return slim.repartition("seg").sortWithinPartitions("pos").mapInArrow(run, _PART)


_EDITS = "conv_id long, seg long, start long, illegal long, cost long, edits string, audit string"


def chosen_edits(rows: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """(conv_id, seg, start, illegal, cost, edits, audit): the edits of every segment of ``placed``
    rows, one string for the rows from ``start`` on.  ``illegal`` and ``cost`` add up to those of
    the conversation."""
    parts = pinned(segments(rows, bits))
    schema = pa.schema([(n, pa.string() if n in ("edits", "audit") else pa.int64()) for n in (c.split()[0] for c in _EDITS.split(", "))])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chain, seg, moves, last, bill = None, None, None, [], "", [0, 0]

        def told(pieces: list, tail: str = "", cost: int = 0) -> list[dict]:
            out = []
            for k, (s, start, edits) in enumerate(pieces):
                edits += tail if k == len(pieces) - 1 else ""
                out.append({"conv_id": conv, "seg": s, "start": start, "illegal": 0, "cost": 0, "edits": edits, "audit": audit(edits)})
            if tail or cost:
                out[-1]["cost"] = cost
            return out

        def close() -> list[dict]:
            """The last segments of the conversation, with its cost and illegal pairs."""
            chain.step(moves, lambda p: p[2])
            q, cost, tail = chain.best_end()
            out = told(chain.settled + chain.pieces(q), tail, cost)
            out[-1]["illegal"] = bill[0]
            return out

        for b in batches:
            out = []
            for r in b.to_pylist():
                if chain is None or r["conv_id"] != conv:
                    out += close() if chain else []
                    conv, chain, seg, moves, bill = r["conv_id"], Survivors({START: 0}), None, [], [0]
                if r["seg"] != seg:
                    if seg is not None:
                        chain.step(moves, lambda p: p[2])
                        if len(chain.settled) > 1:  # the last piece may yet take the tail and the bill
                            out += told(chain.settled[:-1])
                            chain.settled = chain.settled[-1:]
                        bill[0] += last + r["first"] not in ("su", "ua", "au")
                    seg, moves, last = r["seg"], [], r["last"]
                    bill[0] += r["illegal"]
                moves.append((r["entry"], r["exit"], r["cost"], (r["seg"], r["start"], r["edits"])))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if chain is not None:
            yield pa.RecordBatch.from_pylist(close(), schema)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([audit(e) for e in b.column(5).to_pylist()], pa.string())], schema=schema)

    columns = [c.split()[0] for c in _EDITS.split(", ")][:-1]
    whole = parts.filter("closed").select(*columns).mapInArrow(single, _EDITS)
    cut = (parts.filter("NOT closed").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "entry", "exit")
           .mapInArrow(compose, _EDITS))
    return whole.unionByName(cut)


def row_edits(edits: DataFrame) -> DataFrame:
    """(pos, sub, edit) of every edit of ``chosen_edits``, in order, but for copies: ``pos`` is that
    of the row, inserts stand before their row and, at the end of a conversation, behind it."""
    each = edits.select("conv_id", "start", F.posexplode(F.regexp_extract_all("edits", F.lit("[Ii]*[KRrD]"), 0)).alias("j", "piece"))
    inner = each.select("conv_id", (F.col("start") + F.col("j")).alias("pos"), F.posexplode(F.split("piece", "(?<=.)(?=.)")).alias("sub", "edit"))
    n = F.length(F.regexp_replace("edits", r"[Ii]|\*[0-9]+", ""))
    tail = edits.filter(F.col("edits").rlike("[Ii]$"))
    tail = tail.select("conv_id", (F.col("start") + n - 1).alias("pos"),
                       F.posexplode(F.split(F.regexp_extract("edits", "([Ii]+)$", 1), "(?<=.)(?=.)")).alias("sub", "edit"))
    return inner.unionByName(tail.withColumn("sub", F.col("sub") + 10))


def repaired(rows: DataFrame, at: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, pos, sub, edit, role, text): the repaired conversations of ``rows``, to be read by
    (pos, sub); ``at`` are its ``placed`` rows and ``edits`` their ``chosen_edits``."""
    every = row_edits(edits).filter("edit <> 'D'")
    role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("i", "r"), "assistant")
    new = every.filter("edit IN ('I', 'i')").select("conv_id", "pos", "sub", "edit", role.alias("role"), F.lit("").alias("text"))
    kept = every.filter("edit NOT IN ('I', 'i')").drop("conv_id").join(at.select(*KEY, "pos"), "pos")
    kept = kept.select(F.struct(*KEY).alias("_k"), F.xxhash64(*KEY).alias("_h"), "pos", "sub", "edit", role.alias("_role"))
    texts = rows.select(F.struct("conv_id", "turn", "role", _digest("text").alias("digest")).alias("_r"), "text")
    texts = texts.withColumn("_x", F.xxhash64(*[F.col("_r").getField(c) for c in KEY]))
    met = kept.join(texts, (F.col("_h") == F.col("_x")) & F.col("_k").eqNullSafe(F.col("_r")))
    old = met.select(F.col("_k.conv_id").alias("conv_id"), "pos", "sub", "edit", F.coalesce("_role", "_k.role").alias("role"), "text")
    return new.unionByName(old)


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the ``role:text`` lines of every conversation of
    ``repaired`` rows.  A hash reads its lines one after the other: a conversation is streamed by
    one task, which holds a batch of it; copies of a row come several times and count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        conv, state, at = None, None, None
        for b in batches:
            ids, sums = [], []
            for c, pos, sub, role, text in zip(*(col.to_pylist() for col in b.columns)):
                if state is None or c != conv:
                    if state is not None:
                        ids.append(conv)
                        sums.append(state.hexdigest())
                    conv, state, at = c, hashlib.sha256(), None
                if (pos, sub) != at:
                    state.update((f"{role}:{text}" if at is None else f"\n{role}:{text}").encode())
                    at = (pos, sub)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums)], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return (turns.select("conv_id", "pos", "sub", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")
            .mapInArrow(run, "conv_id long, repaired_sha256 string"))


def faults(at: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation of ``placed`` rows."""
    heard = F.when(F.col("blank"), 0).when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1)
    cut = F.col("truncated") & ~F.col("blank") & ~F.col("again")
    turns = at.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
                                              F.sum(heard).alias("duplicate"), F.sum(cut.cast("long")).alias("truncated"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def repair(rows: DataFrame, ids: DataFrame | None = None, bits: int = SEGMENT_BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id).

    Null ids are one conversation; null turns come first and count for no gap; rows of one turn are
    read by role and text digest; a null role or text is one space; repeated rows are duplicates;
    texts are read whole; other columns are ignored; a conversation of ``ids`` without rows has
    zeros, no edits and the hash of nothing; empty tables give no rows."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    at = placed(rows)
    edits = pinned(chosen_edits(at, bits))
    bills = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
                                         F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("_a"))
    bills = bills.withColumn("audit", F.array_join("_a.audit", "")).drop("_a")
    all_ids = (rows if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))).select("conv_id").distinct()
    out = all_ids
    for found in (faults(at), bills, hashed(repaired(rows, at, edits))):
        found = found.withColumnRenamed("conv_id", "_c")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of the empty string
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": nothing})
