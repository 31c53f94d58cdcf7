"""op13: repair of conversations against an exhaustive search."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm.turns import Survivors, audit, damaged, repair, row_edits, solved
from test_queries import QUERIES, SF001

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow the last initial


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits) by trying every edit of every row, from the last row back."""
    n = len(rows)

    @functools.cache
    def best(i, last, inserts):
        found = []
        if i == n and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            for c in NEXT[last].replace("s", ""):
                cost, edits, out = best(i, c, inserts + 1)
                found.append((cost + 5, "I" + edits, ({"u": "user", "a": "assistant"}[c] + ":",) + out))
        if i < n:
            role, text, fault = rows[i]
            cost, edits, out = best(i + 1, last, 0)
            found.append((cost + 2, "D" + edits, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in NEXT[last]:
                    cost, edits, out = best(i + 1, role[:1], 0)
                    found.append((cost + extra, "K" + edits, (f"{role}:{text}",) + out))
                for c in NEXT[last].replace("s", ""):
                    cost, edits, out = best(i + 1, c, 0)
                    new = {"u": "user", "a": "assistant"}[c]
                    found.append((cost + extra + 1, "R" + edits, (f"{new}:{text}",) + out))
        return min(found, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def brute(original):
    convs = {c: [] for c, *_ in original}
    for conv, turn, role, text in damage(original):
        convs[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text, turn))
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: r[:4])
        seen, faults, told = set(), defaultdict(int), []
        for *_, role, _, text, turn in rows:
            core = text.rstrip(" \t\n\x0b\f\r")
            fault = ("blank" if not core else "duplicate" if (role, text) in seen else
                     "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
            faults[fault] += 1
            told.append((role, text, fault))
        turns = {r[-1] for r in rows if r[-1] is not None}
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, edits, lines = cheapest(tuple(told))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
                    faults["truncated"], pairs, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def corpus():
    rng = random.Random(13)
    rows = []
    def text(): return rng.choice(["Yes.", "No!", "Why?", "cut off", "  ", "", None, "So. \n", "é.", "a: b."]) if rng.random() < 0.4 else f"t{rng.randint(0, 999)}."
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            if rng.random() < 0.93:
                role = ("user", "assistant")[turn % 2] if rng.random() < 0.75 else rng.choice(["system", "user", "assistant", "tool", None, "", "usher"])
                rows.append((conv, None if rng.random() < 0.03 else turn, role, text()))
    rows += [(700, t, "user", f"only users {t}.") for t in range(40)]  # survivors that never meet
    rows += [(701, t, "system", f"only system {t}.") for t in range(15)]
    rows += [(702, t, "user", " ") for t in range(11)]
    rows += [(703, 2, "user", "again.")] * 9 + [(703, 9, "user", "again.")] * 3 + [(703, 10, "assistant", "so.")]
    rows += [(None, t, ("user", "assistant")[t % 2], f"n{t}.") for t in range(9)] + [(None, None, "system", "first.")]
    rows += [(704, t, rng.choice(["user", "assistant"]), f"m{t}" + rng.choice([".", ""])) for t in range(130)]
    gone = next(c for c in range(800, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "dropped.")]


@pytest.mark.parametrize("bits", [2, 12])
def test_equal_exhaustive_search(spark, bits):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, copies string")
    got = repair(damaged(df), df.select("conv_id"), bits)
    want = brute(rows)
    found = sorted(map(tuple, got.select(COLUMNS).collect()), key=str)
    assert found == want
    assert {"D", "K", "R"} == set("".join(w[7] for w in want))  # an insert costs more than the deletion that does the same


def test_survivors_settle_and_prune():
    rows = [("u" if k % 2 == 0 else "a", False, False, 1) for k in range(1000)]
    end = solved(rows, 0)
    assert len(end.settled) >= 1000 - 2 * 64 and end.best_end()[1] == 0
    nodes = {id(n) for q in end.heads for n in end._path(end.heads[q])}
    assert len(nodes) < 300
    assert set(solved([("s", False, False, 1)] + rows[:4], 0).costs) <= {1, 2, 3}
    chain = Survivors({0: 0})
    chain.all(2, "D")
    assert chain.best_end() == (0, 2, "") and chain.pieces(0) == ["D"]


def test_inserts_of_dearer_deletions(spark):
    assert Survivors({2: 0}).best_end() == (2, 5, "i") and Survivors({1: 3}).best_end() == (1, 13, "Ii")
    edits = spark.createDataFrame([(1, 0, 100, "IKiK*3rDKi")], "conv_id long, seg long, start long, edits string")
    assert sorted(tuple(r)[1:] for r in row_edits(edits).collect()) == [
        (100, 0, "I"), (100, 1, "K"), (101, 0, "i"), (101, 1, "K"), (102, 0, "r"), (103, 0, "D"), (104, 0, "K"), (104, 10, "i")]
    assert audit("IKiK*3rDKi") == "IKIKDDDRDKI"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(empty), empty.select("conv_id")).count() == 0


def test_query_equals_exhaustive_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_viterbi_repair"](spark, SF001).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
