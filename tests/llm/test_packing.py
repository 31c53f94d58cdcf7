"""op1, op2: every id once, gapless windows, little padding, ids equal to the tokenizer's."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.packing_bfd import CapacityTree, best_fit_decreasing, pack_best_fit, read_segments, segments, write_matrices
from tessera.llm.packing_sos import SumOfSquares, pack_sum_of_squares
from tessera.llm.tokens import WordEncoder, default_tokenizer

TEXTS = [(1, "Hello, World! it's 3 o'clock."), (2, None), (3, ""), (None, "no id"), (5, "long word " * 9000),
         (5, "long word " * 9000), (7, "É été ß ñ!! ΣΑΣ <|endoftext|> x")]


def plain_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in TEXTS], "doc_id long, text string, ids string, length int")


def test_encoder_equals_tokenizer():
    e = WordEncoder(default_tokenizer())
    odd = ["á ́b", "x y\tz\r\nq ", "İ 'S don't a's' é!&&&", "\x1c\x1d a\x85b", "ñ! ﬁ x², a.b .. ...", "日本語。 Ǆ ŉ", "<|ENDOFTEXT|>"]
    for t in odd + [t for _, t in TEXTS]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == plain_ids(t)[:-1], t


def test_sum_of_squares_rounds_trip(docs):
    rows = pack_sum_of_squares(docs.repartition(1)).collect()
    want = sorted(plain_ids(t) for _, t in TEXTS)
    by_seq, got, open_doc = defaultdict(list), [], defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        open_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in by_seq.values()) <= 1  # padding: one window of the task
    for (_, total), pieces in open_doc.items():
        pieces.sort(key=lambda r: (r["start"]))
        copies = sum(r["length"] for r in pieces) // total
        assert sum(r["length"] for r in pieces) == copies * total
        starts = defaultdict(list)
        for r in pieces:
            starts[r["start"]].append(bytes(r["ids"]))
        if copies == 1:
            got.append(np.frombuffer(b"".join(starts[s][0] for s in sorted(starts)), "<u4").tolist())
    assert [g for g in sorted(got)] == sorted(plain_ids(t) for i, t in TEXTS if i != 5)
    assert len(want) == len(TEXTS)


@pytest.mark.parametrize("max_open", [4096, 20])
def test_sum_of_squares_choice_and_drain(max_open):
    rng, p, rows, ids = random.Random(3), SumOfSquares(64, max_open, 0), [], {}
    for i in range(800):
        ids[i] = np.arange(rng.randint(1, 150), dtype="<u4").tobytes()
        size = len(ids[i]) // 4 % 64
        if size:  # the chosen level has the least sum of squares
            def cost(h):
                c = p.counts.copy()
                c[h] -= h > 0
                c[h + size] += h + size < 64
                return int((c[1:64] ** 2).sum())
            levels = [0] + [h for h in range(1, 65 - size) if p.counts[h]]
            assert cost(p.level_for(size)) == min(map(cost, levels))
        rows += p.place(i, ids[i])
    rows += p.drain()
    parts = defaultdict(list)
    for doc, start, n, b, total, _, _ in rows:
        parts[doc].append((start, b))
        assert n == len(b) // 4 and total == len(ids[doc]) // 4
    assert {d: b"".join(b for _, b in sorted(x)) for d, x in parts.items()} == ids


def test_best_fit_tree_equals_scan():
    rng = random.Random(5)
    sizes = [rng.randint(1, 64) for _ in range(700)]
    rooms, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [r for r in rooms if r >= sizes[i]]
        room = min(fit) if fit else 64
        if fit:
            rooms.remove(room)
        rooms.append(room - sizes[i])
    got = best_fit_decreasing(sizes, 64)
    want = sorted(64 - r for r in rooms)
    assert sorted(sum(sizes[i] for i in w) for w in got) == want
    assert sorted(i for w in got for i in w) == list(range(700))
    t = CapacityTree(64)
    assert t.best(1) is None
    t.add(7, 0)
    assert t.best(8) is None and t.best(7) == (7, 0) and t.best(1) is None


def test_matrices_round_trip(spark, docs, tmp_path):
    packed = pack_best_fit(docs, matrix_rows=4, block_tokens=20_000)
    write_matrices(packed, str(tmp_path / "m"))
    seg = read_segments(spark, str(tmp_path / "m")).collect()
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<u4").reshape(r["n_rows"], r["n_cols"])
        pos = np.frombuffer(r["position_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert ids.shape[1] == 2048 and cu[-1] == ids.size
        for a, b in zip(cu, cu[1:]):
            assert (pos[a:b] == np.arange(b - a)).all() and a // 2048 == (b - 1) // 2048
    parts = defaultdict(list)
    for s in seg:
        parts[(s["doc_id"], s["doc_tokens"])].append((s["start"], bytes(s["ids"])))
    for i, t in TEXTS:
        want = plain_ids(t)
        pieces = dict(parts[(i, len(want))])
        assert np.frombuffer(b"".join(pieces[s] for s in sorted(pieces)), "<u4").tolist() == want
    assert sum(len(s["ids"]) for s in seg) == 4 * sum(len(plain_ids(t)) for _, t in TEXTS)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_sum_of_squares(empty).count() == 0
    assert segments(pack_best_fit(empty)).count() == 0


def test_query_digest(spark):
    from conftest import SF001
    from tessera.llm.queries import QUERIES
    from tessera.llm.common import table
    got = QUERIES["op1_sum_of_squares_packing"](spark, SF001)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    one = got.filter("start = 0 AND length = doc_tokens").orderBy("doc_id").first()
    text = table(spark, SF001, "documents").filter(F.col("doc_id") == one["doc_id"]).first()["text"]
    assert one["ids_crc32"] == zlib.crc32(np.array(plain_ids(text), "<u4").tobytes())
