"""op4 against a sequential mix, op7 against its law."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import word_count
from tessera.llm.mixing import mix, mixed_rows, source_targets
from tessera.llm.shards import assign_shards, write_shards

ROWS = ([(i, "a b c d " * (i % 7), "hot", 1) for i in range(400)] + [(1000 + i, "x\x0by z", "b", 2) for i in range(30)]
        + [(2000 + i, "word", None, 3) for i in range(25)] + [(3000, None, "void", 4), (3001, "", "void", 4)]
        + [(None, "null id", "b", 5), (1000, "x\x0by z", "b", 2), (4000, "w " * 30000, "long", 6)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, slot int")


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Round by round: what is above its cap is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
        free -= set(over)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_words(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0c\r\n", " x  ", "a" * 70000, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_equals_sequential(docs):
    got = mix(docs, ["doc_id", "source", "slot"]).collect()
    assert len(got) == len(ROWS)
    size = {s: 0 for *_, s, _ in ROWS}
    for _, t, s, _ in ROWS:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(size)
    by = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    for s, taken in by.items():
        # equal rows are taken alike: within half of the largest group of them
        assert abs(taken - want[s]) <= {"hot": 24, "b": 3, None: 1, "void": 0, "long": 15000}[s], s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(3), ["doc_id", "source", "slot"]).collect()), key=str)


def test_mix_thresholds_by_hash(docs):
    """Within a source the documents taken once more are those with the smallest hashes."""
    got = mix(docs, ["doc_id", "source", "text"]).filter("source = 'hot' AND size > 0").collect()
    h = {r["doc_id"]: int(hashlib.md5(f"0:{r['doc_id']}:{r['text']}".encode()).hexdigest()[:15], 16) for r in got}
    more = sorted((h[r["doc_id"]], r["taken"] // r["size"]) for r in got)
    assert [t for _, t in more] == sorted((t for _, t in more), reverse=True)


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 300}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_repeated_rows(docs):
    named = docs.withColumnRenamed("slot", "size")
    n = Counter((r["doc_id"], r["text"]) for r in mixed_rows(named).collect())
    assert mixed_rows(named).columns == named.columns
    for r in mix(docs, docs.columns).collect():
        if r["doc_id"] not in (1000,):
            assert n[(r["doc_id"], r["text"])] == (r["taken"] // r["size"] if r["size"] else 0)


def test_mix_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string"), ["doc_id"]).count() == 0


def sized(df):
    return df.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)


def test_shards_are_even_and_gapless(docs):
    got = assign_shards(sized(docs), ["doc_id", "text"], "size").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = assign_shards(sized(docs), ["doc_id", "text"], "size").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = assign_shards(sized(docs), ["doc_id", "text"], "size", seed=18).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))


def test_shards_spread_a_heavy_key(spark):
    rows = spark.range(0, 6000, 1, 4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    from tessera.llm.shards import shuffled
    got = shuffled(sized(rows), ["doc_id", "text"], "size")
    assert sorted(r["position"] for r in got.collect()) == list(range(6000))


def test_written_shards(spark, docs, tmp_path):
    write_shards(assign_shards(sized(docs), ["doc_id", "text"], "size", shards=5), str(tmp_path / "s"), "size", file_bytes=20000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ROWS) and {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(5))
    files = sorted((tmp_path / "s" / "shard=3").glob("*.parquet"))
    slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(files) > 1 and slots == list(range(len(slots)))


def test_positions_equal_a_sequential_shuffle(spark):
    """Scatter by seeded hash, then Fisher-Yates bucket by bucket, in one loop; null texts included."""
    import numpy as np
    from tessera.llm.shards import LEAST_BUCKETS, shuffled
    rows = [(i, None if i % 3 == 0 else f"text {i}" * (i % 7)) for i in range(4000)]
    df = sized(spark.createDataFrame(rows, "doc_id long, text string"))
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    b = {r["h"]: r["b"] for r in spark.createDataFrame([(x,) for x in h.values()], "h long").select(
        "h", F.pmod(F.xxhash64("h"), F.lit(LEAST_BUCKETS)).alias("b")).collect()}
    buckets = defaultdict(list)
    for i, x in h.items():
        buckets[b[x]].append((x, i))
    want = []
    for k in sorted(buckets):
        held = [i for _, i in sorted(buckets[k])]
        want += [held[j] for j in np.random.Generator(np.random.PCG64([17, k])).permutation(len(held))]
    got = {r["position"]: r["doc_id"] for r in shuffled(df, ["doc_id", "text"], "size").collect()}
    assert [got[p] for p in range(4000)] == want


def test_rows_without_text_do_not_swell_a_bucket(spark, monkeypatch):
    import tessera.llm.shards as sh
    monkeypatch.setattr(sh, "LEAST_BUCKETS", 1)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("size"))
    got = sh.shuffled(df, ["doc_id"], "size", bucket_bytes=64 * sh.ROW_BYTES)
    order = [r["doc_id"] for r in got.orderBy("position").collect()]
    assert sorted(order) == list(range(5000)) and order != sorted(order)


def test_shards_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert assign_shards(sized(empty), ["doc_id", "text"], "size").count() == 0
