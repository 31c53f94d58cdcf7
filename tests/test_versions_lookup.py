"""Bitemporal as-of, upserts, exact splits, value ranks, lookups, shifts, typed records and
stream joins on literal rows, odd ones and hot ones included."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

import tessera.operators.joins as joins
from tessera.operators import asof, bars, events, features, screen
from tessera.session import scratch_path
from tessera.sources import feeds, readers, sinks
from tessera.streaming import streams

DAY = dt.date(2024, 1, 1)


def day(k):
    return None if k is None else DAY + dt.timedelta(days=k)


def test_known_as_of_two_time_axes(spark):
    rng = random.Random(1)
    recs = [(rng.choice(["A", "B", None]), day(rng.randint(0, 200)), day(rng.randint(0, 260)), rng.randint(0, 3), i) for i in range(300)]
    recs += [("A", None, day(3), 0, 900), ("A", day(3), None, 0, 901)]
    facts = [(rng.choice(["A", "B", "C", None]), day(rng.randint(-5, 280)), k) for k in range(200)] + [("A", None, 777), ("A", day(50), 5), ("A", day(50), 5)]
    r = spark.createDataFrame(recs, "tic string, rd date, up date, rev int, val int")
    f = spark.createDataFrame(facts, "tic string, date date, n int")
    got = asof.known_as_of(f, r, "tic", "date", "rd", "up", ["val"], tie=["rev", "val"]).collect()
    def best(tic, d):
        met = [(rd, up, rev, v) for t, rd, up, rev, v in recs if t == tic and rd and up and d and rd <= d and up <= d]
        return max(met)[3] if met else None
    assert sorted(map(tuple, got), key=str) == sorted(((t, d, n, best(t, d)) for t, d, n in facts), key=str)


def test_upsert_moves_keys_and_replays(spark):
    path = scratch_path(spark, "t-upsert")
    schema = "id long, part string, v long, x string"
    state = {}
    def apply(rows):
        sinks.upsert(spark.createDataFrame(rows, schema), path, ["id"], "v", "part")
        for r in rows:
            k = (r[2] is not None, r[2] or 0)
            if r[0] not in state or k >= state[r[0]][0]:
                state[r[0]] = (k, r)
        got = sorted(map(tuple, spark.read.schema(schema).parquet(path).select("id", "part", "v", "x").collect()), key=str)
        assert got == sorted((r for _, r in state.values()), key=str)
    apply([(1, "a", 1, "x"), (2, "a", 1, "x"), (3, "b", 5, "x"), (None, "c", 1, "n"), (4, None, 1, "p")])
    apply([(3, "a", 6, "moved")])  # the last row of b goes: its folder too
    assert not os.path.exists(path.replace("file:", "") + "/part=b")
    apply([(1, "z", 0, "stale"), (2, "b", 2, "y"), (None, "c", 2, "n2"), (9, "q", None, "new")])
    apply([(2, "b", 2, "y"), (2, "b", 1, "old")])
    before = os.path.getmtime(path.replace("file:", "") + "/part=q")
    apply([(1, "a", 3, "x3")])
    assert os.path.getmtime(path.replace("file:", "") + "/part=q") == before  # untouched


def test_exact_split_counts_and_order(spark):
    rows = [(g, i) for g, n in (("a", 1000), ("b", 7), ("c", 1), (None, 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long")
    d = features.exact_split(df, ["g"], ["g", "k"], 0.1).collect()
    for g, n in (("a", 1000), ("b", 7), ("c", 1), (None, 33)):
        assert sum(r.split == "test" and r.g == g for r in d) == -(-n // 10) and sum(r.g == g for r in d) == n
    again = features.exact_split(df.repartition(5), ["g"], ["g", "k"], 0.1).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, d), key=str)
    same = spark.range(500).select(F.lit("h").alias("g"), F.lit(1).alias("k"))  # one key: half of it must go
    assert features.exact_split(same, ["g"], ["k"], 0.5).filter("split = 'test'").count() == 250
    for share in (0.0, 1.0):
        assert features.exact_split(df, ["g"], ["k"], share).filter("split = 'test'").count() == len(rows) * share
    assert features.exact_split(df.limit(0), ["g"], ["k"]).count() == 0


def test_percent_rank_with_a_value_held_by_half(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 0.05)
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None]), 5.0 if rng.random() < 0.5 else rng.choice([None, 0.0, -0.0, float(rng.randint(-9, 30))]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "peer string, m double, i int")
    want = df.select("i", F.percent_rank().over(Window.partitionBy("peer").orderBy("m")).alias("r"))
    assert sorted(map(tuple, screen.percent_rank(df, "m", "peer", "r").select("i", "r").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [1, 3, -2, 0, 40])
def test_shift_by_halo(spark, n, monkeypatch):
    monkeypatch.setattr(joins, "SHIFT_BLOCK", 8)
    rows = [(t, day(3 * i), i) for t, m in (("A", 50), (None, 20), ("B", 1)) for i in range(m)]
    df = spark.createDataFrame(rows, "tic string, date date, x int")
    w = Window.partitionBy("tic").orderBy("date")
    want = df.withColumn("x_s", F.lead("x", n).over(w) if n >= 0 else F.lag("x", -n).over(w))
    got = joins.shift(df, ["x"], n, suffix="_s")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_tail_quote_stats_and_first(spark):
    rows = [(t, day(2 * i), float(i)) for t, m in (("A", 300), (None, 5), ("B", 60)) for i in range(m)]
    df = spark.createDataFrame(rows, "tic string, date date, close double")
    for n in (1, 7, 100):
        got = screen.tail_per_key(df, n, back="b").collect()
        want = [(t, d, c, m - int(c)) for t, m in (("A", 300), (None, 5), ("B", 60)) for tt, d, c in rows if tt == t and c >= m - n]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    q = {r.tic: r for r in bars.quote_stats(df.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(2.0)})).collect()}
    assert q["A"].last == 299 and q["A"].prev_close == 298 and q["A"].avg50 == 274.5 and q["A"].low52 == 299 - 182 - 1
    assert q[None].last == 4 and set(q) == {"A", "B", None}
    d = spark.createDataFrame([("k", 1, "hot", "x" * i) for i in range(50)] + [(None, 2, None, "n"), (None, 1, None, "m")], "k string, o int, t string, body string")
    d = d.withColumn("o", F.when(F.col("k") == "k", F.length("body")).otherwise(F.col("o")))
    assert sorted((r.k, r.o, r.body) for r in events.dedupe_first(d, ["k"], ["o"]).fillna("~", ["k"]).collect()) == [("k", 0, ""), ("~", 1, "m")]


def test_session_roll_looks_days_up(spark):
    s = spark.createDataFrame([("A", day(5)), ("A", day(9)), (None, day(2))], "tic string, date date")
    d = spark.createDataFrame([("A", day(4), 1)] * 30 + [("A", day(9), 2), ("A", day(10), 3), (None, day(1), 4), ("A", None, 5), ("C", day(1), 6)], "tic string, date date, n int")
    got = {(r.n, r.session) for r in asof.session_roll(d, s).collect()}
    assert got == {(1, day(5)), (2, day(9)), (3, None), (4, day(2)), (5, day(5)), (6, None)} and asof.session_roll(d, s).count() == 35


@pytest.mark.parametrize("q,method", [("a", "symbol"), ("Ab", "symbol"), ("abc", "symbol"), ("abcd", "symbol"), ("te", "symbol_name"),
                                      ("tech", "symbol_name"), ("b", "symbol_within"), ("bc", "symbol_within"), ("bcab", "symbol_within")])
def test_lookup_equals_scan(spark, q, method):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ABc") for _ in range(rng.randint(1, 7))), rng.choice(["Tech One", "te  x", "Big TECHNO", None, ""]), i) for i in range(150)]
    df = spark.createDataFrame(rows + [(None, "tech", 1), ("", "tech", 2)], "symbol string, name string, i int")
    want = {r.symbol for r in screen.autocomplete(df.filter("symbol <> ''"), q, method, 10 ** 6).collect()}
    assert {r.symbol for r in screen.lookup(screen.lookup_index(df), q, method).collect()} == want
    with pytest.raises(ValueError):
        screen.lookup(screen.lookup_index(df), "", method)


def test_lookup_index_drops_repeats_before_rows_multiply(spark):
    rows = [("Ab1", "Two two tea"), ("Ab1", "two"), ("Ab1", None), ("Ab1", "Two two tea"), ("11", "")]
    index = screen.lookup_index(spark.createDataFrame(rows, "symbol string, name string"))
    got = [tuple(r) for r in index.collect()]
    want = {("s", x[:n], x, y) for x, y in (("ab1", "Ab1"), ("11", "11")) for n in range(1, len(x) + 1)}
    want |= {("g", x[i:i + n], x, y) for x, y in (("ab1", "Ab1"), ("11", "11")) for n in (1, 2, 3) for i in range(len(x) - n + 1)}
    want |= {("w", w[:n], w, "Ab1") for w in ("two", "tea") for n in (1, 2, 3)}
    assert sorted(got) == sorted(want)
    plan = index._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in plan if "Aggregate [" in x] and not [x for x in plan if "Aggregate [" in x and "gram" in x]


def test_typed_records_lose_nothing(spark):
    texts = ['{"a": 1, "b": "x", "c": [1, 2]}', '{"a": 2.5, "b": 3, "d": {"e": null}}', '{"a": null, "b": "y"}', "[1]", "broken", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    fields = feeds.infer_fields(df, "j")[None]
    assert fields == {"a": "double", "b": "string", "c": "array<bigint>", "d": "struct<e:string>"}
    got = {r.i: r for r in feeds.typed_records(df, "j", {"a": "bigint", "b": "string"}).collect()}
    assert (got[0].a, got[0].b, got[0].rescued) == (1, "x", {"c": "[1,2]"})
    assert got[1].a is None and got[1].rescued["a"] == "2.5" and "d" in got[1].rescued and got[4].a is None
    assert feeds.infer_fields(df.limit(0), "j") == {}


def test_sources_tell_what_is_missing(spark):
    raw = spark.createDataFrame([("A", day(1), 2.0), ("B", day(2), None)], "tic string, date date, close double")
    assert readers.load_bars(raw, ["A", "Z"], "2024-01-01", "2024-02-01").count() == 1
    with pytest.raises(ValueError):
        readers.load_bars(raw, ["B", "Z"], "2024-01-01", "2024-02-01")
    rated = spark.createDataFrame([(1, "5"), (None, "7")], "doc_id long, benz_rate string")
    stories = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    assert sorted(map(tuple, readers.resume_scan(rated, stories, on="doc_id").collect()), key=str) == [(1, "5"), (2, None), (None, "7"), (None, None)]
    assert [r.benz_rate for r in readers.resume_scan(None, stories).collect()] == [None] * 3


def test_next_sessions_are_always_n(spark):
    from tessera.functions.dates import next_sessions
    closed = spark.range(60).select(F.date_add(F.lit("2024-01-02").cast("date"), F.col("id").cast("int")).alias("date"))
    starts = spark.createDataFrame([("A", day(0)), (None, day(3))], "tic string, date date")
    got = next_sessions(starts, spark, 4, holidays=closed)
    assert got.count() == 8 and got.agg(F.min("date")).first()[0] >= day(61)


def test_stream_join_with_late_reports(spark):
    land, path = scratch_path(spark, "t-land"), scratch_path(spark, "t-join")
    t0 = dt.datetime(2024, 1, 1)
    bar = lambda k, tic="A": (tic, t0 + dt.timedelta(minutes=k), k)
    rep = lambda k, tic="A": (tic, t0 + dt.timedelta(minutes=k), f"r{k}")
    steps = [([bar(10), bar(70), bar(75, None)], [rep(65)]), ([bar(200)], [rep(5), rep(75, None)]), ([bar(900)], [rep(900)]), ([bar(1500)], [rep(1500)])]
    for k, (b, r) in enumerate(steps):
        spark.createDataFrame(b, "tic string, ts timestamp_ntz, n int").write.parquet(f"{land}/bars{k}.parquet")
        spark.createDataFrame(r, "tic string, published timestamp_ntz, rep string").write.parquet(f"{land}/reps{k}.parquet")
        streams.run_available_now(streams.stream_reports(streams.file_stream(spark, land, "bars", "tic string, ts timestamp_ntz, n int"),
                                                         streams.file_stream(spark, land, "reps", "tic string, published timestamp_ntz, rep string")), path)
    got = sorted(((r.n, r.rep) for r in spark.read.parquet(path + "/out").collect()), key=str)
    # the report of minute 5 comes a batch late and is still met; bars without one come out when they are passed
    assert got == sorted([(10, "r5"), (70, "r65"), (75, None), (200, None), (900, "r900"), (1500, "r1500")], key=str)
