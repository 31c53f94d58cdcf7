"""Streaming re-aims equal their batch counterparts (availableNow runs)."""

import os

from pyspark.sql import functions as F

from tessera.operators import bars as B
from tessera.plans.fixtures import Fixtures
from tessera.plans.q_streaming import EVENTS_SCHEMA
from tessera.session import checkpoint_dir
from tessera.streaming import streams as ST

from conftest import SF001


def test_stream_bars_equal_batch_on_closed_windows(spark):
    checkpoint_dir(spark)
    s = ST.file_stream(spark, SF001, "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    path = ST.scratch(spark, "t-bars")
    ST.run_available_now(ST.stream_bars(s, "1 hour", "10 minutes"), path)
    got = spark.read.parquet(path + "/out")
    ev = Fixtures(spark, SF001).events.withColumnRenamed("event_type", "tic")
    batch = B.resample(ev, "1H", price="value", volume=None, tie="event_id")
    closed = batch.join(got.select("tic", "ts"), ["tic", "ts"], "left_semi")
    assert got.count() > 0 and got.count() == closed.count()
    diff = got.select("tic", "ts", "open", "high", "low", "close", "volume").exceptAll(
        closed.select("tic", "ts", "open", "high", "low", "close", "volume"))
    assert diff.count() == 0


def test_stream_state_ema_matches_batch(spark):
    s = ST.file_stream(spark, SF001, "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    path = ST.scratch(spark, "t-state")
    ST.run_available_now(ST.stream_state(s, span=12), path)
    got = spark.read.parquet(path + "/out")
    from tessera.operators.series import ewm_mean
    ev = Fixtures(spark, SF001).events.select(F.col("event_type").alias("tic"), "ts", "value")
    batch = ewm_mean(ev, "value", "ema_b", 2.0 / 13, order="ts")
    j = got.withColumn("ts", F.col("ts").cast("timestamp_ntz")).join(batch, ["tic", "ts"])
    assert j.count() == ev.count()
    assert j.filter(F.abs(F.col("ema") - F.col("ema_b")) > 1e-6).count() == 0


def test_stream_state_over_batches_without_a_task_per_ticker(spark):
    import datetime as dt
    import random

    import pytest

    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), start + dt.timedelta(minutes=i),
             rng.choice([None, float("nan"), rng.random()])) for i in range(900)]
    rows += [("gone", start, 5.0), ("gone", start + dt.timedelta(days=30), None), ("hot", start + dt.timedelta(days=20), 1.0)]
    folder, path = ST.scratch(spark, "t-land"), ST.scratch(spark, "t-batches")
    schema, got = "tic string, ts timestamp_ntz, value double", []
    for k, (lo, hi) in enumerate([(dt.datetime.min, start + dt.timedelta(minutes=500)), (start + dt.timedelta(minutes=500), start + dt.timedelta(days=25)),
                                  (start + dt.timedelta(days=25), dt.datetime.max)]):
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{folder}/ticks{k}.parquet")
        ST.run_available_now(ST.stream_state(ST.file_stream(spark, folder, "ticks", schema)), path)
    for r in spark.read.parquet(path + "/out").withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect():
        got.append((str(r["tic"]), r["ts"], r["value"], r["last_known"], r["ema"]))
    want, a = [], 1 - 2 / 13
    for tic in {r[0] for r in rows}:
        last, num, den = None, 0.0, 0.0
        for _, ts, v in sorted((r for r in rows if r[0] == tic), key=lambda r: r[1]):
            if tic == "gone" and ts > start:
                last, num, den = None, 0.0, 0.0  # idle for more than a week when the second batch was over
            v = None if v is None or v != v else v
            last, num, den = (v if v is not None else last), a * num + (v or 0.0), a * den + (v is not None)
            want.append((str(tic), ts, v, last, num / den if den else None))
    got.sort(key=lambda r: r[:2])
    want.sort(key=lambda r: r[:2])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all((g[4] is None and w[4] is None) or g[4] == pytest.approx(w[4], rel=1e-9) for g, w in zip(got, want))
    stream = ST.stream_state(ST.file_stream(spark, folder, "ticks", schema))
    plan = getattr(stream, "source", stream)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" not in plan  # no Python group of a ticker's whole batch


def test_stream_news_dedupe_keys_equal_batch(spark):
    from tessera.plans.q_streaming import stm_01
    got = stm_01(spark, SF001)
    n = Fixtures(spark, SF001).news
    assert got.select("created", "title").distinct().count() == n.select("created", "title").distinct().count()
    assert got.count() == got.select("created", "title").distinct().count()


def test_blocks_of_late_rows_over_batches(spark):
    import datetime as dt
    import random

    import pytest
    from tessera.streaming import blocks as BL

    rng, start = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), start + dt.timedelta(minutes=7 * i, seconds=rng.randint(0, 50)),
             rng.choice([None, float("nan"), rng.random()])) for i in range(300)]
    rows.append(("end", start + dt.timedelta(days=9), 1.0))
    folder, path = ST.scratch(spark, "t-land"), ST.scratch(spark, "t-blocks")
    schema = "tic string, ts timestamp_ntz, value double"
    # rows of a block are spread over batches and come in any order, up to the delay
    parts = [[], [], [], []]
    for k, r in enumerate(rows[:-1]):
        parts[min(2, k // 100 + (rng.random() < 0.2 and k % 100 > 80))].append(r)
    parts[3].append(rows[-1])
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/ticks{k}.parquet")
        got = BL.run_blocks(ST.file_stream(spark, folder, "ticks", schema), path, delay="6 hours")
    assert spark.conf.get(BL.PROVIDER) != BL.ROCKSDB
    got = sorted(((str(r.tic), r.ts.replace(tzinfo=None), r.value, r.last_known, r.ema) for r in
                  got.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()), key=lambda r: r[:2])
    want, a = [], 1 - 2 / 13
    for tic in {r[0] for r in rows} - {"end"}:
        last, num, den = None, 0.0, 0.0
        for _, ts, v in sorted((r for r in rows if r[0] == tic), key=lambda r: r[1]):
            v = None if v is None or v != v else v
            last, num, den = (v if v is not None else last), a * num + (v or 0.0), a * den + (v is not None)
            want.append((str(tic), ts, v, last, num / den if den else None))
    want.sort(key=lambda r: r[:2])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all((g[4] is None and w[4] is None) or g[4] == pytest.approx(w[4], rel=1e-9) for g, w in zip(got, want))


def test_old_state_tables_are_deleted(spark):
    folder, path = ST.scratch(spark, "t-land"), ST.scratch(spark, "t-old")
    schema = "tic string, ts timestamp_ntz, value double"
    for k in range(4):
        spark.sql(f"SELECT 'a' AS tic, TIMESTAMP_NTZ'2024-01-0{k + 1} 00:00:00' AS ts, {k}D AS value").write.parquet(f"{folder}/ticks{k}.parquet")
        ST.run_available_now(ST.stream_state(ST.file_stream(spark, folder, "ticks", schema)), path)
    left = sorted(int(d) for d in os.listdir(path.replace("file:", "") + "/state"))
    assert len(left) == 2 and spark.read.parquet(path + "/out").count() == 4


def test_stream_reports_meet_by_slices_of_time(spark):
    """Rows of one ticker meet by time as well: the join has the slice among its keys."""
    from collections import Counter
    from datetime import datetime, timedelta
    t = datetime(2024, 1, 1)
    at = [t + timedelta(minutes=20 * i) for i in range(30)] + [t + timedelta(hours=7)]
    bars = [("A", x) for x in at] + [("A", at[3]), ("B", at[0]), (None, at[0]), ("A", None)]
    reports = [("A", x, i) for i, x in enumerate(at[::2])] + [("A", at[0], 99), ("A", None, 98), (None, at[0], 97), ("B", t - timedelta(minutes=61), 96)]
    got = ST.stream_reports(spark.createDataFrame(bars, "tic string, ts timestamp_ntz"),
                            spark.createDataFrame(reports, "tic string, published timestamp_ntz, n int"))
    want = Counter()
    for tic, ts in bars:
        met = [n for k, p, n in reports if tic and ts and p and k == tic and p <= ts <= p + timedelta(hours=1)]
        want.update((tic, ts, n) for n in met or [None])
    assert Counter((r.tic, r.ts, r.n) for r in got.collect()) == want
    join = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x)
    assert "_slice" in join and "_in" in join


def _drain_reports(spark, steps, **more):
    """``stream_reports`` over the landed (bars, reports) of each step, drained after each; its folder."""
    land, path = ST.scratch(spark, "t-land"), ST.scratch(spark, "t-reports")
    bars, reports = "tic string, ts timestamp_ntz, n int", "tic string, published timestamp_ntz, rep int"
    for k, (b, r) in enumerate(steps):
        spark.createDataFrame(b, bars).repartition(2).write.parquet(f"{land}/bars{k}.parquet")
        spark.createDataFrame(r, reports).repartition(2).write.parquet(f"{land}/reps{k}.parquet")
        ST.run_available_now(ST.stream_reports(ST.file_stream(spark, land, "bars", bars), ST.file_stream(spark, land, "reps", reports), **more), path)
    return path


def test_stream_reports_take_space_by_rows_and_not_by_pairs(spark):
    """300 bars after 200 reports of their hour are 60,000 pairs; stored are the bars and the reports."""
    from datetime import datetime, timedelta
    t = datetime(2024, 1, 1)
    bars = [("A", t + timedelta(minutes=40, seconds=i), i) for i in range(300)]
    reports = [("A", t + timedelta(seconds=5 * i), i) for i in range(200)]
    path = _drain_reports(spark, [(bars, reports)], packed=True)
    packs = spark.read.parquet(path + "/out")
    assert packs.agg(F.sum(F.size("bars")) + F.sum(F.size("reports"))).first()[0] == 500
    got = ST.unpack_reports(packs)
    assert got.columns == ["tic", "ts", "n", "published", "rep"]
    assert got.select("n", "rep").distinct().count() == got.count() == 60000
    assert not os.path.exists(path.replace("file:", "") + "/work")


def test_stream_reports_over_batches_packed_or_not(spark, monkeypatch):
    """Late, early, repeated and null rows over batches, in packs of three; state holds what is newer
    than the watermark."""
    import random
    from collections import Counter
    from datetime import datetime, timedelta

    monkeypatch.setattr(ST, "PACK_ROWS", 3)
    rng, t, n = random.Random(7), datetime(2024, 1, 1), 0
    steps, hour = [], timedelta(hours=1)
    for k in range(4):
        at = lambda: t + timedelta(minutes=rng.randrange(max(0, 300 * k - 400), 300 * k + 300))
        bars = [(rng.choice(["A", "A", "B", "C", None]), rng.choice([at(), at(), at(), None]), n + i) for i in range(120)]
        reports = [(rng.choice(["A", "A", "B", None]), rng.choice([at(), at(), at(), None]), n + i) for i in range(90)]
        steps.append((bars + bars[:2], reports + reports[:2]))
        n += 200
    want, passed, held, open_bars, seen = Counter(), None, [], [], [[], []]
    for bars, reports in steps:
        bars, reports = ([x for x in rows if x[1] and (passed is None or x[1] > passed)] for rows in (bars, reports))
        open_bars += [[b, False] for b in bars]
        held += reports
        new = {id(x) for x in reports}
        for pair in open_bars:
            fresh = any(pair[0] is b for b in bars)
            for r in held:
                if pair[0][0] and r[0] == pair[0][0] and r[1] <= pair[0][1] <= r[1] + hour:
                    if fresh or id(r) in new:
                        want[pair[0][2], r[2]] += 1
                    pair[1] = True
        for s, rows in zip(seen, (bars, reports)):
            s += [x[1] for x in rows]
        newest = min(max(seen[0]) - timedelta(minutes=10), max(seen[1]) - timedelta(hours=2))
        passed = newest if passed is None else max(passed, newest)
        for b, met in (x for x in open_bars if x[0][1] <= passed):
            want[b[2], None] += not met
        open_bars = [x for x in open_bars if x[0][1] > passed]
    want = +want
    path = _drain_reports(spark, steps, packed=True)
    got = ST.unpack_reports(spark.read.parquet(path + "/out"))
    assert Counter((r.n, r.rep) for r in got.collect()) == want
    assert sum(v for (_, r), v in want.items() if r is None) > 50 and sum(v for (_, r), v in want.items() if r is not None) > 200
    plain = spark.read.parquet(_drain_reports(spark, steps) + "/out").drop("batch_id")
    assert plain.columns == got.columns and plain.exceptAll(got).count() == got.exceptAll(plain).count() == 0
    left = sorted(int(d) for d in os.listdir(path.replace("file:", "") + "/state"))
    rows = spark.read.parquet(f"{path}/state/{left[-1]}/rows")
    assert left == [2, 3]
    assert rows.filter("bar IS NOT NULL").count() == len(open_bars)
    assert rows.filter(F.col("report").isNotNull()).agg(F.min("report.published")).first()[0] > passed - hour
