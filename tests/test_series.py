"""Chunked ordered-series operators against straightforward Python on literal rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.series import bfill, ffill, linear_recurrence, linear_recurrences, rolling, with_index


def _days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_with_index_crosses_chunks(spark):
    rows = [("A", d) for d in _days(100)] + [("B", d) for d in _days(7, dt.date(2020, 3, 30))]
    df = spark.createDataFrame(rows, "tic string, date date")
    got = {(r.tic, r.date): r._j for r in with_index(df).collect()}
    for tic in ("A", "B"):
        dates = sorted(d for t, d in got if t == tic)
        assert [got[(tic, d)] for d in dates] == list(range(len(dates)))


def test_ffill_bfill_leading_and_trailing_nulls(spark):
    vals = [None, None, 1.0, None, None, 4.0, None] + [None] * 40 + [7.0, None]
    rows = [("A", d, v) for d, v in zip(_days(len(vals)), vals)] + [("B", dt.date(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "tic string, date date, x double")
    f = {(r.tic, r.date): r.x for r in ffill(df, ["x"]).collect()}
    b = {(r.tic, r.date): r.x for r in bfill(df, ["x"]).collect()}
    days = _days(len(vals))
    last, exp_f = None, []
    for v in vals:
        last = v if v is not None else last
        exp_f.append(last)
    nxt, exp_b = None, []
    for v in reversed(vals):
        nxt = v if v is not None else nxt
        exp_b.append(nxt)
    exp_b.reverse()
    assert [f[("A", d)] for d in days] == exp_f
    assert [b[("A", d)] for d in days] == exp_b
    assert f[("B", dt.date(2020, 1, 1))] is None


def test_rolling_partial_frames_and_halo(spark):
    xs = [float(i % 13) for i in range(300)]
    df = spark.createDataFrame([("A", d, x) for d, x in zip(_days(300), xs)], "tic string, date date, x double")
    out = rolling(df, 20, {"m": F.avg("x"), "lo": (5, F.min("x"))}, block=64)
    got = {r.date: (r.m, r.lo) for r in out.collect()}
    for i, d in enumerate(_days(300)):
        w = xs[max(0, i - 19): i + 1]
        assert abs(got[d][0] - sum(w) / len(w)) < 1e-9
        assert got[d][1] == min(xs[max(0, i - 4): i + 1])


def test_linear_recurrence_matches_loop_over_many_blocks(spark):
    random.seed(1)
    n = 2500  # a = 2/3 gives blocks of ~850 rows: three carries
    xs = [random.uniform(0, 100) if random.random() > 0.05 else None for _ in range(n)]
    df = spark.createDataFrame([("K", d, x) for d, x in zip(_days(n), xs)], "tic string, date date, x double")
    a, seed = 2.0 / 3.0, 50.0
    out = linear_recurrence(df, F.col("x") / 3.0, a, "s", seed=seed)
    got = {r.date: r.s for r in out.collect()}
    s, exp = seed, []
    for x in xs:
        s = a * s + ((x or 0.0) / 3.0)
        exp.append(s)
    assert np.allclose([got[d] for d in _days(n)], exp, rtol=1e-12, atol=1e-9)


def test_fused_recurrences_independent(spark):
    xs = [float(i) for i in range(50)]
    df = spark.createDataFrame([("K", d, x) for d, x in zip(_days(50), xs)], "tic string, date date, x double")
    out = linear_recurrences(df, [("s1", F.col("x"), 0.5, 0.0), ("s2", F.lit(1.0), 0.9, 1.0)])
    r = {row.date: (row.s1, row.s2) for row in out.collect()}
    s1, s2 = 0.0, 1.0
    for d, x in zip(_days(50), xs):
        s1, s2 = 0.5 * s1 + x, 0.9 * s2 + 1.0
        assert abs(r[d][0] - s1) < 1e-9 and abs(r[d][1] - s2) < 1e-9


def test_chained_recurrence_matches_loop(spark):
    random.seed(7)
    n = 2000
    xs = [random.uniform(0, 100) for _ in range(n)]
    df = spark.createDataFrame([("K", d, x) for d, x in zip(_days(n), xs)], "tic string, date date, x double")
    a = 2.0 / 3.0
    out = linear_recurrences(df, [("k", F.col("x") / 3.0, a, 50.0)], chains=[("dd", 0, 50.0)])
    got = {r.date: (r.k, r.dd) for r in out.collect()}
    k, dd = 50.0, 50.0
    for day, x in zip(_days(n), xs):
        k = a * k + x / 3.0
        dd = a * dd + k / 3.0
        assert abs(got[day][0] - k) < 1e-9 and abs(got[day][1] - dd) < 1e-9


def test_recurrence_lookback_drops_only_zero_weight_history(spark):
    # a = 2/3 -> blocks of ~850 rows and a lookback of 4 blocks; 7000 rows = 9 blocks, so
    # later carries start from a frame that no longer reaches block 0.  a = 0.9 shares
    # the block size and needs a longer lookback.  Two keys of different lengths.
    random.seed(3)
    rows, series = [], {}
    for tic, n in (("K", 7000), ("L", 1900)):
        xs = [random.uniform(-50, 100) for _ in range(n)]
        series[tic] = xs
        rows += [(tic, d, x) for d, x in zip(_days(n), xs)]
    df = spark.createDataFrame(rows, "tic string, date date, x double")
    out = linear_recurrences(df, [("s", F.col("x"), 2.0 / 3.0, 50.0), ("v", F.col("x"), 0.9, -3.0)],
                             chains=[("w", 0, 7.0)])
    got = {(r.tic, r.date): (r.s, r.v, r.w) for r in out.collect()}
    for tic, xs in series.items():
        s, v, w = 50.0, -3.0, 7.0
        for d, x in zip(_days(len(xs)), xs):
            s, v = 2.0 / 3.0 * s + x, 0.9 * v + x
            w = 2.0 / 3.0 * w + s / 3.0
            gs, gv, gw = got[(tic, d)]
            assert np.isclose(gs, s, rtol=1e-11, atol=1e-9)
            assert np.isclose(gv, v, rtol=1e-11, atol=1e-9)
            assert np.isclose(gw, w, rtol=1e-11, atol=1e-9)


def test_timestamp_order_splits_by_day_and_stays_exact(spark):
    # 100 hourly rows span five day buckets; index and fills must not notice the cuts
    t0 = dt.datetime(2021, 3, 1, 0, 30)
    ts = [t0 + dt.timedelta(hours=h) for h in range(100)]
    vals = [float(h) if h % 7 == 0 else None for h in range(100)]
    df = spark.createDataFrame([("A", t, v) for t, v in zip(ts, vals)], "tic string, ts timestamp_ntz, x double")
    got = {r.ts: (r._j, r.x) for r in ffill(with_index(df, order="ts"), ["x"], order="ts").collect()}
    last = None
    for i, (t, v) in enumerate(zip(ts, vals)):
        last = v if v is not None else last
        assert got[t] == (i, last)


def test_release_materialized_removes_cut_tables(spark):
    import os
    from tessera.session import _SCRATCH, materialize, release_materialized
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    cut = materialize(df.groupBy("k").count().join(df, "k"), min_weight=1)
    path = _SCRATCH[-1]
    assert cut.count() == 100 and os.path.exists(path.replace("file:", ""))
    assert release_materialized(spark) >= 1
    assert not os.path.exists(path.replace("file:", "")) and not _SCRATCH


def test_checkpoint_folder_is_set_once_a_session(spark):
    from tessera.session import checkpoint_dir
    assert len({checkpoint_dir(spark) for _ in range(200)}) == 1


def test_disk_is_back_to_its_start_after_release(spark):
    import os
    from tessera.session import checkpoint_dir, materialize, release_materialized
    release_materialized(spark)
    root = checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    df = spark.range(50).withColumn("k", F.col("id") % 3)
    for _ in range(3):
        df = materialize(df, pin=True)
    assert df.count() == 50 and release_materialized(spark) == 3
    assert set(os.listdir(root)) <= before
