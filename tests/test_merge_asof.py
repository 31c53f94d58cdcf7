"""merge_daily and the as-of operators on literal rows (closed days, weekend reports,
null estimates, news after the last bar)."""

import datetime as dt

from tessera.operators import asof as A
from tessera.plans import daily as D

d = dt.date


def _inputs(spark):
    bars = spark.createDataFrame(
        [("A", d(2023, 1, k), float(9 + i), 100.0 + i, d(2023, 1, k).weekday())
         for i, k in enumerate([2, 3, 4, 5, 6, 9], start=1)],
        "tic string, date date, close double, volume double, day int")
    macro = spark.createDataFrame([(d(2023, 1, 1), 100.0), (d(2023, 1, 4), 101.0)], "date date, NFP double")
    ratings = spark.createDataFrame([("A", d(2023, 1, 3), 4.0), ("A", d(2023, 1, 7), 8.0), ("A", d(2023, 1, 8), 6.0),
                                     ("A", d(2023, 1, 10), 9.0)], "tic string, date date, benz_rate double")
    earn = spark.createDataFrame([("A", d(2022, 12, 1), 1.0, 0.9, 11.1111), ("A", d(2023, 1, 7), 1.5, None, None)],
                                 "tic string, date date, reportedEPS double, estimatedEPS double, surprisePct double")
    return bars, macro, ratings, earn


def test_merge_daily_semantics(spark):
    bars, macro, ratings, earn = _inputs(spark)
    for parity in (False, True):
        out = {r.date.day: r for r in D.merge_daily(bars, macro, ratings, earn, parity=parity).collect()}
        assert sorted(out) == [2, 3, 4, 5, 6, 9]
        assert [out[k].benz_rate for k in (2, 3, 4, 5, 6, 9)] == [None, 4.0, 4.0, 4.0, 4.0, 6.667]
        assert [out[k].NFP for k in (2, 3, 4, 5, 6, 9)] == [None, None, 101.0, 101.0, 101.0, 101.0]
        assert out[6].reportedEPS == 1.0 and out[9].reportedEPS == 1.5
        assert out[9].estimatedEPS == 0.9  # null estimate filled from the previous report
        assert out[9].surprisePct == 11.1111


def test_asof_backward_is_columnwise_and_point_in_time_is_recordwise(spark):
    bars, _, _, earn = _inputs(spark)
    a = {r.date.day: r for r in A.asof_backward(bars.select("tic", "date"), earn,
                                                 ["reportedEPS", "estimatedEPS"]).collect()}
    assert a[9].reportedEPS == 1.5 and a[9].estimatedEPS == 0.9
    p = {r.date.day: r for r in A.point_in_time(bars.select("tic", "date"), earn.withColumnRenamed("date", "rd"),
                                                 "tic", "date", "rd", ["reportedEPS", "estimatedEPS"]).collect()}
    assert p[9].reportedEPS == 1.5 and p[9].estimatedEPS is None
    assert p[2].reportedEPS == 1.0


def test_session_roll(spark):
    bars, _, ratings, _ = _inputs(spark)
    r = {x.date.day: x.session for x in A.session_roll(ratings, bars.select("tic", "date")).collect()}
    assert r == {3: d(2023, 1, 3), 7: d(2023, 1, 9), 8: d(2023, 1, 9), 10: None}
