"""Turbulence and covariance against brute force on a small literal fixture; the
per-ticker model dataflow end to end."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.risk import covariance, turbulence


def _returns(spark, n_days=330, tickers=("A", "B", "C"), gaps=((1, 5), (2, 40), (2, 41))):
    random.seed(3)
    rows = []
    for di in range(n_days):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=di)
        for ti, t in enumerate(tickers):
            if (ti, di) in gaps:
                continue
            rows.append((t, d, random.gauss(0, 0.02) + (0.01 if t == "B" else 0.0)))
    return spark.createDataFrame(rows, "tic string, date date, ret double"), rows


def _brute(rows, tickers, lb):
    df = pd.DataFrame(rows, columns=["tic", "date", "ret"]).pivot(index="date", columns="tic", values="ret")
    df = df.reindex(columns=list(tickers)).sort_index()
    out, count = {}, 0
    for i, d in enumerate(df.index):
        if i < lb:
            out[d] = 0.0
            continue
        h = df.iloc[i - lb:i]
        h = h.iloc[h.isna().sum().min():].dropna(axis=1)
        cur = df.iloc[i][h.columns]
        dv = cur.values - h.mean().values
        v = float(dv @ np.linalg.pinv(np.atleast_2d(np.cov(h.values, rowvar=False))) @ dv.T)
        if v > 0:
            count += 1
            v = v if count > 2 else 0.0
        else:
            v = 0.0
        out[d] = v
    return out


def test_turbulence_matches_brute_force(spark):
    df, rows = _returns(spark)
    got = {r.date: r.turbulence for r in turbulence(df, ["A", "B", "C"], lookback=60).collect()}
    exp = _brute(rows, ["A", "B", "C"], 60)
    assert set(got) == set(exp)
    for d, v in exp.items():
        assert abs(got[d] - v) < 1e-9 * max(1.0, abs(v)), d


def test_covariance_pairwise_complete(spark):
    df, rows = _returns(spark, n_days=120)
    got = {(r.tic_a, r.tic_b): r.cov for r in covariance(df, ["A", "B", "C"]).collect()}
    w = pd.DataFrame(rows, columns=["tic", "date", "ret"]).pivot(index="date", columns="tic", values="ret")
    exp = w.cov()  # pandas: pairwise complete, sample
    for a in "ABC":
        for b in "ABC":
            assert abs(got[(a, b)] - exp.loc[a, b]) < 1e-12


def test_covariance_tiles_equal_one_tile(spark):
    names = [f"T{k}" for k in range(9)]
    df, rows = _returns(spark, n_days=60, tickers=names, gaps=[(k, d) for k in range(9) for d in range(60) if (k * 7 + d) % 11 == 0])
    odd = spark.createDataFrame([(None, dt.date(2020, 1, 5), 1.0), ("T1", None, 1.0), ("T9", dt.date(2020, 1, 5), None)], df.schema)
    got = {(r.tic_a, r.tic_b): r.cov for r in covariance(df.unionByName(odd), tile=2, days=7).collect()}
    exp = pd.DataFrame(rows, columns=["tic", "date", "ret"]).pivot(index="date", columns="tic", values="ret").cov()
    assert {k for k in got if "T9" not in k} == {(a, b) for a in names for b in names}
    assert all(abs(got[a, b] - exp.loc[a, b]) < 1e-12 for a in names for b in names)
    assert got["T9", "T0"] is None
    assert covariance(df.limit(0)).count() == 0


def test_turbulence_needs_no_ticker_list(spark):
    df, rows = _returns(spark, n_days=130)
    a = turbulence(df, lookback=30).collect()
    assert sorted(a) == sorted(turbulence(df, ["A", "B", "C"], lookback=30).collect())
    assert turbulence(df.limit(0), lookback=30).count() == 0


def test_model_dataflow(spark):
    import __spark_entry__ as E
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    coefs = q["ml_06_fit_per_ticker"](spark, sf).collect()
    assert len(coefs) == 5 and all(len(c.coef) == 5 for c in coefs)
    best = q["ml_07_grid_search"](spark, sf).collect()
    assert {b.lam for b in best} <= {0.1, 1.0, 10.0, 100.0}
    ev = q["ml_13_evaluate"](spark, sf).collect()
    assert {e.split for e in ev} == {"train", "val", "test"} and all(e.mae >= 0 for e in ev)
    r = q["ml_14_rate_text"](spark, sf).collect()
    assert all(x.rating is None or 1 <= x.rating <= 10 for x in r)


def test_ridge_from_sufficient_stats_matches_grouped(spark):
    from tessera.operators import model as M
    random.seed(5)
    rows = []
    for t in ("A", "B"):
        for i in range(300):
            x = [random.gauss(0, 1), random.gauss(5, 2), 1000.0 + random.gauss(0, 10)]
            y = 2 * x[0] - x[1] + 0.01 * x[2] + random.gauss(0, 0.1)
            rows.append((t, x, y, "train" if i < 200 else "val"))
    df = spark.createDataFrame(rows, "tic string, features array<double>, target double, split string")
    a = {r.tic: r for r in M.fit_per_ticker(df, 0.5).collect()}
    for t in ("A", "B"):
        # brute force: centred closed-form ridge with an unpenalised intercept, in numpy
        tr = [(x, y) for tic, x, y, sp in rows if tic == t and sp == "train"]
        va = [(x, y) for tic, x, y, sp in rows if tic == t and sp == "val"]
        x, y = np.array([r[0] for r in tr]), np.array([r[1] for r in tr])
        xm, ym = x.mean(axis=0), y.mean()
        w = np.linalg.solve((x - xm).T @ (x - xm) + 0.5 * np.eye(3), (x - xm).T @ (y - ym))
        b0 = ym - xm @ w
        mae = np.mean([abs(np.dot(xv, w) + b0 - yv) for xv, yv in va])
        assert np.allclose(a[t].coef, w, rtol=1e-6, atol=1e-8)
        assert abs(a[t].intercept - b0) < 1e-6 and abs(a[t].val_mae - mae) < 1e-8


def test_grid_search_reuses_stats_and_picks_min_val_mae(spark):
    from tessera.operators import model as M
    random.seed(11)
    rows = []
    for t in ("A", "B", "C"):
        for i in range(120):
            x = [random.gauss(0, 1), random.gauss(0, 3)]
            rows.append((t, x, 3 * x[0] + random.gauss(0, 2), "train" if i < 90 else "val"))
    df = spark.createDataFrame(rows, "tic string, features array<double>, target double, split string")
    lams = [0.01, 1.0, 50.0, 500.0]
    fits = {lam: {r.tic: r for r in M.fit_per_ticker(df, lam).collect()} for lam in lams}
    best = {r.tic: r for r in M.grid_search(df, lams).collect()}
    for t in ("A", "B", "C"):
        want = min(lams, key=lambda lam: (fits[lam][t].val_mae, lam))
        assert best[t].lam == want
        assert np.allclose(best[t].coef, fits[want][t].coef) and best[t].val_mae == fits[want][t].val_mae
