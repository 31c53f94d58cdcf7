"""Iterative fit with early stopping and the text classifier against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.operators.iterative import best_of_grid, fit_iterative
from tessera.operators.textclass import classify_text, fit_text


def plain_descent(rows, p):
    """(intercept, coef, val_mae, best_epoch, last_epoch) of one model."""
    tr = [(x, y) for x, y, s in rows if s == "train"]
    va = [(x, y) for x, y, s in rows if s == "val"]
    w, best, best_mae, best_epoch, epoch = np.zeros(3), np.zeros(3), None, 0, 0
    while True:
        mae = np.mean([abs(np.dot(x, w[:2]) + w[2] - y) for x, y in va]) if va else None
        if mae is None or best_mae is None or mae < best_mae - p["min_delta"]:
            best, best_mae, best_epoch = w.copy(), mae, epoch
        if epoch >= p["epochs"] or epoch - best_epoch >= p["patience"]:
            return best[2], best[:2], best_mae, best_epoch, epoch
        g = np.zeros(3)
        for x, y in tr:
            e = np.dot(x, w[:2]) + w[2] - y
            g += [e * x[0], e * x[1], e]
        w -= p["learning_rate"] * (g / max(len(tr), 1) + p["l2"] * np.array([w[0], w[1], 0]))
        epoch += 1


def test_descent_equals_plain_loop(spark):
    rng = random.Random(2)
    rows = []
    for tic, n in (("A", 90), ("B", 60), (None, 50), ("NOVAL", 20), ("NOTRAIN", 5)):
        for i in range(n):
            x = [rng.gauss(0, 1), rng.gauss(0, 1)]
            split = {"NOVAL": "train", "NOTRAIN": "val"}.get(tic, "train" if i < n * 0.7 else "val")
            rows.append((tic, x, x[0] - 2 * x[1] + rng.gauss(0, 0.5) + (0.5 if split == "val" else 0), split))
    odd = [("A", [1.0, None], 1.0, "train"), ("A", None, 1.0, "train"), ("A", [1.0, 1.0], None, "val"), ("A", [1.0, 2.0], 9.0, "test")]
    df = spark.createDataFrame(rows + odd, "tic string, features array<double>, target double, split string")
    grid = [{"learning_rate": 0.3, "epochs": 30, "patience": 2}, {"learning_rate": 0.05, "epochs": 7, "l2": 0.2}]
    models, told = fit_iterative(df, grid, 2)
    got = {(m.tic, m.set_id): m for m in models.collect()}
    full = {"min_delta": 1e-6, "patience": 10, "l2": 0.0}
    for (tic, k), m in got.items():
        b, w, mae, best, last = plain_descent([r[1:] for r in rows if r[0] == tic], full | grid[k])
        assert (m.best_epoch, m.last_epoch) == (best, last), (tic, k)
        assert np.allclose([m.intercept, *m.coef], [b, *w]) and (mae is None or math.isclose(m.val_mae, mae))
    assert len(got) == 10 and min(m.last_epoch for m in got.values()) < 30
    seen = told.filter("tic = 'A' AND set_id = 0").orderBy("epoch").collect()
    assert [r.epoch for r in seen] == list(range(got["A", 0].last_epoch + 1)) and seen[got["A", 0].best_epoch].best
    pick = {r.tic: r.set_id for r in best_of_grid(models).collect()}
    assert all(got[t, k].val_mae is None or got[t, k].val_mae <= got[t, 1 - k].val_mae for t, k in pick.items())
    with pytest.raises(ValueError):
        fit_iterative(df, [{"layers": 3}], 2)
    assert fit_iterative(df.limit(0), grid, 2)[0].count() == 0


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain_bayes(train, texts):
    n = len(train)
    df = Counter(w for _, t, _ in train for w in set(words(t)))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    weight, prior = defaultdict(lambda: defaultdict(float)), Counter(y for *_, y in train)
    for _, t, y in train:
        for w, c in Counter(words(t)).items():
            weight[y][w] += c * idf[w]
    out = {}
    for i, t in texts:
        tf = Counter(w for w in words(t) if w in idf)
        score = {y: round(math.log(prior[y] / n) + sum(c * idf[w] * math.log((weight[y][w] + 1) / (sum(weight[y].values()) + len(idf)))
                                                      for w, c in tf.items()), 6) for y in prior}
        out[i] = min(prior, key=lambda y: (-score[y], str(y)))
    return out


def test_bayes_equals_plain_loop(spark, monkeypatch):
    import tessera.operators.joins as joins
    monkeypatch.setattr(joins, "HOT_SHARE", 0.01)  # common words are broadcast, the others shuffled
    rng = random.Random(4)
    vocab = {"up": ["gain", "rise", "Beat"], "down": ["loss", "fall", "miss"], "flat": ["hold", "wait"]}
    rows = []
    for i in range(200):
        y = rng.choice(list(vocab))
        t = " ".join(rng.choice(vocab[y]) if rng.random() < 0.4 else f"the w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 30)))
        rows.append((i, t, y if i % 3 else None))
    rows += [(900, None, "up"), (901, "", None), (902, "unheard", None), (903, "gain " * 3000, None), (904, None, None), (905, "!", "down")]
    df = spark.createDataFrame([(i, t, y, "x") for i, t, y in rows], "doc_id long, text string, label string, tf string")
    model = fit_text(df, "label")
    got = {r["id"]: r["predicted"] for r in classify_text(df, model).collect()}
    want = plain_bayes([r for r in rows if r[2] is not None and r[1] is not None], [(i, t) for i, t, _ in rows])
    assert got == want and sum(got[i] == y for i, _, y in rows if y) > 100
    none = fit_text(df.filter("label = 'nobody'"), "label")
    assert {r["predicted"] for r in classify_text(df, none).collect()} == {None}
    assert classify_text(df.limit(0), model).count() == 0


def test_words_are_counted_in_their_row(spark):
    """No shuffle before words are counted; repeated ids are one text with the labels of all, null ids no text."""
    from tessera.operators.textclass import terms
    rows = [(1, "b a B, a a", "x"), (1, "a c", "y"), (2, "c c d", "x"), (2, "c c d", "x"), (3, None, "y"), (4, "", None), (None, "a c", "x"), (5, "d a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = terms(df, "doc_id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter(tuple(r) for r in found.collect()) == Counter([(1, "a", 3), (1, "b", 2), (1, "a", 1), (1, "c", 1), (2, "c", 2), (2, "d", 1), (2, "c", 2), (2, "d", 1),
                                                                  (None, "a", 1), (None, "c", 1), (5, "a", 1), (5, "d", 1)])
    model = fit_text(df, "label")
    got = {r["term"]: (r["df"], {(o["label"]) for o in r["of"]}) for r in model.gains.collect()}
    assert got == {"a": (2, {"x", "y"}), "b": (2, {"x", "y"}), "c": (4, {"x", "y"}), "d": (2, {"x"})}
    # id 1: tf a 4, b 2, c 1 for x and y each; id 2: tf c 4, d 2 for x twice; N = 5
    idf = {t: math.log(6 / (n + 1)) + 1 for t, (n, _) in got.items()}
    tf = {"x": {"a": 4, "b": 2, "c": 9, "d": 4}, "y": {"a": 4, "b": 2, "c": 1}}
    total = {k: sum(n * idf[t] for t, n in v.items()) + len(idf) for k, v in tf.items()}
    prior = {"x": 4 / 5, "y": 1 / 5}
    texts = {1: {"a": 4, "b": 2, "c": 1}, 2: {"c": 4, "d": 2}, 5: {"a": 1, "d": 1}}
    for r in classify_text(df, model).collect():
        score = {k: math.log(prior[k]) + sum(n * idf[t] * math.log((tf[k].get(t, 0) * idf[t] + 1) / total[k]) for t, n in texts.get(r["id"], {}).items()) for k in tf}
        best = max(score, key=score.get)
        assert (r["predicted"], round(score[best], 4)) == (best, round(r["score"], 4)), r
