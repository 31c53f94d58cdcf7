"""op11: the quadtree, the search and its scores against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import tessera.llm.lexical as lx
from tessera.llm.lexical import build, quadtree, ranked, search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    words = [terms(t) for _, t in docs]
    n_docs, n_words = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    tfs = [Counter(w) for w in words]
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for (doc, _), w, tf in zip(docs, words, tfs):
            m = 50 + (50 * len(w) * n_docs) // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 20 * m))
                    for t in set(terms(text)) if tf[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    def text(n): return " ".join(f"t{min(rng.randint(0, 300), rng.randint(0, 300))}" for _ in range(n))
    docs = [(500 - i, text(rng.randint(1, 80))) for i in range(300)]
    docs += [(10_000 + i, docs[5][1]) for i in range(90)]  # copies: ties over the k-th place
    docs += [(7, docs[5][1])] * 3 + [(None, docs[6][1]), (None, docs[5][1]), (2 ** 63 - 1, docs[5][1]), (1, None), (2, ""),
             (3, " ,.- "), (4, "Ünder ünder UNDER a-b_c\x7fd"), (5, "\x80x \u20ac5"), (6, " ".join(f"u{i}" for i in range(30000)))]
    items = [(i, text(rng.randint(1, 40))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "ÜNDER under A b C d"), (104, "t0"), (104, "t1 t2"), (None, "t3 \u20ac5"),
              (105, docs[5][1]), (105, docs[5][1]), (106, "u29999 t1")]
    return docs, items


@pytest.mark.parametrize("block,step,item_bytes", [(16, 4, 300), (4096, 256, 1 << 20)])
def test_equal_brute_force(spark, block, step, item_bytes, monkeypatch):
    monkeypatch.setattr(lx, "ITEM_BYTES", item_bytes)  # several chunks of items
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item string, score int").repartition(3)
    index = build(df, block_docs=block, block_words=block * 40)
    got = search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), 20)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items, 20)


def test_quadtree_holds_the_cells():
    rng = np.random.Generator(np.random.PCG64(4))
    for height in (1, 5, 9):
        side = 1 << height
        cells = np.unique(rng.integers(0, side * side, 3 * side))
        rows, cols = np.divmod(cells, side)
        masks, order = quadtree(rows, cols, height)
        assert len(masks) == height
        at = [(0, 0)]
        for mask in masks:
            at = [(2 * r + (q >> 1), 2 * c + (q & 1)) for (r, c), m in zip(at, mask) for q in range(4) if m >> q & 1]
        assert at == list(zip(rows[order].tolist(), cols[order].tolist())) and len(at) == len(cells)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked(none, items).count() == 0
    assert ranked(some, items.limit(0)).count() == 0
    assert ranked(some.select("doc_id", some.text.substr(9, 1).alias("text")), items).count() == 0
    assert [tuple(r) for r in ranked(some, items).collect()] == brute([(1, "a b")], [(1, "a")], 50)
