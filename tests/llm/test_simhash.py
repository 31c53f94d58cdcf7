"""op12: fingerprints, balls and components against brute force."""

import random
import re
from collections import Counter

import pytest
import xxhash

from tessera.llm.simhash import as_hex, ball, links, near_fingerprints, simhash
from test_queries import QUERIES, SF001


def brute_print(text, width=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(rows, radius=2):
    """Rows (id, fp): the smallest id reachable, null ids last."""
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, f"{fp:016x}", low.get(find(i))) for i, (d, fp) in enumerate(rows)]


def got(df):
    return sorted(map(tuple, df.select("id", as_hex(df["fp"]), "component").collect()), key=str)


def test_equal_brute_force_on_odd_rows(spark):
    rng = random.Random(3)
    def words(n): return [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    base = words(400)
    rows = []
    for i in range(120):  # near copies: chains of small differences
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(400)] = f"x{rng.randint(0, 9)}"
        rows.append((900 - i, " ".join(t)))
    rows += [(2000 + i, " ".join(words(rng.randint(1, 60)))) for i in range(80)]
    rows += [(1, None), (0, ""), (5, " \n\t"), (6, "one"), (7, "ONE two"), (8, "one  two"), (9, "Ä é É"), (10, "ä é É"),
             (None, rows[0][1]), (None, "only here"), (900, rows[3][1]), (900, rows[3][1]), (3000, rows[0][1].upper()),
             (4000, " ".join(words(40000)))]
    df = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], "doc_id long, text string, fp int, id string, n string")
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    found = got(near_fingerprints(df))
    assert found == sorted(want, key=str)
    assert max(Counter(c for _, _, c in found).values()) > 20


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_balls_find_every_pair(spark, radius):
    rng = random.Random(radius)
    fps = {0, 2 ** 64 - 1}
    while len(fps) < 60:  # chains with steps around the radius
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, radius + 2)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {(r.a % 2 ** 64, r.b % 2 ** 64) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()}
    assert all(bin(a ^ b).count("1") <= radius for a, b in found)
    ids = {x: i for i, x in enumerate(sorted(fps))}
    def groups(pairs):
        root = {x: x for x in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(ids[y] for y in fps if find(y) == find(x)) for x in fps}
    assert groups(found) == groups((a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= radius)
    assert len(ball(1)) == 65 and len(set(ball(2))) == 1 + 64 + 2016


def test_odd_radius_and_empty_table(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([], "fp long"), 3)
    assert near_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_is_counted_whole():
    text = " ".join(f"w{i * 7919 % 99991}" for i in range(90_000))
    assert simhash(text.encode(), 3) == brute_print(text)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = QUERIES["op12_simhash_balls"](spark, SF001).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, rows)) == sorted(brute_components(docs))
