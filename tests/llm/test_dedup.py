"""op9, op5: against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.near_dedup import intersections, keep_one, near_duplicates
from tessera.llm.shingles import MinHash, match_floor, shingle_set
from tessera.llm.spotsigs import ANCHORS, fingerprint, fingerprints, length_partition, pruned_jaccard, spot_columns


def corpus():
    rng = random.Random(11)
    def words(n): return [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    base = words(120)
    rows = []
    for i in range(150):  # a large group of near copies, some of which are not linked
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(120)] = rng.choice("abcdefgh") + str(rng.randint(0, 99))
        rows.append((1000 - i, " ".join(t)))
    passage = words(60)
    for i in range(60):  # a shared passage with texts of their own
        rows.append((2000 + i, " ".join(passage + words(rng.randint(0, 200)))))
    for i in range(60):
        rows.append((3000 + i, " ".join(words(rng.randint(1, 80)))))
    rows += [(4000, None), (4001, ""), (4002, " \n "), (4003, "one two"), (4004, "ONE  Two"), (4005, "one"), (4006, "Ä b c"),
             (4007, "ä b c"), (5, rows[0][1].upper()), (1000, rows[0][1]), (None, rows[-1][1]), (6000, "long " * 5 + " ".join(words(20000)))]
    return rows


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    low = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return [(rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else low[find(i)]) for i in range(len(rows))], groups


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent, monkeypatch):
    import tessera.llm.near_dedup as nd
    monkeypatch.setattr(nd, "LIST_BLOCK", 40)  # the large group is split into block pairs
    monkeypatch.setattr(nd, "SET_BLOCK", 30)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = near_duplicates(df, width, percent).select("id", "n", "component").collect()
    want, groups = brute(rows, width, percent)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert max(map(len, groups.values())) > 30


def test_keep_one_of_each_group(spark):
    rows = corpus() + [(3000, corpus()[210][1])] * 50
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _keep int")
    kept = keep_one(df).collect()
    _, groups = brute(rows, 5, 80)
    words = [bool((t or "").split()) for _, t in rows]
    assert len(kept) == sum(1 for g in groups.values() if words[g[0]]) + words.count(False)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        assert not words[g[0]] or not ids or sum(r["doc_id"] == min(ids) and r["text"] is not None for r in kept) >= 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0 and fingerprints(empty).count() == 0


def test_signatures_and_threshold():
    rng = np.random.Generator(np.random.PCG64(1))
    sign, t, worst = MinHash(48), match_floor(48, 0.85, 1e-7), 48
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 1085, dtype=np.uint64)
        a, b = np.unique(pool[:1000]), np.unique(pool[81:1081])  # similarity 0.85
        worst = min(worst, int((sign(a) == sign(b)).sum()))
    assert worst >= t >= 24
    assert len(shingle_set("a b", 3)) == 1 and (shingle_set("A b", 3) == shingle_set("a  b\n", 3)).all()


def test_intersections():
    rng = np.random.Generator(np.random.PCG64(2))
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 3000, 6000, 6000)]
    got = intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [(i, w) for i, w in enumerate(words) if w not in ANCHORS]
    out = set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            chain = [c for j, c in content if j > i][:2]
            if chain:
                out.add((w, *chain))
    return out or ({tuple(words)} if words else set())


TEXTS = ["The cat sat on a mat and the dog ate the cat.", "no anchors here at all", "plain words only", "", None, "the the the",
         "de la Maison, é É und der Hund", "the cat", "  ", "the cat sat on a mat and the dog ate the bird." * 40]


def test_spot_signatures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r for r in spot_columns(df, F.col("t"), "s").withColumn("f", fingerprint(F.col("s"))).collect()}
    for i, t in enumerate(TEXTS):
        assert len(got[i]["s"]) == len(spots(t or "")) and len(got[i]["f"]) == 8 * len(got[i]["s"])
        for j, u in enumerate(TEXTS):
            assert len(set(got[i]["s"]) & set(got[j]["s"])) == len(spots(t or "") & spots(u or ""))


def test_fingerprints_edit_and_successor(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-50, 10 ** 12), " ".join(rng.choice(["the", "of", "ça", "x𝄞y", "dog"]) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    rows += [(10 ** 13, None), (10 ** 13 + 1, "the last one of all")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars int").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints(df).withColumn(
        "near", pruned_jaccard(F.col("signatures"), F.col("next_signatures"))).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        assert got[i]["edited_text"] == t[:len(t) - cut] + n[:cut] and got[i]["n_chars"] == len(t)
        a, b = spots(t), spots(n)
        assert got[i]["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprints_ties_nulls_and_single(spark):
    rows = [(1, "the a of dog"), (1, "the a of dog"), (1, "other the text"), (None, "null the id"), (None, None)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({r["edited_text"] for r in got if r["text"] == "the a of dog"}) == 1
    one = fingerprints(spark.createDataFrame([(3, "the dog is it")], "doc_id long, text string")).first()
    assert one["edited_text"] == "the dog isthe"[:10] + "the"


def test_length_partitions_and_pruning(spark):
    df = spark.range(0, 400).select(F.col("id").cast("int").alias("n"))
    part = {r["n"]: r["p"] for r in df.select("n", length_partition(F.col("n"), 0.8).alias("p")).collect()}
    assert all(part[m] - part[n] <= 1 for n in range(1, 400) for m in range(n, 400) if n >= 0.8 * m)
    a, b = F.array(*[F.lit(i) for i in range(10)]), F.array(F.lit(0), F.lit(1))
    r = spark.range(1).select(pruned_jaccard(a, b).alias("x"), pruned_jaccard(a, b, 0.5).alias("y")).first()
    assert (r["x"], r["y"]) == (0.2, 0.0)


def test_ids_of_many_texts_bring_one_text_a_class(spark, monkeypatch):
    from tessera.llm import near_dedup
    rng, base = random.Random(31), [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(80)] = f"x{i}"
        rows.append((None if i % 2 else 7, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, made = [], near_dedup._blocked
    def blocked(frame, key, size, block):
        if key == "root":  # texts that were fetched for the classes
            plan = frame._jdf.queryExecution().analyzed().toString()
            seen.append((frame.count(), "print" in plan))
        return made(frame, key, size, block)
    monkeypatch.setattr(near_dedup, "_blocked", blocked)
    got = near_duplicates(df, 5, 80).collect()
    want, _ = brute(rows, 5, 80)
    assert sorted(map(str, [(r["id"], r["n"], r["component"]) for r in got])) == sorted(map(str, want))
    assert seen == [(60, True)]
    members = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, t string").select("id", F.xxhash64("t").alias("print"))
    assert near_dedup.class_texts(df, members, "doc_id", "text").count() == 60  # not 30 * 30 for each id


def test_matches_equal_brute_force(spark):
    from tessera.llm.spotsigs import matches
    rng = random.Random(21)
    base = rng.sample(range(-9000, 9000), 60)
    rows = [sorted({*rng.sample(base, rng.randint(40, 60)), *rng.sample(range(-9000, 9000), rng.randint(0, 6))}) for _ in range(80)]
    rows += [sorted(rng.sample(range(-300, 300), rng.randint(1, 12))) for _ in range(150)]
    rows += [list(range(n)) for n in range(1, 40)] * 2 + [[], [], None] + [rows[0]] * 30
    df = spark.createDataFrame([(r,) for r in rows], "signatures array<int>")
    for similarity in (0.5, 0.8):
        classes, pairs = matches(df, similarity, block=16)  # lists of up to 90 classes: split
        classes = classes.collect()
        of = {r["class"]: tuple(r["set"]) for r in classes}
        assert sorted((tuple(r["set"]), r["copies"]) for r in classes) == sorted(
            (x, sum(r is not None and tuple(r) == x for r in rows)) for x in {tuple(r) for r in rows if r is not None})
        every = sorted({tuple(r) for r in rows if r})
        want = {(x, y): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in enumerate(every) for y in every[:i]}
        got = [(max(of[r["a"]], of[r["b"]]), min(of[r["a"]], of[r["b"]]), r["similarity"]) for r in pairs.collect()]
        assert sorted(got) == sorted((x, y, v) for (x, y), v in want.items() if v >= similarity) and len(got) > 50
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_near_classes_equal_brute_force(spark):
    rng, words = random.Random(41), ["the", "of", "is", "and"] * 30 + [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(50):  # near copies that differ in a word each, some equal, one id for several texts
        t = list(base)
        t[rng.randrange(120)] = f"x{i % 35}"
        rows.append((i // 2, " ".join(t)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, None), (None, rows[3][1]), (7, rows[5][1])] + [rows[0]] * 40
    found = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    root = {s: s for s in {frozenset(spots(t or "")) for _, t in rows}}
    def top(s):
        while root[s] != s:
            s = root[s]
        return s
    for a in root:
        for b in root:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[top(a)] = top(b)
    pairs = {(r["near_class"], top(frozenset(spots(r["text"])))) for r in found}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs}) < len(root) - 20


def test_class_components_by_turns_equal_those_by_pairs(spark):
    from tessera.llm.spotsigs import class_components, signature_class
    rng = random.Random(5)
    rows = []
    for g in range(3):  # groups of near sets that share rare members with sets unlike all others
        base = [1000 * g + i for i in range(40)]
        for _ in range(40):
            keep = rng.sample(base, 36)
            rows.append((sorted(set(keep + [rng.randrange(5000, 5020) for _ in range(rng.randint(0, 3))])),))
        rows += [(sorted(rng.sample(base, 12) + rng.sample(range(6000, 6100), 28)),) for _ in range(20)]
    rows += [([],), (None,), rows[0], rows[70]]
    df = spark.createDataFrame(rows, "signatures array<int>")
    sets = {r["class"]: frozenset(r["signatures"]) for r in df.filter("size(signatures) > 0")
            .select("signatures", signature_class(F.col("signatures")).alias("class")).collect()}
    root = {c: c for c in sets}
    def top(c):
        while root[c] != c:
            c = root[c]
        return c
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                hi, lo = sorted((top(a), top(b)), reverse=True)
                root[hi] = lo
    want = {c: top(c) for c in sets}
    for tests in (0, 2, 10 ** 9):  # turns as long as they halve the lists, some, none
        found = {r["node"]: r["root"] for r in class_components(df, block=16, tests=tests).collect()}
        assert {c: found.get(c, c) for c in sets} == want
    assert len(set(want.values())) < len(want) - 60
    assert class_components(df.limit(0)).collect() == []


def test_query_digests(spark):
    from conftest import SF001
    from tessera.llm.queries import QUERIES
    got = QUERIES["op5_spot_signatures"](spark, SF001).collect()
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    want = {}
    for k, (i, t) in enumerate(docs):
        cut = len(t) // 4
        want[i] = hashlib.sha256((t[:len(t) - cut] + docs[(k + 1) % len(docs)][1][:cut]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
    found = QUERIES["op9_minhash_components"](spark, SF001).collect()
    want, _ = brute(docs, 3, 85)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_sets_that_meet_are_compared_only_where_sketches_leave_room(spark, monkeypatch):
    """Many sets of one family, most of them too unlike: the components hold, with few comparisons."""
    import random
    from tessera.llm import spotsigs as S
    rng = random.Random(3)
    family = [rng.randrange(-2 ** 31, 2 ** 31) for _ in range(50)]
    sets = [sorted(rng.sample(family, 40)) for _ in range(60)]
    sets += [sorted(set(x[:-1]) | {rng.randrange(-2 ** 31, 2 ** 31)}) for x in sets[:20]]
    df = spark.createDataFrame([(x,) for x in sets], "signatures array<int>")
    key = [r.c for r in df.select(S.signature_class(df.signatures).alias("c")).collect()]
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    pairs = {(max(key[i], key[j]), min(key[i], key[j])) for i, j in alike}
    compared, verified = [], S._verified

    def counted(met, lists, similarity):
        compared.append(met.count())
        return verified(met, lists, similarity)
    monkeypatch.setattr(S, "_verified", counted)
    assert {(r.a, r.b) for r in S.matches(df, 0.8)[1].collect()} == pairs
    assert len(pairs) == 22 and 22 <= compared[0] < 200
    root = {k: k for p in pairs for k in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in S.class_components(df, 0.8).collect()} == root
