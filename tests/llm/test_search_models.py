"""op3, op6, op8, op10 against brute force, and their odd rows."""

import hashlib
import math
import random
import re
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest as nn
from tessera.llm import url_filter
from tessera.llm.pii import KINDS, expectation_maximisation, listed, personal_data, posterior, redacted
from tessera.llm.toxicity import UNIT, Slots, feature_keys, held_out, score, train
from tessera.llm.url_filter import RULES, gram_slots, judge


def vectors(n=900, d=24, seed=3):
    rng = np.random.Generator(np.random.PCG64(seed))
    m = rng.normal(size=(n, d)).astype(np.float32) * rng.lognormal(0, 1.5, (n, 1)).astype(np.float32)
    m[100:400] = m[7]  # a third of the rows are one vector
    rows = [(i, m[i].tolist()) for i in range(n)]
    rows[20] = (20, None)
    rows[40] = (40, [0.0] * d)
    rows[60] = (60, [float("nan")] + [1.0] * (d - 1))
    rows[61] = (61, [float("inf")] + [1.0] * (d - 1))
    rows[62] = (62, [None] + [1.0] * (d - 1))
    return rows + [(None, m[1].tolist()), (2000, [1.0, 2.0]), (2001, [3.0, 4.0]), (2020, []), (5, m[5].tolist())]


def brute_nearest(rows, k, step):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v
          and len(v) and np.isfinite(v).all() and any(v)]
    out = []
    for q, a in ok:
        if q % step == 0:
            best = sorted((-reduce(lambda t, xy: t + float(xy[0]) * float(xy[1]), zip(a, b), 0.0), i) for i, b in ok if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(nn, "TILE", 64)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = nn.nearest(df.filter("vec_id % 20 = 0"), df, k=20).collect()
    want = brute_nearest(rows, 20, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_neighbours_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(nn, "CANDIDATE_BLOCK", 128)
    monkeypatch.setattr(nn, "TILE", 64)
    rng = np.random.Generator(np.random.PCG64(5))
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 200)]
    rows += [(400, [9.0] * 8)] * 30 + [(401 + i, [9.0] * 8) for i in range(5)]  # one vector, mostly of one id
    rows += [(500, (20 + rng.normal(size=8)).tolist()) for _ in range(30)]  # one id, many vectors, all near the best
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    as_float = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    want = []
    for q in (20, 40, 400, 500):
        pairs = sorted((-reduce(lambda t, xy: t + xy[0] * xy[1], zip(a, b), 0.0), i)
                       for j, a in as_float if j == q for i, b in as_float if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(pairs[:20])]
    got = nn.nearest(df.filter("vec_id IN (20, 40, 400, 500)"), df, k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    # one block: its best candidates are the query's own
    a, i = np.array([v for _, v in as_float]), np.array([i for i, _ in as_float])
    for own, part in ((500, i > 0), (400, i < 500)):
        at = int(np.flatnonzero(i == own)[-1])
        heap = nn.search_block(i[[at]], a[[at]], i[part], a[part], 20)[0]
        scores = nn.exact_products(np.repeat(a[[at]], len(a), axis=0), a)
        assert sorted(heap, reverse=True) == sorted([(float(scores[r]), -int(i[r])) for r in np.flatnonzero(part & (i != own))],
                                                    reverse=True)[:20]


def test_quantisation_bounds_hold():
    rng = np.random.Generator(np.random.PCG64(9))
    a, b = rng.normal(size=(50, 40)), rng.normal(size=(70, 40)) ** 3
    qa, sa, na, ea = nn.quantised(a)
    qb, sb, nb, eb = nn.quantised(b)
    assert (nn.int8_product(qa, qb) == qa.astype(int) @ qb.astype(int).T).all()
    near = nn.int8_product(qa, qb) * sa[:, None] * sb[None, :]
    slack = na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :]
    assert (np.abs(a @ b.T - near) <= slack + 1e-12).all()


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nn.nearest(df, df).orderBy("query_id").collect()] == [(0, 1, 20, 1.0), (20, 1, 0, 1.0)]
    none = df.filter("vec_id < 0")
    assert nn.nearest(none, df).count() == 0 and nn.nearest(df, none).count() == 0


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


VALID = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": luhn,
         "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15}


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, t) if VALID[k](m.group())]


def texts():
    rng = random.Random(8)
    bits = ["a@b.co", "x.y+z@mail.example.com", "@", "a@b", "c.d@e.f_g@h.i", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "4111111111111111", "12 34", "5", "+1 (555) 010-9999", "+1", "+12 3", "+123456789012345678", "+1 555 0109999.",
            " ", "  ", "-", ".", "ä𝄞", "word", "\n", "12  3456789012345", "1- 4111111111111111", "a%b@c-d.e.f."]
    out = ["".join(rng.choice(bits) + rng.choice(["", " ", ","]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    return out + ["", "x" * 9000, "1" * 9000, "1 " * 5000, "1." * 5000, "a@" * 5000, "+1" * 5000, "a@b.c " * 300, "a.b@" + "c." * 5000]


def test_base_spans_equal_patterns(spark):
    rows = list(enumerate(texts())) + [(None, "null@id.org"), (7777, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, _text int")
    got = personal_data(df).withColumn("b", listed("base")).withColumn("all", listed("spans"))
    assert got.columns[:3] == ["doc_id", "text", "_text"]
    found = {r["doc_id"]: r for r in got.collect()}
    for i, t in rows:
        want = [f"{k}:{s}:{e}" for k, s, e in brute_spans(t or "")]
        assert found[i]["b"] == ",".join(want), t
        assert set(want) <= set(found[i]["all"].split(",")) | {""} and len(found) == len(rows)
        order = [(KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in found[i]["all"].split(",") if x]
        assert order == sorted(order)


def test_candidates_are_learnt(spark):
    rows = [(i, f"call phone +1 ({200 + i}) 555-{1000 + i} now") for i in range(120)]
    rows += [(500 + i, f"phone ({300 + i}) 555-{2000 + i}") for i in range(20)]
    rows += [(900 + i, f"order card 411111111111{1000 + i}") for i in range(40)]
    got = {r["doc_id"]: r["s"] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
           .select("doc_id", listed("spans").alias("s")).collect()}
    assert all(got[500 + i] == "phone:6:20" for i in range(20))
    assert all(("card" in got[900 + i]) == luhn(f"411111111111{1000 + i}") for i in range(40))


def test_expectation_maximisation_tells_labelers_apart():
    rng, counts = random.Random(2), {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) if rng.random() < q else (-1 if y else 1) for q in (0.95, 0.8, 0.6))
        counts[v] = counts.get(v, 0) + 1
    prior, true, false = expectation_maximisation(sorted(counts.items()))
    assert 0.35 < prior < 0.45 and true[0][1] > true[1][1] > true[2][1]
    assert posterior((1, 1, 1), prior, true, false) > 0.95 > 0.05 > posterior((-1, -1, -1), prior, true, false)


def test_redaction(spark):
    t = "ä a@b.co, +1 (555) 010-9999 and 1.2.3.4"
    df = personal_data(spark.createDataFrame([(1, t), (2, None), (3, "none")], "doc_id long, text string"))
    got = [r["x"] for r in df.orderBy("doc_id").select(redacted(F.col("text"), "spans").alias("x")).collect()]
    assert got == ["ä [EMAIL], [PHONE] and [IP]", None, "none"]
    assert personal_data(df.select("doc_id", "text").filter("doc_id < 0")).count() == 0


def host_path(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_urls(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.ORG", "http://org/", "http://xorg/", "http://EXAMPLE.org/es/1?x=/#y", "http://a.example.org/en/12",
            "http://a.com?x=/fr/", "http://a.com#/fr/", "http://Ä.com/fr/://x", "x://y://z/w"]
    urls += [f"https://{rng.choice(['good', 'fine'])}{rng.randint(0, 99)}.com/fr/{rng.choice(['tea', 'cake'])}" for _ in range(200)]
    urls += [f"https://{rng.choice(['casino', 'pills'])}{rng.randint(0, 99)}.com/de/{rng.choice(['bet', 'win'])}" for _ in range(200)]
    new = ["https://good7.net/en/cake", "https://fine3.net/tea", "https://casino5.net/en/win", "https://pills1.net/bet"]
    df = spark.createDataFrame([(i, u, "t", "r") for i, u in enumerate(urls + new)], "page_id long, url string, text string, rule string")
    got = {r["page_id"]: r for r in judge(df).collect()}
    assert len(got) == len(urls + new) and got[0]["text"] == "t"
    for i, u in enumerate(urls + new):
        host, path = host_path(u)
        name, verdict = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, name), u
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert [got[len(urls) + k]["verdict"] for k in range(4)] == ["allow", "allow", "block", "block"]
    assert {r["verdict"] for r in judge(df.filter("page_id < 5")).collect()} == {"allow"}  # nothing rejected to learn from
    assert judge(df.filter("page_id < 0")).count() == 0


def test_gram_slots_are_of_one_text():
    alone, first, n = gram_slots(["abc"])
    both, firsts, _ = gram_slots(["xyz", "abc"])
    assert (alone[:, first[0]:] == both[:, firsts[1]:]).all() and n.tolist() == [4]


def brute_ratio(taught, text):
    """Mean log-likelihood a byte under allow minus that under block, from counts of whole grams."""
    total, marks = 0.0, b"\x02" * 6
    counts = []
    for verdict in ("allow", "block"):
        c = {}
        for t in [t for t, v in taught if v == verdict]:
            b = marks + t.encode() + b"\x03"
            for at in range(6, len(b)):
                for k in range(1, 7):
                    c[b[at + 1 - k:at + 1]] = c.get(b[at + 1 - k:at + 1], 0) + 1
                c[b""] = c.get(b"", 0) + 1
            for k in range(1, 6):
                c[marks[:k]] = c.get(marks[:k], 0) + 1
        counts.append(c)
    b = marks + text.encode() + b"\x03"
    for at in range(6, len(b)):
        for c, sign in zip(counts, (1, -1)):
            p = (c.get(b[at:at + 1], 0) + 1 / 256) / (c.get(b"", 0) + 1)
            for k in range(2, 7):
                p = (c.get(b[at + 1 - k:at + 1], 0) + p) / (c.get(b[at + 1 - k:at], 0) + 1)
            total += sign * np.log(min(p, 1.0))
    return total / (len(b) - 6)


def test_url_counts_are_of_whole_grams(spark, monkeypatch):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(90)) for _ in range(400)]
    # tens of thousands of distinct grams: a table of hashed slots would mix some of them up
    urls = [f"https://h{i}.com/{'fr' if i % 2 else 'de'}/{w}" for i, w in enumerate(words)]
    urls += [f"https://{rng.choice(words)[:40]}.net/{rng.choice(words)[:30]}ä" for _ in range(60)] + ["", None, urls[0], urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    held = {r["page_id"]: r for r in judge(df).collect()}
    fold = {r["u"]: r["f"] for r in spark.createDataFrame([("".join(host_path(u)),) for u in urls], "u string")
            .select("u", F.pmod(F.xxhash64("u"), F.lit(5)).alias("f")).collect()}
    text = [("".join(host_path(u)) if host_path(u)[0] else u or "") for u in urls]
    taught = [(text[i], rule(*host_path(u))[1]) for i, u in enumerate(urls) if rule(*host_path(u))[1] and fold[text[i]] > 0]
    for i in (0, 1, 2, 399, *range(400, 464)):
        assert held[i]["ratio"] == pytest.approx(brute_ratio(taught, text[i]), abs=1e-8)
    monkeypatch.setattr(url_filter, "HELD_GRAMS", 1000)  # counts joined instead of held
    monkeypatch.setattr(url_filter, "TASK_GRAMS", 5000)
    assert {r["page_id"]: r for r in judge(df).collect()} == held


def toxic_rows(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        y = int(rng.random() < 0.2)
        for _ in range(y * 3):
            w[rng.randrange(len(w))] = rng.choice(["Nasty", "vile,", "awful"])
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows() + [(9000, None, None), (9001, "", None), (None, "vile awful", 1), (9003, "nasty " * 50000, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, rows[0][2]), (77777, 1)], "doc_id long, toxic int")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in score(docs, model).withColumn("h", held_out(F.col("doc_id"))).collect()}
    held = [(i, y) for i, _, y in rows if y is not None and got[i]["h"]]
    right = sum((got[i]["score"] >= 0.3) == bool(y) for i, y in held)
    assert len(held) > 100 and right >= 0.95 * len(held)
    assert got[9000]["score"] == got[9001]["score"] < 0.3 < got[9003]["score"] and got[None]["score"] > 0.3
    import zlib
    assert all(got[i]["h"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None)
    again = train(docs.repartition(3), labels.filter(~held_out(F.col("doc_id"))))
    assert (again.held[0] == model.held[0]).all() and (again.held[1] == model.held[1]).all()
    assert len(model.held[0]) < 3000


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """FTRL-proximal, one coordinate at a time, over rows (keys, label)."""
    z, n, w = {}, {}, {}
    base = (sum(y for _, y in rows) + 0.5) / (len(rows) + 10)
    for _ in range(epochs):
        for keys, y in rows:
            for k in keys:
                zk, nk = z.get(k, 0.0), n.get(k, 0.0)
                w[k] = 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((beta + math.sqrt(nk)) / alpha + l2)
            p = 1 / (1 + math.exp(-(math.log(base / (1 - base)) + sum(w[k] for k in keys))))
            for k in keys:
                g, nk = p - y, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(nk + g * g) - math.sqrt(nk)) / alpha * w[k]
                n[k] = nk + g * g
    out = {k: -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2) for k in z if abs(z[k]) > l1}
    return out, base


def test_weights_equal_the_plain_loop(spark):
    rows = [r for r in toxic_rows(400, seed=5)] + [(0, "another text of id 0", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string")  # repeated rows teach once
    labels = {i: y for i, _, y in rows} | {0: rows[0][2]}
    model = train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    order = (docs.distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("p", F.xxhash64("text")).orderBy("h", "doc_id", "p").collect())
    want, _ = plain_ftrl([(sorted(set(feature_keys(r["text"]).tolist())), labels[r["doc_id"]]) for r in order], 2, 3.0, 1.0, 4.0, 0.1)
    got = dict(zip(model.held[0].tolist(), (model.held[1] * UNIT).tolist()))
    assert set(got) == {k for k, w in want.items() if round(w / UNIT)} and len(got) > 20
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in got)


def test_joined_scores_equal_held_ones(spark, monkeypatch):
    import tessera.llm.toxicity as tox
    rows = toxic_rows(300, seed=6) + [(9000, None, 0), (None, "vile awful", 1), (9002, "", 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = sorted(map(tuple, score(docs, train(docs, labels)).collect()), key=str)
    monkeypatch.setattr(tox, "HELD_WEIGHTS", 5)
    model = train(docs, labels)
    assert model.held is None and sorted(map(tuple, score(docs, model).collect()), key=str) == held


def test_rows_of_a_hot_id_are_bounded(spark):
    docs = spark.range(30000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("nasty "), (F.col("id") % 500).cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(100, 200).select(F.col("id").alias("doc_id"), F.lit("calm words").alias("text")))
    labels = spark.range(100, 200).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")).unionByName(
        spark.createDataFrame([(7, 1)], "doc_id long, toxic int"))
    few, all_ = train(docs, labels, sample_docs=300), train(docs, labels)
    assert math.exp(few.offset) / (1 + math.exp(few.offset)) <= 300.5 / 310
    assert math.exp(all_.offset) / (1 + math.exp(all_.offset)) == pytest.approx(500.5 / 610)


def test_slots_grow_and_stay():
    rng = np.random.Generator(np.random.PCG64(9))
    slots, seen = Slots(4), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 4000, 200, dtype=np.uint64) * np.uint64(2 ** 50 + 1))
        for k, at in zip(keys.tolist(), slots.of(keys).tolist()):
            assert seen.setdefault(k, at) == at
    assert sorted(seen.values()) == list(range(len(seen))) and slots.size == len(seen)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(docs, none)
    assert {round(r["score"], 6) for r in score(docs, model).collect()} == {0.05}
    assert score(docs.filter("doc_id < 0"), model).count() == 0 and len(feature_keys("")) == 0


def test_hashes_in_query(spark):
    from conftest import SF001
    from tessera.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in QUERIES["op6_weakly_supervised_pii"](spark, SF001).collect():
        spans = brute_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in spans) for k in KINDS]


def test_redaction_takes_the_union_of_overlapping_spans(spark):
    texts = ["+491701234567@gate.example.com x", "10.0.0.1.bob@x.com", "a@b.co and 10.0.0.1", "plain", None,
             "call +1 (030) 555-0631 or bob@x.com."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in personal_data(df).select("doc_id", redacted(F.col("text"), "spans").alias("t")).collect()}
    assert got == {0: "[EMAIL] x", 1: "[EMAIL]", 2: "[EMAIL] and [IP]", 3: "plain", 4: None, 5: "call [PHONE] or [EMAIL]."}


def test_secrets_are_learnt(spark):
    rng = random.Random(21)
    def hexes(n): return "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, real = [], {}
    for i in range(400):
        plain = " ".join(rng.choice(["word", "line", "title", "name"]) for _ in range(12))
        if i % 8 == 0:
            v = hexes(40)
            rows.append((i, f'{plain} token = "{v}" {plain}'))
            real[i] = v
        elif i % 8 == 1:
            rows.append((i, f'{plain} title = "averylongplaintitle" {"=" * 30} some-long-dashed-lower-case-name {plain}'))
        else:
            rows.append((i, plain))
    held = "068c002651439458202064d35406d6b34bf01abe"  # with a card number by its check digit inside
    rows[8] = (8, f'word token = "{held}" line')
    real[8] = held
    rows += [(900, None), (901, ""), (902, 'token = "' + hexes(40) + '" ' * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in personal_data(df).collect()}
    for i, t in rows[:400]:
        spans = [t[x["s"]:x["e"]] for x in found[i]["spans"] if x["k"] == 4]
        assert spans == ([real[i]] if i in real else []), (i, spans)
        assert i == 8 or found[i]["base"] == []
    text = spark.createDataFrame([(x["doc_id"], x["text"], x["spans"]) for x in found.values() if x["doc_id"] == 8],
                                 "doc_id long, text string, spans array<struct<k:int,s:long,e:long>>")
    assert text.select(redacted(F.col("text"), "spans")).first()[0] == 'word token = "[SECRET]" line' and found[8]["base"]
    assert len(found[902]["spans"]) >= 1
