"""Personal data by weak supervision.

DataFrame functions only.  Patterns give base spans, which are always kept, and looser
candidates: spelled addresses, national phone numbers, assignments of credentials and bare
high-entropy runs (kind ``secret``, which has no base pattern).  Four labelers (pattern,
gazetteer, context, shape) vote on every span; the counts of vote patterns, a table of fixed
size, go through expectation-maximisation, which estimates how reliable each labeler is; the
posteriors train a classifier over the features of a span, and candidates that it accepts are
added to the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds with base patterns, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

#: Base patterns, written so that no character is tried twice: runs are taken whole (they are
#: possessive), and start only where a run starts or the match before ended.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of digits with single separators; shorter runs than 13 digits cannot pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser candidates.
SPELLED_EMAIL = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
ASSIGNED_SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]{1,40}+\x20?[=:]\x20?[\"'][A-Za-z0-9+/=_.-]{12,}+[\"']"
BARE_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24,}+"

# Gazetteers and context words (four languages).
TOP_DOMAINS = "com net org edu gov mil int info biz io co uk de fr es it eu us ca au ch at nl be ru jp cn in br mx".split()
CUES = {
    "email": "email e-mail mail contact kontakt correo courriel écrire schreiben escribir",
    "ip": "ip server host address adresse dirección login serveur servidor",
    "card": "card visa mastercard amex credit payment karte carte tarjeta kreditkarte",
    "secret": "token secret password passwd auth bearer credential credentials api apikey access jeton geheim clave",
    "phone": "phone call tel telephone mobile fax telefon anrufen téléphone appeler teléfono llamar",
}
AGAINST = "order invoice isbn version ref serial id bestellung rechnung commande facture pedido factura".split()
#: Parts of the names that credentials are assigned to; sizes of hexadecimal digests.
CREDENTIALS = "token secret passw pwd auth credential api_key apikey access_key private_key"
DIGEST_SIZES = (32, 40, 64, 128)
#: Code points before a span that the context labeler reads.
CONTEXT = 32

#: Forms of a span; the first four are base spans.
FORMS = ("email", "ip", "card", "phone", "spelled_email", "odd_ip", "odd_card", "odd_phone", "local_phone", "assigned", "bare")
#: Forms that may be added; the odd ones break the format of their kind (a part over 255, a wrong
#: check digit, too few digits), so they cannot be real and only teach what is not.
ADDABLE = ("spelled_email", "local_phone", "assigned", "bare")
_KIND_OF = {"spelled_email": "email", "odd_ip": "ip", "odd_card": "card", "odd_phone": "phone", "local_phone": "phone",
            "assigned": "secret", "bare": "secret"}


def _sums_before(lengths: Column) -> Column:
    """Sum of the entries before each entry, in blocks of 64: near-linear without recursion."""
    def add(xs):
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    block = 64
    n_blocks = F.floor(F.size(lengths) / block).cast("int")
    totals = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: add(F.slice(lengths, b * block + 1, block)))
    starts = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: add(F.slice(totals, F.lit(1), b)))
    return F.transform(lengths, lambda x, i: F.get(starts, F.floor(i / block).cast("int"))
                       + add(F.slice(lengths, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))))


def matches(df: DataFrame, text: str, pattern: str, may: Column, name: str) -> DataFrame:
    """``df`` with ``name``: array of (s, e, m, b), the leftmost non-overlapping matches with
    code point offsets and the up to ``CONTEXT`` code points between the match before and this
    one; empty where ``may`` rules matches out."""
    m, gaps, at = f"_{name}_m", f"_{name}_gaps", f"_{name}_at"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(m, F.when(may, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)))
    steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
    df = df.withColumn(at, F.when(F.size(m) > 0, steps))
    df = df.withColumn(at, _sums_before(F.col(at)))
    span = F.transform(m, lambda x, i: F.struct(
        (F.get(at, i) + F.length(F.get(gaps, i))).cast("long").alias("s"),
        (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(x)).cast("long").alias("e"), x.alias("m"),
        F.substring(F.get(gaps, i), -CONTEXT, CONTEXT).alias("b")))
    return df.withColumn(name, span).drop(m, gaps, at)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def ip_valid(s: Column) -> Column:
    """Parts of at most 255; leading zeros do not count."""
    def small(p):
        bare = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).otherwise(F.lit("0")).cast("int") <= 255)

    return F.forall(F.split(s, r"\."), small)


def luhn_valid(s: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(s)
    ok = (F.length(d) >= 13) & (F.length(d) <= 19)
    ds = F.array_remove(F.split(F.when(ok, F.reverse(d)).otherwise(F.lit("1")), ""), "")
    twice = F.transform(ds, lambda x, i: F.when(i % 2 == 0, F.ascii(x) - 48)
                        .otherwise((F.ascii(x) - 48) * 2 - F.when(F.ascii(x) > 52, 9).otherwise(0)))
    return ok & (F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0)


def phone_valid(s: Column) -> Column:
    return F.length(_digits(s)).between(9, 15)


def found_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` (null texts are empty already) with ``base`` and ``loose``: arrays of
    (k, s, e, form, m, b), base spans by kind and start, candidates likewise."""
    t = F.col(text)
    df = matches(df, text, EMAIL, t.contains("@"), "_email")
    df = matches(df, text, IP, t.rlike(r"[0-9]\.[0-9]"), "_ip")
    df = matches(df, text, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "_card")
    df = matches(df, text, PHONE, t.contains("+"), "_phone")
    df = matches(df, text, SPELLED_EMAIL, t.rlike(r"[\[(]at[\])]"), "_spelled")
    df = matches(df, text, LOCAL_PHONE, t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), "_local")
    df = matches(df, text, ASSIGNED_SECRET, t.rlike(r"[=:]\x20?[\"'][A-Za-z0-9+/=_.-]{12}"), "_assigned")
    df = matches(df, text, BARE_SECRET, t.rlike(BARE_SECRET), "_bare")

    def of(col, form, keep=None):
        spans = F.col(col) if keep is None else F.filter(col, lambda x: keep(x["m"]))
        kind = ALL_KINDS.index(_KIND_OF.get(form, form))

        def one(x):
            s, e = x["s"], x["e"]
            if form == "assigned":  # the value between the quotes
                s, e = s + F.length(F.regexp_extract(x["m"], r"^[^\"']*[\"']", 0)), e - 1
            return F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), F.lit(form).alias("form"), x["m"].alias("m"), x["b"].alias("b"))

        return F.transform(spans, one)

    df = df.withColumn("base", F.concat(of("_email", "email"), of("_ip", "ip", ip_valid), of("_card", "card", luhn_valid),
                                        of("_phone", "phone", phone_valid)))
    loose = F.concat(of("_spelled", "spelled_email"), of("_ip", "odd_ip", lambda m: ~ip_valid(m)),
                     of("_card", "odd_card", lambda m: ~luhn_valid(m)), of("_phone", "odd_phone", lambda m: ~phone_valid(m)),
                     of("_local", "local_phone"), of("_assigned", "assigned"),
                     F.filter(of("_bare", "bare"), lambda x: ~F.exists("_assigned", lambda a: (a["s"] < x["e"]) & (x["s"] < a["e"]))))
    # a credential may hold what looks like a card number; other candidates give way to base spans
    def taken(x):
        return F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])
                        & ~((x["k"] == ALL_KINDS.index("secret")) & (x["s"] <= b["s"]) & (b["e"] <= x["e"])))

    df = df.withColumn("loose", F.filter(loose, lambda x: ~taken(x)))
    return df.drop("_email", "_ip", "_card", "_phone", "_spelled", "_local", "_assigned", "_bare")


def described(spans: str) -> Column:
    """The spans with ``votes`` (pattern, gazetteer, context, shape: each -1, 0 or 1) and ``features``."""
    def one(x):
        form, m, kind = x["form"], x["m"], x["k"]
        value = F.when(form == "assigned", F.regexp_extract(m, r"[\"'](.*)[\"']$", 1)).otherwise(m)
        name = F.lower(F.regexp_extract(m, r"^([A-Za-z0-9_-]*)", 1))
        pattern = F.when(form.isin(*KINDS) | (form == "assigned"), 1).when(form.startswith("odd"), -1).otherwise(0)
        digits = _digits(m)
        tld = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        gaz = (F.when(kind == 0, F.when(tld.isin(*TOP_DOMAINS), 1).otherwise(-1))
               .when(kind == 1, F.when(F.regexp_extract(m, r"^0*([0-9]{0,4})", 1).isin("", "127", "255"), -1).otherwise(1))
               .when(kind == 2, F.when(F.substring(digits, 1, 1).isin("3", "4", "5", "6"), 1).otherwise(-1))
               .when(form == "assigned", F.when(name.rlike(CREDENTIALS.replace(" ", "|")), 1).otherwise(-1))
               .when(form == "bare", F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & F.length(m).isin(*DIGEST_SIZES), 1)
                     .when(m.rlike("[/=_-].*[/=_-]"), -1).otherwise(0))
               .otherwise(F.when(F.substring(F.substring(digits, -10, 10), 1, 1).isin("0", "1"), -1).otherwise(1)))
        words = F.split(F.lower(x["b"]), r"[^\p{L}\p{N}-]+")
        cue = F.lit(False)
        for i, k in enumerate(ALL_KINDS):
            cue = cue | ((kind == i) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in CUES[k].split()])))
        against = F.arrays_overlap(words, F.array(*[F.lit(w) for w in AGAINST]))
        context = F.when(cue, 1).when(against, -1).otherwise(0)
        joined = F.when(x["b"].rlike(r"[\p{L}\p{N}_=\"]$"), "j").otherwise("f")
        size = F.when(kind == 4, F.least(F.floor(F.length(value) / 8), F.lit(9))).otherwise(F.least(F.length(digits), F.lit(20))).cast("string")
        chars = F.size(F.array_distinct(F.split(value, "")))
        letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        shape = (F.when(kind == 0, F.when(m.rlike("^[A-Za-z0-9._%+-]*[A-Za-z]"), 1).otherwise(-1))
                 .when(kind == 1, F.when(m.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1))
                 .when(kind == 2, F.when(F.length(digits).isin(15, 16), 1).otherwise(0))
                 .when(kind == 3, F.when(F.length(digits).between(10, 13), 1).otherwise(0))
                 .when((F.length(digits) >= 4) & (letters >= 4) & (chars >= 10), 1)
                 .when((F.length(digits) == 0) | (letters == 0) | (chars < 8), -1).otherwise(0))
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"),
                        F.struct(pattern.alias("p"), gaz.alias("g"), context.alias("c"), shape.alias("h")).alias("votes"),
                        F.concat_ws("|", form, gaz.cast("string"), context.cast("string"), shape.cast("string"), joined, size).alias("features"))

    return F.transform(spans, one)


def expectation_maximisation(rows: list[tuple], rounds: int = 50) -> tuple[float, list[dict], list[dict]]:
    """(prior, true, false): probability that a span is real, and each labeler's chance of each
    vote given that it is or is not.  ``rows``: (votes, count); votes are -1, 0 or 1."""
    values, labelers = (-1, 0, 1), range(len(rows[0][0]) if rows else 0)
    true = [{-1: 0.1, 0: 0.3, 1: 0.6} for _ in labelers]
    false = [{-1: 0.6, 0: 0.3, 1: 0.1} for _ in labelers]
    prior = 0.5
    for _ in range(rounds):
        weight = [posterior(v, prior, true, false) for v, _ in rows]
        n = sum(c for _, c in rows)
        real = sum(w * c for w, (_, c) in zip(weight, rows))
        prior = (real + 1) / (n + 2)
        for j in labelers:
            for x in values:
                hit = sum(w * c for w, (v, c) in zip(weight, rows) if v[j] == x)
                miss = sum((1 - w) * c for w, (v, c) in zip(weight, rows) if v[j] == x)
                # one and a half votes of prior belief: a labeler is right rather than wrong
                true[j][x] = (hit + 0.5 + (x == 1)) / (real + 2.5)
                false[j][x] = (miss + 0.5 + (x == -1)) / (n - real + 2.5)
    return prior, true, false


def posterior(votes, prior, true, false) -> float:
    a = math.log(prior) + sum(math.log(t[v]) for t, v in zip(true, votes))
    b = math.log(1 - prior) + sum(math.log(f[v]) for f, v in zip(false, votes))
    return 1 / (1 + math.exp(min(max(b - a, -700), 700)))


def train(found: DataFrame) -> dict[str, float]:
    """Probability by feature string (form, votes, surroundings, digits), smoothed per feature.

    What comes to the driver is one row a (kind, votes, features): the features take fewer than
    13,000 values, whatever the input."""
    spans = found.select(F.explode(described("_spans")).alias("x")).select("x.*")
    seen = spans.groupBy("k", "votes", "features").count().collect()
    scores = {}
    for kind in range(len(ALL_KINDS)):
        mine = [r for r in seen if r["k"] == kind]
        if not mine:
            continue
        patterns: dict[tuple, int] = {}
        for r in mine:
            v = tuple(r["votes"])
            patterns[v] = patterns.get(v, 0) + r["count"]
        prior, true, false = expectation_maximisation(sorted(patterns.items()))
        # the final classifier: naive Bayes over the parts of the feature string
        parts: dict[tuple, list[float]] = {}
        total = [1.0, 1.0]
        for r in mine:
            w = posterior(tuple(r["votes"]), prior, true, false)
            total = [total[0] + w * r["count"], total[1] + (1 - w) * r["count"]]
            for part in enumerate(r["features"].split("|")):
                c = parts.setdefault(part, [0.5, 0.5])
                c[0] += w * r["count"]
                c[1] += (1 - w) * r["count"]
        for r in mine:
            odds = math.log(total[0] / total[1])
            for part in enumerate(r["features"].split("|")):
                c = parts[part]
                odds += math.log(c[0] / (total[0] + 1)) - math.log(c[1] / (total[1] + 1))
            scores[r["features"]] = 1 / (1 + math.exp(min(max(-odds, -700), 700)))
    return scores


def personal_data(df: DataFrame, text_col: str = "text", accept: float = 0.9) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (k, s, e) (kind by its place in ``ALL_KINDS``,
    code points, end exclusive), by kind and start; ``spans`` holds all base spans and the
    candidates with a probability of ``accept`` or more.

    Null and empty texts have no spans; repeated rows have the same; columns named like the
    results are replaced, others kept; an empty table gives no rows."""
    # the text is searched twice: once to learn, once to apply
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    learn = found_spans(df.select(text), "_text")
    scores = train(learn.withColumn("_spans", F.concat("base", "loose")))
    good = [f for f, p in scores.items() if p >= accept and f.split("|")[0] in ADDABLE]
    kept = [F.col(c) for c in df.columns if c not in ("base", "spans")]
    out = found_spans(df.select(F.struct(*kept, F.lit(0).alias("_end")).alias("_row"), text), "_text")

    def bare(col):
        return F.transform(col, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    if good:
        more = F.filter(described("loose"), lambda x: x["features"].isin(*good))
        out = out.withColumn("_more", F.when(F.size("loose") > 0, more))
        none = F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")
        spans = F.array_sort(F.concat(bare("base"), F.coalesce(bare("_more"), none)))
    else:
        spans = bare("base")
    return out.select("_row.*", bare("base").alias("base"), spans.alias("spans")).drop("_end")


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def united(spans: str) -> Column:
    """The spans in order, those that overlap as one (s, e, k) with the kind of the longest."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), (x["e"] - x["s"]).alias("n"))))
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int,n:bigint>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = x["n"] > last["n"]
        one = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), F.when(longer, x["k"]).otherwise(last["k"]).alias("k"),
                       F.greatest(last["n"], x["n"]).alias("n"))
        return F.when((F.size(acc) > 0) & (x["s"] < last["e"]),
                      F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, none, step)


def redacted(text: Column, spans: str) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as
    one, by the kind of the longest, so nothing of any of them is left."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        return F.struct(
            x["e"].alias("at"),
            F.concat(acc["out"], F.array(F.concat(
                F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")),
                F.get(names, x["k"])))).alias("out"))

    def finish(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(united(spans), empty, step, finish)).otherwise(text)
