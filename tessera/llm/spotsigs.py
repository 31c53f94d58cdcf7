"""SpotSigs fingerprints: chains of content words that follow common words.

DataFrame functions only.  Each occurrence of an anchor (a common word) gives one signature:
the anchor and the next content words after it.  A text is the set of its signatures; sets are
partitioned by length, so that sets too different in length to reach a similarity never meet,
and compared by Jaccard similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pinned
from tessera.llm.components import components
from tessera.operators.joins import skew_join

# Common words of four languages that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "al con del el es las lo los no para por se su una y"
).split()


def spot_columns(df: DataFrame, text: Column, name: str, chain: int = 2) -> DataFrame:
    """``df`` with ``name``: the sorted distinct 32-bit signatures of ``text``.

    A chain at the end of the text may be shorter, but has one content word at least.  A text
    without signatures counts as one chain of all its words; without words it has none."""
    words, at, content = f"_{name}_words", f"_{name}_at", f"_{name}_content"
    df = df.withColumn(words, F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))
    spot = F.transform(words, lambda w, i: F.when(w.isin(*ANCHORS), i))
    df = df.withColumn(at, F.filter(spot, lambda i: i.isNotNull()))
    df = df.withColumn(content, F.filter(words, lambda w: ~w.isin(*ANCHORS)))
    # the k-th anchor, at word i, has i - k content words before it
    def signature(i, k):
        first = i - k
        return F.when(F.get(content, first).isNotNull(), F.hash(
            F.get(words, i), *[F.coalesce(F.get(content, first + j), F.lit("")) for j in range(chain)]))

    spots = F.filter(F.transform(at, signature), lambda s: s.isNotNull())
    df = df.withColumn(name, spots)
    whole = F.when(F.size(words) > 0, F.array(F.hash(F.array_join(words, " ")))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(name, F.when(F.size(name) > 0, F.array_sort(F.array_distinct(name))).otherwise(whole))
    return df.drop(words, at, content)


def fingerprint(signatures: Column) -> Column:
    """Eight hex digits a signature, in the order of the signatures."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(
        F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def length_partition(n: Column, similarity: float) -> Column:
    """Partition of a set length: sets of the similarity lie in the same or in adjacent ones."""
    return F.when(n > 0, F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(-math.log(similarity)) + 1e-9)
                  ).otherwise(F.lit(-1)).cast("int")


def pruned_jaccard(a: Column, b: Column, at_least: float = 0.0, sizes: tuple[Column, Column] | None = None) -> Column:
    """Jaccard similarity of two signature sets; 0 where their lengths alone rule out
    ``at_least``, without looking at the members.  Two empty sets are alike (1).  With ``sizes``
    (the lengths of the whole sets) ``a`` and ``b`` may lack signatures that no other set has."""
    n, m = sizes or (F.size(a), F.size(b))
    reach = F.least(n, m) / F.greatest(n, m)
    both = F.size(F.array_intersect(a, b))
    return (F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0))
            .when(reach < at_least, F.lit(0.0)).otherwise(both / (n + m - both)))


def signature_class(signatures: Column) -> Column:
    """Class of a signature set: equal sets have one class (64 bits)."""
    return F.xxhash64(signatures)


def _classes(df: DataFrame, similarity: float, set_col: str) -> DataFrame:
    n = F.size("set")
    return (df.filter(F.col(set_col).isNotNull()).groupBy(signature_class(F.col(set_col)).alias("class"))
            .agg(F.first(set_col).alias("set"), F.count(F.lit(1)).alias("copies"))
            .select("class", "set", n.alias("n"), length_partition(n, similarity).alias("part"), "copies"))


def _lists(sets: DataFrame, similarity: float) -> DataFrame:
    """The classes that can match another: class, n, part, l (their signatures that other classes
    have, rarest first) and take, the number of those to be posted."""
    each = sets.select("class", "n", F.explode("set").alias("s"))
    # a signature that no other class has meets nobody, but takes a place among the rarest
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    places = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    return pinned(each.join(shared, "s").groupBy("class", "n")
                   .agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("l"))  # at most n
                   .withColumn("take", (places - (F.col("n") - F.size("l"))).cast("int")).filter("take > 0")
                   .withColumn("part", length_partition(F.col("n"), similarity)))


#: Words of 64 bits of a sketch.
SKETCH_WORDS = 4


def _sketch(signatures: Column) -> Column:
    """(k, w): the number of ``signatures`` and a bit set per signature, at a place its own bits name."""
    place = lambda s: F.pmod(s, F.lit(64 * SKETCH_WORDS))
    word = lambda i: F.aggregate(F.filter(signatures, lambda s: F.floor(place(s) / 64) == i), F.lit(0).cast("long"),
                                 lambda w, s: w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)))))
    return F.struct(F.size(signatures).alias("k"), *[word(i).alias(f"w{i}") for i in range(SKETCH_WORDS)])


def _posts(lists: DataFrame, block: int) -> DataFrame:
    """A row per posted signature; ``rest`` counts the listed signatures from it on, ``sketch`` is of all listed."""
    sketched = lists.withColumn("sketch", _sketch(F.col("l.s")))
    return (sketched.select("class", "n", "part", "sketch", F.posexplode(F.slice("l", F.lit(1), F.col("take"))).alias("i", "x"))
             .select("class", "n", "part", "x.s", F.ceil(F.col("x.c") / block).cast("int").alias("blocks"),
                     (F.col("sketch.k") - F.col("i")).alias("rest"), "sketch"))


def _can_match(similarity: float) -> Column:
    """Whether sets of lengths _n and _m, sketches _x and _y, that meet with _r and _q listed signatures to go
    can be alike."""
    near = F.least("_n", "_m") / F.greatest("_n", "_m") >= similarity
    least = (F.col("_n") + F.col("_m")) * (similarity / (1 + similarity)) - 1e-6
    # each bit that only one sketch has stands for a signature, or more, that only one set has
    apart = sum((F.bit_count(F.col(f"_x.w{i}").bitwiseXOR(F.col(f"_y.w{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    # the first holds where the two sets meet first: what follows in both lists is all they can share
    return near & (F.least("_r", "_q") >= least) & (F.col("_x.k") + F.col("_y.k") - apart >= 2 * least)


def matches(df: DataFrame, similarity: float = 0.8, set_col: str = "signatures",
            block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Classes (class, set, n, part, copies) of the equal signature sets of ``df``, and the pairs
    (a, b, similarity; a > b) of classes whose Jaccard similarity is at least ``similarity``.
    ``df`` is read several times.

    Every set is posted under its rarest signatures, as many as a similar set must meet one of,
    in its own length partition and in the next one; sets meet in the partition of the longer
    where the signatures from the meeting point on can still reach the similarity, and are
    compared once.  A signature that no other class has is not posted.  A posting list of more
    than ``block`` classes is split: one side by class, the other repeated in every part.  All
    pairs are given, so a group of sets that are all alike but not equal gives quadratically
    many.  Sets without signatures are one class that matches no other; null sets are left out."""
    sets = _classes(df, similarity, set_col)
    lists = _lists(sets, similarity)
    posts = _posts(lists, block)
    own = posts.select(F.col("class").alias("a"), F.col("n").alias("_n"), F.col("rest").alias("_r"), F.col("sketch").alias("_x"), "part", "s",
                       F.pmod("class", F.col("blocks").cast("long")).cast("int").alias("block"))
    other = (posts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.col("class").alias("b"), F.col("n").alias("_m"), F.col("rest").alias("_q"), F.col("sketch").alias("_y"), "s", "block", F.explode(F.array(
                 F.struct("part", F.lit(True).alias("own")), F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("own")))).alias("_p"))
             .select("b", "_m", "_q", "_y", "s", "block", "_p.part", "_p.own"))
    met = (own.join(other, ["part", "s", "block"]).filter(_can_match(similarity) & (~F.col("own") | (F.col("a") > F.col("b"))))
           .select("a", "b").distinct())
    return sets, _verified(met, lists, similarity)


def _verified(met: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, similarity; a > b) of ``met`` (a, b) that reach the similarity."""
    pairs = (met.join(lists.select(F.col("class").alias("a"), F.col("n").alias("_n"), F.col("l.s").alias("_x")), "a")
             .join(lists.select(F.col("class").alias("b"), F.col("n").alias("_m"), F.col("l.s").alias("_y")), "b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
                     pruned_jaccard(F.col("_x"), F.col("_y"), similarity, (F.col("_n"), F.col("_m"))).alias("similarity")))
    return pairs.filter(F.col("similarity") >= similarity)


def class_components(df: DataFrame, similarity: float = 0.8, set_col: str = "signatures", block: int = 1024,
                     tests: int = 1) -> DataFrame:
    """(node, root): classes of equal sets that reach each other through pairs of the similarity,
    with the smallest one; classes without a match may be left out.  ``df`` is read several times.

    The posting lists are those of ``matches``, without its pairs, since a pair within a
    component would change nothing; sets that meet are compared if their sketches (bits of their
    signatures) leave room for the similarity.  In each turn a class of the largest component in a list,
    drawn by list and turn, is compared with the classes of the list in other components.  Turns end when the
    lists hold at most ``tests`` pairs of different components a posting, or when a turn rids them
    of less than a tenth of these; then these pairs are compared, each once.  How many turns there are changes the
    work alone.  Lists of more than ``block`` classes are split as in ``matches``."""
    lists = _lists(_classes(df, similarity, set_col), similarity)
    posts = pinned(_posts(lists, 1).select("class", "n", "s", "rest", "sketch", F.explode(F.array(
        F.struct("part", F.lit(True).alias("own")), F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("own")))).alias("p"))
        .select("class", "n", "s", "rest", "sketch", "p.part", "p.own"))
    total, edges, before, turn = posts.count(), None, None, 0
    rooted = posts.withColumn("root", F.col("class"))
    while True:
        by_root = rooted.groupBy("part", "s", "root").agg(
            F.count(F.lit(1)).alias("c"), F.max("own").alias("own"),
            F.min(F.struct(F.xxhash64("class", "s", F.lit(turn)).alias("h"), "class", "root", "n", "rest", "own", "sketch")).alias("b"))
        mixed = pinned(by_root.groupBy("part", "s").agg(
            F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("roots"),
            F.max("own").alias("own"), F.max_by("b", F.struct("c", "b.h")).alias("b"))
            .filter("own AND roots > 1").select("part", "s", "c", "same", "b"))
        apart = mixed.agg(F.sum(F.col("c") * F.col("c") - F.col("same"))).first()[0] or 0
        if apart <= tests * total or (before is not None and 10 * apart > 9 * before):
            break
        centre = mixed.select("part", "s", "c", F.col("b.class").alias("b"), F.col("b.root").alias("_rb"),
                              F.col("b.n").alias("_m"), F.col("b.rest").alias("_q"), F.col("b.own").alias("_own"), F.col("b.sketch").alias("_y"))
        stars = (skew_join(rooted.withColumnsRenamed({"class": "a", "n": "_n", "rest": "_r", "root": "_ra", "sketch": "_x"}), centre,
                           ["part", "s"], "c", total)
                 .filter((F.col("_ra") != F.col("_rb")) & _can_match(similarity) & (F.col("own") | F.col("_own")))
                 .select("a", "b").distinct())
        met = _verified(stars, lists, similarity).select("a", "b")
        edges = components(met if edges is None else edges.unionByName(met)).select(F.col("node").alias("a"), F.col("root").alias("b"))
        rooted = pinned(posts.join(edges.select(F.col("a").alias("class"), F.col("b").alias("root")), "class", "left")
                        .withColumn("root", F.coalesce("root", "class")))
        before, turn = apart, turn + 1
    left = skew_join(rooted, mixed.select("part", "s", F.ceil(F.col("c") / block).cast("int").alias("blocks"), "c"),
                     ["part", "s"], "c", total)
    own = left.filter("own").select("part", "s", F.col("class").alias("a"), F.col("root").alias("_ra"), F.col("n").alias("_n"),
                                    F.col("rest").alias("_r"), F.col("sketch").alias("_x"), F.pmod("class", F.col("blocks").cast("long")).cast("int").alias("block"))
    other = left.select("part", "s", F.col("class").alias("b"), F.col("root").alias("_rb"), F.col("n").alias("_m"), F.col("rest").alias("_q"),
                        F.col("sketch").alias("_y"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = (own.join(other, ["part", "s", "block"])
             .filter((F.col("_ra") != F.col("_rb")) & _can_match(similarity) & (~F.col("own") | (F.col("a") > F.col("b"))))
             .select("a", "b").distinct())
    met = _verified(pairs, lists, similarity).select("a", "b")
    return components(met if edges is None else edges.unionByName(met))


def clustered_documents(keyed: DataFrame, similarity: float) -> DataFrame:
    """The documents (_i, _h) of ``keyed`` (_i, _h, signatures; read several times) whose class
    matches another one, with ``root``, the smallest class of its component."""
    roots = class_components(keyed, similarity).select(F.col("node").alias("class"), "root")
    rows = keyed.select("_i", "_h", signature_class(F.col("signatures")).alias("class"))
    copies = rows.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    roots = pinned(roots.join(copies, "class"))
    return skew_join(rows, roots, ["class"], "copies", keyed.count()).groupBy("_i", "_h").agg(F.max("root").alias("root"))


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (_i, _h; distinct) with the key after each in order (after the last: the first).

    Keys are range-partitioned; each partition looks up its own, and only the last key of a
    partition looks at the table of partition firsts."""
    spread = pinned(keys.select("_i", "_h").repartitionByRange("_i", "_h").withColumn("_p", F.spark_partition_id()))
    order = Window.partitionBy("_p").orderBy("_i", "_h")
    inner = spread.withColumn("_next", F.lead(F.struct("_i", "_h")).over(order))
    firsts = spread.groupBy("_p").agg(F.min(F.struct("_i", "_h")).alias("_first"))  # one row a partition
    every = Window.orderBy("_p")
    after = firsts.select("_p", F.coalesce(F.lead("_first").over(every),
                                           F.first("_first").over(every.rowsBetween(Window.unboundedPreceding,
                                                                                    Window.unboundedFollowing))).alias("_after"))
    return (inner.join(after, "_p").withColumn("_next", F.coalesce("_next", "_after"))
            .select("_i", "_h", F.col("_next._i").alias("_ni"), F.col("_next._h").alias("_nh")))


def fingerprints(df: DataFrame, chain: int = 2, similarity: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, text, edited_text, the signature sets of the text, the edited
    text and the next document; length partition of the first, and its ``near_class``: rows have
    the same one where equal sets, or chains of sets of at least ``similarity``, join them.

    The edited text has its last quarter replaced by as many first characters of the next
    document, by id (null ids last; after the last document the first).  Null texts are empty.
    Rows that repeat a document (id and text) have one successor, the next other document;
    documents of one id follow each other in the order of a hash of their texts.  A table of
    one document is its own successor; an empty table gives no rows; other columns are
    ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    # the lowest bit of the hash tells null ids; both joins below then read one and the same shuffle
    bit = F.when(doc_id.isNull(), 1).otherwise(0).cast("long")
    docs = df.select(F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("_i"),
                     F.shiftleft(F.xxhash64(text), 1).bitwiseOR(bit).alias("_h"), text.alias("text"))
    clustered = clustered_documents(
        pinned(spot_columns(docs, F.col("text"), "signatures", chain).select("_i", "_h", "signatures")), similarity)
    sizes = docs.groupBy("_i", "_h").agg(F.max(F.length("text")).alias("_n"))
    asked = (successors(sizes).join(sizes, ["_i", "_h"])
             .select(F.col("_ni").alias("_i"), F.col("_nh").alias("_h"), F.col("_i").alias("_oi"),
                     F.col("_h").alias("_oh"), F.floor(F.col("_n") / 4).cast("int").alias("_k")))
    # a document lends its first characters, and its signatures, to the one before it
    lent = (spot_columns(docs.join(asked, ["_i", "_h"]), F.col("text"), "next_signatures", chain)
            .select(F.col("_oi").alias("_i"), F.col("_oh").alias("_h"), F.expr("left(text, _k)").alias("_lent"),
                    "next_signatures")
            .groupBy("_i", "_h").agg(F.first("_lent").alias("_lent"), F.first("next_signatures").alias("next_signatures"))
            .join(clustered, ["_i", "_h"], "left"))
    out = docs.join(lent, ["_i", "_h"]).withColumn("n_chars", F.length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    out = out.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("_lent")))
    out = spot_columns(out, F.col("text"), "signatures", chain)
    out = spot_columns(out, F.col("edited_text"), "edited_signatures", chain)
    own_id = F.when(F.col("_h").bitwiseAND(F.lit(1)) == 0, F.col("_i"))
    return out.select(own_id.alias("doc_id"), "n_chars", "text", "edited_text", "signatures", "edited_signatures",
                      "next_signatures", length_partition(F.size("signatures"), similarity).alias("length_partition"),
                      F.coalesce("root", signature_class(F.col("signatures"))).alias("near_class"))
