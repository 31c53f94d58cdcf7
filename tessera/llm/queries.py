"""Registered queries of this package: thin digests of the operators' outputs, and oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


@query()
def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing_sos import pack_sum_of_squares
    return pack_sum_of_squares(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op2_best_fit_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing_bfd import pack_best_fit
    return pack_best_fit(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source,
                  CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             (source_size * 3)::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lv
      FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lv) FROM f WHERE lv <= cap / w) * w, cap)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT d.source, h, sum(size) AS hs FROM d WHERE size > 0 GROUP BY d.source, h),
c AS (SELECT g.source, h, hs, sum(hs) OVER (PARTITION BY g.source ORDER BY h) AS upto FROM g),
b AS (SELECT c.source, arg_min(c.h, c.h) AS bh, arg_min(hs, c.h) AS bs, arg_min(upto - hs, c.h) AS before
      FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source
      WHERE upto > target - epochs * source_size GROUP BY c.source)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (d.size * (e.epochs + CASE WHEN b.bh IS NULL OR d.h < b.bh
                                    OR (d.h = b.bh AND b.bs < 2 * (e.target - e.epochs * e.source_size - b.before))
                                  THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""


@query(OP4_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


@query()
def op7_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.shards import assign_shards
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return (assign_shards(slim, ["doc_id", "text_crc32"], "size").withColumn("law", F.lit("rows"))
            .withColumn("grown_shard", F.lit(None).cast("int"))
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


@query()
def op10_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import held_out, score, train
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


OP3_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""


@query(OP3_SQL)
def op3_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.nearest import nearest
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


@query()
def op8_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "ratio")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
l AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query(OP9_SQL)
def op9_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dedup import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


@query()
def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spotsigs import fingerprint, fingerprints, pruned_jaccard
    found = fingerprints(table(spark, sf_dir, "documents"))
    own = F.col("signatures")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        pruned_jaccard(own, F.col("edited_signatures")).alias("near_edited"),
        pruned_jaccard(own, F.col("next_signatures")).alias("near_next"),
        "length_partition", "near_class")


@query()
def op6_weakly_supervised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import KINDS, listed, personal_data
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))


@query()
def op12_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import as_hex, near_fingerprints
    found = near_fingerprints(table(spark, sf_dir, "documents"), radius=2, width=3)
    return found.select(F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS lt FROM l),
t AS (SELECT r, unnest(w) AS term FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, nd),
s AS (SELECT i.item_id, p.r, l.doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // lt))))::BIGINT AS score
      FROM i JOIN p ON i.term = p.term JOIN f ON i.term = f.term JOIN l ON p.r = l.r, c GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""


@query(OP11_SQL)
def op11_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lexical import ranked
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query()
def op13_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.turns import damaged, repair
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns.select(F.col("conv_id").cast("long")))
