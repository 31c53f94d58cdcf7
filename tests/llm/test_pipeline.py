"""The pipeline: each stage on what its predecessor kept."""

import re

import pytest
from conftest import SF001

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from test_dedup import brute
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
        if name == "toxicity":
            assert {r["doc_id"] for r in kept[name]} < {r["doc_id"] for r in before}
        if name == "near duplicates":
            _, groups = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert len(kept[name]) == len(groups)
            assert {r["doc_id"] for r in kept[name]} == {min(before[i]["doc_id"] for i in g) for g in groups.values()}
        if name == "personal data":
            assert len(kept[name]) == len(before)
            text = {r["doc_id"]: r for r in before}
            for r in kept[name]:
                assert not re.search(r"[\w.]+@mail[0-9]\.example\.com", r["text"]) and r["n_chars"] == len(r["text"])
                old = text[r["doc_id"]]
                assert r["text"] == old["text"] or "[" in r["text"]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.dtypes == spark.read.parquet(f"{SF001}/documents.parquet").dtypes
    pieces, mixed = kept["packing"], kept["mixing"]
    whole = sum(r["length"] for r in pieces if r["start"] + r["length"] == r["doc_tokens"])
    assert sum(r["start"] + r["length"] == r["doc_tokens"] for r in pieces) == len(mixed) and whole > 0


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a@b.co x", "en", None, 8),
            (4, "word " * 30000, "en", "s", 150000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 AS size", "2 AS key", "3 AS spans", "4 AS _row", "5 AS row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, extra, docs.filter("doc_id < 0")):
            out = stage(spark, df, SF001)
            assert out.columns == df.columns
            out.collect()
