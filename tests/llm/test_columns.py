"""Operators and stages leave columns alone, whatever their names, and take ids of any type."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from biblioflux.llm import bpe, decontaminate, divergence, language_id, licenses, line_templates, minhash, sharding, suffix_merge, weak_labels

OWN = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("i1", "one two three four five six seven eight nine")], "item_id string, text string")


def kept(df, but=()):
    """Rows in some order: doc_id, and whether each further column still holds the row's own value."""
    names = [c for c in df.columns if c not in OWN and c not in but]
    rows = [r.asDict() for r in df.collect()]
    for r in rows:
        for c in names:
            assert r[c] == (r["doc_id"] or "?") + ":" + c
    return sorted((r["doc_id"] or "") for r in rows)


@pytest.mark.parametrize(
    "apply, results",
    [
        (bpe.bpe_round_trip, ["n_tokens", "token_ids", "round_trip"]),
        (lambda d: bpe.bpe_decode(bpe.bpe_encode(d)), ["n_tokens", "token_ids", "decoded"]),
        (divergence.divergence, ["char_js", "word_js", "n_words", "flagged"]),
        (lambda d: sharding.interleave(d, 5), ["shard", "position"]),
        (line_templates.drop_recurring_lines, ["lines_dropped"]),
        (weak_labels.classify, ["label", "quality", "keep"]),
        (language_id.identify, ["predicted", "margin", "rejected"]),
    ],
)
def test_operators_that_keep_rows(clashing, apply, results):
    out = apply(clashing)
    assert sorted(out.columns) == sorted(clashing.columns if set(results) <= set(clashing.columns) else [*clashing.columns, *results])
    assert kept(out, results) == kept(clashing)


def test_stages(spark, clashing, benchmark, tmp_path):
    path = str(tmp_path)
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    docs, seen = clashing, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, path)
        assert out.columns == clashing.columns
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen.append(kept(docs))
    every = [f"d{i:02}" for i in range(18)]
    assert seen[0] == seen[1] == [*every, "d90", "d91", "d91", "d92"]
    assert seen[2] == seen[3] == [*every, "d92"]
    last = corpus_pipeline.STAGES[4][1](spark, docs, path)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"] and last.where("round_trip and n_tokens > 0").count() == 19
    assert corpus_pipeline.tokenize(spark, docs.drop("lang", "source"), path).columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]


def test_operators_that_name_documents(clashing, benchmark):
    assert {(r.doc_id, r.group_id, r.group_size) for r in minhash.near_groups(clashing).collect()} == {("d02", "d02", 2), ("d90", "d02", 2), ("d01", "d01", 2), ("d91", "d01", 2)}
    assert {(r.doc_id, r.first_doc_id) for r in suffix_merge.repeated_passages(clashing).collect()} == {("d02", "d02"), ("d90", "d02"), ("d01", "d01"), ("d91", "d01")}
    held = clashing.withColumn("text", F.when(F.col("doc_id") == "d05", F.lit("so ONE two, three four five six seven eight! All rights reserved")).otherwise(F.col("text")))
    assert [tuple(r) for r in decontaminate.contaminated(held, benchmark).collect()] == [("d05", "i1", 1)]
    assert [tuple(r) for r in licenses.scan(held).collect()] == [("d05", "all-rights-reserved", 1.0)]
