"""The stages on a small corpus, each against what it must do."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline


def test_names():
    names = entry.queries()
    assert {f"op{i}_" for i in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "BPE encoding"]


@pytest.fixture
def folder(spark, tmp_path, words):
    rng = random.Random(20)
    line = "This notice {} stands at the foot of many pages of ours"
    docs = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        text = "\n".join(words(rng, lang, 25) for _ in range(5))
        docs.append([i, text + ("\n" + line.format(i) if i % 4 == 0 else ""), lang, "s"])
    item = words(rng, "en", 20)
    docs += [[100 + i, docs[1][1], "de", "s"] for i in range(7)]  # exact copies
    docs += [[200, " ".join(w for j, w in enumerate(docs[2][1].split()) if j != 50), "fr", "s"], [300, words(rng, "en", 60) + "\n" + words(rng, "en", 60) + " " + item, "en", "s"], [400, None, "en", "s"], [401, "12345 ***", "en", "s"]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, line


def test_stages(spark, folder, tmp_path):
    path, docs, line = folder
    df, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = df.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, path)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id: r for r in df.collect()})
    lang, lines, near, clean, coded = seen
    assert set(lang) == {d[0] for d in docs} - {400, 401}
    assert set(lines) == set(lang) and not any("notice" in r.text for r in lines.values()) and all(len(r.text) == r.n_chars for r in lines.values())
    assert lines[1].text == lines[103].text == docs[1][1]
    assert set(near) == set(lines) - {*range(100, 107), 200}
    assert set(clean) == set(near) - {300}
    assert set(coded) == set(clean) and all(r.round_trip and r.n_tokens == len(r.token_ids) > 0 for r in coded.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(coded)


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
