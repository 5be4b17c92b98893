"""What keeps queries linear in their input: work per distinct value or per row instead of per pair, and no whole-table rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblioflux.functions import similarity
from biblioflux.operators import pairs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_score_a_distinct_pair_once():
    calls, seen = [], {}

    def f(a, b):
        calls.append((a, b))
        return similarity.percent(a, b)

    x, y = pa.array(["ab", "ab", None, "ab", "ba"]), pa.array(["abc", "abc", "x", None, "ab"])
    want = [similarity.percent(a or "", b or "") for a, b in zip(x.to_pylist(), y.to_pylist())]
    assert similarity.each_distinct(f, x, y, seen).tolist() == want and similarity.each_distinct(f, x, y, seen).tolist() == want
    assert sorted(calls) == sorted({(a or "", b or "") for a, b in zip(x.to_pylist(), y.to_pylist())})
    assert similarity.each_distinct(f, pa.array([], pa.string()), pa.array([], pa.string()), seen).tolist() == []


def test_set_percent_is_the_best_of_three_ratios(spark):
    texts = [("a b c", "b c d"), ("a b", "a b"), ("", "a"), ("x y", "p q"), ("b a a", "a")]
    for a, b in texts:
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        ends = [" ".join(filter(None, [both, *sorted(s)])) for s in (x - y, y - x)]
        want = max(similarity.percent(*p) for p in ((both, ends[0]), (both, ends[1]), ends)) if x and y else 0
        assert similarity.set_percent(a, b) == want
    df = spark.createDataFrame(texts, "a string, b string")
    got = df.select(similarity.token_set(similarity.fuzz_words(F.col("a")), similarity.fuzz_words(F.col("b"))).alias("s"))
    assert [r.s for r in got.collect()] == [similarity.set_percent(a, b) / 100 for a, b in texts]


def test_suggested_labels_take_words_of_the_sides(spark):
    e = spark.createDataFrame([("p", "k1", 1, "Large Ring, tin", "Brand 1"), ("p", "k2", 2, "ring large tin", "brand 1"), ("p", "k3", 3, "hot bolt", "Other")], "pub_id string, bib_key string, ord int, title string, author string")
    a = e.select("pub_id", "bib_key", F.col("title").alias("bib_title"), F.col("author").alias("bib_author"))
    b = e.select("pub_id", F.col("bib_key").alias("candidate_id"), F.col("ord").alias("cand_ord"), F.col("title").alias("cand_title"), F.col("author").alias("cand_author"))
    plain = pairs.suggest_labels(pairs.make_pairs(a, b))
    ahead = pairs.suggest_labels(pairs.make_small_pairs(pairs.with_words(a, "bib"), pairs.with_words(b, "cand")))
    columns = ["bib_key", "candidate_id", "rank", "score"]
    assert sorted(map(tuple, plain.select(*columns).collect())) == sorted(map(tuple, ahead.select(*columns).collect()))
    first = ahead.where("bib_key = 'k1' and rank = 2").withColumn("ok", pairs.is_accepted()).first()
    assert first.candidate_id == "k2" and first.score == pytest.approx(100) and not first.ok


def test_suggest_labels_scores_its_pairs_once(spark):
    from biblioflux.plans import queries

    assert plan(queries.suggest_labels(spark, "/root/testdata/sf0.001")).count("Join") == 1


def test_terms_of_sides_give_the_same_text_scores(spark):
    from biblioflux.operators import features

    texts = [("Large ring TIN", "large ring brass"), ("a of", "the"), (None, "bolt"), ("bolt bolt nut", "nut bolt")]
    df = spark.createDataFrame(texts, "a string, b string")
    none = F.lit(None).cast("string")
    ahead = df.withColumns({f"{c}_terms": features.single_terms(F.col(c)) for c in "ab"})
    score = lambda d, *terms: [r.s for r in d.select(features.text_percents(F.col("a"), F.col("b"), none, none, *terms)["combined_tfidf"].alias("s")).collect()]
    got = score(ahead, (F.col("a_terms"), F.col("b_terms")))
    w = (1 + 0.4054651081081644) ** 2
    assert got == score(df) == [round(100 * 2 / (2 + w), 2), 0, 0, round(100 * 3 / 10**0.5, 2)]


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_pairs_that_meet_by_term_have_the_cosine_of_their_texts(spark, monkeypatch, most):
    from biblioflux.operators import features

    monkeypatch.setattr(features, "BROADCAST_ROWS", most)
    bib = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c"]), (3, [])], "item_id int, a array<string>")
    cand = spark.createDataFrame([(7, ["b", "a", "d", "d"]), (8, ["b", "b", "a"]), (9, ["e"]), (10, None)], "doc_id int, b array<string>")
    met = features.tfidf_cosines(bib, cand)
    assert "CartesianProduct" not in (text := met._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in text
    want = bib.crossJoin(cand).where(F.arrays_overlap("a", "b")).select("item_id", "doc_id", features.tfidf_cosine(F.col("a"), F.col("b")).alias("cosine"))
    found = {(r.item_id, r.doc_id): r.cosine for r in met.collect()}
    assert found == pytest.approx({(r.item_id, r.doc_id): r.cosine for r in want.collect()}) and set(found) == {(1, 7), (1, 8)}


def test_a_large_bib_file_keeps_entries_that_nobody_cites(spark, monkeypatch):
    from biblioflux.sources import bibliography

    monkeypatch.setattr(bibliography, "ROWS", 3)
    text = "\n".join(f"@misc{{k{i}, title = {{Title {i}}}, note = {{{'x' * 40000}}}}}" for i in range(60))
    files = spark.createDataFrame([("p", 1, "refs.bib", text, len(text)), ("p", 1, "main.tex", "\\cite{k1}", 9)], "pub_id string, version int, name string, text string, size int")
    got = bibliography.entries(files).select("bib_key", "title").collect()
    assert len(text) > 2 << 20 and {tuple(r) for r in got} == {(f"k{i}", f"Title {i}") for i in range(60)} and len(got) == 60


def test_bibliographies_are_files_of_their_publications(spark):
    """One text of the whole table would be one row of one task."""
    from biblioflux.plans import queries

    for q in (queries.bibtex_round_trip, queries.bibitem_parse):
        df = q(spark, "/root/testdata/sf0.001")
        assert "Aggregate [pub_id" in plan(df) and df.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_combined_sources_of_a_version_that_is_cut_off(spark, tmp_path):
    import duckdb

    from biblioflux.plans import oracle, queries

    spark.range(12).select(F.col("id").alias("doc_id")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(oracle.SQL["combined_sources"]).fetchall()
    assert sorted(map(tuple, queries.combined_sources(spark, str(tmp_path)).collect())) == sorted(want) and ("b1", None, 1) in want


def test_blocks_give_the_best_cosines_of_all_pairs(spark, monkeypatch):
    import numpy as np

    from biblioflux.operators import ranking, vectors

    for name, value in (("ENTRIES", 4), ("CANDIDATES", 8), ("TILE", (3, 4))):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(7)
    e = rng.normal(size=(60, 5)).astype(np.float32).astype(float)
    e[20:40] = e[20]  # copies tie
    e[43] = 0  # no cosine
    rows = [(i, e[i].tolist() if i != 47 else None, i % 3) for i in range(60)]
    v = spark.createDataFrame(rows, "id int, e array<double>, l int")
    a, b = v.where("id % 10 = 0").select(F.col("id").alias("bib_key"), "e", F.col("l").alias("la")), v.where("id % 2 = 1").select(F.col("id").alias("candidate_id"), "e", F.col("l").alias("lb"))
    pub = F.lit("p").alias("pub_id")
    met = vectors.cosine_candidates(a, b, 3).select(pub, "*")
    got = ranking.top_k(met, 3, "candidate_id").select("bib_key", "rank", "candidate_id", "score").collect()
    want = []
    for i in range(0, 60, 10):
        score = {j: None if j in (43, 47) else round(float(e[i] @ e[j] / (np.linalg.norm(e[i]) * np.linalg.norm(e[j]))), 6) for j in range(1, 60, 2)}
        best = sorted(score, key=lambda j: (score[j] is None, -(score[j] or 0), j))[:3]
        want += [(i, r, j, score[j]) for r, j in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == want and met.count() < 6 * 30
    near = vectors.nearest_key(a.select("bib_key", F.col("la").alias("l")), b.select("candidate_id", F.col("lb").alias("l"))).collect()
    assert {tuple(r) for r in near} == {(i, min((j for j in range(1, 60, 2) if j % 3 == i % 3), key=lambda j: (abs(j - i), j))) for i in range(0, 60, 10)}
    few = vectors.cosine_candidates(a.limit(1), b.where("candidate_id in (1, 43)"), 3)
    assert sorted((r.candidate_id, r.score is None) for r in few.collect()) == [(1, False), (43, True)]


def test_embedding_ranks_make_no_join_of_all_pairs(spark):
    from biblioflux.plans import queries

    scored, truth = queries._embedding_ranks(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(scored) and "Join" not in plan(truth)


def test_names_are_parsed_before_people_are_paired(spark):
    from biblioflux.plans import queries

    for q in (queries.author_features, queries.loose_author_overlap):
        pairs_side = plan(q(spark, "/root/testdata/sf0.001")).split("Join", 1)[0]
        assert "split(" not in pairs_side and "Regexp" not in pairs_side.title()


def test_title_statistics_of_counts_are_those_of_all_pairs(spark):
    from biblioflux.functions import text

    bib = spark.createDataFrame([("p", "a b", "a b"), ("p", "a b", "a b"), ("p", "", ""), ("q", "x", "x"), ("r", "y", "y")], "pub_id string, raw string, norm string")
    cand = spark.createDataFrame([("p", "A  b", "a b"), ("p", None, ""), ("p", "c d e", "c d e"), ("q", "z z z", "z z z"), ("s", "y", "y")], "pub_id string, raw string, norm string")
    both = bib.toDF("pub_id", "x", "m").join(cand.toDF("pub_id", "y", "n"), "pub_id")
    want = both.groupBy("pub_id").agg(F.round(F.avg(text.length_ratio(F.col("x"), F.col("y"))), 9), F.sum(text.exact_match(F.col("m"), F.col("n"))))
    got = pairs.title_statistics(bib, cand)
    assert sorted((r.pub_id, round(r.ratio, 9), r.exact) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert "Aggregate [pub_id" in plan(got).split("Join")[-1]


def test_only_rows_of_best_pairs_are_prepared(spark):
    from biblioflux.plans import queries

    df = plan(queries.match_features(spark, "/root/testdata/sf0.001"))
    assert "c_fuzz" in df and "c_fuzz" not in df.split("Join", 1)[1] and "b_fuzz" not in df.split("Join", 1)[1]


def test_duplicate_pairs_keep_publications_in_parts(spark):
    from biblioflux.operators import dedup

    e = spark.createDataFrame([("p", 1, "one title of it", "A Lee"), ("p", 2, "one title of it", "A Lee")], "pub_id string, ord int, title string, author string")
    df = dedup.duplicate_pairs(e)
    assert plan(df).count("RepartitionByExpression [pub_id") == 2 and [tuple(r) for r in df.collect()] == [("p", 1, 2)]


def test_plain_text_without_commands_takes_the_short_way(spark):
    from biblioflux.functions import latex

    texts = ["A  plain \t\r\n sentence , with fig.png and a_b/c.PDF.x png.pngb.png end.!", "in \x0b\x07 50% of  \n% gone\nb\\%c", "\\textbf{a \\emph{b \\textit{c}}} d~e", "x[htp]y [h!] {z}", None, "", "é.jpgé.jpg -a.b.svg \x0c", "a.pngb.png/c.eps", "abc" * 50 + ".pdf " + "-" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for strip in (True, False):
        long = latex._tidy(latex._bare(latex.remove_comments(F.col("t")) if strip else F.coalesce("t", F.lit(""))))
        for r in df.select(latex.plain_text(F.col("t"), strip).alias("short"), long.alias("long")).collect():
            assert r.short == r.long
    old = r"(?i)[\p{L}\p{N}_/-]+\.(?:png|jpg|jpeg|pdf|eps|svg)"
    for r in df.select(F.regexp_replace("t", old, "").alias("old"), F.regexp_replace("t", latex._IMAGE, "").alias("new")).collect():
        assert r.old == r.new


def test_exported_texts_are_cleaned_once(spark):
    from biblioflux.sources import tables

    e = spark.createDataFrame([("p", 1, "a", None, "\\textbf{x} y"), ("p", 1, "b", "a", "References"), ("p", 1, "c", "a", "z~1")], "pub_id string, version int, element_id string, parent_id string, raw_text string")
    edges = e.where("parent_id is not null").select("pub_id", "version", F.col("element_id").alias("child_id"), "parent_id")
    out = tables.hierarchy_json(e, edges)
    assert "regexp_replace" not in plan(out) and [r.json for r in out.collect()] == ['{"elements":{"a":"x y","c":"z 1"},"hierarchy":{"1":{"c":"a"}}}']


def test_only_texts_that_are_read_travel_with_citations(spark):
    from biblioflux.operators import hierarchy

    e = spark.createDataFrame([], hierarchy.ELEMENT)
    assert "CASE WHEN" in hierarchy.citation_features(e)._jdf.queryExecution().analyzed().toString()


def test_rules_search_only_texts_that_hold_what_they_need(spark):
    from biblioflux.functions import latex

    df = spark.createDataFrame([("a",), ("az",), ("ay",), (None,)], "t string")
    assert [r.x for r in df.select(latex._sub(F.col("t"), ("a", "b", "z", "y")).alias("x")).collect()] == ["a", "bz", "by", None]
    rich = "\\title{T} \\textbf{a \\emph{b}} \\paragraph{x}\\hspace{1cm}\\par [H]\\hline\\cline{1-2} \\tiny s~\\citep[see]{k, l} \\citeauthor{z} \\ref{r}\\label{l} 5\\% [ht!] [width=3cm] fig/a.PNG \\includegraphics[width=1]{f.eps} \\foo{\\bar{y}} \\\\ \\(m\\) \\begin{math}w\\end{math}"
    r = spark.createDataFrame([(rich,)], "t string").select(latex.plain_text(F.col("t"), False).alias("plain"), latex.clean(F.col("t"), False).alias("clean")).first()
    assert "textbf" not in r.plain and "a b" in r.plain and "[k, l] [z] r 5%" in r.plain and "PNG" not in r.plain and "hline" not in r.plain
    assert "$m$" in r.clean and "$w$" in r.clean and "hspace" not in r.clean and "\\par " not in r.clean and "\\paragraph{x}" in r.clean
