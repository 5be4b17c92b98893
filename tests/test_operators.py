"""Operators on small inputs, with nulls, ties, empty sides and cycles."""

import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblioflux.config import Settings
from biblioflux.functions import identifiers, people, text
from biblioflux.operators import dedup, features, hierarchy, learning, pairs, profile, ranking
from biblioflux.operators.order import numbered
from biblioflux.sources import bibliography, publications, tables
from biblioflux.streaming import arrivals


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_pairs_are_m_times_n(spark):
    bib = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("r", "d")], "pub_id string, bib_key string")
    cand = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "3"), ("s", "4")], "pub_id string, candidate_id string")
    p = pairs.make_pairs(bib, cand)
    assert p.count() == 5
    s = pairs.pair_statistics(p).first()
    assert (s.publications, s.pairs, s.avg_m, s.avg_n) == (2, 5, 1.5, 1.5)


def feature_row(spark, b, c):
    def side(d, prefix):
        schema = "title string, authors array<string>, year int, venue string, abstract string"
        df = spark.createDataFrame([tuple(d.get(k) for k in ("title", "authors", "year", "venue", "abstract"))], schema)
        return features.prepare(df, prefix, *[F.col(x) for x in ("title", "authors", "year", "venue", "abstract")]).drop("title", "authors", "year", "venue", "abstract")

    return features.extract(side(b, "b").crossJoin(side(c, "c"))).select(*features.TEXT_FEATURES).first().asDict()


def test_features_of_one_work(spark):
    t = "Machine Learning for Natural Language Processing"
    f = feature_row(spark, dict(title=t, authors=["Smith, John", "Doe, Jane"], year=2020, abstract="We present a novel approach to NLP using ML."), dict(title="Machine Learning for NLP", authors=["John Smith", "Jane Doe"], year=2020, abstract="A novel machine learning approach for NLP tasks."))
    want = dict(title_jaccard=3 / 7, title_levenshtein=0.67, title_token_sort=0.67, title_token_set=0.91, title_exact_match=0, author_overlap_ratio=1, num_common_authors=2, first_author_match=1, last_author_match=1, author_initials_match=1, year_diff=0, year_exact_match=1, year_within_1=1, both_years_present=1, abstract_jaccard=4 / 13, venue_similarity=0, text_word_overlap=0.4375, bigram_similarity=0.15, title_length_ratio=2 / 3)
    assert f == pytest.approx(want)


def test_features_of_nothing(spark):
    f = feature_row(spark, {}, {})
    assert f.pop("year_diff") == -1 and set(f.values()) == {0}


def test_auto_label(spark):
    schema = "t1 string, t2 string, y1 string, y2 string, w1 string, w2 string"
    data = [("The mythos of models", "the {mythos} of models", None, None, None, None), ("Short one", "Short one", None, None, None, None), ("A great paper title", "A great paper titles", "2018", "2019", None, None), ("A great paper title", "Wholly other words", "2018", "2018", "X", "X"), (None, "x", None, None, None, None)]
    df = spark.createDataFrame(data, schema).select(pairs.auto_label(*[F.col(c) for c in ("t1", "t2", "y1", "y2", "w1", "w2")]).alias("l"))
    assert [r.l for r in df.collect()] == [1, None, 1, None, None]


def test_labels(spark):
    p = spark.createDataFrame([("p", "k", "1", 0), ("p", "k", "2", 1), ("p", "j", "1", 0), ("p", "i", "1", 0)], "pub_id string, bib_key string, candidate_id string, cand_ord int")
    manual = spark.createDataFrame([("p", "k", "2")], "pub_id string, bib_key string, candidate_id string")
    auto = spark.createDataFrame([("p", "k", "1"), ("p", "j", "1")], manual.schema)
    assert rows(pairs.merge_labels(p, manual, auto), "bib_key", "candidate_id", "label", "origin") == [("i", "1", 0, "none"), ("j", "1", 1, "auto"), ("k", "1", 0, "manual"), ("k", "2", 1, "manual")]
    assert rows(pairs.ground_truth(manual, auto)) == [("p", "j", "1"), ("p", "k", "2")]
    assert rows(pairs.add_manual_label(manual, spark.createDataFrame([("p", "k", "9")], manual.schema))) == [("p", "k", "9")]
    assert pairs.label_statistics(pairs.merge_labels(p, manual, auto)).first()["auto_percent"] is None  # no publication without manual labels


def test_splits(spark):
    pubs = spark.createDataFrame([(f"p{i}",) for i in range(10) for _ in range(10)], "pub_id string")
    counts = dict(pairs.split_publications(pubs).groupBy("split").count().collect())
    assert counts == {"train": 7, "valid": 1, "test": 2}


def test_balance(spark):
    p = spark.createDataFrame([("p", str(i), str(i), int(i < 3)) for i in range(20)], "pub_id string, bib_key string, candidate_id string, label int")
    assert dict(pairs.balance(p, 2.0).groupBy("label").count().collect()) == {1: 3, 0: 6}
    assert dict(pairs.balance(p, 2.0, over=True).groupBy("label").count().collect()) == {1: 6, 0: 17}


def test_metrics(spark):
    pred = spark.createDataFrame([("p", "r1", ["a", "b"]), ("p", "r2", ["x", "c"]), ("p", "r4", ["q"])], "pub_id string, bib_key string, candidates array<string>")
    truth = spark.createDataFrame([("p", "r1", "a"), ("p", "r2", "c"), ("p", "r3", "m"), ("p", "r4", "no")], "pub_id string, bib_key string, candidate_id string")
    m = ranking.metrics(ranking.ranks(truth, pred)).first()
    assert (m.mrr, m.hit_at_1, m.hit_at_3, m.hit_at_5, m.avg_rank) == (0.375, 0.25, 0.5, 0.5, 1.5 + 0.25 - 0.25)
    none = ranking.metrics(ranking.ranks(truth.limit(0), pred)).first()
    assert none.mrr == 0 and none.queries == 0
    assert [r.bib_key for r in ranking.report(ranking.ranks(truth, pred)).collect()][:2] == ["r1", "r2"]


def test_top_k_keeps_order_of_ties(spark):
    s = spark.createDataFrame([("p", "k", str(i), i, 1.0) for i in range(8)], "pub_id string, bib_key string, candidate_id string, cand_ord int, score double")
    assert ranking.predictions(ranking.top_k(s)).first()["candidates"] == list("01234")


def test_post_process(spark):
    p = lambda faithful, s, *f: spark.range(1).select(ranking.post_process(F.lit(s), *map(F.lit, f), faithful=faithful)).first()[0]
    assert p(True, 3.0, True, 10, False, True) == 1.0
    assert p(False, -5.0, False, 0, False, True) > p(False, 9.0, True, 0, False, False) > p(False, 9.0, False, 0, True, False)


def test_seed_greedy_groups(spark):
    t = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsu", "abcdefghijklmnopqrvu", None]
    e = spark.createDataFrame([("p", i, x, None) for i, x in enumerate(t)], "pub_id string, ord long, title string, author string")
    assert rows(dedup.seed_groups(e, dedup.duplicate_pairs(e)), "ord", "seed") == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_merge_and_rename(spark):
    schema = "pub_id string, ord long, bib_key string, entry_type string, title string, author string, year string, journal string"
    e = spark.createDataFrame([("p", 0, "smith2020", "misc", "A Great Paper Title", "J. Smith and A. Doe", "2020", None), ("p", 1, "S20", "article", "A great paper title.", "John Smith", None, "X"), ("p", 2, "z", "misc", "Other", None, None, None)], schema)
    m = dedup.merge_groups(e, dedup.seed_groups(e, dedup.duplicate_pairs(e)))
    first = m.where("seed = 0").first()
    assert (first.bib_key, first.title, first.author, first.entry_type, first.journal, first.year) == ("smith2020", "A great paper title.", "J. Smith and A. Doe and John Smith", "article", "X", "2020")
    r = dedup.rename_map(m)
    assert rows(r) == [("p", "S20", "smith2020")]
    texts = spark.createDataFrame([("p", "a \\citealp[x]{S20, z} b"), ("q", "\\cite{S20}")], "pub_id string, text string")
    assert rows(dedup.rename_citations(texts, r), "renamed_text") == [("\\cite{S20}",), ("a \\citealp[x]{smith2020,z} b",)]


def test_duplicate_elements(spark):
    e = spark.createDataFrame([("p", f"e{i}", i, t) for i, t in enumerate(["Hello  World.", "hello world.", "Other", "Figure", "Figure"])], "pub_id string, element_id string, ord int, raw_text string")
    assert rows(dedup.duplicate_elements(e), "element_id", "canonical_id") == [("e0", "e0"), ("e1", "e0"), ("e2", "e2"), ("e3", "e3"), ("e4", "e4")]


def test_chains_end_at_cycles(spark):
    e = spark.createDataFrame([("p", "c", "b"), ("p", "b", "a"), ("p", "x", "y"), ("p", "y", "x")], "pub_id string, child_id string, parent_id string")
    assert rows(hierarchy.chains(e, ["pub_id"]), "node", "chain", "depth") == [("b", ["a"], 1), ("c", ["b", "a"], 2), ("x", ["y"], 1), ("y", ["x"], 1)]


def test_citation_features(spark):
    src = spark.createDataFrame([("p", 1, "\\begin{document}\\section{Introduction} We cite \\cite{a, b} here. \\subsection{Method notes} Again \\citet{a} now.\\begin{figure}\\caption{Cap}\\end{figure}\\end{document}")], "pub_id string, version int, text string")
    elements = hierarchy.parse(src)
    got = {r.bib_key: r for r in hierarchy.citation_features(elements).collect()}
    a, b = got["a"], got["b"]
    assert (a.citation_count, a.cited_in_intro, a.cited_in_methods, a.near_figure, a.co_citation_count) == (2, 1, 1, 1, 1)
    assert (a.min_citation_depth, a.max_citation_depth, a.first_citation_depth) == (2, 3, 2)
    assert (b.citation_count, b.cited_in_methods, b.has_co_citations) == (1, 0, 1)
    good, orphans = hierarchy.consistency(elements, hierarchy.edges(elements))
    assert good.count() == elements.count() - 1 and orphans.isEmpty()
    assert hierarchy.citation_contexts(elements).count() == 3
    out = json.loads(tables.hierarchy_json(elements, hierarchy.edges(elements)).first()["json"])
    assert set(out["hierarchy"]["1"]) <= set(out["elements"]) and "We cite[a, b] here." in out["elements"].values()


@pytest.fixture
def tree(tmp_path):
    files = {
        "2101.00001/v1/main.tex": "\\documentclass{article}\\begin{document}\\input{sections/intro}\\include{sections/methods} % \\input{gone}\n\\bibliography{refs}\\end{document}",
        "2101.00001/v1/sections/intro.tex": "\\section{Introduction} Known from \\cite{k1}. \\input{sections/deep}",
        "2101.00001/v1/sections/deep.tex": "Deep text here. \\input{main}",
        "2101.00001/v1/sections/methods.tex": "\\section{Methods} We do things.",
        "2101.00001/v1/unused.tex": "Nothing.",
        "2101.00001/v1/refs.bib": "@article{k1, title={One}, year={2018}}\n@misc{k2, title={Two}}",
        "2101.00001/v1/main.bbl": "\\bibitem{k1} A. Smith. Better title of it. Journal, 2019.",
        "2101.00001/references.json": json.dumps({"2001-1": {"paper_title": "One", "authors": ["A"], "submission_date": "2018-01-01"}, "2001-2": None}),
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode("latin-1") if "unused" in name else content.encode())
    return str(tmp_path)


def test_publications(spark, tree):
    files = publications.scan(spark, tree).cache()
    assert rows(publications.main_files(files)) == [("2101.00001", 1, "main.tex")]
    used = [r.path for r in publications.included_files(files).orderBy("trail").collect()]
    assert used == ["main.tex", "sections/intro.tex", "sections/deep.tex", "sections/methods.tex"]
    assert rows(publications.ignored_files(files), "path") == [("unused.tex",)]
    text = publications.combined_sources(files).first()["text"]
    assert text.index("Known from") < text.index("Deep text") < text.index("We do things") < text.index("\\end{document}")
    entries = {r.bib_key: r for r in bibliography.entries(files).collect()}
    assert entries["k1"].title == "Better title of it" and entries["k2"].title == "Two"
    assert rows(tables.candidates(files), "candidate_id", "title") == [("2001-1", "One")]
    elements = hierarchy.parse(publications.combined_sources(files))
    assert [r.raw_text for r in elements.where("element_type = 'section'").orderBy("ord").collect()] == ["Introduction", "Methods"]
    files.unpersist()


def test_includes_are_found_from_the_including_file(spark, tmp_path):
    files = {
        "p/v1/main.tex": "\\documentclass{article}\\begin{document}\\input{sec/a} \\input{late} \\import{ch/}{c}\\include{sec/../late}\\end{document}",
        "p/v1/sec/a.tex": "AAA \\input{b} \\input{./deep/d} AAA-END",
        "p/v1/sec/b.tex": "BBB \\input{a} \\input{late}",
        "p/v1/b.tex": "wrong b",
        "p/v1/sec/deep/d.tex": "DDD \\input{../b} \\input{nowhere}",
        "p/v1/late.tex": "LATE",
        "p/v1/ch/c.tex": "CCC",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    scanned = publications.scan(spark, str(tmp_path)).cache()
    used = publications.included_files(scanned)
    assert rows(used, "path", "parent", "depth") == sorted([("main.tex", None, 0), ("sec/a.tex", "main.tex", 1), ("sec/b.tex", "sec/a.tex", 2), ("late.tex", "sec/b.tex", 3), ("sec/deep/d.tex", "sec/a.tex", 2), ("ch/c.tex", "main.tex", 1)])
    got = publications.combined_sources(scanned).first()
    assert got.n_files == 6 and " ".join(got.text.split()) == "\\documentclass{article}\\begin{document}AAA BBB LATE DDD AAA-END CCC\\end{document}"
    assert rows(publications.ignored_files(scanned), "path") == [("b.tex",)]
    assert publications.included_files(scanned, 1).count() == 4
    scanned.unpersist()


def test_stream(spark, tree, tmp_path_factory):
    counts = arrivals.citation_counts(arrivals.stream_sources(spark, tree))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("cites").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("cites"), "bib_key", "n") == [("k1", 1)]


def test_labels_json(spark):
    df = spark.createDataFrame([('{"p": {"k": "1", "j": null}}',), (None,)], "value string")
    assert rows(tables.labels(df)) == [("p", "k", "1")]


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.0, ""), (3.0, 6.0, None)], "x double, y double, s string")
    assert profile.correlations(df, ["x", "y"], 0.5).first()["r"] == pytest.approx(1.0)
    assert rows(profile.completeness(df, ["s"]), "field", "present") == [("s", 1)]
    assert rows(profile.histogram(df, "x", [0, 2, 3])) == [(0, 1), (1, 2)]


def test_learning(spark):
    data = [("p", f"k{i}", str(j), float(i == j), float((i * 7 + j) % 3), int(i == j)) for i in range(6) for j in range(6)]
    p = spark.createDataFrame(data, "pub_id string, bib_key string, candidate_id string, f double, g double, label int")
    for model in (learning.train_ranker(p, ["f", "g"], 20), learning.train_classifier(p, ["f", "g"], 3)):
        best = ranking.top_k(learning.predict(model, p), 1, "candidate_id")
        assert best.where("label = 0").isEmpty()
        assert learning.importances(model, ["f", "g"])[0][0] == "f"
    assert learning.train_ranker(p.where("label = 0"), ["f", "g"]) is None


def test_models_and_reports_are_stored(spark, tmp_path):
    data = [("p", f"k{i}", str(j), float(i == j) if j else None, "ab"[j % 2], int(i == j)) for i in range(1, 6) for j in range(6)]
    p = spark.createDataFrame(data, "pub_id string, bib_key string, candidate_id string, f double, g string, label int")
    model = learning.train_classifier(p, ["f", "g"], 3)
    learning.save(model, f"{tmp_path}/m", ["f", "g"], {"rate": 0.1}, learning.history(model, learning.balanced_weights(learning.filled(p, ["f", "g"]))))
    again, about = learning.load(f"{tmp_path}/m")
    scores = lambda m: rows(learning.predict(m, p), "bib_key", "candidate_id", "score")
    assert scores(again) == scores(model) and about["columns"] == ["f", "g"] and len(about["training_history"]) == 3
    assert learning.predict(model, p).columns == [*p.columns, "score"]
    learning.importance_table(model, ["f", "g"], spark).coalesce(1).write.csv(f"{tmp_path}/i", header=True)
    assert spark.read.csv(f"{tmp_path}/i", header=True).first().feature == "f"
    ranker = learning.train_ranker(p, ["f"], 10)
    assert learning.history(ranker)[-1] <= learning.history(ranker)[0]
    best, mrr = learning.tune(p, p, ["f"], rates=(0.1,), depths=(2, 3), iterations=(2,))
    assert mrr == 1.0 and best["depth"] == 2
    labelled = p.withColumn("origin", F.when(F.col("bib_key") < "k3", "manual").otherwise("auto"))
    split = spark.createDataFrame([("p", "test"), ("q", "train")], "pub_id string, split string")
    metrics = spark.createDataFrame([(0.5,)], "mrr double")
    report = json.loads(tables.report_json(pairs.compliance(labelled), split, labelled, metrics, learning.importance_table(model, ["f", "g"], spark), {"model_type": "classifier"}, {"title": ["f"], "other": ["g"]}).first().value)
    assert [r["status"] for r in report["compliance"]] == ["FAIL"] * 3 and report["data"]["positive"] == 5 and report["data"]["negatives_per_positive"] == 5.0
    assert report["test_metrics"] == {"mrr": 0.5} and report["top_features"][0]["feature"] == "f" and report["feature_groups"] == {"title": 1, "other": 1} and report["model"] == {"model_type": "classifier"}
    assert [(r["split"], r["publications"], r["pairs"]) for r in report["splits"]] == [("test", 1, 30), ("train", 1, 0)]
    labels = spark.createDataFrame([("p", "k1", "1"), ("p", "k0", "2"), ("q", "k", "3")], "pub_id string, bib_key string, candidate_id string")
    tables.write_labels(labels, f"{tmp_path}/labels")
    assert rows(tables.labels(spark.read.text(f"{tmp_path}/labels"))) == rows(labels)


def test_row_numbers_and_splits(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got, n = numbered(df, "n", "x")
    assert n == 1000 and got.where("n <> x + 1").isEmpty()
    assert numbered(df.limit(0), "n", "x")[1] == 0
    keys = df.select(F.col("x").cast("string").alias("pub_id"), F.lit("k").alias("bib_key"))
    assert rows(pairs.split_queries(keys).groupBy("split").count()) == [("test", 200), ("train", 800)]
    manual, auto = (spark.createDataFrame([(str(i),) for i in r], "pub_id string") for r in (range(9), range(8, 30)))
    assert rows(pairs.split_by_labels(keys, manual, auto).groupBy("split").count()) == [("test", 5), ("train", 22), ("valid", 3)]  # one of the first half has automatic labels too
    assert rows(pairs.split_by_labels(keys, manual.limit(0), auto).groupBy("split").count()) == [("test", 150), ("train", 700), ("valid", 150)]
    labelled = keys.withColumns({"candidate_id": F.lit("c"), "cand_ord": F.lit(1), "label": F.lit(1)})
    none = labelled.where("false").select("pub_id", "bib_key")
    assert pairs.auto_label_batch(labelled, none).count() == 1000 and rows(pairs.auto_label_batch(labelled, none, 0.002), "pub_id") == [("0",), ("1",)]


def test_scan_of_labelling_candidates(spark):
    bib = spark.createDataFrame([("a", f"k{i}", f"t{i}") for i in range(25)] + [("b", "k", "t")], "pub_id string, bib_key string, bib_title string")
    cand = spark.createDataFrame([(p, str(i), f"c{i}") for p in "ab" for i in range(30)] + [("d", "1", "c")], "pub_id string, candidate_id string, cand_title string")
    pubs = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", False, True), ("d", True, False), ("e", True, True), ("f", True, True)], "pub_id string, has_candidates boolean, has_entries boolean")
    cand = cand.unionByName(spark.createDataFrame([("f", "1", "c")], cand.schema))
    got = pairs.labelling_candidates(bib, cand, 20, pubs)
    assert dict(rows(got, "pub_id", "status")) == {"a": "eligible", "b": "too few", "c": "no candidate file", "d": "no entry file", "e": "no candidates", "f": "no entries"}
    assert tuple(pairs.labelling_counts(got).first()) == (1, 1, 1, 1, 1, 1, 6)
    assert rows(pairs.top_publications(got), "pub_id") == [("a",)] and pairs.one_publication(bib, cand, "a", 3).count() == 6


def test_scores_of_raw_strings(spark):
    df = spark.createDataFrame([("Ann Bee", "ann b", "2018", "2019", "Deep graph networks for graph data", "graph networks of the data", "ICML", "icml"), ("", "", "x", None, "the of", "the of", None, None)], "a string, b string, y string, z string, t string, u string, v string, w string")
    c = F.col
    made = features.author_percents(c("a"), c("b")) | features.year_gaps(c("y"), c("z")) | features.text_percents(c("t"), c("u"), c("v"), c("w"))
    first, second = df.select(*[e.alias(n) for n, e in made.items()]).collect()
    assert (first.author_fuzz_ratio, first.author_overlap, first.author_initials_match) == (83, 33.33, 100) and (first.year_match, first.year_diff, first.year_close) == (0, 1, 1)
    x, y = {"deep": 1, "graph": 2, "networks": 1, "data": 1}, {"graph": 1, "networks": 1, "data": 1}
    weigh = lambda v: {w: n * (1 if w in x and w in y else 1 + math.log(1.5)) for w, n in v.items()}
    p, q = weigh(x), weigh(y)
    cosine = sum(p[w] * q.get(w, 0) for w in p) / math.sqrt(sum(n * n for n in p.values()) * sum(n * n for n in q.values()))
    assert first.combined_tfidf == pytest.approx(100 * cosine, abs=0.01) and first.venue_fuzz == 100 and first.ref_text_length == 6.8
    assert (second.author_overlap, second.year_diff, second.combined_tfidf, second.ref_text_length) == (0, 100, 0, 1.2)
    place = df.limit(1).select(*[e.alias(n) for n, e in features.place_percents(F.lit("Method"), F.lit(3), F.lit(1.5), F.lit(250), F.lit(40)).items()]).first()
    assert tuple(place) == (1, 60.0, 100.0, 25.0, 100.0)
    terms = df.select(features.tfidf_terms(c("t")).alias("t")).first().t
    assert terms == ["deep", "graph", "networks", "graph", "data", "deep graph", "graph networks", "networks graph", "graph data"]
    cut = spark.range(1).select(features.tfidf_cosine(F.array(*map(F.lit, "bbac")), F.array(*map(F.lit, "bad")), 2).alias("s")).first().s
    assert cut == pytest.approx((2 * 1 + 1) / math.sqrt(5 * 2))  # only b and a are left


def test_ids_folding_and_keys_without_an_index(spark):
    df = spark.createDataFrame([("arXiv:1606.03490v2", "Ünïcode ﬁ  X"), ("see 1606-03490", "plain  Text"), ("none", None)], "a string, t string")
    got = df.select(identifiers.standard_arxiv_id(F.col("a")).alias("a"), text.fold(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("1606-03490", "unicode fi x"), ("1606-03490", "plain text"), ("none", "")]
    e = spark.createDataFrame([("p", "e1", "as \\cite{a1, b.2} and \\citep[x]{c}"), ("p", "e2", "\\cite{a11}")], "pub_id string, element_id string, raw_text string")
    keys = spark.createDataFrame([("p", k) for k in ("a1", "b.2", "zz")], "pub_id string, bib_key string")
    assert rows(hierarchy.scan_for_keys(e, keys)) == [("p", "a1", "e1"), ("p", "b.2", "e1")]
    people_ = spark.createDataFrame([(["Dr. Ann Bee", "Cy Dee"], ["bee, A."])], "a array<string>, b array<string>")
    assert people_.select(people.listed_overlap(F.col("a"), F.col("b"))).first()[0] == 1.0
    assert df.select(text.text_jaccard(F.lit("A graph, net x"), F.lit("graph of net"))).first()[0] == pytest.approx(2 / 3)


def test_settings():
    assert Settings().checked().faults() == [] and Settings(top_k=3, model_type="x").faults() == ["five candidates are ranked", "the model is a classifier or a ranker"]
    with pytest.raises(ValueError, match="five"):
        Settings(top_k=4).checked()
    assert Settings(root="out/").path("p", "predictions") == "out/p/pred.json" and Settings().labelling()["min_manual_labels"] == 20 and "seed" in Settings().view()


def test_a_failing_publication_does_not_stop_the_others(spark, monkeypatch):
    def fragile(publication, body):
        if publication == "bad":
            raise ValueError("broken")
        return scanned(publication, body)

    scanned = hierarchy._elements
    batches = lambda: iter([pa.RecordBatch.from_pydict({"pub_id": ["good", "bad", "other"], "version": pa.array([1, 1, 2], pa.int32()), "body": ["One sentence here.", "x", "\\section{A} Two of them here."]})])
    monkeypatch.setattr(hierarchy, "_elements", fragile)
    out = [r for b in hierarchy._scan(batches()) for r in b.to_pylist()]
    assert [r["raw_text"] for r in out if r["element_type"] == hierarchy.FAILED] == ["ValueError: broken"] and {r["pub_id"] for r in out} == {"good", "bad", "other"}


def test_duplicate_groups_that_do_not_settle_are_an_error(spark, monkeypatch):
    nodes = spark.createDataFrame([("p", i) for i in range(8)], "pub_id string, ord long")
    chain = spark.createDataFrame([("p", i, i + 1) for i in range(7)], "pub_id string, a long, b long")
    assert rows(dedup.seed_groups(nodes, chain), "ord", "seed") == [(i, i - i % 2) for i in range(8)]
    monkeypatch.setattr(dedup, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="settle"):
        dedup.seed_groups(nodes, chain)


def test_entry_without_the_llm_package():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
