"""End-to-end plans: parse a folder of publications, match their references, suggest labels.

Each returns DataFrames by name; nothing runs before one of them is written or counted, but for the steps of the
duplicate groups and the fit of a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflux.functions import identifiers
from biblioflux.operators import dedup, features, hierarchy, learning, pairs, ranking
from biblioflux.operators.order import cut_lineage
from biblioflux.sources import bibliography, publications, tables


def parse_publications(spark: SparkSession, root: str, deduplicate: bool = True) -> dict[str, DataFrame]:
    """files, elements, edges, entries, candidates, statistics; with deduplicate also renames, sources with renamed
    citations, and elements and edges on canonical ids.  A publication without LaTeX has entries only."""
    files = publications.scan(spark, root)
    sources = publications.combined_sources(files)
    scanned = hierarchy.parse(sources, failures=True)
    elements = scanned.where(F.col("element_type") != hierarchy.FAILED)
    edges = hierarchy.edges(elements)
    entries = bibliography.entries(files)
    order = Window.partitionBy("pub_id").orderBy("version", "source", "ord", "bib_key")
    entries = entries.withColumn("ord", F.row_number().over(order).cast("long"))
    out = {"files": files, "elements": elements, "edges": edges, "entries": entries, "candidates": tables.candidates(files), "statistics": hierarchy.statistics(elements), "failures": scanned.where(F.col("element_type") == hierarchy.FAILED).select("pub_id", "version", F.col("raw_text").alias("reason"))}
    if not deduplicate:
        return out
    out["references"] = entries
    merged = dedup.merge_groups(entries, dedup.seed_groups(entries, dedup.duplicate_pairs(entries)))
    renames = dedup.rename_map(merged)
    mapping = dedup.duplicate_elements(elements)
    first = elements.join(mapping.where("element_id = canonical_id").select("pub_id", "element_id"), ["pub_id", "element_id"], "left_semi")
    return out | {"entries": merged, "renames": renames, "sources": dedup.rename_citations(sources, renames), "elements": first, "edges": dedup.remap_edges(edges, mapping)}


def parsing_statistics(parsed: dict[str, DataFrame]) -> DataFrame:
    """(pub_id, versions, files_found, elements, references, deduplicated_refs, failed_versions, status) of each publication."""
    n = lambda df, name: df.groupBy("pub_id").agg(F.count(F.lit(1)).alias(name))
    files = parsed["files"].groupBy("pub_id").agg(F.countDistinct(F.when(F.col("name").endswith(".tex"), F.col("version"))).alias("versions"), F.count_if(F.col("name").endswith(".tex")).alias("files_found"))
    out = files
    for name, part in (("elements", parsed["elements"]), ("references", parsed.get("references", parsed["entries"])), ("deduplicated_refs", parsed["entries"]), ("failed_versions", parsed["failures"])):
        out = out.join(n(part, name), "pub_id", "left")
    out = out.na.fill(0)
    status = F.when(F.col("failed_versions") > 0, "failed").when(F.col("versions") == 0, "no sources").otherwise("parsed")
    return out.withColumn("status", status)


def parsing_summary(statistics: DataFrame) -> DataFrame:
    """(value): the statistics of all publications as one JSON object, with totals."""
    fields = ["pub_id", "versions", "files_found", "elements", "references", "deduplicated_refs", "failed_versions", "status"]
    whole = statistics.agg(F.count(F.lit(1)).alias("total_publications"), F.count_if(F.col("status") == "failed").alias("failed"), F.array_sort(F.collect_list(F.struct(*fields))).alias("publications"))
    return whole.select(F.to_json(F.struct("*")).alias("value"))


def match_references(entries: DataFrame, candidates: DataFrame, elements: DataFrame | None = None, manual: DataFrame | None = None, k: int = 5, rounds: int = 100) -> dict[str, DataFrame]:
    """pairs with features, labels and split; predictions, metrics and report over the test split; truth.

    The ranker is trained on the training split; without positives there, the mean of the title and author scores ranks.
    """
    cand = candidates.withColumn("cand_ord", F.col("ord"))
    bib = features.prepare(entries.select("pub_id", "bib_key", "title", "author", "year", F.coalesce("journal", "booktitle").alias("venue"), "abstract"), "b", F.col("title"), F.col("author"), identifiers.year(F.col("year")), F.col("venue"), F.col("abstract"))
    year = identifiers.candidate_year(F.col("year"), F.col("submission_date"))
    cand = features.prepare(cand, "c", F.col("title"), F.col("authors"), year, F.col("venue"), F.col("abstract"))
    bib = bib.select("pub_id", "bib_key", F.col("author").alias("bib_author"), F.col("year").alias("bib_year"), *[c for c in bib.columns if c.startswith("b_")])
    cand = cand.select("pub_id", "candidate_id", "cand_ord", F.concat_ws(", ", "authors").alias("cand_author"), year.cast("string").alias("cand_year"), *[c for c in cand.columns if c.startswith("c_")])
    rows = features.extract(pairs.make_pairs(bib, cand))
    rows = rows.withColumn("label", pairs.auto_label(F.col("b_title"), F.col("c_title"), F.col("bib_year"), F.col("cand_year"), F.col("bib_author"), F.col("cand_author")))
    columns = list(features.TEXT_FEATURES)
    if elements is not None:
        rows = features.attach_hierarchy(rows, hierarchy.citation_features(elements))
        columns += features.HIERARCHY_FEATURES
    if manual is None:
        manual = rows.select("pub_id", "bib_key", "candidate_id").where("false")
    auto = pairs.auto_label_batch(rows, manual)
    labelled = pairs.merge_labels(rows, manual, auto).select("pub_id", "bib_key", "candidate_id", "cand_ord", *columns, "label", "origin")
    labelled = cut_lineage(labelled)  # numbers only; the text work behind them is not done again for the fit and the scores
    labelled = labelled.join(pairs.split_publications(labelled), "pub_id")
    model = learning.train_ranker(labelled.where("split = 'train'"), columns, rounds)
    if model is None:
        scored = labelled.withColumn("score", (F.col("title_token_sort") + F.col("author_overlap_ratio")) / 2)
    else:
        scored = learning.predict(model, labelled)
    truth = pairs.ground_truth(manual, auto)
    predicted = ranking.predictions(ranking.top_k(scored, k))
    test = truth.join(labelled.where("split = 'test'").select("pub_id").distinct(), "pub_id", "left_semi")
    placed = ranking.ranks(test, predicted)
    return {"pairs": labelled, "truth": truth, "predictions": predicted, "metrics": ranking.metrics(placed), "report": ranking.report(placed)}


def suggest(entries: DataFrame, candidates: DataFrame, top_n: int = 3, threshold: float = 85) -> dict[str, DataFrame]:
    """Eligible publications, the best candidates of each entry, and those good enough to accept unseen."""
    bib = entries.select("pub_id", "bib_key", F.coalesce("title", F.lit("")).alias("bib_title"), F.coalesce("author", F.lit("")).alias("bib_author"))
    cand = candidates.select("pub_id", "candidate_id", F.col("ord").alias("cand_ord"), F.coalesce("title", F.lit("")).alias("cand_title"), F.concat_ws(" and ", "authors").alias("cand_author"))
    best = pairs.suggest_labels(pairs.make_pairs(bib, cand), top_n)
    return {"publications": pairs.labelling_candidates(bib, cand), "suggestions": best, "accepted": pairs.auto_accept(best, threshold)}
