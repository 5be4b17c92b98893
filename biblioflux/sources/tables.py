"""Driver tables, JSON inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.functions import text

CANDIDATE = "struct<title:string,paper_title:string,authors:array<string>,paper_authors:array<string>,submission_date:string,semantic_scholar_id:string,year:string,venue:string,abstract:string>"
LABELS = "map<string,map<string,string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many parts as there are cores, for work that is heavy a row: a file of one row group is read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def candidates(files: DataFrame) -> DataFrame:
    """(pub_id, candidate_id, ord, title, authors, year, submission_date, venue, abstract, s2_id) from references.json texts.

    Titles and authors go by two names; entries without content are left out.
    """
    refs = files.where("name = 'references.json'").select("pub_id", F.from_json("text", f"map<string,{CANDIDATE}>").alias("m"))
    rows = refs.select("pub_id", F.posexplode(F.map_entries("m")).alias("ord", "e")).where("e.value is not null")
    c = F.col("e.value")
    return rows.select(
        "pub_id",
        F.col("e.key").alias("candidate_id"),
        "ord",
        F.coalesce(text.present(c["paper_title"]), text.present(c["title"])).alias("title"),
        F.coalesce(c["paper_authors"], c["authors"]).alias("authors"),
        c["year"].alias("year"),
        c["submission_date"].alias("submission_date"),
        text.present(c["venue"]).alias("venue"),
        text.present(c["abstract"]).alias("abstract"),
        c["semantic_scholar_id"].alias("s2_id"),
    )


def labels(json_text: DataFrame, column: str = "value") -> DataFrame:
    """(pub_id, bib_key, candidate_id) from label files {pub: {key: id}}."""
    pubs = json_text.select(F.explode(F.from_json(column, LABELS)).alias("pub_id", "m"))
    return pubs.select("pub_id", F.explode("m").alias("bib_key", "candidate_id")).where("candidate_id is not null")


def hierarchy(json_text: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Elements (element_id, text) and edges (version, child_id, parent_id) of exported hierarchies."""
    doc = json_text.select(F.from_json(column, "struct<elements:map<string,string>,hierarchy:map<string,map<string,string>>>").alias("d"))
    elements = doc.select(F.explode("d.elements").alias("element_id", "text"))
    edges = doc.select(F.explode("d.hierarchy").alias("version", "m")).select(F.col("version").cast("int").alias("version"), F.explode("m").alias("child_id", "parent_id"))
    return elements, edges


def bibtex_text(key: Column, kind: Column, fields: dict[str, Column]) -> Column:
    """One BibTeX entry; absent fields are left out."""
    lines = F.array_compact(F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {k} = {{"), v, F.lit("}"))) for k, v in fields.items()]))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}\n"))


def hierarchy_json(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(pub_id, json): plain texts by element, and child -> parent by version for the children that stay."""
    from biblioflux.functions import latex
    from biblioflux.operators.order import cut_lineage

    kept = elements.select("pub_id", "element_id", latex.plain_text(F.col("raw_text")).alias("plain"))
    kept = cut_lineage(kept).where(~latex.is_bibliography_residue(F.col("plain")))  # texts are cleaned once, not for each use
    by_pub = kept.groupBy("pub_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_id", "plain")))).alias("elements"))
    live = edges.join(kept.select("pub_id", F.col("element_id").alias("child_id")), ["pub_id", "child_id"], "left_semi")
    versions = live.groupBy("pub_id", "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("child_id", "parent_id")))).alias("m"))
    by_version = lambda x, y: x["version"] - y["version"]
    rows = F.array_sort(F.collect_list(F.struct("version", "m")), by_version)
    tree = versions.groupBy("pub_id").agg(F.map_from_entries(F.transform(rows, lambda x: F.struct(x["version"].cast("string"), x["m"]))).alias("hierarchy"))
    return by_pub.join(tree, "pub_id", "left").select("pub_id", F.to_json(F.struct("elements", "hierarchy")).alias("json"))


def prediction_json(predictions: DataFrame, truth: DataFrame, split: DataFrame) -> DataFrame:
    """(pub_id, json): {partition, groundtruth, prediction} of each publication."""
    pred = predictions.groupBy("pub_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bib_key", "candidates")))).alias("prediction"))
    true = truth.groupBy("pub_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bib_key", "candidate_id")))).alias("groundtruth"))
    out = split.select("pub_id", F.col("split").alias("partition")).join(pred, "pub_id", "left").join(true, "pub_id", "left")
    return out.select("pub_id", F.to_json(F.struct("partition", "groundtruth", "prediction")).alias("json"))


def write_by_publication(rows: DataFrame, path: str) -> None:
    """One folder of text files per publication from (pub_id, json)."""
    rows.select("pub_id", "json").write.partitionBy("pub_id").text(path)


def label_json(labels: DataFrame) -> DataFrame:
    """(value): one line {pub: {key: candidate}} of each publication, which ``labels`` reads again; keys in order."""
    by_key = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bib_key").cast("string"), F.col("candidate_id").cast("string")))))
    pubs = labels.groupBy(F.col("pub_id").cast("string").alias("pub_id")).agg(by_key.alias("m"))
    return pubs.select(F.to_json(F.create_map("pub_id", "m")).alias("value"))


def write_labels(labels: DataFrame, path: str) -> None:
    label_json(labels).write.mode("overwrite").text(path)


def report_json(compliance: DataFrame, split: DataFrame, pairs: DataFrame, metrics: DataFrame, importance: DataFrame | None = None, model: dict[str, str] | None = None, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(value): the evaluation report as one JSON object: compliance, publications of each split by origin of their labels,
    pairs of each split and label, the sizes of the feature groups, test metrics, the 20 most important features and the
    model's settings."""
    rules = compliance.agg(F.collect_list(F.struct("requirement", "required", "actual", "status")).alias("compliance"))
    origin = pairs.groupBy("pub_id").agg(F.max((F.col("origin") == "manual").cast("int")).alias("m"), F.max((F.col("origin") == "auto").cast("int")).alias("a"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    per = split.join(origin, "pub_id", "left").na.fill(0).groupBy("split").agg(F.count(F.lit(1)).alias("publications"), F.sum("m").alias("manual"), F.sum("a").alias("auto"), F.sum("n").alias("pairs"), F.sum("p").alias("positive"))
    splits = per.agg(F.array_sort(F.collect_list(F.struct("split", "publications", "manual", "auto", "pairs", "positive"))).alias("splits"))
    counts = pairs.agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    counts = counts.select(F.struct("*", F.expr("round(try_divide(negative, positive), 1)").alias("negatives_per_positive")).alias("data"))
    found = metrics.select(F.struct("*").alias("test_metrics"))
    out = rules.join(F.broadcast(splits)).join(F.broadcast(counts)).join(F.broadcast(found))
    if importance is not None:
        out = out.join(F.broadcast(importance.orderBy(F.desc("importance"), "feature").limit(20).agg(F.sort_array(F.collect_list(F.struct("importance", "feature")), False).alias("top_features"))))
    sizes = F.to_json(F.map_from_arrays(F.array(*[F.lit(k) for k in groups]), F.array(*[F.lit(len(v)) for v in groups.values()]))) if groups else F.lit("{}")
    about = F.to_json(F.create_map(*[F.lit(x) for pair in model.items() for x in pair])) if model else F.lit("{}")
    names = [c for c in out.columns]
    whole = out.withColumns({"feature_groups": F.from_json(sizes, "map<string,int>"), "model": F.from_json(about, "map<string,string>")})
    return whole.select(F.to_json(F.struct(*names, "feature_groups", "model")).alias("value"))


#: Files that pass through a parse unchanged.
PASSED_ON = ("metadata.json", "references.json")


def passed_on(files: DataFrame) -> DataFrame:
    """(pub_id, name, text) of the files that go with a publication's results as they are; of several the one with the shortest path."""
    own = files.where(F.col("name").isin(*PASSED_ON))
    return own.groupBy("pub_id", "name").agg(F.min_by("text", F.struct(F.length("path"), "path")).alias("text"))


def result_path(root: str, publication: Column, name: str) -> Column:
    """Place of a publication's file: root/<publication>/<name>."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), publication, F.lit(name))
