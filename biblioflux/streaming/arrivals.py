"""Publications as they arrive: the file scan as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.functions import identifiers, latex

RAW = "path string, modificationTime timestamp, length bigint, content binary"


def stream_sources(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Stream of (pub_id, path, arrived, text) of new .tex files under root/<publication>/."""
    files = spark.readStream.format("binaryFile").schema(RAW).option("pathGlobFilter", "*.tex").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    rel = F.split(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + root.rstrip("/") + "/", ""), "/")
    return files.select(identifiers.publication_id(F.get(rel, 0)).alias("pub_id"), "path", F.col("modificationTime").alias("arrived"), F.col("content").cast("string").alias("text"))


def citation_counts(sources: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(window, bib_key, n): citations of each key in the files that arrived in a window; later files are left out."""
    keys = sources.withWatermark("arrived", late).select("arrived", F.explode(latex.cited_keys(F.col("text"))).alias("bib_key"))
    return keys.groupBy(F.window("arrived", window), "bib_key").agg(F.count(F.lit(1)).alias("n"))
