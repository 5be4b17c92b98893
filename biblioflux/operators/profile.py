"""Profiles of inputs and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numeric_profile(df: DataFrame, group: list[str], value: str) -> DataFrame:
    c = F.col(value)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, present, percent): how many rows hold a value that is not blank."""
    n = F.count(F.lit(1))
    parts = [F.struct(F.lit(c).alias("field"), F.count_if(F.trim(F.col(c).cast("string")) != "").alias("present"), n.alias("n")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p")).select("field", "present", F.expr("100.0 * try_divide(present, n)").cast("double").alias("percent"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bucket, n): rows between consecutive edges, the last edge inclusive."""
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    v = F.col(column).cast("double")
    bucket = F.least(F.size(F.filter(cuts, lambda e: e <= v)) - 1, F.lit(len(edges) - 2))
    return df.where((v >= edges[0]) & (v <= edges[-1])).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def version_sharing(elements: DataFrame, item: str = "element_id") -> DataFrame:
    """(pub_id, shared, total, ratio): items that all versions of a publication hold, of all its items."""
    n = elements.groupBy("pub_id").agg(F.countDistinct("version").alias("versions"))
    per = elements.groupBy("pub_id", item).agg(F.countDistinct("version").alias("v")).join(n, "pub_id")
    return per.groupBy("pub_id").agg(F.count_if(F.col("v") == F.col("versions")).alias("shared"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.col("shared") / F.col("total"))


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) of all pairs of columns whose Pearson correlation is at least ``least`` in size, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("p"))
    return out.select(F.inline("p")).where(F.abs("r") >= least)


def importance_by_group(importance: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, importance): sums of (feature, importance) rows."""
    rows = [(f, g) for g, fs in groups.items() for f in fs]
    table = importance.sparkSession.createDataFrame(rows, "feature string, `group` string")
    return importance.join(F.broadcast(table), "feature").groupBy("group").agg(F.sum("importance").alias("importance"))
