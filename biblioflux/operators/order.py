"""Lineage cuts, and row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id: partition above these bits, row below


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; only a session in one process (tests) gets a folder of its own where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def parted(df: DataFrame, *keys: str) -> DataFrame:
    """df in parts by its keys, as many as shuffles have and at least one a core, which adaptive execution does not merge: rows are few bytes, but heavy once they are paired."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def numbered(df: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """df with ``name``: each row's number from 1 in the order of the columns; and the number of rows.

    Rows are cut into ranges and sorted there; a count for each range gives its offset.  The ranges are checkpointed, so
    that both passes see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    part = F.shiftright(F.col(name), _ROW_BITS)
    before, total = {}, 0
    for r in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():
        before[r.p], total = total, total + r["count"]
    if not total:
        return ranged, 0
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return ranged.withColumn(name, offset[part] + F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1), total
