"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, tokenization.

Each stage works on all that the stage before it kept, as written to Parquet and read again.  The stages need the columns
``doc_id`` (of any type that has an order) and ``text``, the first one ``lang`` as well; all other columns, whatever their
names, pass through all stages but the last with their values.  Texts are worked on whole, whatever their length, and an
empty table stays empty through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.llm import bpe, decontaminate, language_id, line_templates, minhash
from biblioflux.llm.arrow_text import column, ensure_checkpoint_dir, spread, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected.

    Null, empty and letterless texts go, and texts for which two languages compress equally well or nearly so.  Rows with
    null ``lang`` or ``doc_id`` are judged like all others; repeated rows stay or go together.
    """
    return language_id.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out of the texts; every document stays, and ``n_chars``, where there is one, follows its text.

    Null and empty texts stay as they are; a text of recurring lines alone becomes empty.  Equal texts lose equal lines, and
    null ids do not matter.  Rows that lose nothing keep their ``n_chars``, null or not.
    """
    dropped = unused("dropped", docs)
    out = line_templates.drop_recurring_lines(docs, result=dropped)
    changed = lambda c: F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(column(c)).alias(c)
    return out.select(*[changed(c) if c == "n_chars" else column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the least doc_id.

    Rows with null doc_id, and null, empty and blank texts, are in no group and stay.  Of rows with one doc_id the one whose
    text sorts first stays, of equal texts any.
    """
    return minhash.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay, rows with null doc_id are judged like all others, repeated rows stay or go
    together.  With an empty benchmark all stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang`` and ``source`` (where docs has them), and token ids of each document, decoded again to check them.

    Null texts have null ids and 0 tokens, empty ones no ids.  Rows stay, repeated ones and null ids among them; other
    columns of docs, those named like the results too, are not returned.
    """
    coded = bpe.bpe_round_trip(docs)
    return coded.select(*[c for c in ("doc_id", "lang", "source") if c in docs.columns], "n_tokens", "token_ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("BPE encoding", tokenize),
]

#: SQL cannot express the compression, the template tree, the signatures or the automaton.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What lies between them is written below the session's checkpoint folder; each stage's input is removed once its output is
    written, and the last one, which the result reads, when the session's process ends.
    """
    ensure_checkpoint_dir(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(root)
    files.deleteOnExit(root)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}")
            docs = spark.read.parquet(f"{root}/{k}")
            if k:
                files.delete(path(root, str(k - 1)), True)
    return docs
