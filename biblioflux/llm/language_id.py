"""Language identification by compression.

Each language owns a zstandard raw-content dictionary made of its own text.  A document is compressed once
with every dictionary; the language with the smallest frame wins, and the answer is rejected when the
second-best frame is nearly as small.  Labels may be wrong, so texts of the training sample that dictionaries of the other
half of the sample give to another language are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from biblioflux.llm.arrow_text import bound_batches, unused, without

#: Bound of the labelled sample that the dictionaries are made of: distinct texts of each language.  They are taken whole.
SAMPLE_ROWS = 64
LEVEL = 3
#: A text is rejected if the second-best frame is larger by less than this share, or by fewer bytes than MIN_GAP.
MIN_MARGIN = 0.01
MIN_GAP = 2
#: Margin by which another language must win a text of the sample for its label to count as wrong.
MISLABELLED = 0.05
RESULT = "struct<predicted:string,margin:double,gap:int>"


def letters(text: Column) -> Column:
    """Lower-case letters with single spaces: symbols, digits and shouting say nothing about the language."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample of the rows labelled in ``lang``: ``sample_rows`` distinct texts of each.

    The sample is the texts whose hash comes first, among all that have a letter; their letters are taken whole, but for
    texts that ``agreeing`` finds mislabelled.  Only hashes travel for the choice, and the chosen texts are read in a second scan.
    """
    labelled = docs.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = labelled.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows).select("h").distinct()
    rows = labelled.where(F.col("h").isin([r.h for r in chosen.collect()])).select("lang", "h", letters(F.col("text")).alias("t")).distinct()
    sample: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():
        sample.setdefault(r.lang, []).append((r.h, r.t))
    return {k: " ".join(v).encode() for k, v in agreeing({k: [t for _, t in sorted(v)[:sample_rows]] for k, v in sample.items()}).items()}


def rejects(gap: int, margin: float, min_margin: float = MIN_MARGIN) -> bool:
    return gap < MIN_GAP or margin < min_margin


def agreeing(sample: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sample without the texts that another language wins, by a margin of MISLABELLED, under dictionaries made of the other half.

    Texts at even places are judged by those at odd places and the other way round, if these hold the text's own language.
    A language of which nothing would be left keeps all.
    """
    halves = [{k: " ".join(v[i::2]).encode() for k, v in sample.items() if v[i::2]} for i in (0, 1)]
    judges = [_compressors(tuple(sorted(h.items())), LEVEL) for h in halves]
    out = {}
    for lang, texts in sample.items():
        kept = []
        for i, t in enumerate(texts):
            raw, there = t.encode(), lang in halves[1 - i % 2]
            sizes = {k: len(c.compress(raw)) for k, c in judges[1 - i % 2]} if there else {}
            if not there or sizes[lang] - min(sizes.values()) < MISLABELLED * sizes[lang]:
                kept.append(t)
        out[lang] = kept or texts
    return out


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def best(text: str, compressors: list) -> tuple[str, int, int, float]:
    """(language, its frame's size, bytes by which the second-best is larger, and their share of it); of equal sizes the first language by name."""
    raw = text.encode()
    sizes = sorted((len(c.compress(raw)), lang) for lang, c in compressors)
    size, lang = sizes[0]
    second = sizes[1][0] if len(sizes) > 1 else size + max(size, MIN_GAP)
    return lang, size, second - size, (second - size) / second if len(sizes) > 1 else 1.0


def classify(text: str | None, compressors: list) -> tuple[str | None, float | None, int | None]:
    """(language, margin, gap in bytes); all None without letters or without dictionaries."""
    if not text or not compressors:
        return None, None, None
    lang, _, gap, margin = best(text, compressors)
    return lang, margin, gap


def classifier(dictionaries: dict[str, bytes], level: int = LEVEL):
    """Arrow UDF over letters(text) giving RESULT."""
    fixed = tuple(sorted(dictionaries.items()))
    kind = pa.struct([("predicted", pa.string()), ("margin", pa.float64()), ("gap", pa.int32())])

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = _compressors(fixed, level)
        for arr in batches:
            rows = [classify(t.as_py(), compressors) for t in arr]
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.int32())], fields=list(kind))

    return run


def _accepted(verdict: Column, min_margin: float) -> Column:
    return F.coalesce((verdict["margin"] >= F.lit(min_margin)) & (verdict["gap"] >= MIN_GAP), F.lit(False))


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """docs plus ``predicted``, ``margin`` and ``rejected``.

    Needs ``text`` (and ``lang`` for training, when no dictionaries are given).  All rows and columns stay; input columns
    named like the three results are replaced, others keep their values whatever their names.  Rows with null, empty or
    letterless text have null ``predicted`` and ``margin`` and are rejected.  Equally small frames have margin 0 and are
    rejected, as are margins under ``min_margin`` or of fewer than MIN_GAP bytes.  With a single language every text with letters is accepted; with none (an empty table) every row is rejected.
    Repeated rows get equal results; texts are compressed whole, whatever their length.
    """
    if dictionaries is None:
        dictionaries = train(docs)
    results, own = without(docs, "predicted", "margin", "rejected"), unused("lid", docs)
    scored = bound_batches(docs).withColumn(own, classifier(dictionaries, level)(letters(F.col("text"))))
    part = F.col(own)
    return scored.select(*results, part["predicted"].alias("predicted"), part["margin"].alias("margin"), (~_accepted(part, min_margin)).alias("rejected"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """The rows of docs that ``identify`` does not reject; all columns keep their values, those named like its results too."""
    if dictionaries is None:
        dictionaries = train(docs)
    verdict = classifier(dictionaries, level)(letters(F.col("text")))
    return bound_batches(docs).where(_accepted(verdict, min_margin))
