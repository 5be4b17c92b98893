"""Quality rules by divergence: how far a document's characters and words are from those of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from biblioflux.llm.arrow_text import bound_batches, concat, cut_lineage, list_array, row_chunks, text_buffer, unused, without, words

COMMON_WORDS = 64
MIN_CHARS = 100
MIN_WORDS = 40
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.42
#: lower-case and upper-case ASCII letters, digits, white space, sentence signs, other ASCII, U+00C0..U+027F, all else
CLASSES = 8
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[0xC0:] = 7
_CLASS[0xC3:0xCA] = 6
_CLASS[0x80:0xC0] = CLASSES  # bytes within a character


def class_counts(arr: pa.Array) -> np.ndarray:
    """(rows, CLASSES) numbers of characters."""
    data, offsets = text_buffer(arr)
    row = np.repeat(np.arange(len(arr)), np.diff(offsets))
    return np.bincount(row * (CLASSES + 1) + _CLASS[data], minlength=len(arr) * (CLASSES + 1)).reshape(len(arr), -1)[:, :CLASSES]


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence (base 2) of each row of counts from the reference counts."""
    p = counts / counts.sum(axis=1, keepdims=True)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)).sum(axis=1) / 2
    return np.sqrt(np.maximum(d, 0.0))


def _classes():
    """Arrow UDF: text -> class_counts."""
    kind = pa.list_(pa.int64())

    @arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield concat([list_array(class_counts(x).ravel().astype(np.int64), np.full(len(x), CLASSES), pa.int64()) for x in row_chunks(arr)], kind)

    return run


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> dict[str, tuple[list[int], list[str], list[int]]]:
    """By language, over all its rows: character-class counts, its most common words, and their counts with all others' last."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    per_class = bound_batches(known).select("lang", _classes()("text").alias("c")).groupBy("lang").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(CLASSES)])
    word = F.explode(F.split(F.lower("text"), r"[ \t\n\r\x0B\f]+"))
    counted = cut_lineage(known.select("lang", word.alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    # the limit on the rank cuts each part down before rows meet by language; no task sees a whole vocabulary
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= common_words)
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    found: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.r)):
        found.setdefault(r.lang, []).append(r)
    out = {}
    for r in per_class.collect():
        rows = found.get(r.lang, [])
        n = [x.n for x in rows]
        out[r.lang] = ([r[f"c{i}"] for i in range(CLASSES)], [x.w for x in rows], [*n, totals.get(r.lang, 0) - sum(n)])
    return out


def _scorer(refs: dict, min_chars: int, min_words: int):
    kind = pa.struct([("char_js", pa.float64()), ("word_js", pa.float64()), ("n_words", pa.int32())])

    @arrow_udf("struct<char_js:double,word_js:double,n_words:int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arr, langs in batches:
            parts, done = [], 0
            for piece in row_chunks(arr):
                n = len(piece)
                code = langs.slice(done, n).dictionary_encode()
                done += n
                chars = class_counts(piece)
                data, offsets = text_buffer(pc.utf8_lower(piece.fill_null("")))
                starts, ends, rows = words(data, offsets)
                n_words = np.bincount(rows, minlength=n)
                cuts = np.zeros(len(starts) + 1, np.int32)
                np.cumsum(ends - starts, out=cuts[1:])
                ink = np.zeros(len(data) + 1, np.int8)
                ink[starts] += 1
                ink[ends] -= 1
                spelled = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[np.cumsum(ink[:-1]).astype(bool)].tobytes())])
                char_js, word_js = np.full(n, np.nan), np.full(n, np.nan)
                which = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for k, lang in enumerate(code.dictionary.to_pylist()):
                    if lang not in refs:
                        continue
                    by_class, common, by_word = refs[lang]
                    mine = np.flatnonzero((which == k) & (chars.sum(axis=1) >= min_chars))
                    if len(mine):
                        char_js[mine] = js_distance(chars[mine], np.array(by_class, np.float64))
                    mine = np.flatnonzero((which == k) & (n_words >= min_words))
                    if len(mine):
                        place = np.full(n, -1)
                        place[mine] = np.arange(len(mine))
                        at = np.flatnonzero(place[rows] >= 0)
                        hit = pc.index_in(spelled.take(pa.array(at)), value_set=pa.array(common, pa.string())).fill_null(len(common)).to_numpy(zero_copy_only=False)
                        counts = np.bincount(place[rows[at]] * (len(common) + 1) + hit, minlength=len(mine) * (len(common) + 1)).reshape(len(mine), -1)
                        word_js[mine] = js_distance(counts, np.array(by_word, np.float64))
                parts.append(pa.StructArray.from_arrays([pa.array(char_js, mask=np.isnan(char_js)), pa.array(word_js, mask=np.isnan(word_js)), pa.array(n_words.astype(np.int32))], fields=list(kind)))
            yield concat(parts, kind)

    return run


def divergence(docs: DataFrame, refs: dict | None = None, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs plus ``char_js``, ``word_js`` (Jensen-Shannon distances, 0 to 1), ``n_words`` and ``flagged``.

    References are counted over all rows of a language, unless given.  A distance is null if the text has under
    ``min_chars`` characters or ``min_words`` words, or its language is null or has no reference; a row is flagged if a
    distance it has exceeds its limit (one that equals it does not), so short and unknown texts are never flagged.  Null
    texts count as empty; texts are read whole, whatever their length.  All rows and columns stay; input columns named like
    the results are replaced, others keep their values whatever their names.  Equally common words are taken in the order of
    their bytes, and repeated rows count as often as they occur.  An empty table has no references and no rows.
    """
    if refs is None:
        refs = references(docs)
    own = unused("d", docs)
    out = bound_batches(docs).withColumn(own, _scorer(refs, min_chars, min_words)("text", "lang"))
    part = F.col(own)
    flagged = F.coalesce(part["char_js"] > max_char, F.lit(False)) | F.coalesce(part["word_js"] > max_word, F.lit(False))
    return out.select(*without(docs, "char_js", "word_js", "n_words", "flagged"), *[part[c].alias(c) for c in ("char_js", "word_js", "n_words")], flagged.alias("flagged"))
