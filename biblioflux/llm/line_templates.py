"""Line dedup with a log-template tree.

A line is a sequence of tokens; tokens that hold a digit are variable fields.  The tree has a fixed depth: token
count, then the leading tokens.  Under a leaf, lines that agree in most positions share a template in which the
other positions become variable.  Templates that recur across documents are boilerplate, and their lines go.  Near copies of
one document are no evidence of boilerplate, for their lines recur with the document: a template recurs if enough texts
hold it of which no two are near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from biblioflux.llm import minhash
from biblioflux.llm.arrow_text import bound_batches, column, concat, cut_lineage, row_chunks, small_side, unused

FIELD = "<*>"
LEADING = 2
SIMILARITY = 0.75
MIN_DOCS = 5
#: Estimated probability Jaccard similarity from which two texts count as near copies, and the registers it is estimated with.
COPY_SIMILARITY = 0.5
REGISTERS = 128
#: Parts in which the texts of one template are compared, so that a template of many texts is not one task's work.
PARTS = 64


def masked(text: Column) -> Column:
    """Text whose lines have single spaces, and a field for each token that holds a digit.

    Texts in which there is nothing to replace, as most are, are told by plain searches.
    """
    odd = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\f")])
    plain = F.when(odd, F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")).otherwise(text)
    # one step a character: tokens are entered at their start only, and what holds no digit is not given back
    return F.when(text.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)).otherwise(plain)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


class Leaf:
    """Templates under one leaf, in order of arrival; similar lines join the most similar one (the oldest of equals).

    With at most m mismatches allowed, two sequences cut into m + 1 blocks agree on one whole block, so candidates
    come from an index of blocks and no template that qualifies is missed.
    """

    def __init__(self, n_tokens: int, similarity: float = SIMILARITY):
        self.n = n_tokens
        self.need = int(np.ceil(similarity * n_tokens - 1e-9))
        blocks = n_tokens - self.need + 1
        self.cuts = [n_tokens * i // blocks for i in range(blocks + 1)]
        self.templates: list[list[str | None]] = []
        self.index: dict[tuple, list[int]] = {}

    def add(self, line: str) -> int:
        tokens = line.split(" ")
        keys = [(i, *tokens[self.cuts[i] : self.cuts[i + 1]]) for i in range(len(self.cuts) - 1)]
        best, best_same = -1, self.need - 1
        for g in sorted({g for k in keys for g in self.index.get(k, ())}):
            same = sum(a == b for a, b in zip(self.templates[g], tokens))
            if same > best_same:
                best, best_same = g, same
        if best < 0:
            best = len(self.templates)
            self.templates.append(list(tokens))
            for k in keys:
                self.index.setdefault(k, []).append(best)
        elif best_same < self.n:  # positions that differ become variable; they equal no token from now on
            self.templates[best] = [a if a == b else None for a, b in zip(self.templates[best], tokens)]
        return best


def _parse_leaves(min_docs: int, similarity: float):
    """Arrow batches sorted by (leaf, line) -> hashes of lines in templates with at least min_docs line-bearing documents."""

    def flush(leaf: int, lines: list[str], hashes: list[int], counts: list[int], out: list) -> None:
        if sum(counts) < min_docs:
            return
        tree, groups = Leaf(lines[0].count(" ") + 1, similarity), []
        for line in lines:
            groups.append(tree.add(line))
        totals = np.bincount(groups, counts)
        out.extend((h, leaf, g) for h, g in zip(hashes, groups) if totals[g] >= min_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, list, list, list] = (None, [], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]])
            totals = np.add.reduceat(n, starts[:-1])
            out: list = []
            lines, hashes = batch.column("line"), batch.column("line_hash")
            last = len(starts) - 2
            for i in [0, *(i for i in np.flatnonzero(totals >= min_docs).tolist() if 0 < i < last), *([last] if last else [])]:
                a, b = int(starts[i]), int(starts[i + 1])
                part = (int(leaf[a]), lines.slice(a, b - a).to_pylist(), hashes.slice(a, b - a).to_pylist(), n[a:b].tolist())
                if i not in (0, last):
                    flush(*part, out)
                elif held[0] == part[0]:
                    for x, y in zip(held[1:], part[1:]):
                        x.extend(y)
                else:
                    if held[0] is not None:
                        flush(*held, out)
                    held = part
            yield _batch(out)
        out = []
        if held[0] is not None:
            flush(*held, out)
        yield _batch(out)

    return run


def _batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    h, leaf, g = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(leaf, pa.int64()), pa.array(g, pa.int32())], names=["line_hash", "leaf", "template"])


def _lines(docs: DataFrame) -> DataFrame:
    """(t, line_no, leaf, line) of every non-empty line; t stands for the text."""
    rows = docs.select(text_key(F.col("text")).alias("t"), F.posexplode(F.split(masked(F.col("text")), "\n")).alias("line_no", "line"))
    rows = rows.select("t", "line_no", F.trim("line").alias("line")).where("line <> ''")
    return rows.select("t", "line_no", F.xxhash64(token_count(F.col("line")), F.substring_index("line", " ", LEADING)).alias("leaf"), "line")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sketches():
    """Arrow UDF: text -> its REGISTERS registers, a byte of each."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            parts = []
            for piece in row_chunks(arr):
                row, value, weight = minhash.shingles(piece)
                z = minhash.signatures(row, value, weight.astype(np.float64), len(piece), REGISTERS)
                flat = np.ascontiguousarray(z.astype(np.uint8))
                cuts = np.arange(len(piece) + 1, dtype=np.int32) * REGISTERS
                parts.append(pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(cuts), pa.py_buffer(flat.tobytes())]))
            yield concat(parts, pa.binary())

    return run


def leaders(sketches: list[bytes], enough: int, held: list[np.ndarray] | None = None) -> list[int]:
    """Numbers of the sketches that are no near copies of an earlier leader, until ``enough`` leaders are held."""
    held = [] if held is None else held
    need, out = int(np.ceil(COPY_SIMILARITY * REGISTERS)), []
    for i, raw in enumerate(sketches):
        if len(held) >= enough:
            break
        own = np.frombuffer(raw, np.uint8)
        if all(np.count_nonzero(own == x) < need for x in held):
            held.append(own)
            out.append(i)
    return out


def _leaders(keys: list[str], enough: int):
    """Arrow batches sorted by the keys and t -> the rows that are leaders of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            starts = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            sketch, take = batch.column("sketch"), []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if (key := tuple(at[:, lo].tolist())) != now:
                    now, held = key, []
                for x in range(lo, hi, 64):  # what comes after enough leaders is not read
                    if len(held) >= enough:
                        break
                    take += [x + i for i in leaders(sketch.slice(x, min(64, hi - x)).to_pylist(), enough, held)]
            yield batch.take(pa.array(take, pa.int64()))

    return run


def _spread(docs: DataFrame, hits: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, template) of the templates held by at least min_docs texts of which no two are near copies.

    Texts are taken in the order of their key, first in PARTS parts and then those that lead a part; a template is settled
    by its first min_docs leaders.  Only texts with a template that min_docs texts hold are sketched.
    """
    held = hits.select("leaf", "template", "t").distinct()
    wide = cut_lineage(held.groupBy("leaf", "template").count().where(F.col("count") >= min_docs).select("leaf", "template"), "leaf")
    held = cut_lineage(held.join(small_side(wide, 16), ["leaf", "template"], "left_semi"), "t")
    texts = cut_lineage(held.select("t").distinct(), "t")
    rows = docs.where("text is not null").select(text_key(F.col("text")).alias("t"), "text").join(small_side(texts, 16), "t", "left_semi")
    sketched = rows.select("t", _sketches()("text").alias("sketch")).groupBy("t").agg(F.first("sketch").alias("sketch"))
    part = F.pmod(F.xxhash64("t"), F.lit(PARTS)).cast("int")
    schema = "leaf long, template int, part int, t binary, sketch binary"
    posted = held.join(sketched, "t").select("leaf", "template", part.alias("part"), "t", "sketch")
    first, then = ["leaf", "template", "part"], ["leaf", "template"]
    led = posted.repartition(*first).sortWithinPartitions(*first, "t").mapInArrow(_leaders(first, min_docs), schema)
    led = led.repartition(*then).sortWithinPartitions(*then, "t").mapInArrow(_leaders(then, min_docs), schema)
    return cut_lineage(led.groupBy(*then).count().where(F.col("count") >= min_docs).select(*then))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """(t, drop: array<int>): the lines to drop from each text that has any."""
    texts = bound_batches(docs.select("text"))
    lines = _lines(texts)
    # The lines travel once, by leaf; the count per distinct line and the sort reuse that partitioning.
    tree = lines.select("leaf", "line").repartition("leaf").groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    tree = tree.withColumn("line_hash", F.xxhash64("line")).sortWithinPartitions("leaf", "line").mapInArrow(_parse_leaves(min_docs, similarity), "line_hash long, leaf long, template int")
    found = cut_lineage(tree, "line_hash")
    hits = lines.select("t", "line_no", "leaf", F.xxhash64("line").alias("line_hash")).join(small_side(found, 20), ["leaf", "line_hash"]).select("t", "line_no", "leaf", "template")
    hits = cut_lineage(hits, "t")
    return hits.join(small_side(_spread(texts, hits, min_docs), 16), ["leaf", "template"], "left_semi").groupBy("t").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, result: str = "lines_dropped") -> DataFrame:
    """docs with the lines of recurring templates taken out of ``text``, and ``lines_dropped`` (or another name, ``result``).

    A template recurs when at least ``min_docs`` distinct texts hold a line of it of which no two are near copies, so neither
    exact nor near copies of a document make its own lines recur.  Every recurring line goes, from copies too, and a text of
    nothing else becomes empty.  Every non-empty line counts; one of 1 to 3 tokens is of a template only if its masked
    tokens are equal, and empty lines stay.  Every row and column stays, in any order; null and empty texts stay as they are
    with 0 dropped.  An input column named like the result is replaced, all others keep their values whatever their names.  An
    empty table stays empty.  Equal texts get equal results; lines of the same leaf are parsed in the order of their text
    (ties: equal lines are one), so results depend on the data only.  Texts are read whole, whatever their length.
    """
    drops = cut_lineage(recurring_lines(docs, min_docs, similarity))
    key, drop = unused("t", docs), unused("drop", docs)
    side = small_side(drops, 128).select(F.col("t").alias(key), F.col("drop").alias(drop))
    joined = docs.withColumn(key, text_key(F.col("text"))).join(side, key, "left")
    gone = F.col(drop)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), F.col("text")).otherwise(kept).alias("text")
    columns = [text if c == "text" else column(c) for c in docs.columns if c.lower() != result.lower()]
    return joined.select(*columns, F.when(gone.isNull(), 0).otherwise(F.size(gone)).alias(result))
