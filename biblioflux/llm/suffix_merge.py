"""Repeated passages across documents by merging Burrows-Wheeler transforms.

1. Anchors.  In every window of MIN_WORDS words the least hash among its K-word runs marks an anchor.  Equal windows
   have equal anchors at equal places, so a window can only repeat if its anchor occurs in two documents.
2. The windows around such anchors, cut into segments that share one anchor, are gathered by anchor, equal ones once.
3. The segments of an anchor are spread over shards.  Each shard sorts the suffixes of its own segments, which gives
   its transform.  The transforms are then merged by refining their interleave: after h rounds the rows of all shards are
   in the order of their first h words, and each round follows from the last one by stepping every row to its
   predecessor through its shard's transform, so suffixes are not sorted again.  Rows that are alone in their block are
   done.  Blocks left after MIN_WORDS rounds are the repeated intervals, whose common prefixes have MIN_WORDS words or more;
   shorter common prefixes are not kept, for no passage comes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from biblioflux.llm.arrow_text import bound_batches, concat, cut_lineage, row_chunks, small_side, text_buffer, window_hashes, word_hashes, words

MIN_WORDS = 50
SHARDS = 4
#: Segments that are merged together at least, if there are so many; all those of an anchor always are.
BLOCK_SEGMENTS = 20_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(v: np.ndarray, size: int) -> np.ndarray:
    """Position of the first least value in each run of ``size`` values."""
    at = np.arange(len(v))
    have = 1
    while have < size:
        jump = min(have, size - have)
        n = len(at) - jump
        a, b = at[:n], at[jump:]
        at = np.where(v[b] < v[a], b, a)
        have += jump
    return at


class _Windows:
    """Words of the rows of a column, and the anchor of each window."""

    def __init__(self, arr: pa.Array, size: int):
        k = (size + 1) // 2
        self.data, offsets = text_buffer(arr)
        self.starts, self.ends, self.rows = words(self.data, offsets)
        n = len(self.rows)
        if n < size:
            self.first = self.anchor = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        else:
            self.hash = window_hashes(word_hashes(self.data, self.starts, self.ends), k)
            self.hash[self.rows[: n - k + 1] != self.rows[k - 1 :]] = _MAX
            least = _least(self.hash, size - k + 1)
            self.first = np.flatnonzero(self.rows[: n - size + 1] == self.rows[size - 1 :])
            self.anchor = least[self.first]
        self.row_start = np.searchsorted(self.rows, np.arange(len(arr)))


def _anchors(size: int):
    """Arrow UDF: text -> its anchors (hash, word number)."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("pos", pa.int32())]))

    @arrow_udf("array<struct<a:bigint,pos:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            parts = []
            for piece in row_chunks(arr):
                w = _Windows(piece, size)
                at = np.unique(w.anchor)
                row = w.rows[at]
                offs = np.zeros(len(piece) + 1, np.int32)
                np.cumsum(np.bincount(row, minlength=len(piece)), out=offs[1:])
                values = pa.StructArray.from_arrays([pa.array(w.hash[at].view(np.int64)), pa.array((at - w.row_start[row]).astype(np.int32))], fields=list(kind.value_type))
                parts.append(pa.ListArray.from_arrays(pa.array(offs), values))
            yield concat(parts, kind)

    return run


def _segments(size: int):
    """Arrow UDF: text, ascending word numbers of anchors that recur -> segments of windows with one such anchor."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("start", pa.int32()), ("seg", pa.string())]))

    @arrow_udf("array<struct<a:bigint,start:int,seg:string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arr, anchors in batches:
            parts, done = [], 0
            for piece in row_chunks(arr):
                w = _Windows(piece, size)
                mine = anchors.slice(done, len(piece))
                done += len(piece)
                n_anchors = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                wanted = mine.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.row_start, n_anchors)
                keep = np.isin(w.anchor, wanted)
                first, anchor = w.first[keep], w.anchor[keep]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(anchor) != 0)])) if len(first) else np.zeros(0, np.int64)
                lo, hi = first[new], first[np.append(new[1:], len(first)) - 1] + size if len(first) else first
                row = w.rows[lo]
                a, b = w.starts[lo], w.ends[hi - 1]
                raw = w.data.tobytes()
                seg = pa.array([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())], pa.string())
                offs = np.zeros(len(piece) + 1, np.int32)
                np.cumsum(np.bincount(row, minlength=len(piece)), out=offs[1:])
                values = pa.StructArray.from_arrays([pa.array(w.hash[anchor[new]].view(np.int64)), pa.array((lo - w.row_start[row]).astype(np.int32)), seg], fields=list(kind.value_type))
                parts.append(pa.ListArray.from_arrays(pa.array(offs), values))
            yield concat(parts, kind)

    return run


class Shard:
    """Transform of a collection of strings, each with an end sign of its own that sorts before all words."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        """symbols: the strings' words (numbers from 1) in a row; bounds: where strings begin, and the total."""
        m = len(bounds) - 1
        length = np.diff(bounds)
        self.n = len(symbols) + m
        at = np.arange(len(symbols)) + np.repeat(np.arange(m), length)  # place of each word with end signs put in
        end = bounds[1:] + np.arange(m)
        rank = np.empty(self.n, np.int64)
        rank[at] = np.unique(symbols, return_inverse=True)[1] + m
        rank[end] = np.arange(m)
        step, longest = 1, int(length.max(initial=0)) + 1
        while step < longest:  # doubling; what begins with an end sign is told apart already
            second = np.zeros(self.n, np.int64)
            second[: self.n - step] = rank[step:] + 1
            _, rank = np.unique(rank * np.int64(self.n + 2) + second, return_inverse=True)
            step *= 2
        self.suffix = np.argsort(rank, kind="stable")  # by row
        self.symbol = np.zeros(self.n, np.int64)
        self.symbol[at] = symbols
        #: by row: the word before the suffix (0: none), and the row of the suffix that begins with it
        before = self.suffix - 1
        self.transform = self.symbol[before]
        row_of = np.empty(self.n, np.int64)
        row_of[self.suffix] = np.arange(self.n)
        self.lf = row_of[before]
        self.ends = m


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, block) of all rows whose first ``depth`` words occur more than once, in their order."""
    # round 0: every row in one block
    shard = np.concatenate([np.full(s.n, i, np.int32) for i, s in enumerate(shards)])
    row = np.concatenate([np.arange(s.n) for s in shards])
    base = np.cumsum([0, *(s.n for s in shards)])[:-1]
    transform = np.concatenate([s.transform for s in shards])
    lf = np.concatenate([s.lf for s in shards])
    block = np.zeros(len(row), np.int64)
    for _ in range(depth):
        flat = base[shard] + row
        c = transform[flat]
        go = np.flatnonzero(c)  # what precedes a string's first word is an end sign: alone in its block
        c, flat, block, shard = c[go], flat[go], block[go], shard[go]
        order = np.argsort(c, kind="stable")
        c, block = c[order], block[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(new)
        block = np.cumsum(new) - 1
        shared = (np.diff(np.append(starts, len(c))) > 1)[block] if len(c) else np.zeros(0, bool)
        order = order[shared]
        shard, row, block = shard[order], lf[flat[order]], block[shared]
        if not len(row):
            break
    return shard, row, block


def repeated_windows(texts: list[str], low: np.ndarray, high: np.ndarray, size: int, n_shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, first document) of the windows that occur in several documents; low and high: least and greatest document of each text."""
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = words(data, offsets)
    symbols = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1] + 1
    cuts = np.linspace(0, len(texts), min(n_shards, len(texts)) + 1).astype(np.int64)
    word_at = np.searchsorted(rows, np.arange(len(texts) + 1))
    shards = [Shard(symbols[word_at[a] : word_at[b]], word_at[a : b + 1] - word_at[a]) for a, b in zip(cuts[:-1], cuts[1:])]
    shard, row, block = merge(shards, size)
    text, word = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for i, s in enumerate(shards):
        mine = np.flatnonzero(shard == i)
        bounds = word_at[cuts[i] : cuts[i + 1] + 1] - word_at[cuts[i]] + np.arange(cuts[i + 1] - cuts[i] + 1)
        suffix = s.suffix[row[mine]]
        t = np.searchsorted(bounds, suffix, "right") - 1
        text[mine], word[mine] = t + cuts[i], suffix - bounds[t]
    # texts that several documents hold need no second text to repeat
    several = np.flatnonzero(low < high)
    n_windows = np.diff(word_at) - size + 1
    own_text = np.repeat(several, n_windows[several])
    total = np.cumsum(n_windows[several])
    own_word = np.arange(len(own_text)) - np.repeat(total - n_windows[several], n_windows[several])
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        spread = np.diff(np.append(starts, len(block)))
        first = np.repeat(np.minimum.reduceat(low[text], starts), spread)
        last = np.repeat(np.maximum.reduceat(high[text], starts), spread)
        keep = first < last
        text, word, first = text[keep], word[keep], first[keep]
    else:
        first = np.zeros(0, np.int64)
    text, word, first = np.concatenate([text, own_text]), np.concatenate([word, own_word]), np.concatenate([first, low[own_text]])
    order = np.lexsort((first, word, text))
    text, word, first = text[order], word[order], first[order]
    once = np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])]) if len(text) else np.zeros(0, bool)
    return text[once], word[once], first[once]


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids in order, of whatever type, and each value's place among them."""
    known = values.dictionary_encode()
    order = pc.sort_indices(known.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return known.dictionary.take(order), rank[known.indices.to_numpy()]


def _merge_blocks(size: int):
    """Arrow batches (a, seg, key, least, greatest) of distinct segments, sorted by (a, seg) -> runs (a, key, lo, hi, first) of repeated windows, by word number."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda c: pa.concat_arrays([b.column(c) for b in held])
        a, key = column("a"), column("key")
        n = len(a)
        ids, rank = _ranked(pa.concat_arrays([column("least"), column("greatest")]))
        text, word, first = repeated_windows([t for b in held for t in b.column("seg").to_pylist()], rank[:n], rank[n:], size)
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1] + 1)])) if len(text) else np.zeros(0, np.int64)
        stop = np.append(new[1:], len(text))[: len(new)] - 1
        at = pa.array(text[new])
        least = np.minimum.reduceat(first, new) if len(new) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([a.take(at), key.take(at), pa.array(word[new].astype(np.int32)), pa.array(word[stop].astype(np.int32)), ids.take(pa.array(least))], names=["a", "key", "lo", "hi", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = 0
            if rows >= BLOCK_SEGMENTS:  # cut where the anchor changes
                change = np.flatnonzero(batch.column("a").to_numpy() != last)
                if len(change):
                    cut = int(change[0])
                    yield flush([*held, batch.slice(0, cut)])
                    held, rows = [], 0
            held.append(batch.slice(cut))
            rows += batch.num_rows - cut
            last = batch.column("a")[-1].as_py()
        if held:
            yield flush(held)

    return run


def _segment_key() -> Column:
    return F.unhex(F.md5("seg"))


def repeated_passages(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): the maximal passages of each document made of repeated windows.

    A window is ``size`` consecutive words (runs without white space, compared exactly); it repeats if at least two
    distinct doc_ids, of any type that has an order, hold it.  Windows that overlap or touch form one passage; start_word
    counts from 0, and first_doc_id is the least doc_id that holds any of the passage's windows.  Rows with null doc_id and
    texts that are null, empty or shorter than ``size`` words have no passages, nor has an empty table.  A row that repeats
    counts once; rows with one doc_id and different texts have passages of their own, which do not make each other repeat.
    Equal windows are all reported, none is preferred.  Texts are read whole, whatever their length; other columns, whatever
    their names, are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = bound_batches(docs).where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("h"))
    anchors = texts.select("doc", "h", F.inline(_anchors(size)("text")))
    by_anchor = Window.partitionBy("a")
    recurring = anchors.withColumn("least", F.min("doc").over(by_anchor)).withColumn("greatest", F.max("doc").over(by_anchor)).where("least < greatest")
    places = cut_lineage(recurring.groupBy("doc", "h").agg(F.sort_array(F.collect_set("pos")).alias("anchors")))
    held = int(places.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0])
    located = texts.join(small_side(places, 96 + 4 * held // max(1, places.count())), ["doc", "h"])
    segments = located.select("doc", "h", F.inline(_segments(size)("text", "anchors")))
    # Equal segments are merged as one, with the least and greatest of their documents; only the distinct ones meet by anchor.
    distinct = segments.groupBy("a", "seg").agg(F.min("doc").alias("least"), F.max("doc").alias("greatest"))
    blocks = distinct.select("a", "seg", _segment_key().alias("key"), "least", "greatest").repartition("a").sortWithinPartitions("a", "seg")
    found = cut_lineage(blocks.mapInArrow(_merge_blocks(size), f"a long, key binary, lo int, hi int, first {kind}"), "a", "key")
    members = segments.select("doc", "h", "a", "start", _segment_key().alias("key"))
    # what is found grows with the corpus, so both sides are always shuffled
    runs = members.join(found.hint("shuffle_hash"), ["a", "key"]).select("doc", "h", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"), "first")
    order = Window.partitionBy("doc", "h").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.repartition("doc", "h").distinct().withColumn("new", F.coalesce((F.col("lo") > reach + size).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = islands.groupBy("doc", "h", "island").agg(F.min("lo").alias("start_word"), (F.max("hi") - F.min("lo") + size).cast("int").alias("n_words"), F.min("first").alias("first_doc_id"))
    return passages.select(F.col("doc").alias("doc_id"), "start_word", "n_words", "first_doc_id")
