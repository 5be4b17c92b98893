"""Benchmark decontamination with a Wu-Manber multi-pattern search.

Patterns are the word windows of the benchmark's test strings.  A table over hashed blocks of the text says how far
the search may move on from a block; where it says 0, the block may end the common prefix length of a pattern, and
the bucket of that suffix hash holds the patterns to compare directly.  A text is searched from many starting points
at once, each of which moves on by its own shifts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from biblioflux.llm.arrow_text import CHUNK_BYTES, bound_batches, concat, list_array, row_chunks, text_buffer

WINDOW = 8
BLOCK = 8
TABLE_BITS = 22
LANE = 512
#: Bytes of patterns in one table; a larger benchmark is searched in several passes.
PATTERN_BYTES = 64 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: Column) -> Column:
    """Lower-case words of letters and digits, with one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def windows(text: str, n: int) -> list[str]:
    """The n-word windows of a plain text with spaces around them; all its words if there are fewer."""
    words = text.split()
    return [" " + " ".join(words[i : i + n]) + " " for i in range(max(1, len(words) - n + 1))] if words else []


class WuManber:
    def __init__(self, patterns: list[bytes], bits: int = TABLE_BITS):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = b = min(BLOCK, self.m)
        self.down = np.uint64(64 - bits)
        self.mask = np.uint64((1 << 8 * b) - 1)
        far = self.m - b + 1
        joined = np.frombuffer(b"".join(p[: self.m] for p in patterns) + bytes(8), np.uint8)
        heads = self._words(joined)
        starts = np.arange(len(patterns)) * self.m
        self.shift = np.full(1 << bits, far, np.int32)
        for j in range(far):  # the later a block stands, the smaller its shift
            self.shift[self._slot(heads[starts + j])] = far - 1 - j
        suffix = self._slot(heads[starts + far - 1]).astype(np.int64)
        order = np.argsort(suffix, kind="stable")
        self.bucket_of, first = np.unique(suffix[order], return_index=True)
        self.bucket_at = np.append(first, len(order))
        self.bucket = order

    @staticmethod
    def _words(data: np.ndarray) -> np.ndarray:
        """The 8 bytes at each position, as one little-endian number (data has 8 bytes of padding)."""
        return np.ndarray(len(data) - 7, "<u8", data.data if data.flags.c_contiguous else np.ascontiguousarray(data).data, 0, (1,))

    def _slot(self, word: np.ndarray) -> np.ndarray:
        return ((word & self.mask) * _GOLD) >> self.down

    def search(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern number) of every occurrence in data."""
        n, m = len(data), self.m
        at, which = [], []
        if n >= m:
            heads = self._words(np.frombuffer(data + bytes(8), np.uint8))
            pos = np.arange(0, n - m + 1, LANE)
            stop = np.minimum(pos + LANE, n - m + 1)
            tail = m - self.block
            found = []
            while len(pos):
                slot = self._slot(heads[pos + tail])
                step = self.shift[slot]
                zero = step == 0
                if zero.any():
                    found.append((pos[zero], slot[zero].astype(np.int64)))
                    step = np.where(zero, 1, step)
                pos = pos + step
                live = pos < stop
                pos, stop = pos[live], stop[live]
            if found:
                p, s = (np.concatenate(x) for x in zip(*found))
                b = np.searchsorted(self.bucket_of, s)
                for i, k in zip(p.tolist(), b.tolist()):
                    for c in self.bucket[self.bucket_at[k] : self.bucket_at[k + 1]].tolist():
                        if data.startswith(self.patterns[c], i):
                            at.append(i)
                            which.append(c)
        return np.array(at, np.int64), np.array(which, np.int64)


@functools.lru_cache(maxsize=2)
def _machine(patterns: tuple[bytes, ...]) -> WuManber:
    return WuManber(list(patterns))


def _finder(patterns: tuple[bytes, ...], items: np.ndarray, item_at: np.ndarray):
    """Arrow UDF: plain text -> for each item with an occurrence, its ordinal and its number of distinct windows found."""
    kind = pa.list_(pa.struct([("item", pa.int32()), ("windows", pa.int32())]))

    @arrow_udf("array<struct<item:int,windows:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(patterns)
        for arr in batches:
            parts = []
            for piece in row_chunks(arr, CHUNK_BYTES):
                data, offsets = text_buffer(piece)
                at, which = machine.search(data.tobytes())
                row = np.searchsorted(offsets, at, "right") - 1
                inside = at + np.array([len(patterns[c]) for c in which.tolist()], np.int64) <= offsets[row + 1]
                pairs = np.unique(np.stack([row[inside], which[inside]]), axis=1)
                rows, found = np.repeat(pairs[0], np.diff(item_at)[pairs[1]]), [items[item_at[c] : item_at[c + 1]] for c in pairs[1].tolist()]
                found = np.concatenate(found) if found else np.zeros(0, np.int64)
                both, n = np.unique(np.stack([rows, found]), axis=1, return_counts=True)
                lists = pa.StructArray.from_arrays([pa.array(both[1], pa.int32()), pa.array(n, pa.int32())], fields=list(kind.value_type))
                offs = np.zeros(len(piece) + 1, np.int32)
                np.cumsum(np.bincount(both[0], minlength=len(piece)), out=offs[1:])
                parts.append(pa.ListArray.from_arrays(pa.array(offs), lists))
            yield concat(parts, kind)

    return run


def _passes(benchmark: DataFrame, n: int) -> tuple[list, list[tuple[tuple[bytes, ...], np.ndarray, np.ndarray]]]:
    """Item ids by ordinal, and pattern sets of at most PATTERN_BYTES each: patterns, then their items' ordinals, cut at item_at."""
    rows = sorted({(r.item_id, r.t) for r in benchmark.where("text is not null").select("item_id", plain(F.col("text")).alias("t")).toLocalIterator()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ids = list(dict.fromkeys(r[0] for r in rows))
    number = {x: i for i, x in enumerate(ids)}
    owners: dict[bytes, set[int]] = {}
    for item, text in rows:
        for w in windows(text, n):
            owners.setdefault(w.encode(), set()).add(number[item])
    out, group, held = [], [], 0
    # patterns of like length share a table, so that one short test string does not shorten every shift
    for p in sorted(owners, key=lambda p: (len(p), p)):
        if group and (held + len(p) > PATTERN_BYTES or (len(group[0]) < 2 * BLOCK <= len(p) // 2)):
            out.append(group)
            group, held = [], 0
        group.append(p)
        held += len(p)
    sets = []
    for group in [*out, *([group] if group else [])]:
        cut = np.cumsum([0, *(len(owners[p]) for p in group)])
        sets.append((tuple(group), np.array([i for p in group for i in sorted(owners[p])], np.int64), cut))
    return ids, sets


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, windows): for each row of docs and each test string, the number of distinct n-word windows of it found.

    A test string of under n words is one window.  Only pairs with a hit are returned, one for each row of docs (rows
    that repeat, repeat).  Case, punctuation and spacing do not count; words match whole.  Null and empty texts on
    either side match nothing, nor does an empty table on either side; null doc_ids and item_ids, of any type, are kept; test
    strings that repeat under one item_id count once, and a window of several items counts for each.  Texts are searched
    whole, whatever their length.  Other columns, whatever their names, are not looked at.
    The benchmark is read to the driver, since it does not grow with the corpus; whatever its size, a pass holds at most
    PATTERN_BYTES of patterns.
    """
    ids, sets = _passes(benchmark, n)
    kind = benchmark.schema["item_id"].dataType
    if not sets:
        return docs.select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("windows")).where("false")
    text = bound_batches(docs).select("doc_id", plain(F.col("text")).alias("t"))
    found = F.concat(*[_finder(*s)(F.coalesce("t", F.lit(""))) for s in sets])
    pairs = text.select("doc_id", found.alias("f"))
    if len(sets) > 1:  # windows of an item may lie in several sets
        total = F.aggregate(F.filter("f", lambda x: x["item"] == F.col("i")), F.lit(0), lambda a, x: a + x["windows"])
        pairs = pairs.select("doc_id", "f", F.explode(F.array_distinct(F.transform("f", lambda x: x["item"]))).alias("i")).select("doc_id", F.col("i").alias("item"), total.alias("windows"))
    else:  # a filter on the list would search twice; rows without hits have nothing to unnest
        pairs = pairs.select("doc_id", F.inline("f"))
    names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item int, item_id {kind.simpleString()}")
    return pairs.join(F.broadcast(names) if len(ids) <= 1_000_000 else names, "item").select("doc_id", "item_id", "windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs without the rows in which ``contaminated`` finds a window of any test string; all columns keep their values, and null and empty texts stay."""
    _, sets = _passes(benchmark, n)
    out = bound_batches(docs)
    for s in sets:
        out = out.where(F.size(_finder(*s)(F.coalesce(plain(F.col("text")), F.lit("")))) == 0)
    return out
