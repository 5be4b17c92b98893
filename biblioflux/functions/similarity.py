"""Edit similarities.

The score is the Indel ratio: twice the longest common subsequence over both lengths, in percent, rounded half to even.
The subsequence is computed by a bit-parallel kernel over Arrow batches; predicates that cannot lose a match
(``may_reach``) run before it, on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row at a time (Hyyro's recurrence)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def percent(a: str, b: str) -> int:
    """Indel ratio in percent; 0 where either text is empty."""
    if not a or not b:
        return 0
    return round(100 * (2.0 * lcs_length(a, b) / (len(a) + len(b))))


def best_window_percent(a: str, b: str) -> int:
    """Largest ``percent`` of the shorter text against windows of the longer one of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    n = len(a)
    return max(percent(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def set_percent(a: str, b: str) -> int:
    """Best ``percent`` among the shared words alone, and these followed by each side's own, of words parted by single spaces; 0 where either has none."""
    if not a or not b:
        return 0
    x, y = set(a.split(" ")), set(b.split(" "))
    both = " ".join(sorted(x & y))
    with_a, with_b = (f"{both} {' '.join(sorted(own))}".strip(" ") for own in (x - y, y - x))
    return max(percent(both, with_a), percent(both, with_b), percent(with_a, with_b))


#: Pairs that a kernel remembers from batch to batch, and the most characters of such a pair.
REMEMBERED, MAX_CHARS = 1 << 16, 1000


def each_distinct(f, x: pa.Array, y: pa.Array, seen: dict) -> np.ndarray:
    """f of each row of two text arrays, null as '', called once for each distinct pair; ``seen`` holds results of earlier batches."""
    x, y = (pc.fill_null(c, "").dictionary_encode() for c in (x, y))
    a, b = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    n = max(1, len(b))
    codes, at = np.unique(x.indices.to_numpy().astype(np.int64) * n + y.indices.to_numpy(), return_inverse=True)
    out = []
    for c in codes.tolist():
        p = a[c // n], b[c % n]
        if (v := seen.get(p)) is None:
            v = f(*p)
            if len(p[0]) + len(p[1]) <= MAX_CHARS:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[p] = v
        out.append(v)
    return np.array(out)[at] if out else np.array([])


def kernel(f, kind: str = "int"):
    """Maker of a function of two text columns that computes f(a, b) once for each distinct pair of a batch, or of several."""
    to = {"int": pa.int32(), "double": pa.float64()}[kind]

    def make():
        @arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            seen: dict = {}
            for x, y in batches:
                yield pa.array(each_distinct(f, x, y, seen), to)

        return run

    return make


_percent = kernel(percent)
_window = kernel(best_window_percent)
_set = kernel(set_percent)


def ratio(a: Column, b: Column) -> Column:
    """Indel ratio of two texts, 0 to 1; equal and empty ones do not reach Python's kernel twice."""
    return _percent()(a, b) / 100


def partial_ratio(a: Column, b: Column) -> Column:
    return _window()(a, b) / 100


def ratio_hof(a: Column, b: Column) -> Column:
    """``ratio`` without Python, quadratic in interpreted steps: a cross-check for short texts."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.size(y)), lambda _: F.lit(0))

    def row(prev: Column, c: Column) -> Column:
        start = F.array(F.lit(0))
        step = lambda acc, i: F.concat(acc, F.array(F.when(F.get(y, i - 1) == c, F.get(prev, i - 1) + 1).otherwise(F.greatest(F.get(prev, i), F.element_at(acc, -1)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), start, step)

    lcs = F.element_at(F.aggregate(x, zero, row), -1)
    return F.when((a != "") & (b != ""), F.bround(100 * (2.0 * lcs / (F.length(a) + F.length(b)))) / 100).otherwise(0.0)


def may_reach(a: Column, b: Column, t: int) -> Column:
    """False only if the lengths rule out a score of at least t percent."""
    la, lb = F.length(a), F.length(b)
    return (la > 0) & (lb > 0) & (200.0 * F.least(la, lb) / (la + lb) >= t - 0.5)


def fuzz_words(c: Column) -> Column:
    """Sorted words of a text as the token scores see it: lower case, signs as spaces, no U+0080..U+00FF."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\x{80}-\x{FF}]", "")
    return F.array_sort(F.filter(F.split(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != ""))


def token_sort(a: Column, b: Column) -> Column:
    """Ratio of the sorted words; takes results of ``fuzz_words``."""
    return ratio(F.array_join(a, " "), F.array_join(b, " "))


def token_set(a: Column, b: Column) -> Column:
    """Best ratio among the shared words alone, and these followed by each side's own; takes results of ``fuzz_words``."""
    return _set()(F.array_join(a, " "), F.array_join(b, " ")) / 100
