"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Expectation-maximisation over the counts of all vote
patterns estimates each labeller's votes given the hidden class, hence its accuracy, and the classes' shares.  The
posteriors of a bounded sample train a linear scorer over hashed features, which then scores every document.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from biblioflux.llm.arrow_text import bound_batches, concat, mix, row_chunks, text_buffer, unused, without, word_hashes, words

#: Bound of the sample that trains the scorer.
TRAIN_ROWS = 5000
HASH_BITS = 16
THRESHOLD = 0.5
GOOD, BAD, NONE = 0, 1, 2
LABELLERS = ("symbols", "word_ends", "shouting", "capitals", "stutter", "variety", "bare_words", "length", "word_length", "sentences")
PATTERNS = 3 ** len(LABELLERS)

_KIND = np.full(256, 3, np.uint8)  # 0 lower-case letter or part of a character beyond ASCII, 1 upper-case letter, 2 white space, 3 sign or digit
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[0x80:] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in ".,;:?'\"()-"]] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "*$%#&|@~^_=+<>/\\!"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def _pieces(arr: pa.Array):
    data, offsets = text_buffer(arr)
    starts, ends, rows = words(data, offsets)
    return data, offsets, starts, ends, rows, word_hashes(data, starts, ends)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def votes(arr: pa.Array) -> np.ndarray:
    """(rows, labellers) array of GOOD, BAD and NONE; rows without words have no votes but that on length."""
    data, offsets, starts, ends, rows, h = _pieces(arr)
    n = len(arr)
    byte_row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(byte_row * 4 + _KIND[data], minlength=4 * n).reshape(n, 4)
    signs = np.bincount(byte_row[_SIGNS[data]], minlength=n)
    ink = kinds[:, 0] + kinds[:, 1] + kinds[:, 3]
    n_words = np.bincount(rows, minlength=n)
    again = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=n)
    keys = np.unique((rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    distinct = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=n)
    letter = np.concatenate([[0], np.cumsum(_KIND[data] < 2)])
    bare = np.bincount(rows[letter[ends] == letter[starts]], minlength=n)
    stops = np.bincount(rows[_STOPS[data[ends - 1]]], minlength=n) if len(ends) else np.zeros(n, np.int64)
    ends_odd = np.bincount(rows[_ODD[data[ends - 1]]], minlength=n) if len(ends) else np.zeros(n, np.int64)
    tall = np.concatenate([[0], np.cumsum(_KIND[data] == 1)])
    capital = np.bincount(rows[(tall[ends] - tall[starts]) * 2 > ends - starts], minlength=n)
    ends_odd, capital = _share(ends_odd, n_words), _share(capital, n_words)
    odd = _share(kinds[:, 3] - signs, ink)
    upper = _share(kinds[:, 1], kinds[:, 0] + kinds[:, 1])
    stutter, variety, without = _share(again, n_words), _share(distinct, n_words), _share(bare, n_words)
    size, stop = _share(ink, n_words), _share(stops, n_words)
    some, many = n_words >= 10, n_words >= 60

    def vote(good, bad):
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    return np.stack(
        [
            vote(some & (odd < 0.02), some & (odd > 0.06)),
            vote(some & (ends_odd < 0.05), some & (ends_odd > 0.2)),
            vote(some & (upper < 0.12), some & (upper > 0.35)),
            vote(some & (capital < 0.1), some & (capital > 0.3)),
            vote(some & (stutter < 0.05), some & (stutter > 0.25)),
            vote(many & (variety > 0.3), many & (variety < 0.15)),
            vote(some & (without < 0.05), some & (without > 0.2)),
            vote(n_words >= 20, n_words < 2),
            vote(some & (size > 2.5) & (size < 9), some & ((size < 1.5) | (size > 14))),
            vote(many & (stop > 0.02) & (stop < 0.5), many & ((stop < 0.003) | (stop > 0.7))),
        ],
        axis=1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


@dataclasses.dataclass(frozen=True)
class LabelModel:
    """share of bad documents; given[c, j, v]: probability that a vote of labeller j in class c is v; posterior of bad, by pattern.

    That a labeller abstains says nothing about the class.
    """

    share: float
    given: np.ndarray
    posterior: np.ndarray

    @property
    def accuracy(self) -> dict[str, float]:
        """How often a labeller that votes is right."""
        right = (1 - self.share) * self.given[0, :, GOOD] + self.share * self.given[1, :, BAD]
        return dict(zip(LABELLERS, right.tolist()))


def fit_labels(counts: dict[int, int], rounds: int = 100, smoothing: float = 1.0) -> LabelModel:
    """EM over vote patterns and the number of documents that have each; it starts from 'bad if any labeller says so'."""
    k = len(LABELLERS)
    every = np.arange(PATTERNS)[:, None] // 3 ** np.arange(k) % 3
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in ids.tolist()], np.float64)
    bad = np.where((every[ids] == BAD).any(axis=1), 0.9, 0.05)
    share, given = 0.5, np.full((2, k, 2), 1 / 2)
    for _ in range(rounds if len(ids) else 0):
        weight = np.stack([n * (1 - bad), n * bad])
        for v in (GOOD, BAD):
            given[:, :, v] = weight @ (every[ids] == v)
        given = (given + smoothing) / (given + smoothing).sum(axis=2, keepdims=True)
        share = float((weight[1].sum() + smoothing) / (n.sum() + 2 * smoothing))
        old, bad = bad, _posterior(every[ids], share, given)
        if np.abs(bad - old).max() < 1e-9:
            break
    return LabelModel(share, given, _posterior(every, share, given))


def _posterior(v: np.ndarray, share: float, given: np.ndarray) -> np.ndarray:
    j = np.arange(v.shape[1])
    ratio = np.concatenate([np.log(given[1]) - np.log(given[0]), np.zeros((len(given[0]), 1))], axis=1)
    gap = np.log(share) - np.log(1 - share) + ratio[j, v].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def features(arr: pa.Array, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of the hashed features: byte trigrams and word shapes, as shares of the row's number of each."""
    data, offsets, starts, ends, rows, h = _pieces(arr)
    n, down = len(arr), np.uint64(64 - bits)
    d = data.astype(np.uint64)
    tri = (d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:] if len(d) > 2 else np.zeros(0, np.uint64)
    tri_row = np.repeat(np.arange(n), np.diff(offsets))
    inside = tri_row[: len(tri)] == tri_row[2:] if len(tri) else np.zeros(0, bool)
    tri, tri_row = tri[inside], tri_row[: len(inside)][inside]
    upper, letters = (np.concatenate([[0], np.cumsum(x)]) for x in (_KIND[data] == 1, _KIND[data] < 2))
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    shape = (np.minimum(ends - starts, 15) * 4 + np.minimum(upper[ends] - upper[starts], 3)) * 4 + np.minimum((ends - starts) - (letters[ends] - letters[starts]), 3)
    shape = (shape * 2 + same).astype(np.uint64) + np.uint64(1 << 32)
    out = []
    for row, value, total in ((tri_row, tri, np.bincount(tri_row, minlength=n)), (rows, shape, np.bincount(rows, minlength=n))):
        slot = (mix(value) >> down).astype(np.int64)
        keys, count = np.unique((row.astype(np.int64) << bits) | slot, return_counts=True)
        row = keys >> bits
        out.append((row, keys & ((1 << bits) - 1), count / total[row]))
    row, slot, value = (np.concatenate(x) for x in zip(*out))
    return row, slot, np.sqrt(value)


def fit_scorer(row: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, bits: int = HASH_BITS, steps: int = 150, rate: float = 0.05, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch Adam; deterministic."""
    used, at = np.unique(slot, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, s, mb, sb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    n = max(1, len(target))
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[at], minlength=len(target)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        gw = np.bincount(at, value * g[row], minlength=len(used)) / n + decay * w
        gb = g.sum() / n
        m, s = 0.9 * m + 0.1 * gw, 0.999 * s + 0.001 * gw**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        scale = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * scale * m / (np.sqrt(s) + 1e-9)
        b -= rate * scale * mb / (np.sqrt(sb) + 1e-9)
    full = np.zeros(1 << bits, np.float32)
    full[used] = w
    return full, float(b)


def _patterns():
    """Arrow UDF: text -> vote pattern."""

    @arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield concat([pa.array(pattern(votes(x)).astype(np.int32)) for x in row_chunks(arr)], pa.int32())

    return run


def _scores(weights: np.ndarray, bias: float, posterior: np.ndarray):
    """Arrow UDF: text -> posterior of good by the labellers, and the scorer's probability of good."""
    kind = pa.struct([("label", pa.float64()), ("quality", pa.float64())])

    @arrow_udf("struct<label:double,quality:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            parts = []
            for x in row_chunks(arr):
                row, slot, value = features(x)
                z = np.bincount(row, value * weights[slot], minlength=len(x)) + bias
                good = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                parts.append(pa.StructArray.from_arrays([pa.array(1 - posterior[pattern(votes(x))]), pa.array(good)], fields=list(kind)))
            yield concat(parts, kind)

    return run


def label_model(docs: DataFrame) -> LabelModel:
    """Votes of all rows of docs; only the number of rows of each pattern (at most PATTERNS) comes to the driver."""
    counted = bound_batches(docs).select(_patterns()(F.coalesce("text", F.lit(""))).alias("p")).groupBy("p").count()
    return fit_labels({r.p: r["count"] for r in counted.collect()})


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, np.ndarray, float]:
    """Label model of all rows, and the scorer trained on the ``train_rows`` distinct texts whose hash comes first."""
    model = label_model(docs)
    h = F.xxhash64(F.lit(7), "text")
    total = docs.count()
    share = min(1.0, 2.0 * train_rows / max(total, 1))
    few = docs.where("text is not null").select("text", h.alias("h"))
    if share < 1.0:  # so that the sort sees about twice the sample, whatever the input
        few = few.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = few.dropDuplicates(["h"]).orderBy("h").limit(train_rows).select("text").collect()  # a group of copies is one text of the sample
    arr = pa.array([r.text for r in rows], pa.string())
    del rows
    parts, target, done = [], [np.zeros(0)], 0
    for piece in row_chunks(arr):  # a piece at a time: what is kept is a few hundred features of each text
        row, slot, value = features(piece)
        parts.append(((row + done).astype(np.int32), slot.astype(np.int32), value.astype(np.float32)))
        target.append(1 - model.posterior[pattern(votes(piece))])
        done += len(piece)
    row, slot, value = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    weights, bias = fit_scorer(row, slot, value, np.concatenate(target))
    return model, weights, bias


def classify(docs: DataFrame, trained: tuple[LabelModel, np.ndarray, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus ``label`` (posterior of good by the labellers), ``quality`` (the scorer's) and ``keep``.

    Votes are counted over all rows; the scorer is trained on a bounded sample, unless given.  Null texts count as
    empty; texts without features get the scorer's bias; texts are read whole, whatever their length.  A quality that equals
    the threshold is kept.  An empty table gives a model without evidence and no rows.  All rows and columns stay; input
    columns named like the results are replaced, others keep their values whatever their names.  Repeated rows count in the
    votes as often as they occur, once in the sample; equal texts get equal results.
    """
    model, weights, bias = trained or train(docs)
    own = unused("q", docs)
    part = F.col(own)
    out = bound_batches(docs).withColumn(own, _scores(weights, bias, model.posterior)(F.coalesce("text", F.lit(""))))
    return out.select(*without(docs, "label", "quality", "keep"), part["label"].alias("label"), part["quality"].alias("quality"), (part["quality"] >= threshold).alias("keep"))
