"""Exact search among vectors: all pairs are compared, block by block, and only the best ones leave a block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Rows of entries and of candidates that meet in a task, and rows of both in one product.
ENTRIES, CANDIDATES, TILE = 1 << 14, 1 << 15, (1 << 10, 1 << 13)
#: Scores further apart differ in their sixth place; single precision errs by less than MARGIN - TIE; what orders a score that is none.
TIE, MARGIN, NONE = 1.1e-6, 2e-5, -2.0


def _matrix(e: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of d numbers; where one is missing or of another length, NaN."""
    out = np.full((len(e), d), np.nan)
    sizes = np.diff(e.offsets.to_numpy()) if len(e) else np.array([], np.int64)
    good = (sizes == d) & e.is_valid().to_numpy(zero_copy_only=False)
    if len(e):
        flat, first = e.values.to_numpy(zero_copy_only=False), e.offsets.to_numpy()[:-1][good]
        out[good] = flat[first[:, None] + np.arange(d)] if good.any() else out[good]
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for i in range(m.shape[1]):
        total = total + m[:, i] * m[:, i]
    return np.sqrt(total)


def best_pairs(a: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, cosines) that hold the k best of each row of a by the cosine to six places, of equals those first in b.

    Products in single precision rule out what is more than MARGIN below the k-th best; what is left is summed up in double
    precision from the first number to the last.  Of equal sums k stay, so copies do not pile up.  A cosine that is none
    comes last, as NaN.
    """
    na, nb = _norms(a), _norms(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        ua, ub = ((m / n[:, None]).astype(np.float32) for m, n in ((a, na), (b, nb)))

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        dot = np.zeros(len(r))
        for i in range(a.shape[1]):
            dot = dot + a[r, i] * b[c, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(dot / (na[r] * nb[c]), copy=False, nan=NONE)

    for at in range(0, len(a), TILE[0]):
        x = ua[at : at + TILE[0]]
        rows = cols = np.array([], np.int64)
        score, least = np.array([]), np.full(len(x), -np.inf, np.float32)
        for of in range(0, len(b), TILE[1]):
            s = np.nan_to_num(x @ ub[of : of + TILE[1]].T, copy=False, nan=NONE)
            if not of and s.shape[1] >= k:
                least = np.partition(s, -k, axis=1)[:, -k] - np.float32(MARGIN)
            r, c = np.nonzero(s >= least[:, None])
            rows, cols, score = np.concatenate([rows, r]), np.concatenate([cols, c + of]), np.concatenate([score, exact(r + at, c + of)])
            order = np.lexsort((cols, -score, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            new = np.append(True, (rows[1:] != rows[:-1]) | (score[1:] != score[:-1]))[: len(rows)]
            start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) if len(rows) else np.array([], np.int64)
            keep = np.arange(len(rows)) - start < k
            rows, cols, score = rows[keep], cols[keep], score[keep]
            full = np.bincount(rows, minlength=len(x)) >= k
            floor = np.full(len(x), -np.inf)
            floor[full] = score[np.searchsorted(rows, np.arange(len(x)))[full] + k - 1]
            keep = score >= floor[rows] - TIE
            rows, cols, score = rows[keep], cols[keep], score[keep]
            least = np.maximum(least, (floor - MARGIN).astype(np.float32))
        yield rows + at, cols, np.where(score == NONE, np.nan, score)


def cosine_candidates(bib: DataFrame, cand: DataFrame, k: int = 5) -> DataFrame:
    """(bib_key, candidate_id, la, lb, score) of (bib_key, e, la) and (candidate_id, e, lb): of each entry's pairs with all candidates those
    that can be among its k best by ``score``, the cosine to six places; null where there is none.

    Entries and candidates are cut into blocks, every two of which meet in one task, of bounded size.
    """
    cores = cand.sparkSession.sparkContext.defaultParallelism
    i_parts = max(1, math.ceil(bib.count() / ENTRIES))
    j_parts = max(math.ceil(cand.count() / CANDIDATES), math.ceil(3 * cores / i_parts))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = bib.select(F.lit(True).alias("entry"), F.col("bib_key").alias("id"), "e", F.col("la").alias("l"), part("bib_key", i_parts).alias("i"), every(j_parts).alias("j"))
    y = cand.select(F.lit(False).alias("entry"), F.col("candidate_id").alias("id"), "e", F.col("lb").alias("l"), every(i_parts).alias("i"), part("candidate_id", j_parts).alias("j"))
    kinds = dict(x.dtypes)
    ddl = f"bib_key {kinds['id']}, candidate_id {kinds['id']}, la {kinds['l']}, lb {kinds['l']}, raw double"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(block: pa.Table) -> pa.Table:
        entry = block.column("entry").combine_chunks()
        a, b = block.filter(entry), block.filter(pc.invert(entry)).sort_by("id")
        e = [t.column("e").combine_chunks() for t in (a, b)]
        if not len(a) or not len(b):
            return schema.empty_table()
        d = max((int(np.diff(v.offsets.to_numpy()).max()) for v in e), default=0)
        found = list(best_pairs(*(_matrix(v, d) for v in e), k))
        rows, cols, score = (np.concatenate([f[n] for f in found]) for n in range(3))
        r, c = pa.array(rows), pa.array(cols)
        columns = [a.column("id").take(r), b.column("id").take(c), a.column("l").take(r), b.column("l").take(c), pa.array(score, mask=np.isnan(score))]
        return pa.table([x.cast(t) for x, t in zip(columns, schema.types)], schema=schema)

    met = x.unionByName(y).repartition(4 * i_parts * j_parts, "i", "j").groupBy("i", "j").applyInArrow(run, ddl)
    return met.select("bib_key", "candidate_id", "la", "lb", F.round("raw", 6).alias("score"))


def nearest_key(bib: DataFrame, cand: DataFrame) -> DataFrame:
    """(bib_key, candidate_id): of (bib_key, l) and (candidate_id, l) the candidate of the entry's label whose key is nearest, of two the lesser; keys are numbers."""
    both = bib.select("l", F.col("bib_key").alias("k"), F.lit(True).alias("entry")).unionByName(cand.select("l", F.col("candidate_id").alias("k"), F.lit(False).alias("entry"))).where("l is not null")
    w = Window.partitionBy("l").orderBy("k")
    own = F.when(~F.col("entry"), F.col("k"))
    below = F.last(own, True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.last(own, True).over(Window.partitionBy("l").orderBy(F.desc("k")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.when(F.col("above") - F.col("k") < F.col("k") - F.col("below"), F.col("above")).otherwise(F.coalesce("below", "above"))
    return both.withColumns({"below": below, "above": above}).where("entry").select(F.col("k").alias("bib_key"), near.alias("candidate_id")).where("candidate_id is not null")
