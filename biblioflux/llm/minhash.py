"""Near-dedup with ProbMinHash signatures of weighted shingles.

Every distinct shingle of a document, weighted by its count, is a Poisson process of arrivals with that rate; an
arrival picks a register and claims it if it is the earliest there.  A process ends once its next arrival is later
than the latest register, so most shingles of a long text are looked at once.  Two signatures agree in a register
with the probability Jaccard similarity of the documents.  Bands of registers give candidates, whose similarity is
then computed exactly; groups are the connected components of the pairs that qualify.
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

from biblioflux.llm.arrow_text import bound_batches, concat, cut_lineage, list_array, mix, release, row_chunks, small_side, text_buffer, unused, window_hashes, word_hashes, words

SHINGLE = 3
BANDS = 32
ROWS = 3
THRESHOLD = 0.5
#: Shingles of a band's members, as counted with repeats among members, that are compared within one part of it.
PART_SHINGLES = 1 << 20

_TOP = np.uint64(20)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(arr: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, 44-bit hashes and counts of the distinct k-word shingles, ordered by row and hash.

    Words are lower-case runs without white space.  A row of 1 to k-1 words has one shingle, all its words; a row
    without words has none.
    """
    data, offsets = text_buffer(pc.utf8_lower(arr.fill_null("")))
    starts, ends, rows = words(data, offsets)
    h = word_hashes(data, starts, ends)
    w = window_hashes(h, k)
    inside = rows[: len(w)] == rows[k - 1 :] if len(w) else np.zeros(0, bool)
    row, value = rows[: len(w)][inside], w[inside]
    n_words = np.bincount(rows, minlength=len(arr))
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(few):
        first = np.searchsorted(rows, few)
        row = np.concatenate([row, few])
        value = np.concatenate([value, [mix(np.bitwise_xor.reduce(h[a : a + n] * np.arange(1, 2 * n, 2, dtype=np.uint64), keepdims=True))[0] for a, n in zip(first, n_words[few])]]).astype(np.uint64)
    keys = np.sort((row.astype(np.uint64) << np.uint64(44)) | (value >> _TOP))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), counts


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) array: the shingle that claimed each register; rows without shingles hold 0."""
    q = np.full(n * m, np.inf)
    z = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    seed = mix(value * _GOLD + np.uint64(1))
    at, step, burst = np.zeros(len(row)), 0, 1
    while len(row):
        for j in range(burst):
            tick = mix(seed + np.uint64((step + j + 1) * int(_GOLD) & (1 << 64) - 1))
            at = at - np.log(_uniform(tick)) / weight
            slot = row * m + ((mix(tick ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            hit = np.flatnonzero(at < q[slot])
            if len(hit):
                s, a = slot[hit], at[hit]
                np.minimum.at(q, s, a)
                won = a == q[s]
                z[s[won]] = value[hit[won]]
        step += burst
        touched = np.unique(row)
        latest[touched] = q.reshape(n, m)[touched].max(axis=1)
        live = np.flatnonzero(at < latest[row])
        row, value, weight, seed, at = row[live], value[live], weight[live], seed[live], at[live]
        burst = 1 if len(live) > 50_000 else 8
    return z.reshape(n, m)


def signature_bands(k: int, bands: int, rows: int):
    """Arrow UDF: text -> one 64-bit hash per band; null for texts without words."""

    @arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.int64())
        for arr in batches:
            parts = []
            for piece in row_chunks(arr):
                row, value, weight = shingles(piece, k)
                z = signatures(row, value, weight.astype(np.float64), len(piece), bands * rows).reshape(len(piece), bands, rows)
                out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(piece), 1))
                for r in range(rows):
                    out = mix(out + z[:, :, r] * np.uint64(0x9E3779B97F4A7C55))
                empty = np.ones(len(piece), bool)
                empty[row] = False
                lists = list_array(out.view(np.int64).ravel(), np.full(len(piece), bands), pa.int64())
                parts.append(pc.if_else(pa.array(empty), pa.scalar(None, kind), lists))
            yield concat(parts, kind)

    return run


def shingle_vectors(k: int):
    """Arrow UDF: text -> struct of ascending shingle hashes and their counts."""
    kind = pa.struct([("h", pa.list_(pa.int64())), ("w", pa.list_(pa.int32()))])

    @arrow_udf("struct<h:array<bigint>,w:array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            parts = []
            for piece in row_chunks(arr):
                row, value, weight = shingles(piece, k)
                counts = np.bincount(row, minlength=len(piece))
                parts.append(pa.StructArray.from_arrays([list_array(value.astype(np.int64), counts, pa.int64()), list_array(weight.astype(np.int32), counts, pa.int32())], fields=list(kind)))
            yield concat(parts, kind)

    return run


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i), exactly, in n log n."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    a, b = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = float(wa.sum() - a.sum()), float(wb.sum() - b.sum())
    order = np.argsort(a / b, kind="stable")
    ratio = (a / b)[order]
    a, b = a[order], b[order]
    below = np.searchsorted(ratio, ratio, "left")  # elements of a smaller ratio are larger on b's side
    sum_b = np.concatenate([[0.0], np.cumsum(b)])[below] + only_b
    sum_a = a.sum() - np.concatenate([[0.0], np.cumsum(a)])[below] + only_a
    return float((1.0 / (sum_a / a + sum_b / b)).sum())


def _similarity():
    @arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def parts(s):
            out = []
            for f in ("h", "w"):
                x = s.field(f)
                out.append((x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)))
            return out

        for left, right in batches:
            (ha, oa), (wa, _) = parts(left)
            (hb, ob), (wb, _) = parts(right)
            yield pa.array([probability_jaccard(ha[oa[i] : oa[i + 1]], wa[oa[i] : oa[i + 1]], hb[ob[i] : ob[i + 1]], wb[ob[i] : ob[i + 1]]) for i in range(len(left))], pa.float64())

    return run


def linked(h: np.ndarray, w: np.ndarray, offsets: np.ndarray, root: np.ndarray, part: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows of at least the threshold that join all rows which such pairs join, given that rows of one root are joined.

    h, w: shingles and counts of all rows, ascending in each, cut by offsets.  Where rows are of two parts only pairs of
    different ones are looked at.  If rows share shingles of mass X in one and Y in the other, their similarity is at most
    1 / (1/X + 1/Y - 1).  So both masses are at least t, and one is at least 2t / (1 + t); with shingles in one order, rare
    ones first, the first that they share has at most the rest before it.  No pair is given up by that.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    _, code, held = np.unique(h, return_inverse=True, return_counts=True)
    mass = w / np.bincount(row, w, n)[row]
    order = np.lexsort((code, held[code], row))
    run = np.cumsum(mass[order])
    before = run - mass[order] - (run - mass[order])[offsets[:-1]][row]
    light = (held[code[order]] > 1) & (before <= 1 - threshold + 1e-9)
    heavy = light & (before <= (1 - threshold) / (1 + threshold) + 1e-9)
    by_code = np.argsort(code[order][light], kind="stable")
    posted = row[light][by_code]
    post = np.searchsorted(code[order][light][by_code], np.arange(len(held) + 1))
    mine, start = code[order][heavy], np.searchsorted(row[heavy], np.arange(n + 1))
    two, root, share = len(np.unique(part)) > 1, root.copy(), np.zeros(len(held))
    found = []
    for i in np.flatnonzero(np.diff(start)).tolist():
        near = np.unique(np.concatenate([posted[post[c] : post[c + 1]] for c in mine[start[i] : start[i + 1]].tolist()]))
        near = near[(root[near] != root[i]) & ((part[near] != part[i]) | (not two))]
        if not len(near):
            continue
        own = slice(offsets[i], offsets[i + 1])
        share[code[own]] = mass[own]
        total = np.cumsum(size[near])
        at = np.arange(int(total[-1])) + np.repeat(offsets[near] - (total - size[near]), size[near])
        x = share[code[at]]
        share[code[own]] = 0
        x, y = np.add.reduceat(x, total - size[near]), np.add.reduceat(np.where(x > 0, mass[at], 0), total - size[near])
        for j in near[1 / x + 1 / y <= 1 + 1 / threshold + 1e-9].tolist():
            other = slice(offsets[j], offsets[j + 1])
            if root[j] != root[i] and probability_jaccard(h[own], w[own], h[other], w[other]) >= threshold:
                found.append((i, j))
                root[root == root[j]] = root[i]
    return found


def _linked(threshold: float):
    """Arrow batches (band, p, q, part, id, root, v), sorted by (band, p, q) -> (a, b), the pairs that ``linked`` gives of each (band, p, q)."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        get = lambda c: whole.column(c).combine_chunks()
        v, ids = get("v"), get("id")
        lists = v.field("h")
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        root = get("root").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        pairs = np.array(linked(lists.flatten().to_numpy(zero_copy_only=False), v.field("w").flatten().to_numpy(zero_copy_only=False).astype(np.float64), offsets, root, get("part").to_numpy(zero_copy_only=False), threshold), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), ids.take(pa.array(pairs[:, 1]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "p", "q")])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if last is not None and (keys[:, 0] != last).any():
                new = np.concatenate([[0], new])
            lo = 0
            for cut in new.tolist():
                if cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                yield flush(held)
                held, lo = [], cut
            held.append(batch.slice(lo))
            last = keys[:, -1]
        if held:
            yield flush(held)
        release()

    return run


def _across(split: DataFrame, vectors: DataFrame, threshold: float, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Pairs (a, b) of members (band, id, root) that share a band, of at least the threshold, which join all that such pairs join.

    A band's members meet in one task, where they have up to part_shingles shingles; those of a larger band are dealt into
    parts, of which each two meet.
    """
    sized = cut_lineage(split.join(vectors.select("id", F.size("v.h").alias("k")), "id").withColumn("parts", F.ceil(F.sum("k").over(Window.partitionBy("band")) / part_shingles).cast("int")).drop("k"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("band", F.least("part", "o").cast("int").alias("p"), F.greatest("part", "o").cast("int").alias("q"), "part", "id", "root")
    met = cells.join(vectors.hint("shuffle_hash"), "id").select("band", "p", "q", "part", "id", "root", "v").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    kind = split.schema["id"].dataType.simpleString()
    return cut_lineage(met.mapInArrow(_linked(threshold), f"a {kind}, b {kind}"))


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose similarity is at least the threshold."""
    b = pairs.join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    both = b.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    return both.withColumn("s", _similarity()("va", "vb")).where(F.col("s") >= threshold).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root) for every id in the edges (a, b): root is the least id of its connected component.

    Alternating large-star and small-star rounds, each cut by a checkpoint, until nothing changes.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", m)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        pairs = cut_lineage(small)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, group_id, group_size) of every document in a group of at least two near or exact copies.

    Documents are the distinct doc_ids, of any type that has an order; group_id is the least doc_id of the group.  Two
    documents are linked if their probability Jaccard similarity over k-word shingles is at least ``threshold`` (equal to it
    counts) and they share a band; a group is a connected component.  Rows with null doc_id, and null, empty and blank texts,
    are in no group; an empty table has none.  A doc_id that repeats counts once, with the shingles of all its texts.  Texts
    are read whole, whatever their length; other columns, whatever their names, are not looked at.
    """
    texts = bound_batches(docs).where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    exact = F.unhex(F.md5("text"))
    sketch = cut_lineage(texts.select("id", exact.alias("e"), signature_bands(k, bands, rows)("text").alias("bands")).where("bands is not null"), "e")
    # Only the first of identical texts is compared further.
    alike = cut_lineage(sketch.groupBy("e").agg(F.min("id").alias("a"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("n")))
    copies = cut_lineage(sketch.select("id", "e").join(alike.where("n > 1").select("e", "a"), "e").where("a <> id").select("a", "id").distinct())
    first = alike.select(F.col("a").alias("id"), F.explode("bands").alias("band"))
    in_band = Window.partitionBy("band")
    shared = cut_lineage(first.distinct().withColumn("n", F.count(F.lit(1)).over(in_band)).withColumn("a", F.min("id").over(in_band)).where("n > 1").drop("n"))
    stars = cut_lineage(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct())
    wanted = cut_lineage(shared.select("id").distinct())
    vectors = cut_lineage(texts.join(small_side(wanted, 8), "id", "left_semi").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text")).select("id", shingle_vectors(k)("text").alias("v")))
    links = cut_lineage(_verified(stars, vectors, threshold))
    # Members of a band that the first pass did not put together are compared with one another: no pair is given up.
    root = components(links)
    placed = shared.join(root, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    split = placed.withColumn("r", F.min("root").over(in_band)).withColumn("r2", F.max("root").over(in_band)).where("r <> r2").select("band", "id", "root")
    more = _across(split, vectors, threshold)
    # Exact copies follow the first of their text; only documents of several texts can tie groups together.
    several = cut_lineage(sketch.select("id", "e").distinct().groupBy("id").count().where("count > 1").select("id"))
    ties = copies.join(several, "id", "left_semi").select("a", F.col("id").alias("b"))
    joined = cut_lineage(components(links.unionByName(more).unionByName(ties)))
    led = copies.join(several, "id", "left_anti").join(joined.select(F.col("id").alias("a"), "root"), "a", "left")
    followers = led.select("id", F.coalesce("root", "a").alias("root"))
    heads = led.where("root is null").select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    groups = joined.unionByName(followers).unionByName(heads)
    return groups.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), F.count(F.lit(1)).over(Window.partitionBy("root")).alias("group_size"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without the later members of each group of ``near_groups``: the least doc_id stays.

    All columns keep their values, whatever their names; rows that are in no group stay, those with null doc_id or null,
    empty or blank text among them.  Of rows with one doc_id (all one document) the one whose text sorts first stays, of
    equal texts any.  An empty table stays empty.
    """
    groups = near_groups(docs, threshold, k, bands, rows)
    gone, again, rank = (unused(x, docs) for x in ("gone", "again", "rank"))
    later = cut_lineage(groups.where("doc_id <> group_id").select(F.col("doc_id").alias(gone)))
    kept = docs.join(small_side(later, 8), F.col("doc_id") == F.col(gone), "left_anti")
    repeated = cut_lineage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(rank)).where(F.col(rank) > 1).select(F.col("doc_id").alias(again)))
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(again)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    one = kept.join(repeated, same, "left_semi").withColumn(rank, order).where(F.col(rank) == 1).drop(rank)
    return kept.join(repeated, same, "left_anti").unionByName(one)
