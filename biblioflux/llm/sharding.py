"""Proportional stratified interleaving of sources into shards.

Rows are shuffled by a seeded hash and ranked within their source; a row's stand is its rank as a share of the source.  All
rows in the order of their stands, cut into equal stretches, give shards that each hold every source's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflux.llm.arrow_text import column, cut_lineage, small_side, unused, without

SEED = "shards-1"
ROWS_PER_SHARD = 250
#: Hex digits of the shuffling hash that cut a source into parts which are ranked apart.
PART_DIGITS = 4
#: Stretches of the stands, at most, that are put in order apart.
STRETCHES = 1 << 20


def _before(counts: Column, window) -> Column:
    return F.coalesce(F.sum(counts).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def interleave(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD, seed: str = SEED) -> DataFrame:
    """docs plus ``shard`` (from 0) and ``position`` (from 1 within the shard).

    Rows of a source are shuffled by a seeded hash of doc_id and ranked; row r of n stands at (r - 1 + u) / n, with a u in
    (0, 1) from the source's own hash, so that sources of one row do not all stand in the middle.  All rows in the order of
    their stands are cut every ``rows_per_shard`` rows: all shards but the last have that many, and a source's rows in a
    shard follow its share of all rows.

    A null source is a source of its own.  Equal stands come in the order of source, hash and doc_id; rows equal in all of
    these (repeated rows) stand next to each other in any order.  A null doc_id is hashed by the row's other plain columns
    but ``text``, so that such rows are no one task's burden.  All rows and columns stay; ``shard`` and ``position`` in the
    input are replaced, other columns keep their values whatever their names.  Texts are carried whole and not looked at.
    An empty table stays empty.

    No source and no stretch of the result is ranked in one task: counts by the hash's first digits and by stretches of the
    stands give each part its offset.
    """
    base = docs.select(*without(docs, "shard", "position"))
    s, h, part, n, before, stand, stretch, ahead = (unused(x, base, docs) for x in ("s", "h", "part", "n", "before", "stand", "stretch", "ahead"))
    source = F.coalesce(F.concat(F.lit("="), column("source").cast("string")), F.lit(""))
    plain = [column(f.name) for f in base.schema if f.name.lower() not in ("text", "doc_id") and f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    own_id = F.coalesce(column("doc_id").cast("string"), F.concat(F.lit("?"), F.xxhash64(*plain).cast("string")))
    hashed = F.md5(F.concat(F.lit(seed + ":"), own_id))
    keyed = base.withColumn(s, source).withColumn(h, hashed).withColumn(part, F.substring(column(h), 1, PART_DIGITS))
    counts = cut_lineage(keyed.groupBy(s, part).agg(F.count(F.lit(1)).alias(n)))
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    by_source = Window.partitionBy(s)
    offsets = small_side(counts.select(s, part, _before(F.col(n), by_source.orderBy(part)).alias(before), F.sum(n).over(by_source).alias(n)), 96)
    pieces = max(1, min(STRETCHES, total // rows_per_shard))

    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(s, part).orderBy(h, column("doc_id"))) + F.col(before)
        u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ";"), F.col(s))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
        at = (rank.cast("double") - 1 + u) / F.col(n).cast("double")
        rows = rows.join(offsets, [s, part]).withColumn(stand, at)
        return rows.withColumn(stretch, F.least(F.floor(F.col(stand) * pieces), F.lit(pieces - 1)).cast("int"))

    # the first pass carries keys only, and gives each stretch its offset
    held = cut_lineage(ranked(keyed.select(s, h, part, column("doc_id"))).groupBy(stretch).agg(F.count(F.lit(1)).alias(ahead)))
    held = held.select(stretch, _before(F.col(ahead), Window.orderBy(stretch)).alias(ahead))
    place = F.row_number().over(Window.partitionBy(stretch).orderBy(stand, s, h, column("doc_id"))) + F.col(ahead) - 1
    out = ranked(keyed).join(small_side(held, 64), stretch).withColumn(ahead, place)
    shard, position = F.expr(f"{ahead} div {int(rows_per_shard)}"), (F.pmod(F.col(ahead), F.lit(int(rows_per_shard))) + 1).cast("int")
    return out.select(*[column(c) for c in base.columns], shard.alias("shard"), position.alias("position"))
