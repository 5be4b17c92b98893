"""Duplicate bibliography entries and duplicate elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflux.functions import latex, people, similarity
from biblioflux.operators.order import cut_lineage, parted

MAX_ROUNDS = 100


def duplicate_pairs(entries: DataFrame, title: int = 95, both: int = 80, author: int = 80) -> DataFrame:
    """(pub_id, a, b), a before b: titles alike to ``title`` percent, or to ``both`` with ``author`` percent of last names shared.

    Lengths that cannot reach ``both`` are ruled out on the JVM before the subsequence is computed.
    """
    own = entries.select("pub_id", "ord", F.lower(F.trim("title")).alias("t"), people.loose_last_names(F.col("author")).alias("who")).where("t <> ''")
    own = parted(own, "pub_id")
    x, y = (own.select("pub_id", *[F.col(c).alias(f"{p}_{c}") for c in ("ord", "t", "who")]) for p in ("a", "b"))
    pairs = x.join(y, (x["pub_id"] == y["pub_id"]) & (F.col("a_ord") < F.col("b_ord")) & similarity.may_reach(F.col("a_t"), F.col("b_t"), both)).drop(y["pub_id"])
    s = F.round(100 * similarity.ratio(F.col("a_t"), F.col("b_t")))
    scored = pairs.withColumn("s", s).where(F.col("s") >= both)
    shared = 100 * people.overlap(F.col("a_who"), F.col("b_who")) >= author
    return scored.where((F.col("s") >= title) | shared).select("pub_id", F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def seed_groups(nodes: DataFrame, pairs: DataFrame, checkpoint=None) -> DataFrame:
    """(pub_id, ord, seed): greedy groups in document order. The first entry that no seed covers becomes a seed and
    covers its later duplicates, so groups are not transitive.

    In rounds: an undecided entry becomes a seed when all its earlier duplicates are covered, and entries with an
    earlier seed are covered; when none is left, each covered entry joins its first seed.  A chain of duplicates takes a
    round for every second link; one that MAX_ROUNDS do not settle is an error, not a guess.
    """
    checkpoint = checkpoint or cut_lineage
    pairs = checkpoint(pairs)
    touched = checkpoint(pairs.select("pub_id", F.explode(F.array("a", "b")).alias("ord")).distinct().withColumn("state", F.lit(0)))
    for _ in range(MAX_ROUNDS):
        if touched.where("state = 0").isEmpty():
            break
        before = pairs.join(touched.select("pub_id", F.col("ord").alias("a"), F.col("state").alias("sa")), ["pub_id", "a"]).groupBy("pub_id", F.col("b").alias("ord")).agg(F.max(F.when(F.col("sa") == 1, 1).otherwise(0)).alias("seeded"), F.max(F.when(F.col("sa") == 0, 1).otherwise(0)).alias("open"))
        now = touched.join(before, ["pub_id", "ord"], "left").na.fill(0, ["seeded", "open"])
        state = F.when(F.col("state") != 0, F.col("state")).when(F.col("seeded") == 1, 2).when(F.col("open") == 0, 1).otherwise(0)
        touched = checkpoint(now.select("pub_id", "ord", state.alias("state")))
    else:
        if not touched.where("state = 0").isEmpty():
            raise RuntimeError(f"duplicate groups did not settle in {MAX_ROUNDS} rounds")
    seeds = touched.where("state = 1").select("pub_id", F.col("ord").alias("a"))
    joined = pairs.join(seeds, ["pub_id", "a"], "left_semi").join(touched.where("state = 2").select("pub_id", F.col("ord").alias("b")), ["pub_id", "b"], "left_semi")
    member = joined.groupBy("pub_id", F.col("b").alias("ord")).agg(F.min("a").alias("seed"))
    return nodes.select("pub_id", "ord").join(member, ["pub_id", "ord"], "left").withColumn("seed", F.coalesce("seed", "ord"))


def key_score(key: Column, title: Column, author: Column, year: Column, venue: Column) -> Column:
    """How good a key and its entry are: complete fields, a name-and-year key, not too long."""
    has = lambda c, n: F.when(F.coalesce(c, F.lit("")) != "", n).otherwise(0)
    return has(title, 10) + has(author, 10) + has(year, 5) + has(venue, 3) + F.when(F.lower(key).rlike("^[a-z]+[0-9]{4}"), 5).otherwise(0) - F.when(F.length(key) > 30, 3).otherwise(0)


def merge_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """One entry per group: the best key, the longest title, all distinct authors, the first valid year, the most specific
    type and the first value of every other field; ``keys`` lists the group's keys in order."""
    entries = entries.withColumns({c: F.lit(None).cast("string") for c in ("journal", "booktitle") if c not in entries.columns})
    rows = entries.join(groups, ["pub_id", "ord"]).withColumn("_venue", F.coalesce("journal", "booktitle"))
    rows = rows.withColumn("_score", key_score(F.col("bib_key"), F.col("title"), F.col("author"), F.col("year"), F.col("_venue")))
    first = lambda c: F.expr(f"min_by({c}, ord) filter (where coalesce(trim({c}), '') <> '')").alias(c)
    rank = F.when(F.lower("entry_type").isin("article", "inproceedings"), 3).when(F.lower("entry_type").isin("book", "incollection"), 2).otherwise(1)
    other = [c for c in ("journal", "booktitle", "volume", "pages", "publisher", "doi", "eprint", "url", "note", "abstract") if c in entries.columns]
    merged = rows.groupBy("pub_id", "seed").agg(
        F.min_by("bib_key", F.struct(-F.col("_score"), F.length("bib_key"), "ord")).alias("bib_key"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "bib_key"))), lambda x: x["bib_key"]).alias("keys"),
        F.min_by("entry_type", F.struct(-rank, "ord")).alias("entry_type"),
        F.expr("min_by(title, struct(-length(title), ord)) filter (where coalesce(trim(title), '') <> '')").alias("title"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("author", F.lit("")).alias("author")))), lambda x: x["author"]).alias("_authors"),
        F.expr("min_by(year, ord) filter (where year rlike '[0-9]{4}')").alias("year"),
        *[first(c) for c in other],
    )
    names = F.filter(F.transform(F.flatten(F.transform("_authors", lambda a: F.split(a, r"\s+and\s+"))), lambda w: F.trim(w)), lambda n: n != "")
    lower = F.transform(names, F.lower)
    distinct = F.filter(names, lambda n, i: F.array_position(lower, F.lower(n)) == i + 1)
    return merged.withColumn("author", F.nullif(F.array_join(distinct, " and "), F.lit(""))).drop("_authors")


def rename_map(merged: DataFrame) -> DataFrame:
    """(pub_id, old_key, new_key) of the keys that groups gave up."""
    return merged.select("pub_id", F.explode("keys").alias("old_key"), F.col("bib_key").alias("new_key")).where("old_key <> new_key")


def rename_citations(texts: DataFrame, renames: DataFrame) -> DataFrame:
    """texts (pub_id, text, ..) with old keys of all citation commands replaced, in a column of its own; inputs stay as they are.

    A text with an old key has all its keys written without blanks; one without stays as it is.
    """
    table = renames.groupBy("pub_id").agg(F.map_from_entries(F.collect_list(F.struct("old_key", "new_key"))).alias("_m"))
    joined = texts.join(table, "pub_id", "left")
    command = r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{[^}]+\}"
    found = F.regexp_extract_all("text", F.lit(command), F.lit(0))
    head = lambda m: F.regexp_extract(m, r"^(.*\{)", 1)
    key = lambda k: F.coalesce(F.try_element_at("_m", F.trim(k)), F.trim(k))
    renamed = F.transform(found, lambda m: F.concat(head(m), F.array_join(F.transform(F.split(F.regexp_extract(m, r"\{([^}]+)\}$", 1), ","), key), ","), F.lit("}")))
    pieces = F.transform(F.split("text", command), lambda t, i: F.concat(t, F.coalesce(F.get(renamed, i), F.lit(""))))
    keys = F.flatten(F.transform(found, lambda m: F.split(F.regexp_extract(m, r"\{([^}]+)\}$", 1), ",")))
    old = F.exists(keys, lambda k: F.try_element_at("_m", F.trim(k)).isNotNull())
    return joined.withColumn("renamed_text", F.when(old, F.array_join(pieces, "")).otherwise(F.col("text"))).drop("_m")


#: Texts that stand for structure, and are no duplicates of each other.
CONSTANTS = ("Figure", "Table", "Itemize block", "Enumerate block")


def duplicate_elements(elements: DataFrame, text: str = "raw_text") -> DataFrame:
    """(pub_id, element_id, canonical_id): the first element of a publication with the same text in comparison form."""
    own = F.concat(F.lit("\u0000"), F.col("element_id").cast("string"))
    norm = F.when(F.col(text).isin(*CONSTANTS) | F.col(text).rlike("^Item [0-9]+$"), own).otherwise(latex.comparison_form(F.col(text)))
    first = F.first_value("element_id").over(Window.partitionBy("pub_id", "_n").orderBy("ord"))
    return elements.withColumn("_n", norm).withColumn("canonical_id", first).select("pub_id", "element_id", "canonical_id")


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between canonical elements, once each; an element whose duplicates had several parents keeps the last one's."""
    child = mapping.select("pub_id", F.col("element_id").alias("child_id"), F.col("canonical_id").alias("_c"))
    parent = mapping.select("pub_id", F.col("element_id").alias("parent_id"), F.col("canonical_id").alias("_p"))
    joined = edges.join(child, ["pub_id", "child_id"]).join(parent, ["pub_id", "parent_id"], "left")
    return joined.groupBy("pub_id", "version", F.col("_c").alias("child_id")).agg(F.max_by(F.coalesce("_p", "parent_id"), "child_id").alias("parent_id")).where("child_id <> parent_id")
