"""Candidate pairs, their labels, and their splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflux.functions import identifiers, people, similarity, text
from biblioflux.operators.order import numbered, parted

QUERY = ["pub_id", "bib_key"]


def make_pairs(bib: DataFrame, cand: DataFrame) -> DataFrame:
    """All pairs of entry and candidate of one publication: an equi-join on pub_id, so an empty side gives no pairs."""
    return bib.join(cand, "pub_id")


def make_small_pairs(bib: DataFrame, cand: DataFrame) -> DataFrame:
    """``make_pairs`` of many small publications: both sides are parted by publication, so that scoring the pairs keeps all cores at work."""
    return make_pairs(parted(bib, "pub_id"), parted(cand, "pub_id"))


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """One row: publications, pairs, mean entries and candidates per publication, and negatives per positive (n - 1)."""
    per = pairs.groupBy("pub_id").agg(F.countDistinct("bib_key").alias("m"), F.countDistinct("candidate_id").alias("n"), F.count(F.lit(1)).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("publications"), F.sum("p").alias("pairs"), F.avg("m").alias("avg_m"), F.avg("n").alias("avg_n"), (F.avg("n") - 1).alias("imbalance"))


def title_statistics(bib: DataFrame, cand: DataFrame) -> DataFrame:
    """(pub_id, ratio, exact): over all pairs of a publication the mean ``length_ratio`` of (raw), and the number of equal (norm) that are not empty.

    Both depend on how many entries and candidates have a number of words, or a title: pairs of these are made, none of rows.
    """
    of = lambda side, n, key: side.groupBy("pub_id", key).agg(F.count(F.lit(1)).alias(n))
    words = lambda side, key: side.select("pub_id", text.word_count(F.col("raw")).alias(key))
    met = of(words(bib, "x"), "m", "x").join(of(words(cand, "y"), "n", "y"), "pub_id").withColumn("w", F.col("m") * F.col("n"))
    ratio = met.groupBy("pub_id").agg((F.sum(text.count_ratio(F.col("x"), F.col("y")) * F.col("w")) / F.sum("w")).alias("ratio"))
    same = of(bib, "m", "norm").join(of(cand, "n", "norm"), ["pub_id", "norm"]).where("norm <> ''").groupBy("pub_id").agg(F.sum(F.col("m") * F.col("n")).alias("exact"))
    return ratio.join(same, "pub_id", "left").na.fill(0, ["exact"])


def auto_label(bib_title: Column, cand_title: Column, bib_year: Column, cand_year: Column, bib_author: Column, cand_author: Column) -> Column:
    """1 where titles (over 10 characters) are equal, or 90 % alike within a year, or 80 % alike with 60 % of last names
    shared; null otherwise: similarity never labels a pair as wrong."""
    a, b = text.normalize_keep_signs(bib_title), text.normalize_keep_signs(cand_title)
    long = (F.length(a) > 10) & (F.length(b) > 10)
    score = F.when(long & similarity.may_reach(a, b, 80), similarity.ratio(a, b))
    near = F.abs(identifiers.any_year(bib_year) - identifiers.any_year(cand_year)) <= 1
    shared = people.overlap(people.loose_last_names(bib_author), people.loose_last_names(cand_author)) >= 0.6
    return F.when(score >= 1.0, 1).when((score >= 0.9) & near, 1).when((score >= 0.8) & shared, 1)


def auto_label_batch(pairs: DataFrame, manual: DataFrame, target: float | None = None) -> DataFrame:
    """(pub_id, bib_key, candidate_id): the first candidate with label 1 of each entry that has no manual label.

    With ``target``, the strict limit: labelling stops once floor(target x pairs without manual label) entries are labelled
    (but not before the first), in the order of publication and key.
    """
    free = pairs.join(manual, QUERY, "left_anti")
    first = F.expr("min_by(candidate_id, cand_ord) filter (where label = 1)")
    found = free.groupBy(*QUERY).agg(first.alias("candidate_id")).where("candidate_id is not null")
    return found if target is None else found.orderBy(*QUERY).limit(max(1, int(free.count() * target)))


def merge_labels(pairs: DataFrame, manual: DataFrame, auto: DataFrame) -> DataFrame:
    """pairs plus ``label`` (1 or 0) and ``origin``: a manual label of an entry decides all its pairs, else an automatic one, else 0."""
    m = manual.select(*QUERY, F.col("candidate_id").alias("_m"))
    a = auto.select(*QUERY, F.col("candidate_id").alias("_a"))
    both = pairs.drop("label", "origin").join(m, QUERY, "left").join(a, QUERY, "left")
    hit = lambda c: (F.col("candidate_id") == F.col(c)).cast("int")
    origin = F.when(F.col("_m").isNotNull(), "manual").when(F.col("_a").isNotNull(), "auto").otherwise("none")
    return both.withColumns({"label": F.coalesce(hit("_m"), hit("_a"), F.lit(0)), "origin": origin}).drop("_m", "_a")


def ground_truth(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """(pub_id, bib_key, candidate_id): one true candidate per entry, manual before automatic."""
    both = manual.select(*QUERY, "candidate_id", F.lit(0).alias("_o")).unionByName(auto.select(*QUERY, "candidate_id", F.lit(1).alias("_o")))
    return both.groupBy(*QUERY).agg(F.min_by("candidate_id", F.struct("_o", "candidate_id")).alias("candidate_id"))


def add_manual_label(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels with those of ``new`` in place of, or beside, the old ones."""
    return labels.join(new, QUERY, "left_anti").unionByName(new.select(*labels.columns))


def label_gate(labels: DataFrame, min_publications: int = 5, min_labels: int = 20) -> DataFrame:
    """One row: publications, labels, and whether there are enough of both."""
    n = labels.agg(F.countDistinct("pub_id").alias("publications"), F.count(F.lit(1)).alias("labels"))
    return n.withColumn("status", F.when((F.col("publications") >= min_publications) & (F.col("labels") >= min_labels), "PASS").otherwise("FAIL"))


def label_statistics(pairs: DataFrame) -> DataFrame:
    """One row: labelled entries by origin and the automatic share of publications without manual labels; null if there are none."""
    per = pairs.groupBy("pub_id").agg(F.max((F.col("origin") == "manual").cast("int")).alias("m"), F.max((F.col("origin") == "auto").cast("int")).alias("a"))
    return per.agg(F.sum("m").alias("manual_publications"), F.sum(F.when(F.col("m") == 0, F.col("a")).otherwise(0)).alias("auto_publications"), F.expr("try_divide(100.0 * sum(if(m = 0, a, 0)), sum(if(m = 0, 1, 0)))").alias("auto_percent"))


def with_words(side: DataFrame, prefix: str) -> DataFrame:
    """side plus the words that ``suggest_labels`` compares, found once per row and not once per pair."""
    return side.withColumns({f"{prefix}_{c}_words": similarity.fuzz_words(F.col(f"{prefix}_{c}")) for c in ("title", "author")})


def suggest_labels(pairs: DataFrame, top_n: int = 3) -> DataFrame:
    """The top candidates of each entry by 0.7 sorted-title and 0.3 author-set similarity, in percent; sides may come from ``with_words``."""
    words = lambda c: F.col(f"{c}_words") if f"{c}_words" in pairs.columns else similarity.fuzz_words(F.col(c))
    score = 70 * similarity.token_sort(words("bib_title"), words("cand_title")) + 30 * similarity.token_set(words("bib_author"), words("cand_author"))
    rank = F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.desc("score"), "cand_ord"))
    return pairs.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top_n)


def is_accepted(threshold: float = 85) -> Column:
    return (F.col("rank") == 1) & (F.col("score") >= threshold)


def auto_accept(suggestions: DataFrame, threshold: float = 85) -> DataFrame:
    return suggestions.where(is_accepted(threshold)).select(*QUERY, "candidate_id")


def labelling_candidates(bib: DataFrame, cand: DataFrame, least: int = 20, publications: DataFrame | None = None) -> DataFrame:
    """(pub_id, m, n, potential, status) of each publication, those with most potential labels first.

    publications (pub_id, has_candidates, has_entries) tells of the files: with it, a publication whose file is missing is
    told from one whose file is empty, and one without any rows is listed too.
    """
    m = bib.groupBy("pub_id").agg(F.count(F.lit(1)).alias("m"))
    n = cand.groupBy("pub_id").agg(F.count(F.lit(1)).alias("n"))
    both = m.join(n, "pub_id", "full")
    if publications is not None:
        both = publications.join(both, "pub_id", "left")
    both = both.na.fill(0, ["m", "n"]).withColumn("potential", F.least("m", "n"))
    missing = (lambda c: ~F.col(c)) if publications is not None else (lambda c: F.lit(False))
    status = F.when(missing("has_candidates"), "no candidate file").when(F.col("n") == 0, "no candidates").when(missing("has_entries"), "no entry file").when(F.col("m") == 0, "no entries").when(F.col("potential") < least, "too few").otherwise("eligible")
    return both.withColumn("status", status).select("pub_id", "m", "n", "potential", "status").orderBy(F.desc("potential"), "pub_id")


def labelling_counts(scanned: DataFrame) -> DataFrame:
    """One row: publications by status of ``labelling_candidates``: five reasons to skip one, those that are eligible, and all."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return scanned.agg(
        n("no candidate file").alias("no_candidate_file"), n("no candidates").alias("no_candidates"), n("no entry file").alias("no_entry_file"), n("no entries").alias("no_entries"),
        n("too few").alias("too_few"), n("eligible").alias("eligible"), F.count(F.lit(1)).alias("publications"),
    )


def top_publications(scanned: DataFrame, k: int = 10) -> DataFrame:
    """The k eligible publications with most potential labels."""
    return scanned.where("status = 'eligible'").orderBy(F.desc("potential"), "pub_id").limit(k)


def one_publication(bib: DataFrame, cand: DataFrame, pub_id: str, k: int = 5) -> DataFrame:
    """(side, key, title): the first k entries and candidates of a publication, to look at before it is labelled."""
    sides = [df.where(F.col("pub_id") == pub_id).orderBy(key).limit(k).select(F.lit(side).alias("side"), F.col(key).cast("string").alias("key"), F.col(title).alias("title")) for df, side, key, title in ((bib, "entry", "bib_key", "bib_title"), (cand, "candidate", "candidate_id", "cand_title"))]
    return sides[0].unionByName(sides[1])


def compliance(pairs: DataFrame, min_publications: int = 5, min_labels: int = 20, min_auto: float = 0.1) -> DataFrame:
    """(requirement, required, actual, status) from pairs with ``label`` and ``origin``.

    The automatic share is that of publications with automatic labels among those without manual ones, 0 if there are none.
    """
    per = pairs.groupBy("pub_id").agg(F.max((F.col("origin") == "manual").cast("int")).alias("m"), F.max((F.col("origin") == "auto").cast("int")).alias("a"), F.count_if((F.col("origin") == "manual") & (F.col("label") == 1)).alias("n"))
    one = per.agg(F.sum("m").cast("double").alias("pubs"), F.sum("n").cast("double").alias("labels"), F.expr("coalesce(try_divide(sum(if(m = 0, a, 0)), sum(1 - m)), 0.0)").cast("double").alias("auto"))
    rows = [("manual publications", float(min_publications), "pubs"), ("manual labels", float(min_labels), "labels"), ("automatic share", min_auto, "auto")]
    listed = F.array(*[F.struct(F.lit(name).alias("requirement"), F.lit(need).alias("required"), F.coalesce(c, F.lit(0.0)).alias("actual")) for name, need, c in rows])
    return one.select(F.inline(listed)).withColumn("status", F.when(F.col("actual") >= F.col("required"), "PASS").otherwise("FAIL"))


def split_publications(pairs: DataFrame, seed: int = 42, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """(pub_id, split): publications in a seeded order, floor(train n) to train, floor(valid n) to valid, the rest to test."""
    pubs = pairs.select("pub_id").distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("pub_id").cast("string"))))
    ranked, n = numbered(pubs, "_r", "_h", "pub_id")
    t, v = math.floor(n * train), math.floor(n * valid)
    return ranked.select("pub_id", F.when(F.col("_r") <= t, "train").when(F.col("_r") <= t + v, "valid").otherwise("test").alias("split"))


def split_by_labels(pairs: DataFrame, manual: DataFrame, auto: DataFrame, seed: int = 42) -> DataFrame:
    """(pub_id, split): publications of automatic labels train; those of manual ones, in a seeded order, validate in the first
    half (rounded down) and test in the second.  A publication of both trains; one of neither is in no split.  Without
    publications of either kind all are split at random, as ``split_publications`` does."""
    m, a = manual.select("pub_id").distinct(), auto.select("pub_id").distinct()
    if m.isEmpty() or a.isEmpty():
        return split_publications(pairs, seed)
    halves = split_publications(m, seed, train=0.0, valid=0.5)
    both = halves.join(a, "pub_id", "left_anti").unionByName(a.withColumn("split", F.lit("train")))
    return both.join(pairs.select("pub_id").distinct(), "pub_id", "left_semi")


def split_queries(pairs: DataFrame, seed: int = 42, test: float = 0.2) -> DataFrame:
    """(pub_id, bib_key, split): entries in a seeded order, ceil(test n) to test and the rest to train, so that no entry is in both."""
    keys = pairs.select(*QUERY).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in QUERY])))
    ranked, n = numbered(keys, "_r", "_h", *QUERY)
    return ranked.select(*QUERY, F.when(F.col("_r") <= math.ceil(n * test), "test").otherwise("train").alias("split"))


def split_by_origin(pairs: DataFrame) -> DataFrame:
    """(pub_id, split): the first manual and first automatic publication test, the second ones validate, the rest train."""
    per = pairs.groupBy("pub_id").agg(F.max(F.when(F.col("origin") == "manual", 2).when(F.col("origin") == "auto", 1).otherwise(0)).alias("_o")).where("_o > 0")
    picked = []
    for origin in (1, 2):  # the two least of each, by a limit in parallel: four rows
        rows = per.where(F.col("_o") == origin).orderBy("pub_id").limit(2).select("pub_id").collect()
        picked += [(r.pub_id, s) for r, s in zip(rows, ("test", "valid"))]
    kind = per.schema["pub_id"].dataType.simpleString()
    few = pairs.sparkSession.createDataFrame(picked, f"pub_id {kind}, split string")
    return per.join(F.broadcast(few), "pub_id", "left").select("pub_id", F.coalesce("split", F.lit("train")).alias("split"))


def balance(pairs: DataFrame, ratio: float = 1.0, seed: int = 42, over: bool = False) -> DataFrame:
    """Pairs of both labels in proportion: ratio negatives per positive are kept, in seeded order; or, over=True, positives
    are repeated until there is one per ``ratio`` negatives."""
    counts = pairs.agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    both = pairs.join(F.broadcast(counts))
    if over:
        times = F.greatest(F.lit(1), F.floor(F.col("_n") / (F.greatest("_p", F.lit(1)) * ratio)).cast("int"))
        copies = F.explode(F.sequence(F.lit(1), F.when(F.col("label") == 1, times).otherwise(1)))
        return both.withColumn("_c", copies).drop("_c", "_p", "_n")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "pub_id", "bib_key", "candidate_id"))
    # the k smallest hashes: a sorted limit in parallel, instead of one window over all negatives
    k = counts.first()
    keep = int(min(k["_n"], k["_p"] * ratio))
    negatives = pairs.where("label = 0").withColumn("_h", h).orderBy("_h").limit(keep).drop("_h")
    return pairs.where("label = 1").unionByName(negatives)
