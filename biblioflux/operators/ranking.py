"""Ranking of candidates, its post-processing, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflux.functions import identifiers
from biblioflux.operators.order import numbered

QUERY = ["pub_id", "bib_key"]


def top_k(scored: DataFrame, k: int = 5, order: str = "cand_ord") -> DataFrame:
    """The k best rows of each entry with ``rank``; ties keep the candidates' order."""
    rank = F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.desc("score"), order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def jaccard_top_k(bib: DataFrame, cand: DataFrame, k: int = 5) -> DataFrame:
    """(pub_id, bib_key, candidate_id, score, rank): the k candidates of each entry of (pub_id, bib_key, b) with the highest Jaccard
    similarity, to six places, of the distinct words b and c; ties by candidate_id.

    Pairs meet by publication and shared word, so those that share none are never made; an entry with fewer than k that do
    is filled up with the publication's first candidates, of score 0.
    """
    x = bib.select(*QUERY, F.size("b").alias("nb"), F.explode("b").alias("w"))
    y = cand.select("pub_id", "candidate_id", F.size("c").alias("nc"), F.explode("c").alias("w"))
    met = x.join(y, ["pub_id", "w"]).groupBy(*QUERY, "candidate_id").agg(F.count(F.lit(1)).alias("i"), F.first("nb").alias("nb"), F.first("nc").alias("nc"))
    scored = met.select(*QUERY, "candidate_id", F.round(F.col("i") / (F.col("nb") + F.col("nc") - F.col("i")), 6).alias("score"))
    best = top_k(scored, k, "candidate_id").drop("rank")
    # of k - 1 candidates at most that an entry has, as many among the first 2 k - 1 are not new
    first = F.row_number().over(Window.partitionBy("pub_id").orderBy("candidate_id"))
    spare = cand.select("pub_id", "candidate_id").withColumn("_n", first).where(F.col("_n") < 2 * k).drop("_n")
    short = bib.select(*QUERY).join(best.groupBy(*QUERY).count().where(F.col("count") >= k), QUERY, "left_anti")
    fill = short.join(spare, "pub_id").join(best.select(*QUERY, "candidate_id"), [*QUERY, "candidate_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(fill), k, "candidate_id")


def predictions(ranked: DataFrame) -> DataFrame:
    """(pub_id, bib_key, candidates): ranked rows as arrays."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "candidate_id")))
    return ranked.groupBy(*QUERY).agg(F.transform(rows, lambda x: x["candidate_id"]).alias("candidates"))


def post_process(score: Column, exact_title: Column, year_gap: Column, first_author: Column, states_id: Column, faithful: bool = True) -> Column:
    """Adjusted score: 1 for an exact title, a tenth beyond three years, a fifth more for the first author, 1 for a stated id.

    faithful applies the factors in this order to the score itself, which lowers scores above 1 and raises negative ones;
    otherwise forced rows get a bonus above every other score and penalties work on the score's rank-preserving sigmoid.
    """
    if faithful:
        s = F.when(exact_title, 1.0).otherwise(score)
        s = F.when(year_gap > 3, s * 0.1).otherwise(s)
        s = F.when(first_author, s * 1.2).otherwise(s)
        return F.when(states_id, 1.0).otherwise(s)
    s = 1 / (1 + F.exp(-score))
    s = F.when(year_gap > 3, s * 0.1).otherwise(s)
    s = F.when(first_author, s * 1.2).otherwise(s)
    return F.when(states_id, s + 4).when(exact_title, s + 2).otherwise(s)


def year_gap(bib_year: Column, submitted: Column) -> Column:
    return F.coalesce(F.abs(identifiers.any_year(bib_year) - identifiers.any_year(submitted.cast("string"))), F.lit(0))


def states_arxiv_id(entry_id: Column, candidate_id: Column) -> Column:
    """Whether the id that an entry states is the candidate's, as ids and not as substrings."""
    return F.coalesce(identifiers.normalize_arxiv_id(entry_id) == identifiers.normalize_arxiv_id(candidate_id), F.lit(False)) & (candidate_id != "")


def ranks(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(pub_id, bib_key, candidate_id, n, position): place of the true candidate, 0 if absent; n is the list's length."""
    joined = truth.join(predicted, QUERY, "left")
    place = F.coalesce(F.array_position("candidates", F.col("candidate_id")), F.lit(0)).cast("int")
    n = F.when(F.col("candidates").isNull(), 0).otherwise(F.size("candidates"))
    return joined.select(*QUERY, "candidate_id", n.alias("n"), place.alias("position"))


def metrics(rank_rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5), faithful: bool = True) -> DataFrame:
    """One row: mrr, hit_at_k, avg_rank and queries; 0 for no queries.

    An absent truth ranks one past the list, so an entry without predictions ranks 1; faithful=False gives it
    the rank past the longest list of all.
    """
    p = F.col("position")
    past = F.col("n") + 1
    if not faithful:
        longest = rank_rows.agg(F.coalesce(F.max("n"), F.lit(0)).alias("_max"))
        rank_rows = rank_rows.join(F.broadcast(longest))
        past = F.col("_max") + 1
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rank_rows.agg(
        share(F.when(p > 0, 1.0 / p).otherwise(0.0)).alias("mrr"),
        *[share(F.when((p > 0) & (p <= k), 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks],
        share(F.when(p > 0, p).otherwise(past).cast("double")).alias("avg_rank"),
        F.count(F.lit(1)).alias("queries"),
    )


def report(rank_rows: DataFrame) -> DataFrame:
    """Each entry's rank, whether it was found, and its reciprocal rank; found ones first, by rank."""
    p = F.col("position")
    return rank_rows.select(*QUERY, "candidate_id", F.when(p > 0, p).alias("rank"), (p > 0).alias("found"), F.when(p > 0, 1.0 / p).otherwise(0.0).alias("rr")).orderBy(F.asc_nulls_last("rank"), *QUERY)


def precision_at(scored: DataFrame, k: int) -> DataFrame:
    """One row: mean share of positives among the k best of each entry."""
    return top_k(scored, k).groupBy(*QUERY).agg((F.sum("label") / k).alias("p")).agg(F.avg("p").alias(f"precision_at_{k}"))


def group_ids(pairs: DataFrame) -> DataFrame:
    """(pub_id, bib_key, n, group_id): rows of each query, numbered by publication and key, so equal keys of two publications stay apart."""
    sizes = pairs.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("n"))
    return numbered(sizes, "group_id", *QUERY)[0]


def error_analysis(reported: DataFrame, show: int = 5) -> tuple[DataFrame, DataFrame]:
    """From the rows of ``report``: one row (entries, errors, error_rate), and the first ``show`` entries that are not ranked first."""
    wrong = F.coalesce(F.col("rank") != 1, F.lit(True))
    counts = reported.agg(F.count(F.lit(1)).alias("entries"), F.count_if(wrong).alias("errors")).withColumn("error_rate", F.coalesce(F.expr("try_divide(errors, entries)"), F.lit(0.0)))
    return counts, reported.where(wrong).orderBy(*QUERY).limit(show)


def heuristic_score(title_sort: Column, title_partial: Column, author: Column, same_year: Column) -> Column:
    """0.4 title + 0.3 partial title + 0.2 author, in percent, and 10 for the year."""
    return 0.4 * title_sort + 0.3 * title_partial + 0.2 * author + 10 * same_year
