"""The 19 text features of a pair, as one projection over sides normalised before they are paired."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType

from biblioflux.functions import identifiers, people, similarity, text
from biblioflux.operators.order import cut_lineage

TEXT_FEATURES = (
    "title_jaccard title_levenshtein title_token_sort title_token_set title_exact_match "
    "author_overlap_ratio num_common_authors first_author_match last_author_match author_initials_match "
    "year_diff year_exact_match year_within_1 both_years_present "
    "abstract_jaccard venue_similarity text_word_overlap bigram_similarity title_length_ratio"
).split()
HIERARCHY_FEATURES = (
    "citation_count has_citation "
    "cited_in_intro cited_in_related_work cited_in_methods cited_in_results cited_in_conclusion cited_in_abstract "
    "avg_citation_depth min_citation_depth max_citation_depth first_citation_depth "
    "near_figure near_table near_formula in_itemize "
    "co_citation_count has_co_citations"
).split()
GROUPS = {"title": TEXT_FEATURES[:5], "author": TEXT_FEATURES[5:10], "year": TEXT_FEATURES[10:14], "text": TEXT_FEATURES[14:], "hierarchy": HIERARCHY_FEATURES}


def prepare(side: DataFrame, prefix: str, title: Column, authors: Column, year: Column, venue: Column, abstract: Column) -> DataFrame:
    """side plus the columns that features compare, each computed once per row and not once per pair.

    authors is an array of names or a string joined by 'and' or ';'.
    """
    listed = side.select(authors).schema[0].dataType.typeName() == "array"
    names = F.coalesce(authors, F.array().cast("array<string>")) if listed else people.split_authors(authors)
    t, a = text.normalize(title), text.normalize(abstract)
    return side.withColumns(
        {
            f"{prefix}_title": title,
            f"{prefix}_norm": t,
            f"{prefix}_words": F.array_distinct(text.tokens(t)),
            f"{prefix}_fuzz": similarity.fuzz_words(t),
            f"{prefix}_people": people.parse_authors(names),
            f"{prefix}_year": year,
            f"{prefix}_venue": similarity.fuzz_words(text.normalize(venue)),
            f"{prefix}_abstract": F.array_distinct(text.tokens(a)),
            f"{prefix}_all": F.array_distinct(text.tokens(F.trim(F.concat_ws(" ", t, a)))),
            f"{prefix}_bigrams": F.array_distinct(text.ngrams(text.tokens(F.trim(F.concat_ws(" ", t, a))))),
        }
    )


def text_features(a: str = "b", b: str = "c") -> dict[str, Column]:
    """Expressions over the columns that ``prepare`` makes with prefixes a and b."""
    x, y = (lambda n, p=p: F.col(f"{p}_{n}") for p in (a, b))
    la, lb = people.last_names(x("people")), people.last_names(y("people"))
    common = F.size(F.array_intersect(la, lb))
    both = (x("norm") != "") & (y("norm") != "")
    score = lambda e: F.when(both, e).otherwise(0.0)
    out = {
        "title_jaccard": text.jaccard(x("words"), y("words")),
        "title_levenshtein": score(similarity.ratio(x("norm"), y("norm"))),
        "title_token_sort": score(similarity.token_sort(x("fuzz"), y("fuzz"))),
        "title_token_set": score(similarity.token_set(x("fuzz"), y("fuzz"))),
        "title_exact_match": text.exact_match(x("norm"), y("norm")),
        "author_overlap_ratio": people.overlap(la, lb),
        "num_common_authors": common,
        "first_author_match": people.end_match(x("people"), y("people"), 1),
        "last_author_match": people.end_match(x("people"), y("people"), -1),
        "author_initials_match": people.initials_match(x("people"), y("people")),
    }
    out |= identifiers.year_features(x("year"), y("year"))
    return out | {
        "abstract_jaccard": text.jaccard(x("abstract"), y("abstract")),
        "venue_similarity": similarity.token_set(x("venue"), y("venue")),
        "text_word_overlap": text.jaccard(x("all"), y("all")),
        "bigram_similarity": text.jaccard(x("bigrams"), y("bigrams")),
        "title_length_ratio": text.length_ratio(x("title"), y("title")),
    }


def extract(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(text_features())


def attach_hierarchy(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs plus the citation features of their entries, 0 where an entry is not cited."""
    return pairs.join(features, ["pub_id", "bib_key"], "left").na.fill(0, HIERARCHY_FEATURES)


#: The common English stop-word list of text classification, as the vectorizer of the match features uses it.
TFIDF_STOP_WORDS = """a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at
back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further get give go
had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me
meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise
our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still
such system take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards
twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with
within without would yet you your yours yourself yourselves""".split()
MAX_TERMS = 500
#: Terms of items that are sent to all documents; of more, both sides are shuffled.
BROADCAST_ROWS = 1 << 19


def tfidf_terms(c: Column, longest: int = 2) -> Column:
    """Words of two characters or more, without stop words, and then their runs of up to ``longest`` words."""
    stops = F.array(*[F.lit(w) for w in TFIDF_STOP_WORDS])
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~F.array_contains(stops, w))
    return F.concat(words, *[text.ngrams(words, n) for n in range(2, longest + 1)])


#: Stands between joined terms, which hold no control characters.
_TERM_END = "\u0001"


def _cosine(a: str, b: str, max_terms: int) -> float:
    x, y = (Counter(t.split(_TERM_END)) if t else Counter() for t in (a, b))
    terms = list(x | y)
    if len(terms) > max_terms:
        terms = sorted(terms, key=lambda t: (-x[t] - y[t], t))[:max_terms]
    d = p = q = 0.0
    for t in terms:
        w = 1.0 if x[t] and y[t] else 1.0 + math.log(1.5)
        u, v = x[t] * w, y[t] * w
        d, p, q = d + u * v, p + u * u, q + v * v
    return d / (math.sqrt(p) * math.sqrt(q)) if p and q else 0.0


def tfidf_cosine(a: Column, b: Column, max_terms: int = MAX_TERMS) -> Column:
    """Cosine of two term arrays under the smoothed idf of just these two texts: ln(3 / (1 + df)) + 1; 0 where either is empty.

    Only the ``max_terms`` terms most frequent in both together count, of equals the first by name.
    """
    return similarity.kernel(partial(_cosine, max_terms=max_terms), "double")()(F.array_join(a, _TERM_END), F.array_join(b, _TERM_END))


def _counted(df: DataFrame, key: str, terms: str, n: str) -> DataFrame:
    """(key, t, n, nn): each distinct term of a row with its count, and the sum of the squares of the row's counts."""
    kind = dict(df.dtypes)[key]
    types = (df.select(key).schema.fields[0].dataType, StringType(), DoubleType(), DoubleType())
    schema = pa.schema([(name, to_arrow_type(t)) for name, t in zip((key, "t", n, 2 * n), types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(row or ()) for row in batch.column(1).to_pylist()]
            sizes = np.array([len(c) for c in found], np.int64)
            squares = np.array([float(sum(v * v for v in c.values())) for c in found])
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))).cast(schema.types[0]), pa.array([t for c in found for t in c], pa.string()), pa.array([float(v) for c in found for v in c.values()], pa.float64()), pa.array(np.repeat(squares, sizes), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select(key, terms).mapInArrow(run, f"`{key}` {kind}, t string, {n} double, {2 * n} double")


def tfidf_cosines(bib: DataFrame, cand: DataFrame) -> DataFrame:
    """(item_id, doc_id, cosine) of all pairs of (item_id, a) and (doc_id, b) that share a term: ``tfidf_cosine`` of texts of fewer than MAX_TERMS / 2 terms.

    Pairs meet by their shared terms alone. A term of both texts weighs 1 and one of either 1 + ln(1.5), so the squares of the
    terms not shared are what is left of each side's sum.  Terms that no item has go before pairs are summed up.
    """
    x, y = cut_lineage(_counted(bib, "item_id", "a", "x")), _counted(cand, "doc_id", "b", "y")
    small = x.count() <= BROADCAST_ROWS
    met = y.join(F.broadcast(x) if small else x, "t").groupBy("doc_id", "item_id").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("p"), F.sum(F.col("y") * F.col("y")).alias("q"), F.first("xx").alias("xx"), F.first("yy").alias("yy"))
    own = (1.0 + math.log(1.5)) ** 2
    rest = lambda whole, shared: F.sqrt(F.col(shared) + own * (F.col(whole) - F.col(shared)))
    return met.select("item_id", "doc_id", (F.col("d") / (rest("xx", "p") * rest("yy", "q"))).alias("cosine"))


SECTION_WORDS = ("introduction", "related_work", "method", "experiment", "conclusion")


def author_percents(a: Column, b: Column) -> dict[str, Column]:
    """Author scores of two raw strings, in percent: whole and partial ratio, word Jaccard, and ratio of the initials."""
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    initials = lambda c: F.array_join(F.transform(words(c), lambda w: F.substring(w, 1, 1)), "")
    return {
        "author_fuzz_ratio": 100 * similarity.ratio(x, y),
        "author_fuzz_partial": 100 * similarity.partial_ratio(x, y),
        "author_overlap": F.round(100 * text.jaccard(F.array_distinct(words(x)), F.array_distinct(words(y))), 2),
        "author_initials_match": 100 * similarity.ratio(initials(x), initials(y)),
    }


def year_gaps(a: Column, b: Column) -> dict[str, Column]:
    """Year scores of two whole-number strings; a year that is missing, 0 or no number is 100 years away."""
    x, y = (F.nullif(F.when(F.trim(c.cast("string")).rlike(r"^[+-]?[0-9]{1,9}$"), F.trim(c.cast("string")).cast("int")), F.lit(0)) for c in (a, b))
    gap = F.abs(x - y)
    return {"year_match": F.coalesce((gap == 0).cast("int"), F.lit(0)), "year_diff": F.coalesce(gap, F.lit(100)), "year_close": F.coalesce((gap <= 1).cast("int"), F.lit(0))}


def single_terms(c: Column) -> Column:
    """Terms that ``text_percents`` compares."""
    return tfidf_terms(F.trim(F.coalesce(c, F.lit(""))), 1)


def text_percents(a: Column, b: Column, a_venue: Column, b_venue: Column, terms: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Text scores in percent: TF-IDF cosine over single words, venue ratio, and the first text's length up to 500 characters.

    ``terms`` are the texts' ``single_terms``, where they were found per row before the rows were paired.
    """
    x = F.lower(F.trim(F.coalesce(a, F.lit(""))))
    s, t = terms or (single_terms(a), single_terms(b))
    venue = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return {
        "combined_tfidf": F.round(100 * tfidf_cosine(s, t, 1 << 30), 2),
        "venue_fuzz": 100 * similarity.ratio(venue(a_venue), venue(b_venue)),
        "ref_text_length": F.round(F.least(F.length(x), F.lit(500)) / 5.0, 2),
    }


def place_percents(section: Column, depth: Column, position: Column, context: Column, citations: Column) -> dict[str, Column]:
    """Scores of a citation's place: a section of note, and depth, position, context and citations clipped to 5, 1, 1000 and 20, in percent."""
    share = lambda c, most: F.round(100.0 * F.least(c, F.lit(most)) / most, 2)
    return {
        "hierarchy_section_match": F.lower(section).isin(*SECTION_WORDS[:3]).cast("int"),
        "hierarchy_depth": share(depth, 5),
        "hierarchy_position": share(F.greatest(position, F.lit(0.0)), 1),
        "context_length": share(context, 1000),
        "citation_density": share(citations, 20),
    }
