"""Text normalisation, tokens and set similarities as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: English function words that ``content_tokens`` leaves out.
STOP_WORDS = (
    "a an and are as at be been being but by can could did do does for from had has have he if in into is it its of on or our such that the their these they this those to was we were which will with".split()
)


def present(c: Column) -> Column:
    """null for absent values: null, empty and blank strings."""
    t = F.trim(c)
    return F.when(t != "", t)


def unwrap_latex(c: Column) -> Column:
    """\\cmd{x} -> x, and no braces, dollars or backslashes."""
    return F.regexp_replace(F.regexp_replace(c, r"\\[A-Za-z]+\{([^}]*)\}", "$1"), r"[{}$\\]", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Form in which titles are compared: lower case, no LaTeX, letters, digits and underscores only, single spaces."""
    return squeeze(F.regexp_replace(unwrap_latex(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{M}\p{N}_\s]", " "))


def normalize_keep_signs(c: Column) -> Column:
    """The labeller's form: punctuation stays."""
    return squeeze(unwrap_latex(F.lower(F.coalesce(c, F.lit("")))))


@arrow_udf(StringType())
def _decomposed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        yield pa.array([None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in arr.to_pylist()], pa.string())


def fold(c: Column) -> Column:
    """Lower case, compatibility forms decomposed (NFKD) and without combining marks, single spaces; null and blank give ''.

    Only texts beyond ASCII leave the JVM.
    """
    t = F.lower(F.coalesce(c, F.lit("")))
    plain = ~t.rlike(r"[^\x00-\x7f]")
    return squeeze(F.when(plain, t).otherwise(F.coalesce(_decomposed(F.when(~plain, t)), F.lit(""))))


def strip_latex(c: Column) -> Column:
    """Text of a LaTeX fragment without commands, math signs and braces."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\[A-Za-z]+\*?\{([^}]*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[A-Za-z]+\*?", ""), r"\$+|\\[\[\]]|[{}]", "")
    return squeeze(t)


def tokens(c: Column) -> Column:
    """Words of a normalised text, in order; [] for ''."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def plain_tokens(c: Column) -> Column:
    """Lower-case words of two characters or more, signs as spaces."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+"), lambda w: F.length(w) > 1)


def text_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the ``plain_tokens`` of two texts; 0 where either has none."""
    return jaccard(F.array_distinct(plain_tokens(a)), F.array_distinct(plain_tokens(b)))


def content_tokens(c: Column, min_len: int = 2) -> Column:
    """Words of at least min_len characters, folded, without stop words."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(F.split(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: F.length(w) >= min_len)
    return F.filter(words, lambda w: ~F.array_contains(stops, w))


def ngrams(words: Column, n: int = 2) -> Column:
    """Word n-grams in order; [] for fewer than n words."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def word_count(c: Column) -> Column:
    """Words of a raw text."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def length_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger word count of two raw texts; 0 where either has none."""
    return count_ratio(word_count(a), word_count(b))


def count_ratio(x: Column, y: Column) -> Column:
    """Smaller over larger of two counts; 0 where either is."""
    return F.when((x > 0) & (y > 0), F.least(x, y) / F.greatest(x, y)).otherwise(0.0)


def exact_match(a: Column, b: Column) -> Column:
    """1 where two normalised texts are equal and not empty."""
    return F.when((a == b) & (a != ""), 1).otherwise(0)
