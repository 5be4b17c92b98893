"""Years, dates and archive identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year(c: Column) -> Column:
    """First four digits, if they are a year from 1900 to 2100."""
    found = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"[0-9]{4}", 0)
    y = F.when(found != "", found.cast("int"))
    return F.when((y >= 1900) & (y <= 2100), y)


def any_year(c: Column) -> Column:
    """First four digits as they are."""
    found = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"[0-9]{4}", 0)
    return F.when(found != "", found.cast("int"))


def year_of_text(c: Column) -> Column:
    """First whole word 19xx or 20xx, else 0."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(?:19|20)[0-9]{2}\b", 0)
    return F.when(found != "", found.cast("int")).otherwise(0)


def candidate_year(year_column: Column, submitted: Column) -> Column:
    """The stated year, else that of the submission date."""
    return F.coalesce(year(year_column), year(submitted.cast("string")))


def year_features(a: Column, b: Column) -> dict[str, Column]:
    gap = F.abs(a - b)
    both = a.isNotNull() & b.isNotNull()
    return {
        "year_diff": F.when(both, F.least(gap, F.lit(10))).otherwise(-1),
        "year_exact_match": F.when(both & (gap == 0), 1).otherwise(0),
        "year_within_1": F.when(both & (gap <= 1), 1).otherwise(0),
        "both_years_present": F.when(both, 1).otherwise(0),
    }


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM", "yyyy")


def any_date(c: Column) -> Column:
    """Date of a string in any of DATE_FORMATS; null if none fits."""
    return F.coalesce(*[F.try_to_date(c, f) for f in DATE_FORMATS]) if hasattr(F, "try_to_date") else F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS])


def parse_arxiv_id(c: Column) -> Column:
    """New-style id (1234.56789), else old-style (hep-th/9901001), else null."""
    t = F.coalesce(c, F.lit(""))
    new = F.regexp_extract(t, r"[0-9]{4}\.[0-9]{4,5}", 0)
    old = F.regexp_extract(F.lower(t), r"[a-z-]+/[0-9]{7}", 0)
    return F.when(new != "", new).when(old != "", old)


def entry_arxiv_id(eprint: Column, url: Column, note: Column, doi: Column) -> Column:
    """The id an entry states, by field; a doi counts only if it is an archive's."""
    of_doi = F.when(F.contains(F.lower(doi), F.lit("arxiv")), parse_arxiv_id(doi))
    return F.coalesce(parse_arxiv_id(eprint), parse_arxiv_id(url), parse_arxiv_id(note), of_doi)


def normalize_arxiv_id(c: Column) -> Column:
    """Without version, dots as hyphens, lower case."""
    return F.lower(F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"v[0-9]+$", ""), F.lit("."), F.lit("-"))))


def standard_arxiv_id(c: Column) -> Column:
    """New-style id anywhere in a text (1234.56789, 1234-56789, after arXiv: or in an address) as 1234-56789; other texts as they are.

    A point counts before a hyphen, wherever they stand.
    """
    at = lambda p: F.regexp_extract(c, p, 0)
    point, hyphen = at(r"[0-9]{4}\.[0-9]{4,5}"), at(r"[0-9]{4}-[0-9]{4,5}")
    return F.when(point != "", F.replace(point, F.lit("."), F.lit("-"))).when(hyphen != "", hyphen).otherwise(c)


def publication_id(directory: Column) -> Column:
    """The archive id in a directory name, else the name itself."""
    name = F.element_at(F.split(directory, "/"), -1)
    found = F.regexp_extract(name, r"[0-9]{4}\.[0-9]{4,5}", 0)
    return F.when(found != "", found).otherwise(name)
