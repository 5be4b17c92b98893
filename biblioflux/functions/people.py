"""Author names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def split_authors(c: Column) -> Column:
    """'A and B; C' -> [A, B, C] without blanks and 'et al.'."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+and\s+|;\s*"), lambda w: F.trim(w))
    return F.filter(parts, lambda p: (p != "") & ~F.contains(F.lower(p), F.lit("et al")))


def parse_authors(names: Column) -> Column:
    """array<string> of names -> array<struct<first, last, initials>>; 'Last, First' and 'First Last' both work."""

    def one(p: Column) -> Column:
        comma = F.contains(p, F.lit(","))
        w = _words(p)
        last = F.when(comma, F.trim(F.substring_index(p, ",", 1))).otherwise(F.coalesce(F.get(w, F.size(w) - 1), F.lit("")))
        first = F.when(comma, F.trim(F.regexp_replace(p, r"^[^,]*,", ""))).otherwise(F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " "))
        last = F.regexp_replace(last, r"[^\p{L}\p{M}\p{N}_\s-]", "")
        first = F.regexp_replace(first, r"[^\p{L}\p{M}\p{N}_\s.-]", "")
        initials = F.array_join(F.transform(_words(first), lambda x: F.upper(F.substring(x, 1, 1))), "")
        return F.struct(first.alias("first"), last.alias("last"), initials.alias("initials"))

    return F.filter(F.transform(names, one), lambda a: a["last"] != "")


def last_names(people: Column) -> Column:
    return F.array_distinct(F.transform(people, lambda a: F.lower(a["last"])))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 where either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def end_match(a: Column, b: Column, at: int) -> Column:
    """1 where the first (at=1) or last (at=-1) authors' last names agree."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    x = F.when(some, F.lower(F.try_element_at(a, F.lit(at))["last"]))
    y = F.when(some, F.lower(F.try_element_at(b, F.lit(at))["last"]))
    return F.when(F.coalesce(x == y, F.lit(False)), 1).otherwise(0)


def initial_keys(people: Column) -> Column:
    """Distinct (last name, first initial) of ``parse_authors``."""
    return F.array_distinct(F.transform(people, lambda x: F.struct(F.lower(x["last"]).alias("last"), F.lower(F.substring(x["initials"], 1, 1)).alias("i"))))


def initials_match(a: Column, b: Column) -> Column:
    """Shared last names whose first initials meet, or are unknown on a side, over the smaller number of (name, initial) pairs."""
    return keys_match(initial_keys(a), initial_keys(b))


def keys_match(ka: Column, kb: Column) -> Column:
    """``initials_match`` of results of ``initial_keys``."""

    def agrees(name: Column) -> Column:
        ia = F.transform(F.filter(ka, lambda k: k["last"] == name), lambda k: k["i"])
        ib = F.transform(F.filter(kb, lambda k: k["last"] == name), lambda k: k["i"])
        return F.arrays_overlap(ia, ib) | F.array_contains(ia, "") | F.array_contains(ib, "")

    shared = F.array_intersect(F.transform(ka, lambda k: k["last"]), F.transform(kb, lambda k: k["last"]))
    small = F.least(F.size(ka), F.size(kb))
    return F.when(small > 0, F.size(F.filter(shared, agrees)) / small).otherwise(0.0)


def loose_last_names(c: Column) -> Column:
    """Last word of each part between 'and's and commas, so 'Smith, John' gives smith and john."""
    parts = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+and\s+|,\s*"), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.element_at(_words(p), -1)))


def clean_name(c: Column) -> Column:
    """Name without honorifics, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(?:Prof|Mrs|Dr|Mr|Ms|PhD|MD)\.?\s*", ""), r"\s+", " "))


def last_name(c: Column) -> Column:
    n = clean_name(c)
    return F.when(F.contains(n, F.lit(",")), F.trim(F.substring_index(n, ",", 1))).otherwise(F.substring_index(n, " ", -1))


def listed_overlap(a: Column, b: Column) -> Column:
    """Shared last names of two arrays of full names over the smaller set; 0 where either is empty."""
    names = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(last_name(x))), lambda n: n != ""))
    return F.coalesce(overlap(names(a), names(b)), F.lit(0.0))
