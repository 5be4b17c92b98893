"""\\bibitem texts and BibTeX files -> bibliography entries.

Braces nest and the split of authors from titles depends on depth, so the two parsers are plain Python; they run in
``mapInArrow`` over whole files (see ``sources.bibliography``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

FIELDS = ("title", "author", "year", "journal", "booktitle", "volume", "pages", "publisher", "doi", "eprint", "url", "note", "abstract")
_TRIM = ".,;: "


def tidy(value: str) -> str:
    """Field value without ties, links, fonts, comments and outer signs."""
    v = value.replace("~", " ")
    v = re.sub(r"\\href\s*\{[^{}]*\}\s*\{([^{}]*)\}", r"\1", v)
    v = re.sub(r"\\(?:emph|text(?:it|bf|rm)?)\{([^}]*)\}", r"\1", v)
    return re.sub(r"\s+", " ", re.sub(r"%[^\n]*", "", v)).strip().strip(_TRIM)


def tidy_authors(value: str) -> str:
    v = re.sub(r"\s+", " ", value.replace("~", " ")).strip()
    v = re.sub(r"\s*,\s*and\s+", " and ", v)
    return re.sub(r"\s*&\s*", " and ", v).rstrip(".,;:")


def looks_like_author(text: str) -> bool:
    """An initial, up to three capitalised words or particles, or a closing 'et al'."""
    t = text.strip()
    if not t:
        return False
    if re.search(r"\b[A-Z]\.", t) or re.search(r"\bet\s+al\.?$", t, re.I):
        return True
    words = t.split()
    return len(words) <= 3 and all(w[0].isupper() or w.lower() in {"and", "von", "van", "de", "der", "la", "el"} for w in words)


def split_at_depth(text: str, sign: str = ",") -> list[str]:
    """Parts between signs that stand in no bracket."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sign and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]] if text[at:] else parts


def find_year(text: str) -> str | None:
    """In brackets first, then after a comma, before a full stop, anywhere; 1900 to 2100 only."""
    for p in (r"\((\d{4})\)", r",\s*(\d{4})\.", r"(\d{4})\.", r"\b(\d{4})\b"):
        m = re.search(p, text)
        if m and 1900 <= int(m.group(1)) <= 2100:
            return m.group(1)
    return None


def journal_parts(text: str) -> dict[str, str]:
    """'Name 12, 345 (1999)' -> journal, volume, pages, year."""
    out = {}
    if m := re.search(r"\((\d{4})\)", text):
        out["year"] = m.group(1)
    rest = re.sub(r"\s*\(\d{4}\)\s*\.?\s*$", "", text).strip()
    if m := re.match(r"(.+?)\s+(\d+)\s*,\s*([A-Za-z]?\d+|\d+[-\u2013]\d+)$", rest):
        return out | {"journal": m.group(1).strip(), "volume": m.group(2), "pages": m.group(3)}
    return out | {"journal": rest}


def authors_and_title(text: str) -> dict[str, str]:
    """Comma-separated authors, then the title: the title begins at the last part that reads like one."""
    parts = split_at_depth(re.sub(r"\s+", " ", text.replace("~", " ")).strip())
    if not parts:
        return {}
    at = None
    for i in range(len(parts) - 1, -1, -1):
        p = parts[i].strip()
        n = len(p.split())
        if "?" in p or ":" in p or n > 4 or not looks_like_author(p):
            at = i
            break
    if at is None:
        at = 1 if len(parts) > 1 else 0
    out = {}
    if at and (who := tidy_authors(", ".join(p.strip() for p in parts[:at]))):
        out["author"] = who
    if what := ", ".join(p.strip() for p in parts[at:]).strip(_TRIM):
        out["title"] = what
    return out


def _periods(text: str, faithful: bool) -> list[str]:
    """Stretches between full stops; those after single capitals do not count, unless faithful."""
    parts = re.split(r"\.", text) if faithful else re.split(r"(?<!\b[A-Z])\.(?=\s|$)", text)
    return [s.strip() for s in parts if s.strip()]


_NAME = r"(?:[A-Z]\.?\s*){1,2}[A-Z][a-z]+"
_BOOK = re.compile(rf"({_NAME}(?:\s+(?:and|&)\s+{_NAME})*),\s*(.+?)\s*\(([^)]+),\s*\d{{4}}\)\s*\.?\s*$", re.I)


def standard_parts(text: str, faithful: bool = False) -> dict[str, str]:
    """'Authors. Title. Venue, year.' and 'Authors, title (publisher, year).'"""
    t = re.sub(r"\s+", " ", text.replace("~", " ")).strip()
    out = {"year": y} if (y := find_year(t)) else {}
    if m := _BOOK.match(t):
        return out | {"author": tidy_authors(m.group(1)), "title": m.group(2).strip(_TRIM), "ENTRYTYPE": "book", "publisher": m.group(3).strip()}
    s = _periods(t, faithful)
    if not faithful and len(s) > 1 and re.search(r"\(\d{4}\)$", s[0]):
        s[0] = re.sub(r"\s*\(\d{4}\)$", "", s[0])
    elif not faithful and len(s) > 2 and re.fullmatch(r"\(?\d{4}\)?", s[1]):
        del s[1]
    if len(s) >= 2:
        out |= {"author": tidy_authors(s[0]), "title": s[1].strip(_TRIM)}
        if venue := ". ".join(s[2:]).strip(_TRIM):
            out["journal"] = venue
    elif s:
        head, comma, tail = s[0].partition(",")
        if not comma or not head:
            out["title"] = s[0].strip(_TRIM)
        elif looks_like_author(head.strip()):
            out |= {"author": tidy_authors(head.strip()), "title": tail.strip().strip(_TRIM)}
        else:
            out |= authors_and_title(s[0])
    return out


def fallback_title(text: str) -> str | None:
    """Quoted text, else the first later sentence of fitting length that is no name and no numbers, else all of a short text."""
    t = tidy(text)
    if len(t) < 10:
        return None
    if m := re.search("[\"\u201c`]([^\"\u201c\u201d`']{10,200})[\"\u201d']", t):
        return m.group(1).strip()
    for s in [x.strip() for x in t.split(".") if x.strip()][1:]:
        if not re.match(r"[A-Z]\.\s*[A-Z]", s) and not re.search(r"\d+\s*,\s*\d+", s) and 10 < len(s) < 200:
            return s.strip(_TRIM)
    lettered = sum(c.isalpha() for c in t) / len(t)
    return t if 20 < len(t) < 200 and lettered >= 0.5 and "http" not in t.lower() and "doi.org" not in t.lower() else None


def parse_bibitem(key: str, text: str, faithful: bool = False) -> dict[str, str]:
    """One entry from the text after \\bibitem{key}."""
    t = re.sub(r"%[^\n]*", "", text) if not faithful else re.sub(r"%.*$", "", re.sub(r"\s+", " ", text))
    t = re.sub(r"\s+", " ", t.replace("~", " ")).strip()
    entry = {"ID": key, "ENTRYTYPE": "misc"}
    if m := re.search(r"\\href\s*\{\s*(https?://doi\.org/([^{}]+))\}\s*\{([^{}]+)\}", t):
        entry |= {"doi": m.group(2)} | journal_parts(m.group(3).strip())
        entry |= authors_and_title(t[: m.start()].strip().rstrip(",").strip())
        meeting = re.search("workshop|sympos|conf|proc", entry["journal"], re.I)
        entry["ENTRYTYPE"] = "inproceedings" if meeting else "article"
        if meeting:
            entry["booktitle"] = entry.pop("journal")
    else:
        bare = re.sub(r"\s+", " ", re.sub(r"https?://doi\.org/[^\s}]+|\\doi\{[^}]*\}", "", t)).strip()
        entry |= standard_parts(bare or t, faithful)
    entry |= {f: tidy(entry[f]) for f in ("author", "title", "journal", "booktitle") if entry.get(f)}
    if not entry.get("title") and (title := fallback_title(t)):
        entry["title"] = title
    return entry


_ITEM = re.compile(r"\\bibitem\s*(?:\[[^\[\]]*\]\s*)?\{([^{}]+)\}(.*?)(?=\\(?:bibitem|section|chapter|(?:begin|end)\{thebibliography\}|end\{document\})|\Z)", re.S)


def parse_bibitems(text: str, faithful: bool = False) -> list[dict[str, str]]:
    """Entries of all \\bibitem's, first per key; texts of under five characters are left out."""
    return list(each_bibitem(text, faithful))


def each_bibitem(text: str, faithful: bool = False) -> Iterator[dict[str, str]]:
    """``parse_bibitems``, one entry after the other."""
    seen: set[str] = set()
    for m in _ITEM.finditer(text):
        key, body = m.group(1).strip(" {}\t\n"), m.group(2).strip()
        if key and key not in seen and len(body) >= 5:
            seen.add(key)
            yield parse_bibitem(key, body, faithful)


def parse_bibtex(text: str) -> list[dict[str, str]]:
    """Entries of a BibTeX file: @type{key, field = {..} | ".." | word # ..}; strings and comments apply, broken entries end at the next @."""
    return list(each_bibtex(text))


def each_bibtex(text: str) -> Iterator[dict[str, str]]:
    """``parse_bibtex``, one entry after the other."""
    strings: dict[str, str] = {}
    at = 0
    while m := re.compile(r"@\s*(\w+)\s*[{(]").search(text, at):
        at, kind = m.end(), m.group(1).lower()
        if kind in ("comment", "preamble"):
            at = _skip(text, at)
            continue
        if kind != "string":
            k = re.compile(r"\s*([^,\s{}()]+)\s*,").match(text, at)
            if not k:
                continue
            entry, at = {"ID": k.group(1), "ENTRYTYPE": kind}, k.end()
        else:
            entry = {}
        while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at):
            value, at = _value(text, f.end(), strings)
            entry[f.group(1).lower()] = re.sub(r"\s+", " ", value).strip()
        if kind == "string":
            strings |= {k.lower(): v for k, v in entry.items()}
        else:
            yield entry


def _skip(text: str, at: int) -> int:
    depth = 1
    while at < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        at += 1
    return at


def _value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    parts = []
    while True:
        if at < len(text) and text[at] == "{":
            end = _skip(text, at + 1)
            parts.append(text[at + 1 : end - 1])
            at = end
        elif at < len(text) and text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            parts.append(text[at + 1 : end])
            at = end + 1
        else:
            m = re.compile(r"[^\s,{}()#]*").match(text, at)
            parts.append(strings.get(m.group().lower(), m.group()))
            at = m.end()
        m = re.compile(r"\s*#\s*").match(text, at)
        if not m:
            return "".join(parts), at
        at = m.end()
