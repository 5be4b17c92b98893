"""LaTeX cleaning, citations and sentences as Column expressions.

Rewriting rules are folded into one expression per text, so a whole clean stays in one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LAYOUT = [
    r"\\(?:centering|raggedright|raggedleft|noindent|vfill|hfill|newpage|clearpage|pagebreak|linebreak|smallskip|medskip|bigskip|maketitle|quad|qquad)",
    (r"\\[vh]space\*?\{[^}]*\}", "space"),
    (r"\\par\b", "\\par"),
]
_TABULAR = [r"\[(?:htpb!?|H|[htb]!|p)\]", (r"\\(?:midrule|toprule|bottomrule|hline)", "rule", "\\hline"), (r"\\cline\{[^}]*\}", "\\cline")]
_STYLED = r"\\(?:textbf|textit|emph|underline|textrm|textsf|texttt|text)\{([^}]*)\}"
_STYLES = ("\\text", "\\emph", "\\underline")  # one of these is in every match of _STYLED
_SIZES = r"\\(?:tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge)\b"
CITE = r"\\cite(?:p|t|author|year|alp)?\*?\s*(?:\[[^\[\]]*\]\s*)?\{([^{}]+)\}"
#: Nested commands are unwrapped from the inside, one level a pass; passes beyond the nesting change nothing.
PASSES = 10


def _sub(text: Column, *rules: tuple[str, ...]) -> Column:
    """Rules (pattern, put, *needs) one after the other; a text with none of a rule's needs, one of which every match holds, is not searched."""

    def apply(t: Column, rule: tuple[str, ...]) -> Column:
        pattern, put, *needs = rule
        if not needs:
            return F.regexp_replace(t, pattern, put)
        return _let(t, lambda x: F.when(reduce(Column.__or__, [F.contains(x, F.lit(n)) for n in needs]), F.regexp_replace(x, pattern, put)).otherwise(x))

    return reduce(apply, rules, text)


def _drop(text: Column, *patterns: str | tuple[str, ...]) -> Column:
    return _sub(text, *[(p, "") if isinstance(p, str) else (p[0], "", *p[1:]) for p in patterns])


def _unwrap(text: Column, command: str, *needs: str) -> Column:
    """What the commands hold, one level a pass; a text that a pass left as it was, or in which none of the needs is left, is not searched again."""
    some = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(n)) for n in needs or ("\\",)])
    state = lambda t, more: F.struct(t.alias("t"), more.alias("more"))

    def once(s: Column, _: Column) -> Column:
        return F.when(~s["more"], s).otherwise(_let(F.regexp_replace(s["t"], command, "$1"), lambda t: state(t, (t != s["t"]) & some(t))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), _let(text, lambda t: state(t, some(t))), once, lambda s: s["t"])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def remove_comments(text: Column, faithful: bool = False) -> Column:
    """No comment lines, no trailing comments, lines right-trimmed; a percent sign after a digit is not a comment.

    An escaped percent sign becomes a plain one.  Once is enough; faithful=True does it three times over, as a chain of
    cleaning steps does that each strip comments, which cuts lines at the percent signs that were escaped.
    """

    def once(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^\s*%"))
        held = "\ue000"  # stands for an escaped sign meanwhile
        cut = F.transform(lines, lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\\%"), F.lit(held)), r"(?<![0-9])%.*$", ""), r"[ \t\r]+$", "")))
        return F.replace(F.array_join(cut, "\n"), F.lit(held), F.lit("%"))

    return reduce(lambda t, _: once(t), range(3 if faithful else 1), F.coalesce(text, F.lit("")))


def normalize_math(text: Column) -> Column:
    """\\(x\\) and math environments as $x$; $$x$$ and \\[x\\] as equation environments."""
    block = r"\\begin{equation}$1\\end{equation}"
    return _sub(text, (r"(?s)\\\((.+?)\\\)", r"\$$1\$", "\\("), (r"(?s)\\begin\{math\}(.+?)\\end\{math\}", r"\$$1\$", "\\begin{math}"), (r"(?s)\$\$(.+?)\$\$", block, "$$"), (r"(?s)\\\[(.+?)\\\]", block, "\\["))


def standardize_whitespace(text: Column) -> Column:
    t = _sub(text, (r"[\t ]{2,}|\t", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"(?m)[ \r\f]+$", ""))
    return t


def clean(text: Column, strip_comments: bool = True) -> Column:
    """LaTeX for further parsing: no comments, layout, table rules and fonts; math in one notation."""
    t = remove_comments(text) if strip_comments else text
    t = _drop(t, *_LAYOUT, *_TABULAR)
    t = _drop(_sub(t, (_STYLED, "$1", *_STYLES)), _SIZES)
    return F.trim(_drop(standardize_whitespace(normalize_math(t)), r"^\s+|\s+$"))


def plain_text(text: Column, strip_comments: bool = True) -> Column:
    """Text as read: citations as [keys], no commands, braces, layout, image names or control characters."""
    special = "[\\\\~\\[{}%]" if strip_comments else r"[\\~\[{}]"
    return _let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(special), _tidy(_bare(remove_comments(t) if strip_comments else t))).otherwise(_tidy(_drop_images(t))))


#: Names of image files. A run of their characters is tried from its start alone, or from where the last name ended.
_IMAGE = r"(?i)(?:(?<![\p{L}\p{N}_/-])|\G)[\p{L}\p{N}_/-]++\.(?:png|jpg|jpeg|pdf|eps|svg)"


def _drop_images(text: Column) -> Column:
    return _let(text, lambda t: F.when(t.rlike(r"(?i)\.(?:png|jpg|jpeg|pdf|eps|svg)"), _drop(t, _IMAGE)).otherwise(t))


def _bare(t: Column) -> Column:
    """Text without commands, braces and image names: what none of \\ ~ [ { } is in has only the last to lose."""
    t = _drop(t, (r"\\(?:begin|end)\{(?:abstract|document)\}", "{abstract}", "{document}"), (r"(?s)\\begin\{tcolorbox\}.*?\]", "{tcolorbox}"), (r"\\end\{tcolorbox\}", "{tcolorbox}"))
    t = _sub(t, (r"\\(?:title|author|IEEEauthorblockN)\{([^}]*)\}", "$1", "\\title", "\\author", "\\IEEE"))
    t = _drop(t, (r"\\(?:affiliation|email|institution)\{[^}]*\}", "\\affiliation", "\\email", "\\institution"), *_LAYOUT, *_TABULAR)
    t = _unwrap(t, _STYLED, *_STYLES)
    t = _drop(t, _SIZES)
    t = _sub(t, (r"~?\s*\\cite[pt]?\*?\s*(?:\[[^\[\]]*\]\s*)?\{([^{}]+)\}", "[$1]"), (r"\\cite(?:author|year)\*?\s*(?:\[[^\[\]]*\]\s*)?\{([^{}]+)\}", "[$1]", "\\citeauthor", "\\citeyear"))
    t = _sub(t, (r"\\ref\{([^}]*)\}", "$1", "\\ref"), (r"\\label\{[^}]*\}", "", "\\label"), ("~", " ", "~"), (r"\\([%&$_])", "$1", "\\%", "\\&", "\\$", "\\_"))
    t = _drop(t, r"\[[htpb!]+\]", (r"\[(?:width|height|scale)=[^\]]+\]", "[width=", "[height=", "[scale="))
    t = _drop(_drop_images(t), (r"\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}", "\\includegraphics"))
    t = _unwrap(t, r"\\[A-Za-z]+[*]?\{([^{}]*)\}")
    return _sub(_drop(t, r"\\[a-zA-Z]+\*?", r"[{}]"), (r"\\\\", " ", "\\\\"))


def _tidy(t: Column) -> Column:
    """Single spaces, none before signs, and no control characters; with the first two rules no whitespace but spaces is left."""
    t = _sub(t, (r"[\n\t\r]", " "), (r"[\x00-\x1f\x7f-\x9f]", ""), (" {2,}", " "), (" ([.,;:!?])", "$1"), (r"([.,;:!?])([.,;:!?])", "$1 $2"))
    return F.trim(t)


def comparison_form(text: Column) -> Column:
    """Form in which elements count as equal: lower case, one kind of quotes and dashes, single spaces, tight signs."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(_sub(t, (r"\s+", " "), ("[\u201c\u201d\u2018\u2019'`]", '"'), ("[\u2013\u2014\u2212]", "-"), (r"\s+([.,;:!?])", "$1"), (r"([.,;:!?])\s+", "$1 ")))


def cited_keys(text: Column) -> Column:
    """Distinct keys of all citations, in order of first use."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITE), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda w: F.trim(w))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


_DOTTED = ("A.I. Dr. Eq. Fig. M.D. M.L. Mr. Mrs. Ms. No. Ph.D. Prof. U.K. U.S. Vol. e.g. etc. i.e. vs.".split()) + ["et al."]


def sentences(text: Column) -> Column:
    """Sentences of a paragraph, in order: cut after . ! ? before a capital or digit, but not after abbreviations; runs
    of statistics ("85% ... 19% ...") are cut before each figure.  Under five characters, or figures only: dropped."""
    held = "\ue001"
    t = F.coalesce(text, F.lit(""))
    for a in _DOTTED:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", held)))
    whole = F.transform(F.split(t, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.replace(s, F.lit(held), F.lit(".")))
    parts = F.flatten(F.transform(whole, lambda s: F.when(F.length(s) - F.length(F.replace(s, F.lit("%"), F.lit(""))) >= 2, F.split(s, r"(?<=\.)\s+(?=[0-9]+%)")).otherwise(F.array(s))))
    parts = F.transform(parts, lambda w: F.trim(w))
    return F.filter(parts, lambda s: (F.length(s) >= 5) & ~s.rlike(r"^[0-9\s%.,;:]+$"))


def is_main(text: Column) -> Column:
    return text.rlike(r"\\documentclass") & text.rlike(r"\\begin\{document\}")


#: Files that a source takes in.
INCLUDE = r"\\(?:input|include|subfile)\{([^}]+)\}|\\import\{[^}]*\}\{([^}]+)\}"


def body(text: Column) -> Column:
    """What lies within the document environment, else everything; without the bibliography."""
    inner = F.regexp_extract(text, r"(?s)\\begin\{document\}(.*)\\end\{document\}", 1)
    t = F.when(text.rlike(r"(?s)\\begin\{document\}.*\\end\{document\}"), inner).otherwise(text)
    return _drop(t, r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", r"\\bibliography(?:style)?\{[^}]*\}")


def is_bibliography_heading(title: Column) -> Column:
    """Whole words only, so 'Preference learning' is a section like any other."""
    return F.lower(F.trim(title)).rlike(r"\b(?:references?|bibliograph(?:y|ie)|cited\s*literature)\b")


def is_bibliography_residue(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("", "unsrt", "plain", "abbrv", "references", "bibliography")


def document_type(text: Column) -> Column:
    return F.when(text.rlike(r"\\documentclass.*\{book\}") | text.rlike(r"\\chapter\b"), "book").otherwise("paper")
