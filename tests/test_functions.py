"""Golden cases of normalisation, similarities, people, years, LaTeX and bibliography texts."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioflux.functions import bibitems, identifiers, latex, people, similarity, structure, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abcd é", max_size=14), st.text("abcd é", max_size=14))
def test_bit_parallel_lcs(a, b):
    assert similarity.lcs_length(a, b) == lcs(a, b)


@settings(max_examples=300)
@given(st.integers(1, 200), st.integers(1, 200), st.sampled_from([80, 90, 95]))
def test_length_bound_loses_nothing(x, y, t):
    best = round(100 * (2.0 * min(x, y) / (x + y)))
    assert best < t or 200.0 * min(x, y) / (x + y) >= t - 0.5


@pytest.mark.parametrize("a, b, want", [("alpha beta gamma", "completely different words here", 21), ("x", "x", 100), ("", "x", 0)])
def test_percent(a, b, want):
    assert similarity.percent(a, b) == want


def test_ratio_equals_higher_order_form(spark):
    rows = [("small ring", "ring small"), ("deja vu etat", "textbf deja vu"), ("", "a"), ("abc", "abc"), ("kitten", "sitting")]
    df = spark.createDataFrame(rows, "a string, b string").select(similarity.ratio(F.col("a"), F.col("b")).alias("x"), similarity.ratio_hof(F.col("a"), F.col("b")).alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_normalize(spark):
    assert one(spark, text.normalize(F.lit("{\\textbf{Déjà} vu}: état"))) == "déjà vu état"
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, text.fold(F.lit("Éàü Ñandú"))) == "eau nandu"
    assert one(spark, text.strip_latex(F.lit("\\emph{a} $x$ \\foo b"))) == "a x b"


def test_jaccard_properties(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array().cast("array<string>")
    assert one(spark, text.jaccard(a, b)) == one(spark, text.jaccard(b, a)) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(a, a)) == 1 and one(spark, text.jaccard(a, none)) == 0


def test_authors(spark):
    got = one(spark, people.parse_authors(people.split_authors(F.lit("Smith, John A. and Jane von Doe; X et al. and Plato10"))))
    assert [(p["first"], p["last"], p["initials"]) for p in got] == [("John A.", "Smith", "JA"), ("Jane von", "Doe", "JV"), ("", "Plato10", "")]
    a, b = (people.parse_authors(people.split_authors(F.lit(x))) for x in ("Lipton, Z. C.", "Zachary C. Lipton"))
    assert one(spark, people.initials_match(a, b)) == 1.0 and one(spark, people.end_match(a, b, 1)) == 1
    assert sorted(one(spark, people.loose_last_names(F.lit("Smith, John and Doe, Jane")))) == ["doe", "jane", "john", "smith"]
    assert one(spark, people.last_name(F.lit("Dr. Ada Lovelace"))) == "Lovelace"


def test_years_and_ids(spark):
    f = identifiers.year_features(identifiers.year(F.lit("2020")), identifiers.year(F.lit("in 2019")))
    row = spark.range(1).select(*[c.alias(n) for n, c in f.items()]).first()
    assert tuple(row) == (1, 0, 1, 1)
    assert one(spark, identifiers.year(F.lit("1234"))) is None and one(spark, identifiers.year_of_text(F.lit("a1999 2001"))) == 2001
    assert one(spark, identifiers.normalize_arxiv_id(F.lit("2101.00001v3"))) == "2101-00001"
    assert one(spark, identifiers.parse_arxiv_id(F.lit("HEP-TH/9901001"))) == "hep-th/9901001"
    assert one(spark, identifiers.publication_id(F.lit("/data/x2101.00001v2"))) == "2101.00001"
    assert str(one(spark, identifiers.any_date(F.lit("2020-03-01")))) == "2020-03-01" and one(spark, identifiers.any_date(F.lit("soon"))) is None


@pytest.mark.parametrize(
    "raw, clean, plain",
    [
        ("50% off % comment", "50% off", "50% off"),
        ("% only", "", ""),
        ("a \\(x\\) b \\[y\\] $$z$$", "a $x$ b \\begin{equation}y\\end{equation} \\begin{equation}z\\end{equation}", None),
        ("[htpb] [t] [h!]", "[t]", ""),
        ("a \\cite{k1,k2} b~\\citep[p. 3]{k3}.", None, "a[k1,k2] b[k3]."),
        ("\\textbf{\\textit{nest}}", None, "nest"),
        ("Fig.pdf and img_1.png", None, "and"),
        ("wait...really?!", None, "wait. ..really? !"),
        ("foo \\% bar baz", "foo % bar baz", "foo % bar baz"),
    ],
)
def test_latex(spark, raw, clean, plain):
    if clean is not None:
        assert one(spark, latex.clean(F.lit(raw))).strip() == clean
    if plain is not None:
        assert one(spark, latex.plain_text(F.lit(raw))) == plain


def test_comments_as_a_chain_of_steps(spark):
    assert one(spark, latex.remove_comments(F.lit("foo \\% bar baz"), faithful=True)) == "foo"


def test_citations_and_sentences(spark):
    cites = "\\cite{a,b} \\citep[x]{c} \\citet*{d} \\citealp{e} \\citeauthor{f} \\citep[see][p]{g} \\citealt{h} \\nocite{i}"
    assert one(spark, latex.cited_keys(F.lit(cites))) == list("abcdef")
    assert one(spark, latex.sentences(F.lit("Ok. 12, 34. A real sentence."))) == ["A real sentence."]
    assert one(spark, latex.sentences(F.lit("By Dr. Who et al. it is 0. Then 85% used X. 19% used Y."))) == ["By Dr. Who et al. it is 0.", "Then 85% used X.", "19% used Y."]


DOCUMENT = r"""Preamble text here. Second one here.
\section{Introduction}
We cite \cite{a1,b2} here. Deep nets work. 85% used X. 19% used Y.
\subsection{Motivation}
Some motivation text goes here.
\begin{itemize}\item first thing here \item second \begin{enumerate}\item inner one\end{enumerate}\end{itemize}
\section*{Acknowledgements}
Thanks to all of you.
\section{Preference learning}
\textbf{Policy Purpose.} Body text follows now.
\begin{equation*}y=f(x)\end{equation*}
\begin{figure}[h]\caption{A {nested} cap.}\end{figure}
\begin{table}\begin{tabular}{c}x\end{tabular}\end{table}
\section{References}
Ref text is excluded.
"""


def test_structure():
    scanner = structure.Scanner("p")
    got = [(e.kind, e.parent, e.text) for e in scanner.scan(DOCUMENT)]
    kinds = [k for k, _, _ in got]
    assert kinds == ["document", "sentence", "sentence", "section", *["sentence"] * 4, "subsection", "sentence", "itemize", "item", "item", "sentence", "enumerate", "item", "section", "sentence", "section", "sentence", "sentence", "formula", "figure", "table"]
    texts = {t: p for _, p, t in got}
    assert texts["A {nested} cap."] == texts["Table"] == texts["Policy Purpose."] == 19
    assert texts["inner one"] == 15 and texts["Enumerate block"] == texts["second"] == 13 and texts["Thanks to all of you."] == 17
    assert not any("excluded" in t for t in texts)


@pytest.mark.parametrize(
    "key, raw, want",
    [
        ("r", "C.~Rudin, Stop explaining black box models, \\href{https://doi.org/10.1/ab}{Nat. Mach. Intell. 1, 206 (2019)}.", dict(ENTRYTYPE="article", author="C. Rudin", title="Stop explaining black box models", journal="Nat. Mach. Intell", volume="1", pages="206", year="2019", doi="10.1/ab")),
        ("s", "G. Strang, Linear Algebra and Its Applications (Academic Press, New York, 1980).", dict(ENTRYTYPE="book", author="G. Strang", title="Linear Algebra and Its Applications", publisher="Academic Press, New York", year="1980")),
        ("t", "Smith and Doe. A Great Paper Title. Proc. of Testing, 2020.", dict(ENTRYTYPE="misc", author="Smith and Doe", title="A Great Paper Title", journal="Proc. of Testing, 2020", year="2020")),
        ("l", "Lipton, Z. C. (2018). The mythos of model interpretability. ACM Queue.", dict(author="Lipton, Z. C", title="The mythos of model interpretability", journal="ACM Queue", year="2018")),
    ],
)
def test_bibitem(key, raw, want):
    got = bibitems.parse_bibitem(key, raw)
    assert {k: got.get(k) for k in want} == want


def test_bibitem_splits_at_every_period_when_faithful():
    got = bibitems.parse_bibitem("l", "Lipton, Z. C. (2018). The mythos of model interpretability. ACM Queue.", faithful=True)
    assert (got["author"], got["title"]) == ("Lipton, Z", "C")


def test_bibtex_file():
    raw = '@string{acm = "ACM"}\n@comment{no}\n@Article{k1, title = {A {B} C}, author = "X and Y", journal = acm # " Queue", year = 2018}\n@misc{k2,\n title={T}}'
    got = bibitems.parse_bibtex(raw)
    assert got == [{"ID": "k1", "ENTRYTYPE": "article", "title": "A {B} C", "author": "X and Y", "journal": "ACM Queue", "year": "2018"}, {"ID": "k2", "ENTRYTYPE": "misc", "title": "T"}]


def test_first_key_wins_and_short_items_go():
    got = bibitems.parse_bibitems("\\bibitem{a} One thing here. More. \\bibitem[L]{b} x\n\\bibitem {a} Another. \\end{thebibliography}")
    assert [e["ID"] for e in got] == ["a"] and not math.isnan(len(got))
