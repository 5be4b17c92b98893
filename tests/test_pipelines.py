"""End-to-end plans on a folder of small publications."""

import json

import pytest

from biblioflux.plans import pipelines
from biblioflux.sources import tables

WORDS = "graph neural kernel sparse robust causal tensor policy fairness ranking entropy lattice".split()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("pubs")
    for p in range(4):
        folder = base / f"2101.0000{p}" / "v1"
        folder.mkdir(parents=True)
        titles = [f"{WORDS[(p + i) % 12]} {WORDS[(p + 3 * i + 1) % 12]} methods for {WORDS[(2 * p + i) % 12]} learning systems {i}" for i in range(5)]
        items = "".join(f"@article{{k{i}, title={{{t.title()}}}, author={{Doe, Jane and Roe{i}, Sam}}, year={{20{10 + i}}}}}\n" for i, t in enumerate(titles))
        (folder / "refs.bib").write_text(items + f"@misc{{again, title={{{titles[0].title()}.}}}}\n")
        (folder / "main.tex").write_text("\\documentclass{article}\\begin{document}\\section{Introduction} " + " ".join(f"As shown before \\cite{{k{i}}} it holds." for i in range(5)) + " Also \\cite{again} said it.\\end{document}")
        refs = {f"21{p:02d}-{i}": {"paper_title": t, "authors": ["Jane Doe", f"Sam Roe{i}"], "submission_date": f"20{10 + i}-05-01"} for i, t in enumerate(titles)}
        (folder.parent / "references.json").write_text(json.dumps(refs))
    return str(base)


def test_parse_and_match(spark, root):
    parsed = pipelines.parse_publications(spark, root)
    stats = pipelines.parsing_statistics(parsed).orderBy("pub_id").collect()
    assert [(r.versions, r.files_found, r.references, r.deduplicated_refs, r.failed_versions, r.status) for r in stats] == [(1, 1, 6, 5, 0, "parsed")] * 4 and all(r.elements > 5 for r in stats)
    summary = json.loads(pipelines.parsing_summary(pipelines.parsing_statistics(parsed)).first().value)
    assert summary["total_publications"] == 4 and summary["failed"] == 0 and summary["publications"][0]["pub_id"] == "2101.00000"
    assert parsed["failures"].isEmpty()
    assert tables.passed_on(parsed["files"]).count() == 4
    entries = parsed["entries"].cache()
    assert entries.count() == 20  # the duplicate is merged
    assert {(r.old_key, r.new_key) for r in parsed["renames"].collect()} == {("again", "k0")}
    assert all("\\cite{k0} said it" in r.renamed_text for r in parsed["sources"].collect())
    out = pipelines.match_references(entries, parsed["candidates"].cache(), rounds=5)
    m = out["metrics"].first()
    assert m.queries == 10 and m.mrr == 1.0 and m.hit_at_1 == 1.0
    assert out["pairs"].count() == 4 * 5 * 5 and out["truth"].count() == 20
    accepted = pipelines.suggest(entries, parsed["candidates"])["accepted"]
    assert accepted.count() == 20
