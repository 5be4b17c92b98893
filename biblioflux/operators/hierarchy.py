"""Element trees and the features of citations in them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.functions import latex
from biblioflux.functions.structure import Scanner

ELEMENT = "pub_id string, version int, element_id string, element_type string, ord long, parent_id string, raw_text string"
_ELEMENT = pa.schema([("pub_id", pa.string()), ("version", pa.int32()), ("element_id", pa.string()), ("element_type", pa.string()), ("ord", pa.int64()), ("parent_id", pa.string()), ("raw_text", pa.string())])
_SHORT = {"document": "doc", "section": "sec", "subsection": "subsec", "subsubsection": "subsubsec", "chapter": "chap", "paragraph": "par", "subparagraph": "subpar", "sentence": "sent", "figure": "fig"}
SECTION_TYPES = ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
TYPES = ("document", *SECTION_TYPES, "sentence", "formula", "figure", "table", "item", "itemize", "enumerate")
FLAGS = (
    ("cited_in_intro", "intro"),
    ("cited_in_related_work", "related|background|prior|previous"),
    ("cited_in_methods", "method|approach|model|architecture"),
    ("cited_in_results", "result|experiment|evaluation|empirical"),
    ("cited_in_conclusion", "conclusion|summary|discussion|future"),
)
#: Type of the one row of a version whose source could not be read; its text says why.
FAILED = "failed"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for publication, version, body in zip(*(batch.column(c).to_pylist() for c in ("pub_id", "version", "body"))):
            try:
                found = _elements(publication, body)
            except Exception as e:  # one publication's fault is not another's
                row = (publication, version, f"{publication}-v{version}-{FAILED}", FAILED, 0, None, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ELEMENT.types)], schema=_ELEMENT)
                continue
            ids = {e.ord: f"{publication}-v{version}-{_SHORT.get(e.kind, e.kind)}-{e.ord}" for e in found}
            n = len(found)
            columns = ([publication] * n, [version] * n, list(ids.values()), [e.kind for e in found], [e.ord for e in found], [ids.get(e.parent) for e in found], [e.text for e in found])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ELEMENT.types)], schema=_ELEMENT)


def _elements(publication: str, body: str):
    scanner = Scanner(publication)
    scanner.scan(body or "")
    return scanner.elements


def parse(sources: DataFrame, failures: bool = False) -> DataFrame:
    """ELEMENT rows of (pub_id, version, text): one tree per version, the document its root.

    Comments go once, before the scan; excluded are bibliographies and the sections named so.  Texts are scanned whole.  A
    version that cannot be scanned does not stop the others; it has no elements, or with ``failures`` one of type FAILED.
    """
    bodies = sources.select(F.col("pub_id").cast("string").alias("pub_id"), F.col("version").cast("int").alias("version"), latex.body(latex.remove_comments(F.col("text"))).alias("body"))
    found = bodies.mapInArrow(_scan, ELEMENT)
    return found if failures else found.where(F.col("element_type") != FAILED)


def edges(elements: DataFrame) -> DataFrame:
    return elements.where("parent_id is not null").select("pub_id", "version", F.col("element_id").alias("child_id"), "parent_id")


def citation_index(elements: DataFrame, text: str = "raw_text") -> DataFrame:
    """(pub_id, bib_key, element_id, ord): every citation of every element, repeated ones kept, from the raw text."""
    groups = F.regexp_extract_all(text, F.lit(latex.CITE), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    rows = elements.select("pub_id", "element_id", "ord", F.posexplode(keys).alias("at", "k"))
    return rows.select("pub_id", F.trim("k").alias("bib_key"), "element_id", "ord", "at").where("bib_key <> ''")


def _streamed(key: list[str], rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of equal keys, as lists of rows, from batches sorted by the key."""
    now, held = None, []
    for batch in rows:
        for r in batch.to_pylist():
            k = tuple(r[c] for c in key)
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(r)
    if held:
        yield now, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    columns = list(zip(*held)) if held else [()] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def chains(edge_rows: DataFrame, key: list[str]) -> DataFrame:
    """(key.., node, chain, depth): ancestors of each node from its parent to the root; a cycle's chain ends before it repeats.

    A tree is climbed by one task: it is one publication's, and its edges are narrow.  Many trees share a batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType.simpleString() for f in edge_rows.schema}
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"node {kinds['child_id']}", f"chain array<{kinds['child_id']}>", "depth int"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def climb(tree: list[dict]) -> Iterator[tuple]:
        parent: dict = {}
        for r in tree:
            parent.setdefault(r["child_id"], r["parent_id"])
        for node in parent:
            chain, seen, at = [], {node}, parent[node]
            while at is not None and at not in seen:
                chain.append(at)
                seen.add(at)
                at = parent.get(at)
            yield node, chain, len(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*k, *row) for k, tree in _streamed(key, batches) for row in climb(tree)), schema)

    return edge_rows.select(*key, "child_id", "parent_id").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ddl)


def ancestors(edge_rows: DataFrame, key: list[str]) -> DataFrame:
    """(key.., node, ancestor, depth): all pairs of node and ancestor; depth 1 is the parent."""
    rows = chains(edge_rows, key).select(*key, "node", F.posexplode("chain").alias("at", "ancestor"))
    return rows.select(*key, "node", "ancestor", (F.col("at") + 1).alias("depth"))


def siblings(edge_rows: DataFrame, key: list[str]) -> DataFrame:
    """(key.., node, sibling): children of one parent, the node itself among them."""
    other = edge_rows.select(*key, "parent_id", F.col("child_id").alias("sibling"))
    return edge_rows.withColumnRenamed("child_id", "node").join(other, [*key, "parent_id"]).select(*key, "node", "sibling")


_FEATURES = "pub_id string, bib_key string, citation_count long, has_citation int, " + ", ".join(f"{n} int" for n, _ in FLAGS) + ", cited_in_abstract int, avg_citation_depth double, min_citation_depth int, max_citation_depth int, first_citation_depth int, near_figure int, near_table int, near_formula int, in_itemize int, co_citation_count int, has_co_citations int"
_CITE = re.compile(latex.CITE)
_FLAGS = [re.compile(words) for _, words in FLAGS]


def cited_in(text: str) -> list[str]:
    """Keys of all citations of a text, repeated ones kept."""
    return [k for m in _CITE.finditer(text or "") for k in (x.strip(" ") for x in m.group(1).split(",")) if k]


def _heading(kind: str, title: str) -> tuple[int, ...]:
    """What a section's heading says of the citations below it: the first of FLAGS it fits, and whether it is the abstract."""
    out = [0] * (len(FLAGS) + 1)
    if kind in SECTION_TYPES:
        first = next((i for i, p in enumerate(_FLAGS) if p.search(title.lower())), None)
        if first is not None:
            out[first] = 1
        out[-1] = int(title.lower().startswith("abstract"))
    return tuple(out)


def _tree_features(elements: list[dict]) -> Iterator[tuple]:
    """One publication's rows of citation features, by one pass over its elements and one over its citations."""
    nodes: dict[str, dict] = {}
    for e in sorted(elements, key=lambda e: (e["version"], e["ord"])):
        nodes.setdefault(e["element_id"], e)
    near: dict[str, set] = defaultdict(set)
    for e in nodes.values():
        if e["parent_id"] is not None:
            near[e["parent_id"]].add(e["element_type"])
    above: dict[str | None, tuple] = {None: (0, (0,) * (len(FLAGS) + 1))}

    def climb(at: str | None) -> tuple:
        """(number, flags) of a node and its ancestors; a cycle ends before it repeats."""
        path = []
        while at not in above and at not in path:
            path.append(at)
            at = nodes[at]["parent_id"] if at in nodes else None
        depth, flags = above.get(at, above[None])
        for node in reversed(path):
            own = _heading(nodes[node]["element_type"], nodes[node]["raw_text"] or "") if node in nodes else above[None][1]
            depth, flags = depth + 1, tuple(max(a, b) for a, b in zip(flags, own))
            above[node] = (depth, flags)
        return depth, flags

    cites: dict[str, list] = defaultdict(list)
    for e in nodes.values():
        keys = cited_in(e["raw_text"])
        if not keys:
            continue
        depth, flags = climb(e["parent_id"])
        kinds = near[e["parent_id"]] if e["parent_id"] is not None else set()
        beside = (int("figure" in kinds), int("table" in kinds), int("formula" in kinds), int(bool(kinds & {"item", "itemize", "enumerate"})))
        for at, k in enumerate(keys):
            cites[k].append((e["ord"], at, e["version"], depth, flags, beside, set(keys)))
    for k, rows in cites.items():
        depths = [r[3] for r in rows]
        together = len(set().union(*(r[6] for r in rows)) - {k})
        top = lambda i: tuple(max(x) for x in zip(*(r[i] for r in rows)))
        yield k, len(rows), 1, *top(4), sum(depths) / len(depths), min(depths), max(depths), min(rows, key=lambda r: r[:3])[3], *top(5), together, int(together > 0)


def citation_features(elements: DataFrame) -> DataFrame:
    """(pub_id, bib_key, 18 features): how often, where, how deep, near what and with what each key is cited.

    Elements travel once, by publication; each publication's tree is read in one pass, many to a batch.  Of an element that
    several versions hold the first counts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*k, *row) for k, tree in _streamed(["pub_id"], batches) for row in _tree_features(tree)), schema)

    read = F.col("element_type").isin(*SECTION_TYPES) | F.contains("raw_text", F.lit("\\cite"))  # headings and citations: no other text travels
    rows = elements.select("pub_id", "version", "element_id", "element_type", "ord", "parent_id", F.when(read, F.col("raw_text")).alias("raw_text"))
    return rows.repartition("pub_id").sortWithinPartitions("pub_id").mapInArrow(run, _FEATURES)


def scan_for_keys(elements: DataFrame, keys: DataFrame, text: str = "raw_text") -> DataFrame:
    """(pub_id, bib_key, element_id) of the elements that cite the keys, by search in each element: for texts without an index.

    A key counts where it stands as a whole word in a citation command, even beside others in one group.
    """
    hay = elements.select("pub_id", "element_id", F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\\cite[pt]?\*?(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1)), lambda g: F.split(g, r"[^\w:.+/-]+")))).alias("words"))
    return hay.select("pub_id", "element_id", F.explode("words").alias("bib_key")).join(keys.select("pub_id", "bib_key").distinct(), ["pub_id", "bib_key"], "left_semi").select("pub_id", "bib_key", "element_id")


def cocitations(cited: DataFrame) -> DataFrame:
    """(pub_id, bib_key, co_citation_count): other keys cited in an element with the key."""
    keys = cited.select("pub_id", "element_id", "bib_key").distinct()
    other = keys.withColumnRenamed("bib_key", "other")
    pairs = keys.join(other, ["pub_id", "element_id"]).where("bib_key <> other")
    return pairs.groupBy("pub_id", "bib_key").agg(F.countDistinct("other").cast("int").alias("co_citation_count"))


def citation_contexts(elements: DataFrame) -> DataFrame:
    """(pub_id, bib_key, element_id, element_type, excerpt, chain, depth) of each citation."""
    chain = chains(edges(elements).select("pub_id", "child_id", "parent_id").distinct(), ["pub_id"]).withColumnRenamed("node", "element_id")
    rows = citation_index(elements).join(elements.select("pub_id", "element_id", "element_type", F.left("raw_text", F.lit(500)).alias("excerpt")), ["pub_id", "element_id"])
    return rows.join(chain, ["pub_id", "element_id"], "left").select("pub_id", "bib_key", "element_id", "element_type", "excerpt", "chain", F.coalesce("depth", F.lit(0)).alias("depth"))


def consistency(elements: DataFrame, edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose child exists, and elements other than documents that no edge names."""
    key = ["pub_id", "version"]
    good = edge_rows.join(elements.select(*key, F.col("element_id").alias("child_id")), [*key, "child_id"], "left_semi")
    named = good.select(*key, F.explode(F.array("child_id", "parent_id")).alias("element_id")).distinct()
    orphans = elements.where("element_type <> 'document'").join(named, [*key, "element_id"], "left_anti")
    return good, orphans


def statistics(elements: DataFrame) -> DataFrame:
    """Element counts by type for each publication version."""
    return elements.groupBy("pub_id", "version").pivot("element_type", list(TYPES)).count().na.fill(0)
