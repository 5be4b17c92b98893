"""Publications on disk: LaTeX trees as tables of files, versions, and combined sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflux.functions import identifiers, latex

MAIN_NAMES = ("main.tex", "paper.tex", "article.tex", "manuscript.tex", "arxiv.tex", "ms.tex")
MAX_INCLUDES = 10
_OPEN, _CLOSE = "\ue010", "\ue011"  # around the path of a file that is to be put in


def decoded(content):
    """UTF-8 where valid, else Latin-1 (which decodes any bytes)."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def scan(spark: SparkSession, root: str, pattern: str = "*.{tex,bib,bbl,json}") -> DataFrame:
    """(pub_id, version, path, name, text, size) of all files under root/<publication>/[<...>vN/].

    path is relative to the version's directory; files outside a directory named ...vN are version 1.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split(":", 1)[-1]
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), r"^" + base.replace("\\", r"\\") + "/+", "")
    parts = F.split(rel, "/")
    version = F.regexp_extract(F.coalesce(F.get(parts, 1), F.lit("")), r"v([0-9]+)$", 1)
    has_version = (F.size(parts) > 2) & (version != "")
    return files.select(
        identifiers.publication_id(F.get(parts, 0)).alias("pub_id"),
        F.when(has_version, version.cast("int")).otherwise(1).alias("version"),
        F.array_join(F.when(has_version, F.slice(parts, 3, F.size(parts))).otherwise(F.slice(parts, 2, F.size(parts))), "/").alias("path"),
        F.element_at(parts, -1).alias("name"),
        decoded(F.col("content")).alias("text"),
        F.col("length").alias("size"),
    )


def _commands(text):
    return F.regexp_extract_all(text, F.lit(latex.INCLUDE), F.lit(0))


def include_edges(files: DataFrame) -> DataFrame:
    """(pub_id, version, path, ord, targets): the files that a file takes in, in the order of the source; comments do not count.

    targets are the places a name may stand for: relative to the including file, then to the root.  The folder of an
    ``import`` is part of its name.
    """

    def name(m):
        file, folder = F.trim(F.regexp_extract(m, r"\{([^{}]+)\}$", 1)), F.trim(F.regexp_extract(m, r"^\\import\{([^}]*)\}", 1))
        return F.when(folder == "", file).otherwise(F.concat(folder, F.lit("/"), file))

    tex = files.where("name like '%.tex'")
    edges = tex.select("pub_id", "version", "path", F.posexplode(F.transform(_commands(latex.remove_comments(F.col("text"))), name)).alias("ord", "raw"))
    target = F.when(F.col("raw").rlike(r"\.[A-Za-z]+$"), F.col("raw")).otherwise(F.concat("raw", F.lit(".tex")))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)

    def clean(c):
        c = F.regexp_replace(F.regexp_replace(c, "/+", "/"), r"(?:(?<=/)|^)(?:\./)+", "")
        return reduce(lambda x, _: F.regexp_replace(x, r"(?:(?<=/)|^)(?!\.\./)[^/]+/\.\./", ""), range(4), c)

    return edges.select("pub_id", "version", "path", "ord", F.array(clean(F.concat(folder, target)), clean(target)).alias("targets"))


def main_files(files: DataFrame) -> DataFrame:
    """(pub_id, version, path) of each version's main file.

    A top-level file with a usual name and a document of its own wins, then the document with most includes, then the first file.
    """
    tex = files.where("name like '%.tex'").withColumn("n_includes", F.regexp_count("text", F.lit(latex.INCLUDE)))
    order = [
        F.desc(~F.contains("path", F.lit("/"))),
        F.desc(latex.is_main(F.col("text")) & F.lower("name").isin(*MAIN_NAMES)),
        F.desc(latex.is_main(F.col("text"))),
        F.desc("n_includes"),
        F.asc("path"),
    ]
    first = F.row_number().over(Window.partitionBy("pub_id", "version").orderBy(*order))
    return tex.withColumn("_r", first).where("_r = 1").select("pub_id", "version", "path")


def _walk(max_depth: int):
    """Batches of (pub_id, version, path of the main file, edges) -> the files of a depth-first walk, each where it is met first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                below: dict[str, list] = {}
                for e in sorted(r.edges if r.edges is not None else (), key=lambda e: (e["path"], e["ord"])):
                    below.setdefault(e["path"], []).append((e["ord"], e["target"]))
                seen, work = set(), [(r.path, None, -1, ())]
                while work:
                    path, parent, ord_, trail = work.pop()
                    if path in seen:
                        continue
                    seen.add(path)
                    out.append((r.pub_id, r.version, path, parent, ord_, len(trail), list(trail)))
                    if len(trail) < max_depth:
                        work += [(t, path, k, (*trail, k)) for k, t in reversed(below.get(path, []))]
            yield pd.DataFrame(out, columns=["pub_id", "version", "path", "parent", "ord", "depth", "trail"])

    return run


def included_files(files: DataFrame, max_depth: int = MAX_INCLUDES) -> DataFrame:
    """(pub_id, version, path, parent, ord, depth, trail): the main file and all it takes in, once each, by first use.

    parent and ord say which command takes a file in; trail is the path of commands from the main file, so its order is that
    of a depth-first walk.  Cycles end.  Files more than max_depth deep are not taken in, and ``ignored_files`` lists them.
    """
    key = ["pub_id", "version"]
    texts = files.where("name like '%.tex'").select(*key, F.col("path").alias("target")).distinct()
    edges = include_edges(files).select(*key, "path", "ord", F.posexplode("targets").alias("way", "target")).join(texts, [*key, "target"])
    edges = edges.groupBy(*key, "path", "ord").agg(F.min_by("target", "way").alias("target"))
    listed = edges.groupBy(*key).agg(F.collect_list(F.struct("path", "ord", "target")).alias("edges"))
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = f"pub_id {kinds['pub_id']}, version {kinds['version']}, path string, parent string, ord int, depth int, trail array<int>"
    return main_files(files).join(listed, key, "left").select(*key, "path", "edges").mapInPandas(_walk(max_depth), schema)


def ignored_files(files: DataFrame) -> DataFrame:
    """LaTeX files that no main file takes in."""
    return files.where("name like '%.tex'").join(included_files(files), ["pub_id", "version", "path"], "left_anti").select("pub_id", "version", "path")


def combined_sources(files: DataFrame, max_depth: int = MAX_INCLUDES) -> DataFrame:
    """(pub_id, version, text, n_files): the main file with included files in place of the commands that take them in.

    Each file stands where a depth-first walk meets it first; commands for files that are not there, or stand elsewhere, leave nothing.
    """
    key = ["pub_id", "version"]
    used = included_files(files, max_depth)
    taken = used.where("parent is not null").groupBy(*key, F.col("parent").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("ord", F.col("path").alias("target")))).alias("targets"))
    texts = files.join(used.select(*key, "path", "depth"), [*key, "path"]).withColumn("text", latex.remove_comments(F.col("text"))).join(taken, [*key, "path"], "left")
    # commands become marks that hold the path of the file to put there
    put = lambda i: F.coalesce(F.concat(F.lit(_OPEN), F.try_element_at("targets", i), F.lit(_CLOSE)), F.lit(""))
    marked = F.array_join(F.transform(F.split("text", latex.INCLUDE), lambda x, i: F.concat(x, put(i))), "")
    whole = texts.withColumn("text", marked).groupBy(*key).agg(
        F.max(F.when(F.col("depth") == 0, F.col("text"))).alias("text"),
        F.map_from_entries(F.collect_list(F.when(F.col("depth") > 0, F.struct("path", "text")))).alias("files"),
        F.max("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_files"),
    )
    return whole.select(*key, _inline(F.col("text"), F.col("files"), F.col("depth")).alias("text"), "n_files")


def _inline(text, files, depth):
    """The text with the named files in place of its marks, level by level as deep as the version's files go."""
    mark = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"

    def level(t, _):
        names = F.regexp_extract_all(t, F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1))
        put = lambda i: F.when(i < F.size(names), F.coalesce(F.try_element_at(files, F.get(names, i)), F.lit(""))).otherwise("")
        return F.array_join(F.transform(F.split(t, mark), lambda x, i: F.concat(x, put(i))), "")

    return F.when(depth == 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), depth), text, level))
