"""One query per operator, over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.llm import bpe, decontaminate, divergence, language_id, licenses, line_templates, minhash, sharding, suffix_merge, weak_labels
from biblioflux.llm.arrow_text import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir)).select("doc_id", "lang", "predicted", "margin", "rejected")


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(_documents(spark, sf_dir)).select("doc_id", "text", "lines_dropped")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_documents(spark, sf_dir)).select("doc_id", "n_tokens", "token_ids", "round_trip")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.repeated_passages(_documents(spark, sf_dir))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir)).select("doc_id", "lang", F.round("char_js", 6).alias("char_js"), F.round("word_js", 6).alias("word_js"), "n_words", "flagged")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_documents(spark, sf_dir)).select("doc_id", "label", "quality", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_divergence": op2_divergence,
    "op3_sharding": op3_sharding,
    "op4_line_templates": op4_line_templates,
    "op5_weak_labels": op5_weak_labels,
    "op6_language_id": op6_language_id,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_divergence": r"""
        WITH t AS (SELECT *, row_number() OVER () AS id FROM documents),
        n AS (SELECT id, lang, length(text) AS n, length(regexp_replace(text, '[^a-z]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS b, length(regexp_replace(text, '[^0-9]', '', 'g')) AS c,
            length(regexp_replace(text, '[^ \t\n\r\f\v]', '', 'g')) AS d, length(regexp_replace(text, '[^.,;:?''"()\-]', '', 'g')) AS e, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS f, length(regexp_replace(text, '[^\x{00C0}-\x{027F}]', '', 'g')) AS g FROM t),
        c AS (SELECT id, lang, n, unnest(range(8)) AS k, unnest([a, b, c, d, e, f - a - b - c - d - e, g, n - f - g]) AS x FROM n),
        cr AS (SELECT lang, k, sum(x) / sum(sum(x)) OVER (PARTITION BY lang) AS q FROM c WHERE lang IS NOT NULL GROUP BY lang, k),
        cp AS (SELECT id, x / n AS p, q, (x / n + q) / 2 AS m FROM c JOIN cr USING (lang, k) WHERE n >= 100),
        cj AS (SELECT id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2)) AS js FROM cp GROUP BY id),
        s AS (SELECT id, lang, unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) AS w FROM t),
        w AS (SELECT * FROM s WHERE w <> ''),
        wn AS (SELECT id, count(*) AS n FROM w GROUP BY id),
        r AS (SELECT lang, w, count(*) AS x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS k FROM w WHERE lang IS NOT NULL GROUP BY lang, w),
        v AS (SELECT lang, CASE WHEN k <= 64 THEN k ELSE 65 END AS k, w, x FROM r),
        vr AS (SELECT lang, k, sum(x) AS x FROM v GROUP BY lang, k UNION ALL SELECT lang, 65, 0 FROM r GROUP BY lang HAVING count(*) <= 64),
        wr AS (SELECT lang, k, x / sum(x) OVER (PARTITION BY lang) AS q FROM vr),
        wd AS (SELECT w.id, v.k, count(*) AS x FROM w JOIN v ON v.lang = w.lang AND v.w = w.w GROUP BY ALL),
        wp AS (SELECT t.id, coalesce(wd.x, 0) / wn.n AS p, wr.q, (coalesce(wd.x, 0) / wn.n + wr.q) / 2 AS m
            FROM t JOIN wn ON wn.id = t.id AND wn.n >= 40 JOIN wr ON wr.lang = t.lang LEFT JOIN wd ON wd.id = t.id AND wd.k = wr.k),
        wj AS (SELECT id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2)) AS js FROM wp GROUP BY id)
        SELECT doc_id, lang, round(cj.js, 6) AS char_js, round(wj.js, 6) AS word_js, CAST(coalesce(wn.n, 0) AS INTEGER) AS n_words, coalesce(cj.js > 0.25, false) OR coalesce(wj.js > 0.42, false) AS flagged
        FROM t LEFT JOIN cj USING (id) LEFT JOIN wj USING (id) LEFT JOIN wn USING (id)""",
    "op3_sharding": r"""
        WITH k AS (SELECT *, coalesce('=' || source, '') AS s, md5('shards-1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY s) AS n, (CAST('0x' || substr(md5('shards-1;' || s), 1, 8) AS BIGINT) + 0.5) / 4294967296 AS u FROM k),
        x AS (SELECT *, (CAST(r AS DOUBLE) - 1 + u) / CAST(n AS DOUBLE) AS stand FROM r),
        p AS (SELECT *, row_number() OVER (ORDER BY stand, s, h, doc_id) - 1 AS p FROM x)
        SELECT doc_id, text, lang, source, n_chars, p // 250 AS shard, CAST(p % 250 + 1 AS INTEGER) AS position FROM p""",
    "op4_line_templates": r"""
        WITH RECURSIVE t AS (SELECT text, row_number() OVER (ORDER BY md5(text)) AS t FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
        l AS (SELECT t, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM (SELECT t, string_split(text, chr(10)) AS x FROM t)),
        m AS (SELECT t, k, regexp_replace(trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM l),
        n AS (SELECT t, k, m, string_split(m, ' ') AS w FROM m WHERE m <> ''),
        q AS (SELECT len(w) AS n, w[1:2] AS head, m, w, count(*) AS c FROM n GROUP BY m, w),
        leaf AS (SELECT n, head, ceil(0.75 * n) AS need, list(m ORDER BY m) AS ms, list(w ORDER BY m) AS ws FROM q GROUP BY n, head HAVING sum(c) >= 5),
        walk AS (
            SELECT n, head, need, ms, ws, 0 AS i, CAST([] AS VARCHAR[][]) AS g, CAST([] AS BIGINT[]) AS a FROM leaf
            UNION ALL
            SELECT n, head, need, ms, ws, i + 1,
                CASE WHEN best > 0 THEN [CASE WHEN j = best THEN [CASE WHEN g[j][p] = ws[i + 1][p] THEN g[j][p] END for p in range(1, n + 1)] ELSE g[j] END for j in range(1, len(g) + 1)] ELSE list_append(g, ws[i + 1]) END,
                list_append(a, CASE WHEN best > 0 THEN best ELSE len(g) + 1 END)
            FROM (SELECT *, CASE WHEN coalesce(list_max(s), 0) >= need THEN list_position(s, list_max(s)) ELSE 0 END AS best FROM (SELECT *, [len(list_filter(range(1, n + 1), lambda p: coalesce(y[p] = ws[i + 1][p], false))) for y in g] AS s FROM walk WHERE i < len(ws)))),
        template AS (SELECT n, head, unnest(ms) AS m, unnest(a) AS g FROM walk WHERE i = len(ws)),
        hold AS (SELECT DISTINCT x.n, x.head, x.g, y.t FROM template x JOIN n y USING (m)),
        wide AS (SELECT n, head, g, list(t ORDER BY t) AS ts FROM hold GROUP BY n, head, g HAVING count(*) >= 5),
        -- texts that are near copies, as op8 has it
        d AS (SELECT t, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM t WHERE t IN (SELECT unnest(ts) FROM wide)),
        s AS (SELECT t, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[k:k + 2], ' ') for k in range(1, len(w) - 1)] ELSE [array_to_string(w, ' ')] END) AS s FROM d),
        u AS (SELECT t, s, count(*) AS n, sum(count(*)) OVER (PARTITION BY t) AS total FROM s GROUP BY t, s),
        p AS (SELECT x.t AS a, y.t AS b, max(x.total) AS ta, max(y.total) AS tb, sum(x.n) AS sa, sum(y.n) AS sb FROM u x JOIN u y ON x.s = y.s AND x.t < y.t GROUP BY x.t, y.t HAVING sum(least(x.n / x.total, y.n / y.total)) >= 0.499),
        e AS (SELECT p.a, p.b, p.ta - p.sa AS oa, p.tb - p.sb AS ob, x.n AS na, y.n AS nb, x.n / y.n AS r FROM p JOIN u x ON x.t = p.a JOIN u y ON y.t = p.b AND y.s = x.s),
        w AS (SELECT a, b, oa, ob, na, nb, sum(na) OVER (PARTITION BY a, b ORDER BY r RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ua,
            sum(nb) OVER (PARTITION BY a, b ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(nb) OVER (PARTITION BY a, b, r) AS ub FROM e),
        near AS (SELECT b, list(a) AS before FROM (SELECT a, b FROM w GROUP BY a, b HAVING sum(1 / ((ua + oa) / na + (ub + ob) / nb)) >= 0.5) GROUP BY b),
        held AS (SELECT n, head, g, ts, list(coalesce(before, []) ORDER BY x.t) AS near FROM (SELECT n, head, g, ts, unnest(ts) AS t FROM wide) x LEFT JOIN near ON near.b = x.t GROUP BY n, head, g, ts),
        lead AS (
            SELECT n, head, g, ts, near, 0 AS i, CAST([] AS BIGINT[]) AS led FROM held
            UNION ALL
            SELECT n, head, g, ts, near, i + 1, CASE WHEN list_has_any(led, near[i + 1]) THEN led ELSE list_append(led, ts[i + 1]) END FROM lead WHERE i < len(ts) AND len(led) < 5),
        recurs AS (SELECT DISTINCT n, head, g FROM lead WHERE len(led) >= 5),
        gone AS (SELECT t, list(k) AS ks FROM n JOIN template USING (m) JOIN recurs ON recurs.n = template.n AND recurs.head = template.head AND recurs.g = template.g GROUP BY t)
        SELECT doc_id, CASE WHEN ks IS NULL THEN d.text ELSE array_to_string([x for x, i in string_split(d.text, chr(10)) if NOT list_contains(ks, i)], chr(10)) END AS text, CAST(coalesce(len(ks), 0) AS INTEGER) AS lines_dropped
        FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN gone USING (t)""",
    "op7_repeated_passages": r"""
        WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        s AS (SELECT doc_id, hash(text) AS h, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM t),
        g AS (SELECT doc_id, h, w, unnest(range(1, len(w) - 48)) AS k FROM s WHERE len(w) >= 50),
        x AS (SELECT doc_id, h, k - 1 AS lo, md5(array_to_string(w[k:k + 49], ' ')) AS g FROM g),
        r AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
        y AS (SELECT doc_id, h, lo, first, CASE WHEN lo > lag(lo) OVER (PARTITION BY doc_id, h ORDER BY lo) + 50 THEN 1 ELSE 0 END AS new FROM x JOIN r USING (g)),
        z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, h ORDER BY lo) AS island FROM y)
        SELECT doc_id, CAST(min(lo) AS INTEGER) AS start_word, CAST(max(lo) - min(lo) + 50 AS INTEGER) AS n_words, min(first) AS first_doc_id
        FROM z GROUP BY doc_id, h, island""",
    "op8_near_duplicates": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(string_agg(text, chr(10) ORDER BY text)), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) GROUP BY doc_id),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[k:k + 2], ' ') for k in range(1, len(w) - 1)] ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
        c AS (SELECT doc_id, s, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM s GROUP BY doc_id, s),
        f AS (SELECT doc_id, md5(string_agg(s || ':' || n, '|' ORDER BY s)) AS f FROM c GROUP BY doc_id),
        first AS (SELECT f, min(doc_id) AS doc_id FROM f GROUP BY f),
        u AS (SELECT c.* FROM c JOIN first USING (doc_id)),
        -- no similarity exceeds the sum of the smaller shares
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, max(x.total) AS ta, max(y.total) AS tb, sum(x.n) AS sa, sum(y.n) AS sb FROM u x JOIN u y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id HAVING sum(least(x.n / x.total, y.n / y.total)) >= 0.499),
        e AS (SELECT p.a, p.b, p.ta - p.sa AS oa, p.tb - p.sb AS ob, x.n AS na, y.n AS nb, x.n / y.n AS r FROM p JOIN u x ON x.doc_id = p.a JOIN u y ON y.doc_id = p.b AND y.s = x.s),
        g AS (SELECT a, b, r, oa, ob, na, nb, sum(na) OVER (PARTITION BY a, b ORDER BY r RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ua,
            sum(nb) OVER (PARTITION BY a, b ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(nb) OVER (PARTITION BY a, b, r) AS ub FROM e),
        j AS (SELECT a, b FROM g GROUP BY a, b HAVING sum(1 / ((ua + oa) / na + (ub + ob) / nb)) >= 0.5),
        k AS (SELECT a, b FROM j UNION SELECT b, a FROM j UNION SELECT first.doc_id, f.doc_id FROM f JOIN first USING (f) WHERE f.doc_id <> first.doc_id UNION SELECT f.doc_id, first.doc_id FROM f JOIN first USING (f) WHERE f.doc_id <> first.doc_id),
        reach(x, y) AS (SELECT a, a FROM k UNION SELECT reach.x, k.b FROM reach JOIN k ON k.a = reach.y),
        roots AS (SELECT x AS doc_id, min(y) AS group_id FROM reach GROUP BY x)
        SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM roots""",
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
        i AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS k FROM b WHERE w <> ['']),
        p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k:k + 7], ' ') || ' ' AS p FROM i)
        SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS windows FROM d JOIN p ON contains(d.t, p.p) GROUP BY ALL""",
}
