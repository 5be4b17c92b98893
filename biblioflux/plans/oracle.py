"""DuckDB SQL for the rows of the queries, by name: written from the definitions, not from the Spark code."""

from __future__ import annotations

from biblioflux.functions.text import STOP_WORDS
from biblioflux.operators.features import TFIDF_STOP_WORDS
from biblioflux.operators.hierarchy import TYPES


def _norm(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower({x}), '\\[A-Za-z]+\{{([^}}]*)\}}', '\1', 'g'), '[{{}}$\\]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


_PAIRS = f"""
    e AS (SELECT source AS pub_id, item_id AS bib_key, substr(text, 1, 80) AS b_raw FROM benchmark, (SELECT DISTINCT source FROM documents)),
    c AS (SELECT source AS pub_id, doc_id AS candidate_id, substr(text, 1, 80) AS c_raw FROM documents),
    en AS (SELECT *, {_norm('b_raw')} AS b_norm FROM e), cn AS (SELECT *, {_norm('c_raw')} AS c_norm FROM c)"""


def _topk(words: str) -> str:
    return f"""{_PAIRS},
    ew AS (SELECT pub_id, bib_key, {words.format('b_norm')} AS b FROM en), cw AS (SELECT pub_id, candidate_id, {words.format('c_norm')} AS c FROM cn),
    s AS (SELECT pub_id, bib_key, candidate_id, round({_jaccard('b', 'c')}, 6) AS score FROM ew JOIN cw USING (pub_id)),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY score DESC, candidate_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5)"""


_TITLES = _topk(_words("{}"))
_BIGRAM_WORDS = "list_distinct([array_to_string(list_filter(string_split({0}, ' '), lambda w: w <> '')[i:i + 1], ' ') for i in range(1, len(list_filter(string_split({0}, ' '), lambda w: w <> '')))])"

#: Longest common subsequence of each pair (a, b) of table q, one row of the table at a time, and in it one cell after the other:
#: new[j] is old[j - 1] + 1 where the characters agree, else the larger of old[j] and new[j - 1].
_LCS = """
    step(a, b, i, row) AS (
        SELECT a, b, 0, [0 for _ in range(len(b) + 1)] FROM q
        UNION ALL
        SELECT a, b, i + 1, list_reduce(CAST(range(1, len(b) + 1) AS INTEGER[]), lambda acc, j: list_append(acc, CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[-1]) END), [0])
        FROM step WHERE i < len(a)),
    lcs AS (SELECT a, b, row[-1] AS n FROM step WHERE i = len(a)),
    ratio AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0 ELSE round_even(100 * (2.0 * n / (len(a) + len(b))), 0) / 100 END AS r FROM lcs)"""

_SORTED = "array_to_string(list_sort(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ')"
_LIST = "list_sort(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> ''))"

_NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT x.name AS a0, y.name AS b0 FROM n x JOIN n y ON x.name < y.name)"

_PEOPLE = """
    w AS (SELECT c_custkey, c_nationkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, chr(CAST(65 + c_custkey % 5 AS INTEGER)) AS i1, chr(CAST(65 + c_custkey % 3 AS INTEGER)) AS i2 FROM customer),
    p AS (SELECT x.c_custkey AS a_key, y.c_custkey AS b_key, lower(x.seg) AS sa, lower(y.seg) AS sb, x.i1 AS a1, y.i1 AS b1, x.i2 AS a2, y.i2 AS b2 FROM w x JOIN w y ON x.c_nationkey = y.c_nationkey AND x.c_custkey // 500 = y.c_custkey // 500 AND x.c_custkey < y.c_custkey)"""

_PARTS = """
    e AS (SELECT 'p' || (p_partkey // 20) AS pub_id, p_partkey AS ord, 'part' || p_partkey AS bib_key, p_name || ' ' || lower(p_type) AS title, replace(p_brand, '#', ' ') || ' and Common' AS author, CAST(1990 + p_size % 3 AS VARCHAR) AS year,
        CASE WHEN p_size % 2 = 0 THEN lower(p_brand) END AS journal, CASE WHEN p_size % 3 = 0 THEN 'article' ELSE 'misc' END AS entry_type FROM part)"""

_AUTO = (
    _PARTS
    + """,
    pp AS (SELECT pub_id, x.bib_key, y.bib_key AS candidate_id, x.ord AS bib_ord, y.ord AS cand_ord, x.title AS t1, y.title AS t2, x.year AS y1, y.year AS y2, x.author AS w1, y.author AS w2 FROM e x JOIN e y USING (pub_id) WHERE x.ord <> y.ord),
    q AS (SELECT DISTINCT t1 AS a, t2 AS b FROM pp), """
    + _LCS
    + """,
    lab AS (SELECT pp.*, CASE WHEN len(t1) > 10 AND len(t2) > 10 AND (r >= 1 OR r >= 0.9 AND abs(CAST(y1 AS INTEGER) - CAST(y2 AS INTEGER)) <= 1
        OR r >= 0.8 AND len(list_intersect(list_distinct([split_part(lower(w1), ' ', 2), 'common']), list_distinct([split_part(lower(w2), ' ', 2), 'common']))) / 2 >= 0.6) THEN 1 END AS label
        FROM pp JOIN ratio ON a = t1 AND b = t2)"""
)

_LABELS = (
    _TITLES
    + """,
    least AS (SELECT source AS pub_id, min(doc_id) AS cand FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source),
    manual AS (SELECT e.pub_id, e.bib_key, cand AS candidate_id FROM e JOIN least USING (pub_id) WHERE e.bib_key % 3 = 0),
    auto AS (SELECT pub_id, bib_key, candidate_id FROM top WHERE rank = 1 AND score >= 0.1),
    merged AS (SELECT t.pub_id, t.bib_key, t.candidate_id,
        CASE WHEN m.candidate_id IS NOT NULL THEN CAST(t.candidate_id = m.candidate_id AS INTEGER) WHEN a.candidate_id IS NOT NULL THEN CAST(t.candidate_id = a.candidate_id AS INTEGER) ELSE 0 END AS label,
        CASE WHEN m.candidate_id IS NOT NULL THEN 'manual' WHEN a.candidate_id IS NOT NULL THEN 'auto' ELSE 'none' END AS origin
        FROM top t LEFT JOIN manual m USING (pub_id, bib_key) LEFT JOIN auto a USING (pub_id, bib_key))"""
)

_SPLIT = """
    pubs AS (SELECT DISTINCT source AS pub_id FROM documents),
    r AS (SELECT pub_id, row_number() OVER (ORDER BY md5('42:' || pub_id), pub_id) AS r, count(*) OVER () AS n FROM pubs),
    split AS (SELECT pub_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS split FROM r)"""

_GROUPS = (
    _PARTS
    + """,
    pp AS (SELECT x.ord AS x, y.ord AS y, lower(x.title) AS t1, lower(y.title) AS t2, x.author AS w1, y.author AS w2 FROM e x JOIN e y ON x.pub_id = y.pub_id AND x.ord < y.ord),
    q AS (SELECT DISTINCT t1 AS a, t2 AS b FROM pp), """
    + _LCS
    + """,
    dup AS (SELECT x, y FROM pp JOIN ratio ON a = t1 AND b = t2 WHERE r >= 0.95 OR r >= 0.8 AND w1 = w2),
    earlier AS (SELECT e.ord, coalesce(list(x ORDER BY x) FILTER (WHERE x IS NOT NULL), []) AS before FROM e LEFT JOIN dup ON y = ord GROUP BY e.ord),
    walk(k, seeds) AS (
        SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[])
        UNION ALL
        SELECT ord, CASE WHEN list_has_any(seeds, before) THEN seeds ELSE list_append(seeds, ord) END FROM walk JOIN earlier ON ord = k + 1),
    final AS (SELECT seeds FROM walk ORDER BY k DESC LIMIT 1),
    grp AS (SELECT ord, CASE WHEN list_contains(seeds, ord) THEN ord ELSE list_min(list_intersect(before, seeds)) END AS seed FROM earlier, final),
    m AS (SELECT e.*, seed, 10 + 10 + 5 + CASE WHEN journal IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN regexp_matches(bib_key, '^[a-z]+[0-9]{4}') THEN 5 ELSE 0 END AS score,
        CASE WHEN entry_type = 'article' THEN 3 ELSE 1 END AS pri FROM e JOIN grp USING (ord)),
    who AS (SELECT seed, list(name ORDER BY place) AS names FROM (SELECT seed, name, min(ord * 10 + k) AS place FROM (SELECT seed, ord, unnest(string_split(author, ' and ')) AS name, generate_subscripts(string_split(author, ' and '), 1) AS k FROM m) GROUP BY seed, name) GROUP BY seed),
    mg AS (SELECT seed, arg_min(bib_key, (-score, len(bib_key), ord)) AS bib_key, string_agg(bib_key, ',' ORDER BY ord) AS keys, arg_min(entry_type, (-pri, ord)) AS entry_type,
        arg_min(title, (-len(title), ord)) AS title, arg_min(year, ord) AS year, arg_min(journal, ord) FILTER (WHERE journal IS NOT NULL) AS journal FROM m GROUP BY seed)"""
)

_LATEX = r"""
    t AS (SELECT doc_id, '\section{Introduction} We follow \cite{' || source || ', ' || lang || '}. ' || substr(text, 1, CAST(trunc(length(text) / 2) AS INTEGER)) || ' % note' || chr(10)
        || '\section{Methods} By \citep[see]{' || lang || '} it holds.' || chr(10) || chr(10) || substr(text, CAST(trunc(length(text) / 2) AS INTEGER) + 1) AS text FROM (SELECT doc_id, source, lang, replace(text, '$', '') AS text FROM documents))"""

_CITES = (
    _LATEX
    + r""",
    g AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\cite(?:p|t|author|year|alp)?\*?\s*(?:\[[^\[\]]*\]\s*)?\{([^{}]+)\}', 1)) AS g FROM t),
    k AS (SELECT doc_id, trim(unnest(string_split(g, ','))) AS bib_key FROM g)"""
)

_TREE = "x AS (SELECT conv_id, turn, CAST(CASE WHEN turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS BIGINT) AS parent FROM conversations)"

_VECTORS = """
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    s AS (SELECT a.vec_id AS bib_key, b.vec_id AS candidate_id, a.label = b.label AS same,
        round(list_sum([a.e[i] * b.e[i] for i in range(1, len(a.e) + 1)]) / (sqrt(list_sum([x * x for x in a.e])) * sqrt(list_sum([x * x for x in b.e]))), 6) AS score FROM v a JOIN v b ON a.vec_id % 10 = 0 AND b.vec_id % 2 = 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY bib_key ORDER BY score DESC, candidate_id) AS rank FROM s QUALIFY rank <= 5),
    truth AS (SELECT bib_key, arg_min(candidate_id, (abs(candidate_id - bib_key), candidate_id)) AS candidate_id FROM s WHERE same GROUP BY bib_key),
    r AS (SELECT truth.bib_key, truth.candidate_id, top.rank FROM truth LEFT JOIN top USING (bib_key, candidate_id))"""

_STOPS = "[" + ", ".join(f"'{w}'" for w in TFIDF_STOP_WORDS) + "]"


def _terms(x: str) -> str:
    """Words of two characters or more of a title, without stop words."""
    return rf"list_filter(string_split(regexp_replace(lower(substr({x}, 1, 80)), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: len(w) > 1 AND NOT list_contains({_STOPS}, w))"


def _pairs_of(w: str) -> str:
    return f"[{w}[i] || ' ' || {w}[i + 1] for i in range(1, len({w}))]"


def _fuzz(x: str) -> str:
    """Sorted words as the token scores see them, without the characters U+0080 to U+00FF."""
    return rf"list_sort(list_filter(string_split(regexp_replace(regexp_replace(lower({x}), '[\x{{80}}-\x{{FF}}]', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> ''))"


def _sets(x: str, y: str) -> str:
    """Columns i, ix and iy: the shared words of two lists, and these followed by each list's own."""
    both = f"array_to_string(list_sort(list_intersect({x}, {y})), ' ')"
    own = lambda a, b: f"trim({both} || ' ' || array_to_string(list_sort(list_distinct(list_filter({a}, lambda w: NOT list_contains({b}, w)))), ' '))"
    return f"{both} AS i, {own(x, y)} AS ix, {own(y, x)} AS iy"


_STRIPPED = (
    _LATEX
    + r""",
    cl AS (SELECT doc_id, list_filter(string_split(replace(text, '\%', chr(57344)), chr(10)), lambda x: NOT regexp_matches(x, '^\s*%')) AS x FROM t),
    st AS (SELECT doc_id, replace(array_to_string([rtrim(regexp_replace(regexp_replace(l, '(^|[^0-9])%.*$', '\1'), '[ \t\r]+$', '')) for l in x], chr(10)), chr(57344), '%') AS s FROM cl)"""
)


def _rules(x: str, *rules: tuple[str, str]) -> str:
    for pattern, put in rules:
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return x


_TABULAR = [(r"\[htpb!?\]|\[H\]|\[[htb]!\]|\[p\]", "")]
_PLAIN = _rules(
    "s", *_TABULAR, (r"~?\s*\\cite[pt]?\*?\s*(?:\[[^\[\]]*\]\s*)?\{([^{}]+)\}", r"[\1]"), ("~", " "), (r"\\([%&$_])", r"\1"),
    (r"\[[htpb!]+\]", ""), (r"\[(?:width|height|scale)=[^\]]+\]", ""), (r"(?i)[\p{L}\p{N}_/-]+\.(?:png|jpg|jpeg|pdf|eps|svg)", ""),
    (r"\\[A-Za-z]+[*]?\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z]+\*?", ""), ("[{}]", ""), (r"\\\\", " "), (r"[\n\t\r]", " "), (r"[\x00-\x1f\x{7f}-\x{9f}]", ""),
    (r"\s+", " "), (r"\s+([.,;:!?])", r"\1"), (r"([.,;:!?])([.,;:!?])", r"\1 \2"),
)
_CLEAN = _rules("s", *_TABULAR, (r"[\t ]+", " "), (r"\n\s*\n\s*\n+", chr(10) * 2), (r"(?m)[ \r\f]+$", ""), (r"^\s+|\s+$", ""))

_ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "vs", "etc", "Fig", "Eq", "No", "Vol", "et al", "e.g", "i.e", "Ph.D", "M.D", "U.S", "U.K", "A.I", "M.L"]
_HELD = _rules("p", *[(rf"\b{x.replace('.', chr(92) + '.')}\.", x.replace(".", chr(57345)) + chr(57345)) for x in _ABBREVIATIONS])
_CUT = [(r"([.!?])\s+([A-Z0-9])", r"\1" + chr(57346) + r"\2")] * 2
#: Sentences of the two sections of each document's LaTeX, by paragraph.
_SENTENCES = (
    _STRIPPED
    + rf""",
    sec AS (SELECT doc_id, k, unnest(string_split_regex(g, '\n\s*\n')) AS p FROM (SELECT doc_id, unnest([0, 1]) AS k, unnest(string_split(substr(s, len('\section{{Introduction}}') + 1), '\section{{Methods}}')) AS g FROM st)),
    sh AS (SELECT doc_id, k, unnest(string_split({_rules(_HELD, *_CUT)}, chr(57346))) AS x FROM (SELECT doc_id, k, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM sec)),
    sp AS (SELECT doc_id, k, regexp_replace(unnest(CASE WHEN len(x) - len(replace(x, '%', '')) >= 2 THEN string_split(regexp_replace(x, '\.\s+([0-9]+%)', '.' || chr(57346) || '\1', 'g'), chr(57346)) ELSE [x] END), '^\s+|\s+$', '', 'g') AS x FROM sh),
    sn AS (SELECT doc_id, k, replace(x, chr(57345), '.') AS s FROM sp WHERE len(x) >= 5 AND NOT regexp_matches(x, '^[0-9\s%.,;:]+$'))"""
)

_RANKER = (
    _AUTO
    + """,
    f AS (SELECT pub_id, bib_key, candidate_id, r AS f1, len(list_intersect(list_distinct(string_split(t1, ' ')), list_distinct(string_split(t2, ' ')))) / len(list_distinct(list_concat(string_split(t1, ' '), string_split(t2, ' ')))) AS f2,
        CAST(y1 = y2 AS DOUBLE) AS f3, CASE WHEN split_part(lower(w1), ' ', 2) = split_part(lower(w2), ' ', 2) THEN 1.0 ELSE 0.5 END AS f4 FROM pp JOIN ratio ON a = t1 AND b = t2),
    g AS (SELECT *, f2 >= 0.6 AND f4 >= 0.5 AS good FROM f)"""
)

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

SQL: dict[str, str] = {
    "title_jaccard_topk": f"WITH {_TITLES} SELECT pub_id, bib_key, candidate_id, rank, score FROM top",
    "bigram_topk": f"WITH {_topk(_BIGRAM_WORDS)} SELECT pub_id, bib_key, candidate_id, rank, score FROM top",
    "title_ratio_stats": f"""WITH {_PAIRS},
        en2 AS (SELECT *, len(list_filter(string_split_regex(b_raw, '\\s+'), lambda w: w <> '')) AS x FROM en), cn2 AS (SELECT *, len(list_filter(string_split_regex(c_raw, '\\s+'), lambda w: w <> '')) AS y FROM cn)
        SELECT pub_id, round(avg(CASE WHEN x > 0 AND y > 0 THEN least(x, y) / greatest(x, y) ELSE 0.0 END), 6) AS avg_ratio, sum(CASE WHEN b_norm = c_norm AND b_norm <> '' THEN 1 ELSE 0 END) AS exact_pairs FROM en2 JOIN cn2 USING (pub_id) GROUP BY pub_id""",
    "pair_statistics": """WITH d AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT count(*) AS m FROM benchmark)
        SELECT count(*) AS publications, sum(n * m) AS pairs, avg(m) AS avg_m, avg(n) AS avg_n, avg(n) - 1 AS imbalance FROM d, b""",
    "labelling_candidates": """WITH d AS (SELECT source AS pub_id, count(*) AS n FROM documents GROUP BY source), b AS (SELECT count(*) AS m FROM benchmark)
        SELECT pub_id, m, n, least(m, n) AS potential, CASE WHEN least(m, n) < 20 THEN 'too few' ELSE 'eligible' END AS status FROM d, b""",
    "fuzzy_scores": f"""WITH RECURSIVE {_NAMES},
        s AS (SELECT a0, b0, {_LIST.format('a0')} AS x, {_LIST.format('b0')} AS y FROM p),
        f AS (SELECT a0, b0, array_to_string(x, ' ') AS sx, array_to_string(y, ' ') AS sy, array_to_string(list_sort(list_intersect(x, y)), ' ') AS i,
            trim(array_to_string(list_sort(list_intersect(x, y)), ' ') || ' ' || array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ')) AS ix,
            trim(array_to_string(list_sort(list_intersect(x, y)), ' ') || ' ' || array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ')) AS iy FROM s),
        q AS (SELECT a0 AS a, b0 AS b FROM p UNION SELECT sx, sy FROM f UNION SELECT i, ix FROM f UNION SELECT i, iy FROM f UNION SELECT ix, iy FROM f), {_LCS}
        SELECT f.a0 AS a, f.b0 AS b, r1.r AS indel, r2.r AS token_sort, greatest(r3.r, r4.r, r5.r) AS token_set FROM f
        JOIN ratio r1 ON r1.a = f.a0 AND r1.b = f.b0 JOIN ratio r2 ON r2.a = sx AND r2.b = sy JOIN ratio r3 ON r3.a = i AND r3.b = ix JOIN ratio r4 ON r4.a = i AND r4.b = iy JOIN ratio r5 ON r5.a = ix AND r5.b = iy""",
    "partial_ratios": f"""WITH RECURSIVE p AS (SELECT n_name, r_name, CASE WHEN len(n_name) <= len(r_name) THEN n_name ELSE r_name END AS s, CASE WHEN len(n_name) <= len(r_name) THEN r_name ELSE n_name END AS l FROM nation, region),
        w AS (SELECT n_name, r_name, s, unnest([substr(l, greatest(1, i), len(s) + least(0, i - 1)) for i in range(2 - len(s), len(l) + 1)]) AS x FROM p),
        q AS (SELECT DISTINCT s AS a, x AS b FROM w WHERE x <> ''), {_LCS}
        SELECT n_name AS a, r_name AS b, max(r) AS partial FROM w JOIN ratio ON a = s AND b = x GROUP BY n_name, r_name""",
    "author_features": f"""WITH {_PEOPLE}
        SELECT a_key, b_key, CASE WHEN sa = sb THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS overlap, CAST(CASE WHEN sa = sb THEN 2 ELSE 1 END AS INTEGER) AS common, CAST(sa = sb AS INTEGER) AS first_match, 1 AS last_match,
        (CASE WHEN sa = sb AND a1 = b1 THEN 1 ELSE 0 END + CASE WHEN a2 = b2 THEN 1 ELSE 0 END)::DOUBLE / 2 AS initials FROM p""",
    "loose_author_overlap": f"""WITH {_PEOPLE}, l AS (SELECT a_key, b_key, list_distinct([sa, lower(a1) || '.', 'lee']) AS x, list_distinct([sb, lower(b1) || '.', 'lee']) AS y FROM p)
        SELECT a_key, b_key, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS overlap FROM l""",
    "year_features": """WITH j AS (SELECT year(o_orderdate) AS a, year(l_shipdate) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
        f AS (SELECT CAST(CASE WHEN b IS NULL THEN -1 ELSE least(abs(a - b), 10) END AS INTEGER) AS year_diff, CAST(coalesce(a = b, false) AS INTEGER) AS year_exact_match, CAST(coalesce(abs(a - b) <= 1, false) AS INTEGER) AS year_within_1, CAST(b IS NOT NULL AS INTEGER) AS both_years_present FROM j)
        SELECT *, count(*) AS n FROM f GROUP BY ALL""",
    "auto_label": f"WITH RECURSIVE {_AUTO} SELECT bib_key, candidate_id, label FROM lab WHERE label = 1",
    "auto_label_first": f"WITH RECURSIVE {_AUTO} SELECT pub_id, bib_key, arg_min(candidate_id, cand_ord) AS candidate_id FROM lab WHERE label = 1 AND bib_ord % 7 <> 0 GROUP BY pub_id, bib_key",
    "merge_labels": f"WITH {_LABELS} SELECT pub_id, bib_key, candidate_id, label, origin FROM merged",
    "ground_truth": f"WITH {_LABELS} SELECT pub_id, bib_key, coalesce(m.candidate_id, a.candidate_id) AS candidate_id FROM manual m FULL JOIN auto a USING (pub_id, bib_key)",
    "label_gate": f"WITH {_LABELS} SELECT count(DISTINCT pub_id) AS publications, count(*) AS labels, CASE WHEN count(DISTINCT pub_id) >= 5 AND count(*) >= 20 THEN 'PASS' ELSE 'FAIL' END AS status FROM manual",
    "label_statistics": f"""WITH {_LABELS}, per AS (SELECT pub_id, max(CAST(origin = 'manual' AS INTEGER)) AS m, max(CAST(origin = 'auto' AS INTEGER)) AS a FROM merged GROUP BY pub_id)
        SELECT CAST(sum(m) AS BIGINT) AS manual_publications, CAST(sum(CASE WHEN m = 0 THEN a ELSE 0 END) AS BIGINT) AS auto_publications, CAST(100.0 * sum(CASE WHEN m = 0 THEN a ELSE 0 END) / nullif(sum(CASE WHEN m = 0 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS auto_percent FROM per""",
    "split_publications": f"WITH {_SPLIT} SELECT pub_id, split FROM split",
    "split_by_origin": """WITH o AS (SELECT source AS pub_id, max(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 2 ELSE 1 END) AS o FROM documents GROUP BY source),
        r AS (SELECT pub_id, row_number() OVER (PARTITION BY o ORDER BY pub_id) AS r FROM o) SELECT pub_id, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS split FROM r""",
    "balance_under": """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS bib_key, 1 - quality AS label FROM labels),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:p:' || bib_key || ':' || bib_key)) AS r FROM l)
        SELECT bib_key, label FROM r WHERE label = 1 OR r <= (SELECT least(count(*) FILTER (WHERE label = 0), 2 * count(*) FILTER (WHERE label = 1)) FROM l)""",
    "balance_over": """WITH n AS (SELECT count(*) FILTER (WHERE quality = 0) AS p, count(*) FILTER (WHERE quality = 1) AS n FROM labels)
        SELECT 1 AS label, CAST(p * greatest(1, floor(n / (greatest(p, 1) * 2.0))) AS BIGINT) AS n FROM n WHERE p > 0 UNION ALL SELECT 0, n FROM n WHERE n > 0""",
    "content_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[“”‘’''`]', '"', 'g') AS a FROM documents),
        n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(a, '[–—−]', '-', 'g'), '\s+([.,;:!?])', '\1', 'g'), '([.,;:!?])\s+', '\1 ', 'g')) AS n FROM t)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS canonical FROM n""",
    "reference_groups": f"WITH RECURSIVE {_GROUPS} SELECT pub_id, ord, seed FROM grp JOIN e USING (ord)",
    "reference_merge": f"WITH RECURSIVE {_GROUPS} SELECT seed, bib_key, keys, entry_type, title, array_to_string(names, ' and ') AS author, year, journal FROM mg JOIN who USING (seed)",
    "rename_citations": f"""WITH RECURSIVE {_GROUPS} SELECT ord, 'See \\citep[p. 3]{{' || mg.bib_key || CASE WHEN mg.bib_key = 'part' || ord THEN ', ' ELSE ',' END || 'other}}.' AS renamed_text FROM grp JOIN mg USING (seed)""",
    "comment_strip": _LATEX.join(["WITH ", ""])
    + r""",
        x AS (SELECT doc_id, list_filter(string_split(replace(text, '\%', chr(57344)), chr(10)), lambda x: NOT regexp_matches(x, '^\s*%')) AS x FROM t)
        SELECT doc_id, replace(array_to_string([rtrim(regexp_replace(regexp_replace(l, '(^|[^0-9])%.*$', '\1'), '[ \t\r]+$', '')) for l in x], chr(10)), chr(57344), '%') AS stripped FROM x""",
    "citation_index": f"WITH {_CITES} SELECT bib_key, count(*) AS citations, count(DISTINCT doc_id) AS elements FROM k WHERE bib_key <> '' GROUP BY bib_key",
    "cocitation": f"""WITH {_CITES}, d AS (SELECT DISTINCT doc_id, bib_key FROM k)
        SELECT x.bib_key, CAST(count(DISTINCT y.bib_key) AS INTEGER) AS co_citation_count FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.bib_key <> y.bib_key GROUP BY x.bib_key""",
    "latex_sections": "SELECT 'Introduction' AS raw_text, count(*) AS n FROM documents UNION ALL SELECT 'Methods', count(*) FROM documents",
    "tree_depth": f"""WITH RECURSIVE {_TREE}, c(conv_id, turn, node, depth, chain) AS (SELECT conv_id, turn, parent, 1, CAST(parent AS VARCHAR) FROM x WHERE parent IS NOT NULL
        UNION ALL SELECT c.conv_id, c.turn, x.parent, depth + 1, chain || '>' || x.parent FROM c JOIN x ON x.conv_id = c.conv_id AND x.turn = c.node WHERE x.parent IS NOT NULL)
        SELECT conv_id, turn, depth, chain FROM c QUALIFY depth = max(depth) OVER (PARTITION BY conv_id, turn)""",
    "tree_siblings": f"WITH {_TREE} SELECT a.conv_id, a.turn, count(*) AS siblings FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.parent = b.parent GROUP BY ALL",
    "ranking_metrics": f"""WITH {_VECTORS} SELECT round(avg(coalesce(1 / rank, 0)), 6) AS mrr, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}' for k in (1, 3, 5))}, round(avg(CAST(coalesce(rank, 6) AS DOUBLE)), 6) AS avg_rank, count(*) AS queries FROM r""",
    "ranking_report": f"WITH {_VECTORS} SELECT bib_key, candidate_id, CAST(rank AS INTEGER) AS rank, rank IS NOT NULL AS found, round(coalesce(1 / rank, 0), 6) AS rr FROM r",
    "precision_at_5": f"WITH {_VECTORS}, p AS (SELECT bib_key, sum(CAST(same AS INTEGER)) / 5 AS p FROM top GROUP BY bib_key) SELECT round(avg(p), 6) AS precision_at_5 FROM p",
    "post_process": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE o_totalprice / 100000 END AS s, o_orderkey % 7 AS gap, o_custkey FROM orders),
        p AS (SELECT o_orderkey, s * CASE WHEN gap > 3 THEN 0.1::DOUBLE ELSE 1 END * CASE WHEN o_custkey % 2 = 0 THEN 1.2::DOUBLE ELSE 1 END AS s, o_custkey FROM o)
        SELECT o_orderkey, round(CASE WHEN o_custkey % 11 = 0 THEN 1.0::DOUBLE ELSE s END, 8) AS score FROM p""",
    "query_groups": """WITH g AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS pub_id, lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS bib_key, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (ORDER BY pub_id, bib_key) AS INTEGER) AS group_id FROM g""",
    "tfidf_cosine": f"""WITH b AS (SELECT item_id, {_terms('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_terms('text')} AS w FROM documents),
        bt AS (SELECT item_id, list_concat(w, {_pairs_of('w')}) AS a FROM b), dt AS (SELECT doc_id, list_concat(w, {_pairs_of('w')}) AS b FROM d),
        p AS (SELECT item_id, doc_id, a, b FROM bt, dt WHERE list_has_any(a, b)),
        x AS (SELECT item_id, doc_id, unnest(list_distinct(list_concat(a, b))) AS t, a, b FROM p),
        n AS (SELECT item_id, doc_id, len(list_filter(a, lambda x: x = t)) AS x, len(list_filter(b, lambda x: x = t)) AS y FROM x),
        v AS (SELECT item_id, doc_id, x * CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 1 + ln(1.5) END AS x, y * CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 1 + ln(1.5) END AS y FROM n),
        s AS (SELECT item_id, doc_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM v GROUP BY item_id, doc_id)
        SELECT item_id, doc_id, cosine FROM s WHERE cosine > 0.2""",
    "numeric_profile": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang, source",
    "completeness": " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) FILTER (WHERE {c}) AS present, round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6)::DOUBLE AS percent FROM documents" for n, c in (("text", "trim(text) <> ''"), ("lang", "trim(lang) <> ''"), ("short_text", "length(text) < 2000 AND trim(text) <> ''"))),
    "value_counts": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type",
    "histogram": "SELECT CAST(CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 500 THEN 1 WHEN n_chars < 1000 THEN 2 WHEN n_chars < 2000 THEN 3 WHEN n_chars < 5000 THEN 4 ELSE 5 END AS INTEGER) AS bucket, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 50000 GROUP BY 1",
    "version_sharing": """WITH e AS (SELECT user_id % 50 AS pub_id, event_type AS k, event_id % 3 AS v FROM events), n AS (SELECT pub_id, count(DISTINCT v) AS vs FROM e GROUP BY pub_id), p AS (SELECT pub_id, k, count(DISTINCT v) AS v FROM e GROUP BY pub_id, k)
        SELECT pub_id, count(*) FILTER (WHERE v = vs) AS shared, count(*) AS total, round(count(*) FILTER (WHERE v = vs) / count(*), 6) AS ratio FROM p JOIN n USING (pub_id) GROUP BY pub_id""",
    "correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]),
    "bibtex_export": f"""WITH {_PARTS} SELECT bib_key, '@' || entry_type || '{{' || bib_key || ',' || chr(10) || '  author = {{' || author || '}},' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  year = {{' || year || '}}'
        || CASE WHEN journal IS NULL THEN '' ELSE ',' || chr(10) || '  journal = {{' || journal || '}}' END || chr(10) || '}}' || chr(10) AS bibtex FROM e""",
    "bibtex_round_trip": f"WITH {_PARTS} SELECT bib_key, entry_type, title, author, year, journal FROM e",
    "bibitem_parse": f"""WITH {_PARTS} SELECT bib_key, 'misc' AS entry_type, 'A. Smith and B. Jones' AS author, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(title, ' ')], ' ') AS title, 'Journal of Parts, ' || year AS journal, year FROM e""",
    "arxiv_ids": """WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 5, '0') AS k, o_orderkey % 4 AS f FROM orders),
        a AS (SELECT o_orderkey, CASE f WHEN 0 THEN '2101.' || k WHEN 1 THEN 'hep-th/99' || k WHEN 2 THEN '1999.' || substr(k, 2, 4) END AS arxiv_id, CASE f WHEN 1 THEN 'https://example.org/abs/hep-th/99' || k WHEN 3 THEN 'none' END AS other FROM k)
        SELECT o_orderkey, arxiv_id, replace(arxiv_id, '.', '-') AS normal, coalesce(other, replace(arxiv_id, '.', '-')) AS standard FROM a""",
    "bibliography_fields": f"WITH {_PARTS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, round(100.0 * count({c}) / count(*), 6)::DOUBLE AS percent FROM e" for c in ("title", "author", "year", "journal")),
    "sentence_counts": r"""WITH d AS (SELECT doc_id, text AS t FROM documents),
        h AS (SELECT doc_id, list_reduce(list_concat([t], ['vs.', 'i.e.', 'etc.', 'e.g.', 'Vol.', 'U.S.', 'U.K.', 'Prof.', 'Ph.D.', 'No.', 'Ms.', 'Mrs.', 'Mr.', 'M.L.', 'M.D.', 'Fig.', 'Eq.', 'Dr.', 'A.I.', 'et al.']), lambda a, x: replace(a, x, replace(x, '.', chr(57345)))) AS t FROM d),
        s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(57346) || '\2', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(57346) || '\2', 'g'), chr(57346))) AS s FROM h),
        p AS (SELECT doc_id, trim(unnest(CASE WHEN len(s) - len(replace(s, '%', '')) >= 2 THEN string_split(regexp_replace(s, '\.\s+([0-9]+%)', '.' || chr(57346) || '\1', 'g'), chr(57346)) ELSE [s] END)) AS s FROM s)
        SELECT d.doc_id, CAST(count(p.s) FILTER (WHERE len(p.s) >= 5 AND NOT regexp_matches(p.s, '^[0-9\s%.,;:]+$')) AS INTEGER) AS sentences FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""",
    "suggest_labels": f"""WITH RECURSIVE {_PARTS},
        c AS (SELECT x.pub_id, x.bib_key, y.bib_key AS candidate_id, y.ord, {_fuzz('x.title')} AS t1, {_fuzz('y.title')} AS t2, {_fuzz('x.author')} AS w1, {_fuzz('y.author')} AS w2 FROM e x JOIN e y USING (pub_id) WHERE x.ord <> y.ord),
        f AS (SELECT *, array_to_string(t1, ' ') AS s1, array_to_string(t2, ' ') AS s2, {_sets('w1', 'w2')} FROM c),
        q AS (SELECT s1 AS a, s2 AS b FROM f UNION SELECT i, ix FROM f UNION SELECT i, iy FROM f UNION SELECT ix, iy FROM f), {_LCS},
        g AS (SELECT f.*, 70 * r1.r + 30 * greatest(r2.r, r3.r, r4.r) AS score FROM f JOIN ratio r1 ON r1.a = s1 AND r1.b = s2 JOIN ratio r2 ON r2.a = i AND r2.b = ix JOIN ratio r3 ON r3.a = i AND r3.b = iy JOIN ratio r4 ON r4.a = ix AND r4.b = iy)
        SELECT bib_key, candidate_id, CAST(row_number() OVER (PARTITION BY pub_id, bib_key ORDER BY score DESC, ord) AS INTEGER) AS rank, round(score, 4) AS score, rank = 1 AND g.score >= 85 AS accepted FROM g QUALIFY rank <= 3""",
    "match_features": f"""WITH RECURSIVE {_TITLES},
        m AS (SELECT t.pub_id, t.bib_key, t.candidate_id, b_raw, c_raw, b_norm, c_norm, {_words('b_norm')} AS x, {_words('c_norm')} AS y, {_fuzz('b_norm')} AS fx, {_fuzz('c_norm')} AS fy FROM top t JOIN en USING (pub_id, bib_key) JOIN cn USING (pub_id, candidate_id)),
        f AS (SELECT *, array_to_string(fx, ' ') AS sx, array_to_string(fy, ' ') AS sy, {_sets('fx', 'fy')}, {_BIGRAM_WORDS.format("trim(b_norm || ' ' || b_norm)")} AS bx, {_BIGRAM_WORDS.format("trim(c_norm || ' ' || c_norm)")} AS byy,
            len(list_filter(string_split_regex(b_raw, '\\s+'), lambda w: w <> '')) AS nx, len(list_filter(string_split_regex(c_raw, '\\s+'), lambda w: w <> '')) AS ny FROM m),
        q AS (SELECT b_norm AS a, c_norm AS b FROM f UNION SELECT sx, sy FROM f UNION SELECT i, ix FROM f UNION SELECT i, iy FROM f UNION SELECT ix, iy FROM f), {_LCS},
        v AS (SELECT pub_id, bib_key, candidate_id, round({_jaccard('x', 'y')}, 6) AS j, r0.r AS title_levenshtein, r1.r AS title_token_sort, greatest(r2.r, r3.r, r4.r) AS title_token_set, CAST(b_norm = c_norm AND b_norm <> '' AS INTEGER) AS title_exact_match,
            round({_jaccard('bx', 'byy')}, 6) AS bigram_similarity, round(CASE WHEN nx > 0 AND ny > 0 THEN least(nx, ny) / greatest(nx, ny) ELSE 0 END, 6) AS title_length_ratio
            FROM f JOIN ratio r0 ON r0.a = b_norm AND r0.b = c_norm JOIN ratio r1 ON r1.a = sx AND r1.b = sy JOIN ratio r2 ON r2.a = i AND r2.b = ix JOIN ratio r3 ON r3.a = i AND r3.b = iy JOIN ratio r4 ON r4.a = ix AND r4.b = iy)
        SELECT pub_id, bib_key, candidate_id, j AS title_jaccard, title_levenshtein, title_token_sort, title_token_set, title_exact_match, 1.0::DOUBLE AS author_overlap_ratio, 1 AS num_common_authors, 1 AS first_author_match, 1 AS last_author_match, 1.0::DOUBLE AS author_initials_match,
            -1 AS year_diff, 0 AS year_exact_match, 0 AS year_within_1, 0 AS both_years_present, j AS abstract_jaccard, 0.0::DOUBLE AS venue_similarity, j AS text_word_overlap, bigram_similarity, title_length_ratio FROM v""",
    "latex_plain": f"WITH {_STRIPPED} SELECT doc_id, trim({_PLAIN}) AS plain, trim({_CLEAN}) AS clean FROM st",
    "latex_elements": f"""WITH {_SENTENCES}, n AS (SELECT doc_id, count(*) AS sentence FROM sn GROUP BY doc_id)
        SELECT 'd' || doc_id AS pub_id, 1 AS version, {', '.join(f"CAST({'1' if k == 'document' else '2' if k == 'section' else 'coalesce(sentence, 0)' if k == 'sentence' else '0'} AS BIGINT) AS {k}" for k in TYPES)} FROM documents LEFT JOIN n USING (doc_id)""",
    "hierarchy_export": f"""WITH {_SENTENCES}, el AS (SELECT doc_id, s FROM sn UNION ALL SELECT doc_id, unnest(['Document - d' || doc_id, 'Introduction', 'Methods']) FROM documents),
        pl AS (SELECT doc_id, trim({_PLAIN}) AS p FROM el), kept AS (SELECT * FROM pl WHERE lower(trim(p)) NOT IN ('', 'unsrt', 'plain', 'abbrv', 'references', 'bibliography'))
        SELECT 'd' || doc_id AS pub_id, count(*) AS elements, CAST(sum(length(p)) AS BIGINT) AS characters, count(*) - 1 AS edges, CAST(1 AS BIGINT) AS versions FROM kept GROUP BY doc_id""",
    "citation_features": f"""WITH d AS (SELECT 'd' || doc_id AS pub_id, source, lang FROM documents),
        k AS (SELECT pub_id, source AS bib_key, 1 AS n, 0 AS m FROM d UNION ALL SELECT pub_id, lang, 2, 1 FROM d)
        SELECT pub_id, bib_key, CAST(n AS BIGINT) AS citation_count, 1 AS has_citation, 1 AS cited_in_intro, 0 AS cited_in_related_work, m AS cited_in_methods, 0 AS cited_in_results, 0 AS cited_in_conclusion, 0 AS cited_in_abstract, 2.0::DOUBLE AS avg_citation_depth,
            2 AS min_citation_depth, 2 AS max_citation_depth, 2 AS first_citation_depth, 0 AS near_figure, 0 AS near_table, 0 AS near_formula, 0 AS in_itemize, 1 AS co_citation_count, 1 AS has_co_citations FROM k""",
    "prediction_export": f"""WITH {_LABELS}, {_SPLIT.strip()},
        gt AS (SELECT pub_id, bib_key, coalesce(m.candidate_id, a.candidate_id) AS c FROM manual m FULL JOIN auto a USING (pub_id, bib_key)),
        g AS (SELECT pub_id, string_agg('"' || bib_key || '":"' || c || '"', ',' ORDER BY CAST(bib_key AS VARCHAR)) AS g FROM gt GROUP BY pub_id),
        l AS (SELECT pub_id, bib_key, string_agg('"' || candidate_id || '"', ',' ORDER BY rank) AS l FROM top GROUP BY pub_id, bib_key),
        p AS (SELECT pub_id, string_agg('"' || bib_key || '":[' || l || ']', ',' ORDER BY CAST(bib_key AS VARCHAR)) AS p FROM l GROUP BY pub_id)
        SELECT pub_id, '{{"partition":"' || split || '"' || coalesce(',"groundtruth":{{' || g || '}}', '') || coalesce(',"prediction":{{' || p || '}}', '') || '}}' AS json FROM split LEFT JOIN g USING (pub_id) LEFT JOIN p USING (pub_id)""",
    "folded_tokens": f"""WITH w AS (SELECT unnest(string_split(regexp_replace(strip_accents(lower(substr(text, 1, 80))), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')) AS word FROM documents WHERE lang = 'en')
        SELECT word, count(*) AS n FROM w WHERE len(word) >= 2 AND word NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY word""",
    "ranker_preferences": f"""WITH RECURSIVE {_RANKER}, d AS (SELECT {', '.join(f'x.f{i} - y.f{i} AS f{i}' for i in range(1, 5))} FROM g x JOIN g y USING (pub_id, bib_key) WHERE x.good AND NOT y.good)
        SELECT label, count(*) AS n, (SELECT count(DISTINCT (pub_id, bib_key)) FROM g WHERE good) AS entries, {', '.join(f'round(sum((2 * label - 1) * f{i}), 4) AS f{i}' for i in range(1, 5))} FROM d, (SELECT unnest([0, 1]) AS label) GROUP BY label""",
    "split_queries": """WITH k AS (SELECT source AS pub_id, CAST(item_id AS VARCHAR) AS bib_key FROM benchmark, (SELECT DISTINCT source FROM documents)), r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || pub_id || ':' || bib_key), pub_id, bib_key) AS r, count(*) OVER () AS n FROM k)
        SELECT pub_id, bib_key, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""",
    "compliance": f"""WITH {_LABELS}, per AS (SELECT pub_id, max(CAST(origin = 'manual' AS INTEGER)) AS m, max(CAST(origin = 'auto' AS INTEGER)) AS a, count(*) FILTER (WHERE origin = 'manual' AND label = 1) AS n FROM merged GROUP BY pub_id),
        rules AS (SELECT unnest(['manual publications', 'manual labels', 'automatic share']) AS requirement, unnest([5.0, 20.0, 0.1]::DOUBLE[]) AS required, unnest([sum(m), sum(n), coalesce(sum(CASE WHEN m = 0 THEN a ELSE 0 END) / nullif(sum(1 - m), 0), 0)]::DOUBLE[]) AS actual FROM per)
        SELECT requirement, required, round(actual, 6) AS actual, CASE WHEN actual >= required THEN 'PASS' ELSE 'FAIL' END AS status FROM rules""",
    "combined_sources": r"""WITH d AS (SELECT doc_id, doc_id // 10 AS b, doc_id % 10 AS k FROM documents),
        f AS (SELECT b, '<' || doc_id || '>' AS x, '</' || doc_id || '>' AS y, k FROM d),
        m AS (SELECT b, max(x) FILTER (WHERE k = 0) AS x0, max(y) FILTER (WHERE k = 0) AS y0, string_agg(x, '' ORDER BY k) FILTER (WHERE k BETWEEN 1 AND 6) AS x1, string_agg(y, '' ORDER BY k DESC) FILTER (WHERE k BETWEEN 1 AND 6) AS y1,
            string_agg(x || y, '' ORDER BY k) FILTER (WHERE k = 7) AS f7, string_agg(x || y, '') FILTER (WHERE k = 9) AS f9, count(*) - 1 AS n FROM f GROUP BY b)
        SELECT 'b' || b AS pub_id, '\documentclass{article}\begin{document}' || x0 || x1 || y1 || ' ' || f7 || ' ' || f9 || y0 || '\end{document}' AS text, n AS n_files FROM m""",
    "ignored_files": "SELECT 'b' || (doc_id // 10) AS pub_id, 'c/f8.tex' AS path FROM documents WHERE doc_id % 10 = 8",
    "auto_label_strict": f"""WITH RECURSIVE {_AUTO}, f AS (SELECT pub_id, bib_key, arg_min(candidate_id, cand_ord) AS candidate_id FROM lab WHERE label = 1 GROUP BY pub_id, bib_key)
        SELECT * FROM f QUALIFY row_number() OVER (ORDER BY pub_id, bib_key) <= (SELECT greatest(1, floor(count(*) * 0.001)) FROM pp)""",
    "raw_scores": f"""WITH RECURSIVE {_PARTS},
        p AS (SELECT pub_id, x.bib_key, y.bib_key AS candidate_id, y.ord - x.ord AS gap, y.ord, lower(x.author) AS a1, lower(y.author) AS b1, x.title AS t1, y.title AS t2, CAST(x.year AS INTEGER) AS y1, nullif(CAST(y.year AS INTEGER), 1991) AS y2 FROM e x JOIN e y USING (pub_id) WHERE x.ord <> y.ord),
        i AS (SELECT *, array_to_string([w[1] for w in string_split(a1, ' ')], '') AS i1, array_to_string([w[1] for w in string_split(b1, ' ')], '') AS i2, string_split(a1, ' ') AS w1, string_split(b1, ' ') AS w2,
            list_filter(string_split(t1, ' '), lambda w: len(w) > 1 AND NOT list_contains({_STOPS}, w)) AS u1, list_filter(string_split(t2, ' '), lambda w: len(w) > 1 AND NOT list_contains({_STOPS}, w)) AS u2 FROM p),
        s AS (SELECT DISTINCT a1, b1, CASE WHEN len(a1) <= len(b1) THEN a1 ELSE b1 END AS s, CASE WHEN len(a1) <= len(b1) THEN b1 ELSE a1 END AS l FROM i),
        w AS (SELECT a1, b1, s, unnest([substr(l, greatest(1, k), len(s) + least(0, k - 1)) for k in range(2 - len(s), len(l) + 1)]) AS x FROM s),
        q AS (SELECT a1 AS a, b1 AS b FROM s UNION SELECT i1, i2 FROM i UNION SELECT s, x FROM w WHERE x <> ''), {_LCS},
        m AS (SELECT a1, b1, max(r) AS r FROM w JOIN ratio ON a = s AND b = x GROUP BY a1, b1),
        t AS (SELECT i.*, [[len(list_filter(u1, lambda x: x = w)) * CASE WHEN list_contains(u1, w) AND list_contains(u2, w) THEN 1 ELSE 1 + ln(1.5) END, len(list_filter(u2, lambda x: x = w)) * CASE WHEN list_contains(u1, w) AND list_contains(u2, w) THEN 1 ELSE 1 + ln(1.5) END] for w in list_distinct(list_concat(u1, u2))] AS v FROM i)
        SELECT pub_id, bib_key, candidate_id, 100 * r1.r AS author_fuzz_ratio, 100 * m.r AS author_fuzz_partial, round(100 * len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2))), 2) AS author_overlap, 100 * r2.r AS author_initials_match,
            CAST(coalesce(y1 = y2, false) AS DOUBLE) AS year_match, CAST(coalesce(abs(y1 - y2), 100) AS DOUBLE) AS year_diff, CAST(coalesce(abs(y1 - y2) <= 1, false) AS DOUBLE) AS year_close,
            round(100 * list_sum([x[1] * x[2] for x in v]) / (sqrt(list_sum([x[1] * x[1] for x in v])) * sqrt(list_sum([x[2] * x[2] for x in v]))), 2) AS combined_tfidf, 0.0::DOUBLE AS venue_fuzz, round(least(len(t1), 500) / 5, 2) AS ref_text_length,
            CAST(gap > 0 AS DOUBLE) AS hierarchy_section_match, round(100.0 * least(abs(gap), 5) / 5, 2) AS hierarchy_depth, round(100.0 * least(greatest(gap / 10, 0), 1), 2) AS hierarchy_position, round(100.0 * least(100 * ord, 1000) / 1000, 2) AS context_length, round(100.0 * least(abs(gap), 20) / 20, 2) AS citation_density
        FROM t JOIN ratio r1 ON r1.a = a1 AND r1.b = b1 JOIN ratio r2 ON r2.a = i1 AND r2.b = i2 JOIN m ON m.a1 = t.a1 AND m.b1 = t.b1""",
    "label_export": f"WITH {_LABELS} SELECT pub_id, CAST(bib_key AS VARCHAR) AS bib_key, CAST(coalesce(m.candidate_id, a.candidate_id) AS VARCHAR) AS candidate_id FROM manual m FULL JOIN auto a USING (pub_id, bib_key)",
    "labelling_counts": """WITH d AS (SELECT source, least(count(*), (SELECT count(*) FROM benchmark)) AS n FROM documents GROUP BY source)
        SELECT CAST(0 AS BIGINT) AS no_candidate_file, CAST(0 AS BIGINT) AS no_candidates, CAST(0 AS BIGINT) AS no_entry_file, CAST(0 AS BIGINT) AS no_entries, count(*) FILTER (WHERE n < 20) AS too_few, count(*) FILTER (WHERE n >= 20) AS eligible, count(*) AS publications FROM d""",
    "split_by_labels": """WITH m AS (SELECT DISTINCT source AS pub_id FROM documents WHERE source <= 'src15'), r AS (SELECT pub_id, row_number() OVER (ORDER BY md5('42:' || pub_id), pub_id) AS r, count(*) OVER () AS n FROM m)
        SELECT pub_id, CASE WHEN r <= floor(n * 0.5) THEN 'valid' ELSE 'test' END AS split FROM r WHERE pub_id < 'src14' UNION ALL SELECT DISTINCT source, 'train' FROM documents WHERE source >= 'src14'""",
    "error_analysis": f"WITH {_VECTORS}, f AS (SELECT bib_key, CAST(rank AS INTEGER) AS rank FROM r WHERE rank IS DISTINCT FROM 1 ORDER BY bib_key LIMIT 5) SELECT f.*, (SELECT count(*) FROM r) AS entries, (SELECT count(*) FROM r WHERE rank IS DISTINCT FROM 1) AS errors, round((SELECT avg(CAST(rank IS DISTINCT FROM 1 AS INTEGER)) FROM r), 6) AS error_rate FROM f",
    "key_scan": "SELECT source AS bib_key, count(*) AS elements FROM documents GROUP BY source UNION ALL SELECT lang, count(*) FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang",
}
