"""Near-dedup, repeated passages and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from biblioflux.llm import line_templates, minhash, queries, suffix_merge


def jaccard(x, y):
    both = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in both) for i in x.keys() & y.keys())


def vector(text, k=3):
    w = text.lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def edited(rng, text, share, words):
    return " ".join(words(rng, "en", 1) if rng.random() < share else w for w in text.split())


def test_probability_jaccard_and_its_estimate(words):
    rng = random.Random(1)
    a = words(rng, "en", 120) + " " + words(rng, "en", 1) * 3
    for share in (0.0, 0.05, 0.3):
        b = edited(rng, a, share, words) + " again again again again"
        want = jaccard(vector(a), vector(b))
        row, h, w = minhash.shingles(pa.array([a, b]))
        exact = minhash.probability_jaccard(h[row == 0], w[row == 0], h[row == 1], w[row == 1])
        assert exact == pytest.approx(want)
        z = minhash.signatures(row, h, w.astype(float), 2, 4096)
        assert (z[0] == z[1]).mean() == pytest.approx(want, abs=0.04)


def test_groups_against_brute_force(spark, words):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = words(rng, "en", rng.choice([4, 30, 80, 300]))
        texts += [base] + [edited(rng, base, rng.choice([0.0, 0.02, 0.08, 0.3]), words) for _ in range(rng.randint(0, 4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs).collect()}
    v = [vector(t) for t in texts]
    pairs = [(a, b) for a in range(len(v)) for b in range(a) if jaccard(v[a], v[b]) >= 0.5]
    found = [p for p in pairs if p[0] in got and got[p[0]] == got.get(p[1])]
    assert len(found) >= 0.97 * len(pairs)
    parent = list(range(len(v)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert all(root(i) == root(g) for i, g in got.items())  # nothing but true links
    kept = {r.doc_id for r in minhash.keep_first(docs).collect()}
    assert kept == {i for i in range(len(v)) if got.get(i, i) == i}


def boilerplate(rng, words, n):
    """Texts that share a line or two, of a fifth to nine tenths of their words."""
    lines = [words(rng, "en", 14) for _ in range(2)]
    out = []
    for _ in range(n):
        parts = [words(rng, "en", rng.randint(2, 40))] + rng.choice([lines[:1], lines[:1] * 2, lines])
        rng.shuffle(parts)
        out.append("\n".join(parts))
    return out


def joined(n, pairs, root=None):
    """The least row that pairs, and equal roots, join each of n rows to."""
    label = list(range(n)) if root is None else [list(root).index(r) for r in root]
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = [x if k == y else k for k in label]
    return label


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_members_of_a_band_against_all_pairs(words, threshold):
    rng = random.Random(3)
    texts = boilerplate(rng, words, 120) + ["w " * 30, "w " * 40 + "x", "one two"]
    row, h, w = minhash.shingles(pa.array(texts))
    offsets = np.searchsorted(row, np.arange(len(texts) + 1))
    vectors = [(h[a:b], w[a:b]) for a, b in zip(offsets, offsets[1:])]
    every = [(a, b) for a in range(len(texts)) for b in range(a) if minhash.probability_jaccard(*vectors[a], *vectors[b]) >= threshold]
    for root, part in ((np.arange(len(texts)), np.zeros(len(texts), int)), (np.arange(len(texts)) % 50, np.zeros(len(texts), int)), (np.arange(len(texts)), np.arange(len(texts)) % 2)):
        got = minhash.linked(h, w.astype(float), offsets, root, part, threshold)
        asked = [(a, b) for a, b in every if part.max() == 0 or part[a] != part[b]]
        assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in asked} and len(got) < len(texts)
        assert joined(len(texts), got, root) == joined(len(texts), asked, root)


def test_pairs_of_a_band_do_not_leave_their_task(spark, words, monkeypatch):
    texts = boilerplate(random.Random(4), words, 400)
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    sent, verified, across = [], minhash._verified, minhash._across
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: (sent.append(pairs.count()), verified(pairs, *a))[1])
    got = {(r.doc_id, r.group_id) for r in minhash.near_groups(docs).collect()}
    assert sum(sent) < 10 * len(texts)
    monkeypatch.setattr(minhash, "_across", lambda *a: across(*a, part_shingles=2000))  # bands in parts
    assert {(r.doc_id, r.group_id) for r in minhash.near_groups(docs).collect()} == got and len(got) > 100


def test_near_dedup_edges(spark, edges, empty):
    got = {r.doc_id: (r.group_id, r.group_size) for r in minhash.near_groups(edges).collect()}
    assert got == {1: (1, 2), 26: (1, 2)}
    kept = minhash.keep_first(edges)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in [*range(12), 20, 21, 22, 23, 24, 25]] + [(True, 0)]
    assert kept.columns == edges.columns
    assert minhash.near_groups(empty).count() == 0 and minhash.keep_first(empty).count() == 0


def windows(docs, n):
    at = defaultdict(set)
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].add(i)
    out = set()
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - n + 1):
            if len(at[tuple(w[k : k + n])]) > 1:
                out |= {(i, j) for j in range(k, k + n)}
    return out


@pytest.mark.parametrize("n", [5, 12])
def test_repeated_passages_against_brute_force(spark, words, n):
    rng = random.Random(n)
    shared = [words(rng, "en", rng.randint(n - 1, 3 * n)) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [words(rng, "en", rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), words(rng, "en", rng.randint(0, 9))]
        docs.append((i, "\n".join(parts)))
    docs += [(100, "w " * 60), (101, "w " * 45), (102, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = set()
    for r in suffix_merge.repeated_passages(df, n).collect():
        assert r.first_doc_id <= r.doc_id
        got |= {(r.doc_id, j) for j in range(r.start_word, r.start_word + r.n_words)}
    assert got == windows(docs, n)


def test_merge_of_shards_is_the_sort_of_all_suffixes():
    rng = np.random.default_rng(0)
    strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(12)]
    for depth in (1, 2, 5):
        shards = [suffix_merge.Shard(np.concatenate(strings[i : i + 4]), np.cumsum([0, *map(len, strings[i : i + 4])])) for i in (0, 4, 8)]
        shard, row, block = suffix_merge.merge(shards, depth)
        got = []
        for s, r in zip(shard, row):
            ends = np.cumsum([len(x) + 1 for x in strings[4 * s : 4 * s + 4]])
            p = int(shards[s].suffix[r])
            k = int(np.searchsorted(ends, p, "right"))
            got.append(tuple(strings[4 * s + k][p - (ends[k] - len(strings[4 * s + k]) - 1) :][:depth].tolist()))
        every = Counter(tuple(x[i : i + depth].tolist()) for x in strings for i in range(len(x) - depth + 1))
        assert got == sorted(k for k, n in every.items() if n > 1 for _ in range(n))
        assert len(set(block.tolist())) == sum(n > 1 for n in every.values())


def test_repeated_passage_edges(spark, edges, empty):
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in suffix_merge.repeated_passages(edges, 50).collect()}
    assert got == {(1, 0, 60, 1), (26, 0, 60, 1)}
    assert suffix_merge.repeated_passages(empty).count() == 0


def brute_lines(docs, min_docs, similarity):
    """Numbers of the lines to drop, by text: templates in the order of their lines, and all texts of one compared by definition."""
    leaves, lines = defaultdict(list), defaultdict(set)
    mask = lambda s: " ".join("<*>" if re.search("[0-9]", w) else w for w in s.split())
    texts = sorted({t for _, t in docs}, key=lambda t: hashlib.md5(t.encode()).digest())
    for t in texts:
        for n, s in enumerate(t.split("\n")):
            if m := mask(s):
                lines[m].add((t, n))
    for m in sorted(lines):
        w = m.split()
        groups = leaves[len(w), *w[:2]]
        best = max(groups, key=lambda g: sum(a == b for a, b in zip(g[0], w)), default=None)
        if best and sum(a == b for a, b in zip(best[0], w)) >= similarity * len(w):
            best[0] = [a if a == b else None for a, b in zip(best[0], w)]
            best[1].append(m)
        else:
            groups.append([w, [m]])
    out = defaultdict(set)
    for groups in leaves.values():
        for _, members in groups:
            held, led = {t for m in members for t, _ in lines[m]}, []
            for t in texts:
                if t in held and all(jaccard(vector(t), vector(x)) < 0.5 for x in led):
                    led.append(t)
            if len(led) >= min_docs:
                for m in members:
                    for t, n in lines[m]:
                        out[t].add(n)
    return out


def test_lines_against_brute_force(spark, words):
    rng = random.Random(4)
    boiler = ["Page {} of {} in this book", "Copyright {} by the authors of it all", "read more about {} here and there now", "Menu"]
    docs = []
    for i in range(60):
        lines = [words(rng, "en", rng.randint(1, 12)) for _ in range(rng.randint(6, 14))]
        for b in boiler:
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines)), b.format(rng.choice(["7", "12a", "cats", "dogs"]), rng.randint(1, 99)))
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, docs[0][1]) for i in range(8)]  # exact copies
    docs += [(200 + i, docs[1][1] + f"\nof its own {chr(97 + i)}") for i in range(8)]  # near copies
    docs += [(300, "\n".join(b.format("7", "8") for b in boiler))]  # nothing but boilerplate
    docs += [(400 + i, f"{x} {y}\nof a few {x}\n" + words(rng, "en", 30)) for i, (x, y) in enumerate(["ab", "cd", "ef", "gh"])]  # held by too few
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df).collect()}
    want = brute_lines(docs, 5, 0.75)
    for i, t in docs:
        kept = "\n".join(s for n, s in enumerate(t.split("\n")) if n not in want[t])
        assert got[i].text == kept and got[i].lines_dropped == len(want[t])
    assert got[300].text == "" and sum(r.lines_dropped for r in got.values()) > 30
    assert all(got[i].lines_dropped == got[0].lines_dropped for i in range(100, 108)) and len(got[203].text) > len(docs[1][1]) / 2


def test_leaders_stop_at_enough_and_carry_over():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 256, (9, line_templates.REGISTERS)).astype(np.uint8)
    near = own[0].copy()
    near[: line_templates.REGISTERS // 4] ^= 1
    raw = [own[0].tobytes(), near.tobytes(), *(x.tobytes() for x in own[1:])]
    assert line_templates.leaders(raw, 99) == [0, *range(2, 10)] and line_templates.leaders(raw, 3) == [0, 2, 3]
    held = []
    assert line_templates.leaders(raw[:2], 3, held) == [0] and line_templates.leaders(raw[1:], 3, held) == [1, 2] and line_templates.leaders(raw, 3, held) == []


def test_line_edges(spark, edges, empty):
    got = line_templates.drop_recurring_lines(edges)
    assert got.count() == edges.count() and set(got.columns) == set(edges.columns)
    assert {r.lines_dropped for r in got.collect()} == {0}
    assert got.exceptAll(edges.drop("lines_dropped").selectExpr("*", "0 as lines_dropped").select(*got.columns)).isEmpty()
    assert line_templates.drop_recurring_lines(empty).count() == 0
    same = spark.createDataFrame([(1, "one two three four\n" + "x " * 30)] * 9, "doc_id long, text string")  # one document, nine times
    assert line_templates.drop_recurring_lines(same).where("lines_dropped > 0").isEmpty()


def test_boilerplate_goes_from_documents_it_fills_and_copies_stay(spark, tmp_path, words):
    rng = random.Random(21)
    boiler = [words(rng, "en", 8) for _ in range(4)]
    docs = [(i, "\n".join([words(rng, "en", 90), boiler[i % 4]])) for i in range(40)]
    docs += [(50, "\n".join([*boiler, "what is its own here"]))]  # mostly boilerplate, and no copy
    base = [words(rng, "en", 20) for _ in range(8)]
    docs += [(100 + i, "\n".join([words(rng, "en", 20) if j == i else s for j, s in enumerate(base)] + [boiler[0]])) for i in range(8)]  # near copies
    docs += [(200 + i, docs[0][1]) for i in range(8)]  # exact copies
    spark.createDataFrame([(*d, "en", "s", len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_line_templates(spark, str(tmp_path)).collect()}
    for i, t in docs:
        kept = [s for s in t.split("\n") if s not in boiler]
        assert got[i].text == "\n".join(kept) and got[i].lines_dropped == t.count("\n") + 1 - len(kept)


def test_short_lines_recur_and_empty_ones_stay(spark, words):
    rng = random.Random(22)
    docs = [(i, "\n".join(["Menu", words(rng, "en", 30), "", "Read on", words(rng, "en", 30), "Once" + "xyzuvw"[i]])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df).collect()}
    for i, t in docs:
        assert got[i].text == "\n".join(s for s in t.split("\n") if s not in ("Menu", "Read on")) and got[i].lines_dropped == 2


def test_best_template_of_equals_is_the_oldest():
    tree = line_templates.Leaf(4)
    assert [tree.add(x) for x in ("a b c d", "a b c e", "a b x y", "a b c d")] == [0, 0, 1, 0]
