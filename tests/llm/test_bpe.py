import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioflux.llm import bpe

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_merging(word, merges):
    """BPE by its definition: each merge in order, from the left."""
    ids = list(word)
    for a, b, ab in merges:
        out, i = [], 0
        while i < len(ids):
            if ids[i : i + 2] == [a, b]:
                out.append(ab)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def random_merges(rng, n=40, alphabet=b"abc"):
    labels = [bytes([i]) for i in range(256)]
    known = set(labels)
    live, merges = [*alphabet], []
    for _ in range(n):
        a, b = rng.choice(live), rng.choice(live)
        if labels[a] + labels[b] in known or len(labels[a] + labels[b]) > 9:
            continue
        known.add(labels[a] + labels[b])
        merges.append((a, b, len(labels)))
        live.append(len(labels))
        labels.append(labels[a] + labels[b])
    return labels, merges


@pytest.mark.parametrize("seed", range(25))
def test_automaton_accepts_just_what_merging_gives(seed):
    rng = random.Random(seed)
    labels, merges = random_merges(rng)
    machine = bpe.Automaton(labels, merges)
    assert machine.states <= len(merges) + 1
    made = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(120)] + [b"a" * 33]
    data = np.frombuffer(b"".join(made), np.uint8)
    ends = np.cumsum([len(w) for w in made])
    ids, counts = machine.encode_words(data, ends - [len(w) for w in made], ends)
    cut = np.cumsum(counts)
    for w, a, b in zip(made, cut - counts, cut):
        want = by_merging(w, merges)
        assert ids[a:b].tolist() == want == machine.encode_word(w)
        state = 0
        for x in want:  # the states themselves read it too
            assert machine.state_has_arc(state, x)
            state = int(machine.target[x])
    live = [i for i in range(len(labels)) if machine.target[i] >= 0 and (i > 255 or i in b"abc")]
    for t in live:
        for x in live:
            assert machine.arc(t, x) == machine.state_has_arc(int(machine.target[t]), x) == bool(machine.arcs(np.array([t]), np.array([x]))[0])


def test_arcs_asked_for_before_are_not_searched_again(monkeypatch):
    labels, merges = random_merges(random.Random(3))
    data = np.frombuffer(bytes(random.Random(4).choice(b"abc") for _ in range(400)), np.uint8)
    ends = np.arange(20, 401, 20)
    machine = bpe.Automaton(labels, merges)
    want = machine.encode_words(data, ends - 20, ends)
    monkeypatch.setattr(machine._lacks, "get", None)
    again = machine.encode_words(data, ends - 20, ends)
    assert (want[0] == again[0]).all() and (want[1] == again[1]).all()


def test_pairs_that_share_a_slot(monkeypatch):
    monkeypatch.setattr(bpe, "ASKED_BITS", 2)
    labels, merges = random_merges(random.Random(5))
    machine = bpe.Automaton(labels, merges)
    live = [i for i in range(len(labels)) if machine.target[i] >= 0]
    t, x = (np.array(v, np.int32) for v in zip(*[(t, x) for t in [-1, *live[-30:]] for x in live[-30:]]))
    for _ in range(2):
        assert machine.arcs(t, x).tolist() == [t < 0 or machine.arc(t, x) for t, x in zip(t.tolist(), x.tolist())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'strveldmé1 2½\n\t!?. 中\U0001f600"), max_size=18), min_size=1, max_size=4))
def test_pre_split_is_the_pattern(texts):
    starts = np.cumsum([0, *map(len, texts)])
    got = bpe.pre_split("".join(texts), starts).tolist()
    want = [starts[i] + m.start() for i, t in enumerate(texts) for m in regex.finditer(PATTERN, t)]
    assert got == want


@pytest.fixture(scope="module")
def machine():
    return bpe.Automaton(*bpe.read_vocabulary())


def test_equals_the_library(machine, words):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(3)
    texts = [words(rng, lang, 50) for lang in ("en", "de", "fr")] + ["".join(rng.choice("aeéß中 \n'st1½.,\U0001f600") for _ in range(60)) for _ in range(300)] + ["", "a" * 3000, "<|endoftext|>"]
    ids, counts = bpe.encode_texts(machine, pa.array(texts))
    cut = np.cumsum(counts)
    for e, a, b in zip(library.encode_batch(texts, add_special_tokens=False), cut - counts, cut):
        assert ids[a:b].tolist() == e.ids


def test_round_trip_and_edges(spark, edges, empty):
    out = bpe.bpe_round_trip(edges)
    rows = out.collect()
    assert len(rows) == edges.count() and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[20].token_ids is None and by[20].n_tokens == 0 and by[21].token_ids == [] and by[21].n_tokens == 0
    assert len(by[24].token_ids) == by[24].n_tokens > 40_000 and by[24]["keep"] == "x"
    two_steps = bpe.bpe_decode(bpe.bpe_encode(edges))
    assert two_steps.where("not (decoded <=> text)").isEmpty()
    assert [r.token_ids for r in two_steps.orderBy("doc_id", "text").collect()] == [r.token_ids for r in out.orderBy("doc_id", "text").collect()]
    assert bpe.bpe_round_trip(empty).count() == 0
    odd = spark.createDataFrame([([50255, -1, None, 10**6],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded is None for r in bpe.bpe_decode(odd).collect()] == [False, True, False]
