"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order of priority, into a deterministic automaton over tokens that accepts exactly the
BPE token sequences.  It starts as one state with a loop for each byte.  The gadget of a merge (a, b) sends the arcs of
a to a copy of their target that lacks the arc of b, and adds an arc of ab wherever a and then b could be read; that
arc leads where b led (for a = b, where a led before).  All arcs of one token lead to one state, so a state is known
by the token last read, and the automaton has one state more than there are merges.

The states' arcs are compiled into one table of what the copies lack: (a, b) -> birth of the copy.  The state after
token t has descended from copies for t, for its right part, for that one's right part and so on; an arc for x stems
from an arc for its left part, and so on.  So t may be followed by x unless the table holds a pair of these that was
born while both were whole.

Encoding reads pre-split words with the tables: a trie gives the tokens at each position, and the one run of the
automaton over the word's bytes gives its tokens.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json
import os
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from biblioflux.llm.arrow_text import bound_batches, concat, list_array, row_chunks, text_buffer, unused, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words of more bytes than this are read one at a time, shorter ones side by side.
SHORT = 128
#: Text whose distinct words are encoded together.
PIECE_BYTES = 512 << 10
#: log2 of the number of pairs of tokens whose arc is remembered.
ASKED_BITS = 18
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Label of each id, and the merges (left id, right id, id) by priority, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    symbols = byte_symbols()
    labels = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        if all(c in symbols for c in token):
            labels[i] = bytes(symbols[c] for c in token)
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
    return labels, merges


class _Table:
    """int64 -> int32 by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.down, self.size, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]  # of several keys for a slot the last stays
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.size
        self.values[slot] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def one(self, key: int) -> int:
        """``get`` for a single key."""
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.down)
        while (there := self.keys.item(slot)) >= 0:
            if there == key:
                return self.values.item(slot)
            slot = (slot + 1) & self.size
        return self.missing

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], self.missing)
        at = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.size
            there, want = self.keys[slot], keys[at]
            same = there == want
            out[at[same]] = self.values[slot[same]]
            go = np.flatnonzero(~same & (there >= 0))
            at, slot = at[go], slot[go]
        return out


def _arc(t: int, x: int, never: int, lacks, left, right, born) -> bool:
    """Whether no pair of t or a right part, and x or a left part, was removed while both were whole; lacks gives ``never`` for other pairs."""
    until = never
    while t >= 0:
        y, before = x, never - 1
        while y >= 0:
            time = lacks(t << 32 | y)
            if time < until and time <= before:
                return False
            y, before = left(y), born(y)
        t, until = right(t), born(t)
    return True


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n, never = len(labels), len(merges) + 1
        #: By token: state its arcs lead to (-1: it has none), parts, and birth.  By state: the one it was copied from, and the token removed.
        target, left, right, born = [-1] * n, [-1] * n, [-1] * n, [0] * n
        parent, removed, state_born = [-1], [-1], [0]
        lacks: dict[int, int] = {}
        merged = {ab for _, _, ab in merges}
        for i, label in enumerate(labels):
            if len(label) == 1 and i not in merged:
                target[i] = 0
        for time, (a, b, ab) in enumerate(merges, 1):
            if target[a] < 0 or target[b] < 0 or target[ab] >= 0 or not _arc(a, b, never, lambda k: lacks.get(k, never), left.__getitem__, right.__getitem__, born.__getitem__):
                continue  # b never follows a any more, or the token is there already
            s = target[a]
            target[ab] = target[b] if a != b else s
            left[ab], right[ab], born[ab] = a, b, time
            lacks[a << 32 | b] = time
            target[a] = len(parent)
            parent.append(s)
            removed.append(b)
            state_born.append(time)
        self.target, self.left, self.right, self.born, self.parent, self.removed, self.state_born = (np.array(x, np.int32) for x in (target, left, right, born, parent, removed, state_born))
        self.size = np.array([len(x) for x in labels], np.int32)
        self._never = never
        self._lacks = _Table(np.fromiter(lacks, np.int64, len(lacks)), np.fromiter(lacks.values(), np.int32, len(lacks)), never)
        self._build_trie(labels)
        #: By slot: the pair of tokens last asked for there, and in the lowest bit whether it has an arc.
        self._asked = np.full(1 << ASKED_BITS, -1, np.int64)

    def arc(self, t: int, x: int) -> bool:
        """Whether the state after token t (-1: the start) has an arc for token x."""
        return _arc(t, x, self._never, self._lacks.one, self.left.item, self.right.item, self.born.item)

    def state_has_arc(self, state: int, x: int) -> bool:
        """The same from the states themselves: step down the copies and the token's left parts, the younger first."""
        while state:
            if self.born[x] >= self.state_born[state]:
                x = self.left[x]
            elif self.removed[state] == x:
                return False
            else:
                state = self.parent[state]
        return True

    @property
    def states(self) -> int:
        return len(self.parent)

    def _build_trie(self, labels: list[bytes]) -> None:
        child: dict[int, int] = {}
        token = [-1]
        for i, label in enumerate(labels):
            if self.target[i] < 0:
                continue
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = child.setdefault(key, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.token_of = np.array(token, np.int32)
        self._goto = _Table(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)), -1)
        #: Nodes of all first bytes, and of all first two.
        self._one = self._goto.get(np.arange(256))
        pair = np.arange(1 << 16)
        self._two = np.where(self._one[pair >> 8] >= 0, self._goto.get(self._one[pair >> 8].astype(np.int64) << 8 | pair & 255), -1).astype(np.int32)

    def arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``arc`` for arrays.  Most pairs were asked for before; a pair that took another's slot is searched for again."""
        key = (last.astype(np.int64) + 1) << 33 | token.astype(np.int64) << 1
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ASKED_BITS)).astype(np.int64)
        there = self._asked[slot]
        new = np.flatnonzero((there & ~1) != key)
        if len(new):
            there[new] = key[new] | self._search(last[new], token[new])
            self._asked[slot[new]] = there[new]
        return (there & 1).astype(bool)

    def _search(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = np.ones(len(last), bool)
        at = np.flatnonzero(last >= 0)
        t, x, until = last[at], token[at], np.full(len(at), self._never, np.int32)
        while len(at):
            sub, y, before = np.arange(len(at)), x, np.full(len(at), self._never - 1, np.int32)
            while len(sub):
                time = self._lacks.get((t[sub].astype(np.int64) << 32) | y)
                gone = (time < until[sub]) & (time <= before)
                out[at[sub[gone]]] = False
                below = self.left[y]
                go = np.flatnonzero((below >= 0) & ~gone)
                before, sub, y = self.born[y[go]], sub[go], below[go]
            right = self.right[t]
            go = np.flatnonzero((right >= 0) & out[at])
            until = self.born[t[go]]
            at, t, x = at[go], right[go], x[go]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """One word, by the same tables; the time is in proportion to its length."""
        last: list[int | None] = [-1] + [None] * len(word)
        for i in range(len(word)):
            if last[i] is None:
                continue
            node, j = 0, i
            while j < len(word) and (node := self._goto.one(node << 8 | word[j])) > 0:
                j += 1
                x = self.token_of.item(node)
                if x >= 0 and last[j] is None and self.arc(last[i], x):
                    last[j] = x
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j -= self.size.item(last[j])
        return out[::-1]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the number of tokens of each."""
        n, length = len(starts), ends - starts
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        first = np.cumsum(length + 1) - length - 1  # boundary before each word's first byte
        edges = int(length.sum()) + n
        rel = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        pos, edge, room = np.repeat(starts, length) + rel, np.repeat(first, length) + rel, np.repeat(length, length) - rel
        node, depth, found = np.zeros(len(pos), np.int32), 0, []
        while len(pos):
            if depth == 0:
                node = self._one[data[pos]]
            elif depth == 1:
                node = self._two[data[pos].astype(np.int64) << 8 | data[pos + 1]]
            else:
                node = self._goto.get((node.astype(np.int64) << 8) | data[pos + depth])
            depth += 1
            token = np.where(node >= 0, self.token_of[node], -1)
            hit = np.flatnonzero(token >= 0)
            found.append((edge[hit], token[hit], np.full(len(hit), depth, np.int32), rel[hit] + depth))
            live = np.flatnonzero((node >= 0) & (room > depth))
            pos, edge, room, rel, node = pos[live], edge[live], room[live], rel[live], node[live]
        edge, token, size, level = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(level.astype(np.min_scalar_type(int(level.max()))), kind="stable")  # short integers are sorted by digit
        edge, token, size, level = edge[order], token[order], size[order], level[order]
        back, chosen = np.zeros(edges, np.int64), np.full(edges, -1, np.int32)
        cuts = np.searchsorted(level, np.arange(1, int(level.max()) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e, t = edge[lo:hi], token[lo:hi]
            ok = np.flatnonzero(self.arcs(chosen[e], t))
            to = e[ok] + size[lo:hi][ok]
            back[to], chosen[to] = e[ok], t[ok]
        cur, counts, trail = first + length, np.zeros(n, np.int64), []
        live = np.arange(n)[length > 0]
        while len(live):
            at = cur[live]
            trail.append((live, chosen[at]))
            counts[live] += 1
            cur[live] = back[at]
            live = live[cur[live] > first[live]]
        out = np.empty(int(counts.sum()), np.int32)
        end = np.cumsum(counts)
        for k, (w, t) in enumerate(trail, 1):
            out[end[w] - k] = t
        return out, counts


@functools.lru_cache(maxsize=2)
def automaton(compiled: bytes) -> Automaton:
    """The tables as compiled on the driver, unpacked once in each Python worker."""
    return pickle.loads(zlib.decompress(compiled))


@functools.lru_cache(maxsize=2)
def compiled(path: str, _modified: float) -> tuple[bytes, list[bytes]]:
    """On the driver: the packed automaton of a vocabulary file, and the label of each id."""
    labels, merges = read_vocabulary(path)
    return zlib.compress(pickle.dumps(Automaton(labels, merges)), 1), labels


def _compiled(path: str) -> tuple[bytes, list[bytes]]:
    return compiled(path, os.path.getmtime(path))


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, as the pre-splitting pattern sees it."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            out[a : b + 1] = np.where(out[a : b + 1] == _OTHER, kind, out[a : b + 1]) if a < 0xD800 <= b else kind
    out[0xD800:0xE000] = _OTHER
    return out


def pre_split(text: str, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which the words of the texts in ``text`` begin; doc_starts are those of the texts.

    Equal to matching, in each text, the pattern of byte-level BPE vocabularies: contractions, runs of letters,
    numbers or other signs with at most one space before them, and white space.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[doc_starts[doc_starts <= n]] = True
    edge[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    cut = change.copy()
    space = kind == _SPACE
    # the last white-space character before a sign is cut off; a plain space joins the sign, any other stands alone
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
    cut[last] = True
    plain = last[points[last] == 32]
    cut[plain + 1] = False
    # contractions: a single apostrophe with no space before it, and the letters right after it
    quote = np.flatnonzero((points == 39) & cut)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        pair = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = pair & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for where, size in ((quote[short], 2), (quote[long & ~short], 3)):
            cut[where + 1] = False
            after = where + size
            after = after[after < n]
            cut[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(cut)


def encode_texts(machine: Automaton, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows in a row, and the number of tokens of each row."""
    data, offsets = text_buffer(arr)
    text = data.tobytes().decode("utf-8")
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc_starts = np.searchsorted(lead, offsets)
    starts = lead[pre_split(text, doc_starts)]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(arr), np.int64)
    bounds = np.append(starts, len(data)).astype(np.int32)
    spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())]).dictionary_encode()
    code, word = spelled.indices.to_numpy(), spelled.dictionary
    raw = np.frombuffer(word.buffers()[2], np.uint8)
    cut = np.frombuffer(word.buffers()[1], np.int32)[: len(word) + 1].astype(np.int64)
    size = np.diff(cut)
    long = np.flatnonzero(size > SHORT)
    brief = np.flatnonzero(size <= SHORT)
    ids, counts = machine.encode_words(raw, cut[brief], cut[brief + 1])
    count = np.zeros(len(word), np.int64)
    count[brief] = counts
    begin = np.zeros(len(word), np.int64)
    begin[brief] = np.cumsum(counts) - counts
    if len(long):
        extra, at = [], len(ids)
        for i in long.tolist():
            own = machine.encode_word(raw[cut[i] : cut[i + 1]].tobytes())
            extra += own
            count[i], begin[i] = len(own), at
            at += len(own)
        ids = np.concatenate([ids, np.array(extra, np.int32)])
    per_word = count[code]
    total = np.cumsum(per_word)
    take = np.arange(int(total[-1])) - np.repeat(total - per_word - begin[code], per_word)
    word_row = np.searchsorted(offsets, starts, "right") - 1
    return ids[take], np.bincount(word_row, per_word, len(arr)).astype(np.int64)


def encoder(path: str = VOCABULARY):
    """Arrow UDF: text -> token ids; null for null."""
    tables, _ = _compiled(path)

    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(tables)
        for arr in batches:
            parts = []
            for piece in row_chunks(arr, PIECE_BYTES):
                parts.append(_encoded(machine, piece))
            yield concat(parts, pa.list_(pa.int32()))

    return run


def decode_ids(table: pa.Array, ids: pa.Array) -> pa.Array:
    """Texts that lists of ids spell; table holds the label of each id."""
    flat = ids.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    arcs = table.take(pc.if_else(known, flat, pa.scalar(None, flat.type))).fill_null(b"")
    size = ids.value_lengths().fill_null(0)
    raw = pc.binary_join(list_arc(arcs, size.to_numpy(zero_copy_only=False)), b"")
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:  # ids that do not spell UTF-8
        text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))


def decoder(path: str = VOCABULARY):
    """Arrow UDF: token ids -> text; null for null.  Ids without a label, and null ids, emit nothing."""
    labels = _compiled(path)[1]

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(labels, pa.binary())
        for arr in batches:
            yield decode_ids(table, arr)

    return run


def round_tripper(path: str = VOCABULARY):
    """Arrow UDF: text -> struct of its token ids, and whether they decode to the text; one worker does both."""
    tables, labels = _compiled(path)
    kind = pa.struct([("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    @arrow_udf("struct<token_ids:array<int>,round_trip:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine, table = automaton(tables), pa.array(labels, pa.binary())
        for arr in batches:
            parts = []
            for piece in row_chunks(arr, PIECE_BYTES):
                ids = _encoded(machine, piece)
                same = pc.equal(decode_ids(table, ids), piece).fill_null(True)  # null for null
                parts.append(pa.StructArray.from_arrays([ids, same], fields=list(kind)))
            yield concat(parts, kind)

    return run


def _encoded(machine: Automaton, piece: pa.Array) -> pa.Array:
    out = list_array(*encode_texts(machine, piece), pa.int32())
    return pc.if_else(piece.is_valid(), out, pa.scalar(None, out.type)) if piece.null_count else out


def list_arc(arcs: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), arcs)


def _counted(out: DataFrame) -> DataFrame:
    return out.withColumn("n_tokens", F.coalesce(F.when(F.col("token_ids").isNotNull(), F.size("token_ids")), F.lit(0)))


def bpe_encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs plus ``token_ids`` and ``n_tokens``.

    Null texts have null ids and 0 tokens, empty ones no ids; texts are encoded whole, whatever their length.  All rows and
    columns stay; input columns named like the results are replaced, others keep their values whatever their names.  A text
    has one encoding, so repeated rows get equal ids and there are no ties.  An empty table stays empty.  The vocabulary file
    is read on the driver only.
    """
    return _counted(bound_batches(docs).select(*without(docs, "token_ids", "n_tokens"), encoder(path)("text").alias("token_ids")))


def bpe_decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """encoded plus ``decoded``, the text that ``token_ids`` spell; null ids give null.  An input column ``decoded`` is replaced."""
    return bound_batches(encoded).select(*without(encoded, "decoded"), decoder(path)("token_ids").alias("decoded"))


def bpe_round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs plus ``token_ids`` and ``n_tokens`` as ``bpe_encode`` gives them, and ``round_trip``: whether they decode to the text.

    Null texts decode to null, so their round trip holds.  Rows and columns are treated as ``bpe_encode`` treats them.
    """
    own = unused("bpe", docs)
    out = bound_batches(docs).withColumn(own, round_tripper(path)("text"))
    return _counted(out.select(*without(docs, "token_ids", "n_tokens", "round_trip"), F.col(own)["token_ids"].alias("token_ids"), F.col(own)["round_trip"].alias("round_trip")))
