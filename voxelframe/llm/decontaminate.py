"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' words is built once on the driver and broadcast; documents
stream past it, and for every word the length of the longest item passage that ends there
is known. A window is WINDOW consecutive item words (a shorter item is one window); a word
inside any occurrence of a window is hit.

Items are a stated set: they go into automata of at most BLOCK_WORDS words each (or one item), which bounds
what is broadcast: some 60 bytes a word and the distinct words themselves; with more items, the documents stream past one
automaton after another. While it is built an automaton has one dictionary of all arcs; then its states, arcs and
items are sorted arrays.
Before the walk, a table of all item word triples (or shorter, if the shortest item is)
picks out the stretches in which a window can lie at all; that loses nothing, as every
window is made of such triples.

Defined results: null or wordless texts have no words and are clean; items without words
are no windows; items that share an id count once; a null item id is the empty string;
repeated rows are judged each; an empty table gives no rows, an empty benchmark no hits;
other columns are ignored, or passed by ``drop_contaminated`` and ``remove_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

WINDOW = 13
BLOCK_WORDS = 1_000_000
#: Bytes that part words become a space, A-Z become a-z; all of UTF-8's other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window, in flat arrays.

    ``arcs`` are state << 32 | word, sorted, ``to`` the states they lead to; the root's are also in ``roots``, by word.
    ``window_states`` is sorted, the items of the k-th are ``window_items[window_from[k] : window_from[k + 1]]``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        items = [(name, w) for name, w in items if w]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        coded = [(number[name], array("i", [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])) for name, w in items]
        del items
        self.shortest = min((min(len(w), window) for _, w in coded), default=0)
        self.gram = min(3, self.shortest)
        self._build(coded)
        self._grams(coded)

    def _build(self, coded: list[tuple[int, array]]) -> None:
        arcs: dict[int, int] = {}  # state << 32 | word: state
        link, length = array("i", [-1]), array("i", [0])
        # the words of a state's arcs, as a linked list: a clone takes them over
        head, word, after = array("i", [-1]), array("i"), array("i")

        def put(state: int, x: int, to: int) -> None:
            key = state << 32 | x
            if key not in arcs:
                word.append(x)
                after.append(head[state])
                head[state] = len(word) - 1
            arcs[key] = to

        def state_of(n: int) -> int:
            length.append(n)
            link.append(0)
            head.append(-1)
            return len(length) - 1

        def clone(p: int, x: int, q: int) -> int:
            twin = state_of(length[p] + 1)
            at = head[q]
            while at >= 0:
                put(twin, word[at], arcs[q << 32 | word[at]])
                at = after[at]
            link[twin] = link[q]
            link[q] = twin
            while p != -1 and arcs.get(p << 32 | x) == q:
                arcs[p << 32 | x] = twin
                p = link[p]
            return twin

        def insert(w: array) -> int:
            last = 0
            for x in w:
                if (q := arcs.get(last << 32 | x)) is not None:
                    last = q if length[q] == length[last] + 1 else clone(last, x, q)
                    continue
                state = state_of(length[last] + 1)
                p = last
                while p != -1 and (p << 32 | x) not in arcs:
                    put(p, x, state)
                    p = link[p]
                if p != -1:
                    q = arcs[p << 32 | x]
                    link[state] = q if length[q] == length[p] + 1 else clone(p, x, q)
                last = state
            return last

        ends = [insert(w) for _, w in coded]
        del head, word, after
        windows = array("q")  # state << 32 | item
        self.short: dict[int, list[tuple[int, int]]] = {}  # state: (length, item) of whole short items
        for (name, w), state in zip(coded, ends, strict=True):
            if len(w) < self.window:
                while length[link[state]] >= len(w):
                    state = link[state]
                self.short.setdefault(state, []).append((len(w), name))
                continue
            state = 0
            for k, x in enumerate(w):
                state = arcs[state << 32 | x]
                if k + 1 >= self.window:
                    at = state
                    while length[link[at]] >= self.window:
                        at = link[at]
                    windows.append(at << 32 | name)
        keys = np.fromiter(arcs.keys(), np.int64, len(arcs))
        to = np.fromiter(arcs.values(), np.int32, len(arcs))
        arcs.clear()
        order = np.argsort(keys)
        self.arcs, self.to = keys[order], to[order]
        self.link, self.len = np.array(link, np.int32), np.array(length, np.int32)
        self.roots = np.zeros(len(self.vocab) + 1, np.int32)
        first = self.arcs[: np.searchsorted(self.arcs, 1 << 32)]
        self.roots[first] = self.to[: len(first)]
        pairs = np.unique(np.array(windows, np.int64))
        self.window_states, starts = np.unique(pairs >> 32, return_index=True)
        self.window_from, self.window_items = np.append(starts, len(pairs)), (pairs & 0xFFFFFFFF).astype(np.int32)
        # for each state, the nearest state up its suffix links (itself included) with short items, or -1
        self.chain = np.full(len(self.link), -1, np.int32)
        if self.short:
            whole = np.fromiter(self.short, np.int32, len(self.short))
            self.chain[whole] = whole
            for s in np.argsort(self.len, kind="stable")[1:]:
                if self.chain[s] < 0:
                    self.chain[s] = self.chain[self.link[s]]

    def follow(self, state: int, x: int) -> int:
        """The state that word ``x`` leads to, or 0, which no arc leads to."""
        if not state:
            return int(self.roots[x])
        key = state << 32 | x
        at = self.arcs.searchsorted(key)
        return int(self.to[at]) if at < len(self.arcs) and self.arcs[at] == key else 0

    def items_of(self, state: int) -> list[str]:
        """The items with the window that ends in ``state``."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        at = self.window_states.searchsorted(state)
        if at == len(self.window_states) or self.window_states[at] != state:
            return []
        return [self.names[k] for k in self.window_items[self.window_from[at] : self.window_from[at + 1]]]

    def _grams(self, coded: list[tuple[int, array]]) -> None:
        n, codes = self.gram, []
        for _, w in coded:
            codes.append(self.codes(np.array(w, dtype=np.uint64)))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.bits = max(16, int(16 * max(1, len(codes))).bit_length())
        self.table = np.zeros(1 << self.bits, dtype=bool)
        if n:
            self.table[codes >> np.uint64(64 - self.bits)] = True

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A hash of the ``gram`` words that end at each place from gram - 1 on."""
        n = self.gram
        out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
        for k in range(n):
            out = (out ^ ids[k : len(ids) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (first word, one past the last) of hit words, and the items."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        known = np.zeros(len(ids) + 2, dtype=np.int8)
        n = self.gram
        full = self.table[self.codes(ids) >> np.uint64(64 - self.bits)]
        for k in range(n):
            full &= ids[k : len(ids) - n + 1 + k] > 0
        known[n : n + len(full)] = full
        edge = np.diff(known)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        need = self.shortest - n + 1
        for a, b in zip(starts, stops, strict=True):
            if b - a >= need:
                self._walk(ids, int(a) - n + 1, int(b), spans, found)
        return spans, found

    def _walk(self, ids: np.ndarray, first: int, stop: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        link, length, window = self.link, self.len, self.window
        state = n = 0
        for i, x in enumerate(ids[first:stop].tolist(), first):
            to = self.follow(state, x)
            while state and not to:
                state = int(link[state])
                n = int(length[state])
                to = self.follow(state, x)
            if to:
                state, n = to, n + 1
            reach = 0
            if n >= window:
                found.update(self.items_of(state))
                reach = window
            s = int(self.chain[state])
            while s != -1:
                for k, name in self.short[s]:
                    if k <= n:
                        found.add(self.names[name])
                        reach = max(reach, k)
                s = int(self.chain[link[s]])
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))


def blocks(items: DataFrame, window: int, most: int) -> Iterator[Automaton]:
    """Automata over the items (item_id, text), each of at most ``most`` words or one item."""
    part: list[tuple[str, list[bytes]]] = []
    n = 0
    for row in items.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        w = words_of(row[1].encode() if row[1] else None)
        if part and n + len(w) > most:
            yield Automaton(part, window)
            part, n = [], 0
        part.append((row[0] or "", w))
        n += len(w)
    yield Automaton(part, window)


def annotate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with __vf_n_words, __vf_spans (array of [first word, one past the last]) and __vf_items."""
    extra = {"__vf_n_words": "bigint", "__vf_spans": "array<array<int>>", "__vf_items": "array<string>"}
    out = None
    for automaton in blocks(items, window, most):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        source = docs if out is None else save(out, "decontaminate")
        again = out is not None

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for b in batches:
                n, spans, found = [], [], []
                for k, t in enumerate(b.column("text").cast(pa.binary())):
                    w = words_of(t.as_py())
                    s, names = automaton.scan(w)
                    if again:
                        names |= set(b.column("__vf_items")[k].as_py())
                        merged: list[tuple[int, int]] = []
                        for x, y in sorted([*s, *map(tuple, b.column("__vf_spans")[k].as_py())]):
                            if merged and x <= merged[-1][1]:
                                merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
                            else:
                                merged.append((x, y))
                        s = merged
                    n.append(len(w))
                    spans.append([list(x) for x in s])
                    found.append(sorted(names))
                kept = [i for i, name in enumerate(b.schema.names) if name not in ("__vf_n_words", "__vf_spans", "__vf_items")]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in kept] + [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))],
                    names=[b.schema.names[i] for i in kept] + list(extra),
                )

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join(f"{k} {v}" for k, v in extra.items())
        out = source.mapInArrow(scan, types)
    return out


def judge(marked: DataFrame) -> DataFrame:
    """Adds n_words, n_hit, n_items, contaminated to what ``annotate`` gives."""
    hit = F.aggregate("__vf_spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    out = marked.withColumn("__vf_n_hit", hit)
    return out.withColumn("__vf_bad", (F.col("__vf_n_hit") > 0) & (20 * F.col("__vf_n_hit") >= F.col("__vf_n_words")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (their ids), spans, contaminated."""
    out = judge(annotate(docs.select("doc_id", "text"), items, window))
    return out.select("doc_id", F.col("__vf_n_words").alias("n_words"), F.col("__vf_n_hit").alias("n_hit"), F.size("__vf_items").cast("long").alias("n_items"), F.col("__vf_items").alias("items"), F.col("__vf_spans").alias("spans"), F.col("__vf_bad").alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that stay: those under the coverage limit, unchanged."""
    return judge(annotate(docs, items, window)).where("NOT __vf_bad").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = WINDOW) -> DataFrame:
    """Contaminated documents go; in the others, hit spans of ``least`` words or more are cut from the text."""
    marked = judge(annotate(docs, items, window)).where("NOT __vf_bad")
    own = docs.columns
    place = own.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for b in batches:
            texts = []
            for t, spans in zip(b.column(place).cast(pa.binary()).to_pylist(), b.column(b.schema.get_field_index("__vf_spans")).to_pylist(), strict=True):
                spans = [s for s in spans if s[1] - s[0] >= least]
                if spans:
                    at = [m.span() for m in word.finditer(t)]
                    for x, y in reversed(spans):
                        t = t[: at[x][0]] + t[at[y - 1][1] :]
                texts.append(t)
            columns = [b.column(k) for k in range(len(own))]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=own)

    return marked.select(*docs.columns, "__vf_spans").mapInArrow(cut, docs.schema)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
