"""Benchmark decontamination with a generalised suffix automaton over the words of all benchmark items.

Document words stream through the automaton, which gives the longest match that ends at each word. Where it reaches the
window (10 words), the last 10 words are hit and the items that hold them are known from the state; an item of fewer
words hits as a whole. The automaton is built for parts of about ``PART_WORDS`` words of the benchmark, one on the driver at a time, and
kept as flat arrays of some 100 bytes a word. A task holds parts of ``HELD_WORDS`` words at most. A larger benchmark is gone through in groups
of parts: each group but the first has a pass over the texts of its own, of which only the hit texts' stretches and items leave the tasks,
and the pass of the first group, over all columns, takes them up by two hashes of the text. An item is never split.

Vectorised numpy first skips what no window can lie in: stretches whose neighbouring words are no neighbours in any item.

Null and empty texts have no words, are never hit and stay. Items without words are ignored; rows that repeat an item_id
count once, a null item_id counts under the empty name. Ties don't arise: every occurrence counts. Documents repeat as
often as they are given. An empty benchmark hits nothing. Other columns pass through; columns that
are named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pefloom.llm import tokens

WINDOW = 10
PART_WORDS = 100_000
HELD_WORDS = 2_000_000


class Automaton:
    """Suffix automaton of several word sequences (lists of word ids), with the items of every window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.names = [name for name, _ in items]
        self.vocab = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        seqs = [np.searchsorted(self.vocab, h).tolist() for _, h in items]
        for s in seqs:
            self._add(s)
        self._pack()
        self.found: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        pairs = [np.zeros(0, np.int64)]
        for k, s in enumerate(seqs):
            n = min(len(s), window)
            for i, state, matched in self.walk(s):
                if i + 1 >= n and matched >= n and (n == window or len(s) == i + 1):
                    state = self.suffix(state, n)
                    if n == window:
                        self.found.setdefault(state, set()).add(k)
                    else:
                        self.short.setdefault(state, {}).setdefault(n, set()).add(k)
            pairs.append(np.array(s[:-1], np.int64) << 32 | np.array(s[1:], np.int64))
        self.pairs = np.unique(np.concatenate(pairs))
        self.least = min((min(len(s), window) for s in seqs), default=window)

    def _add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            if c in self.next[last]:  # shared with an earlier item
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            cur = self._state(self.length[last] + 1, {}, -1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            else:
                self.link[cur] = 0
            last = cur

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(follow)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _pack(self) -> None:
        """Flat arrays, some 100 bytes a word in all: state << 32 | word in order, and where that leads."""
        key = np.array([state << 32 | c for state, follow in enumerate(self.next) for c in follow], np.int64)
        to = np.array([q for follow in self.next for q in follow.values()], np.int32)
        order = np.argsort(key)
        self.key, self.to, self.next = key[order], to[order], []
        self.length, self.link = np.array(self.length, np.int32), np.array(self.link, np.int32)

    def step(self, state: int, c: int) -> int:
        """The state after word c, or -1."""
        at = int(self.key.searchsorted(state << 32 | c))
        return int(self.to[at]) if at < len(self.key) and self.key[at] == state << 32 | c else -1

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there) along ``seq``."""
        state = matched = 0
        for i, c in enumerate(seq):
            while (to := self.step(state, c)) < 0 and state:
                state = int(self.link[state])
                matched = int(self.length[state])
            if to >= 0:
                state, matched = to, matched + 1
            yield i, state, matched

    def suffix(self, state: int, n: int) -> int:
        """The state of the last n words of a match in ``state``."""
        while self.length[self.link[state]] >= n:
            state = int(self.link[state])
        return state

    def hits(self, seq: list[int]) -> tuple[np.ndarray, set[int]]:
        """Which words of ``seq`` lie in an occurrence of a window, and the items with such windows."""
        change, items, w = np.zeros(len(seq) + 1, np.int64), set(), self.window
        for i, state, matched in self.walk(seq):
            if matched >= w:
                items |= self.found[self.suffix(state, w)]
                change[i + 1 - w] += 1
                change[i + 1] -= 1
            if self.short:
                at = state
                while at > 0:
                    for n, ks in self.short.get(at, {}).items():
                        if n <= matched:
                            items |= ks
                            change[i + 1 - n] += 1
                            change[i + 1] -= 1
                    at = int(self.link[at])
        return np.cumsum(change[:-1]) > 0, items

    def scan(self, h: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Over the words of many rows: which words are hit, and the names of the items by row."""
        hit, items, n = np.zeros(len(h), bool), {}, len(h)
        if not n or not len(self.vocab):
            return hit, items
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        known = self.vocab[at] == h
        row = tokens.rows_of(woffs)
        near = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
        key = at[near] << 32 | at[near + 1]
        joined = np.zeros(n, bool)  # with the word before
        if len(self.pairs):
            joined[near + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            if z - a >= self.least:
                hit[a:z], ks = self.hits(at[a:z].tolist())
                if ks:
                    items.setdefault(int(row[a]), set()).update(self.names[k] for k in ks)
        return hit, items


def automata(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[Automaton]:
    """Automata of the benchmark's parts; only one part of about ``part_words`` words is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (6 * part_words)))
    for p in range(parts):
        got = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).toArrow()
        rows = []
        for first, end, data, offs in tokens.slices(got["text"]):
            h, _, _, woffs = tokens.words(data, offs)
            rows += [(got["item"][first + k].as_py(), h[woffs[k] : woffs[k + 1]]) for k in range(end - first) if woffs[k + 1] > woffs[k]]
        if rows:
            yield Automaton(sorted(rows, key=lambda r: (r[0], r[1].tobytes())), window)


def _held(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, held_words: int = HELD_WORDS) -> list[list]:
    """The parts' automata as broadcasts, in groups that a task can hold. Each is pickled to a file and freed before the next one is built."""
    held = [docs.sparkSession.sparkContext.broadcast(part) for part in automata(benchmark, window, part_words)]
    most = max(1, held_words // part_words)
    return [held[k : k + most] for k in range(0, len(held), most)] or [[]]


def _with_others(docs: DataFrame, groups: list[list]) -> DataFrame:
    """``docs`` and, behind its columns, the hit stretches and the items that ``groups`` find in text; without groups just ``docs``."""
    if not groups:
        return docs

    def finder(held: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, spans, items = _hits(b.column(2), held)
                rows = pa.array(list(spans), pa.int64())
                found = [pa.array([x[k] for k in spans], pa.list_(t)) for x, t in ((spans, pa.int64()), (items, pa.string()))]
                yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), *found], ["h1", "h2", "spans", "items"])

        return run

    hashes = (F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
    texts = docs.where("text IS NOT NULL").select(hashes[0].alias("h1"), hashes[1].alias("h2"), "text")
    found = reduce(DataFrame.union, (texts.mapInArrow(finder(held), "h1 long, h2 long, spans array<long>, items array<string>") for held in groups))
    # copies of a text find the same, so a set holds one entry a group at most
    found = found.groupBy("h1", "h2").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    packed = docs.select(F.struct("*").alias("doc"), hashes[0].alias("h1"), hashes[1].alias("h2")).join(found, ["h1", "h2"], "left")
    taken = {c.lower() for c in docs.columns}
    free = [next(c for k in range(len(taken) + 1) if (c := f"{stem}{k}") not in taken) for stem in ("spans", "items")]
    return packed.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), F.col("spans").alias(free[0]), F.col("items").alias(free[1]))


def _hits(text: pa.Array, held: list, others: list[pa.Array] | None = None) -> tuple[np.ndarray, dict[int, list[int]], dict[int, list[str]]]:
    """Of a column of texts: the number of words, and by hit row the hit stretches (word positions start, end, start, end ...) and item names.
    ``others``: what other groups found, stretches and items."""
    count, spans, items = np.zeros(len(text), np.int64), {}, {}
    for first, end, data, offs in tokens.slices(text):
        h, _, _, woffs = tokens.words(data, offs)
        count[first:end] = np.diff(woffs)
        hit, names = np.zeros(len(h), bool), {}
        for part in held:
            more, named = part.value.scan(h, woffs)
            hit |= more
            for k, x in named.items():
                names.setdefault(k, set()).update(x)
        if others:
            for k in np.flatnonzero(others[0].slice(first, end - first).is_valid().to_numpy(zero_copy_only=False)).tolist():
                old = others[0][first + k].as_py()
                for a, z in zip(old[::2], old[1::2], strict=True):
                    hit[woffs[k] + a : woffs[k] + z] = True
                names.setdefault(k, set()).update(others[1][first + k].as_py())
        for k, x in sorted(names.items()):
            spans[first + k] = np.flatnonzero(np.diff(np.concatenate([[0], hit[woffs[k] : woffs[k + 1]].view(np.int8), [0]]))).tolist()
            items[first + k] = sorted(x)
    return count, spans, items


def find_hits(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` plus hit_spans_ (word positions start, end, start, end ... of maximal hit stretches), hit_items_ (names) and n_words_."""
    docs = docs.drop("hit_spans_", "hit_items_", "n_words_")
    names, (held, *rest) = docs.columns, _held(docs, benchmark, **how)
    n = len(names)
    schema = T.StructType([*docs.schema.fields, T.StructField("hit_spans_", T.ArrayType(T.LongType())), T.StructField("hit_items_", T.ArrayType(T.StringType())), T.StructField("n_words_", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, spans, items = _hits(b.column(names.index("text")), held, b.columns[n:])
            rows = range(b.num_rows)
            more = [pa.array([spans.get(k, []) for k in rows], pa.list_(pa.int64())), pa.array([items.get(k, []) for k in rows], pa.list_(pa.string())), pa.array(count)]
            yield pa.record_batch([*b.columns[:n], *more], [*names, "hit_spans_", "hit_items_", "n_words_"])

    return _with_others(docs, rest).mapInArrow(run, schema)


def remove_hits(docs: DataFrame, benchmark: DataFrame, max_span: int = 0, max_coverage: float = 0.8, **how) -> DataFrame:
    """``docs`` with hit stretches of over ``max_span`` words cut out of text and n_chars set anew; a document of whose words a
    share above ``max_coverage`` is hit goes. Texts without such stretches stay as they are. Found and removed in one pass."""
    names, (held, *rest) = docs.columns, _held(docs, benchmark, **how)
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            count, spans, _ = _hits(b.column(at), held, b.columns[n:])
            gone, texts = np.zeros(b.num_rows, bool), {}
            for k, old in spans.items():
                pairs = [(a, z) for a, z in zip(old[::2], old[1::2], strict=True) if z - a > max_span]
                gone[k] = sum(z - a for a, z in pairs) > max_coverage * count[k]
                if pairs and not gone[k]:
                    data, offs = tokens.buffer(b.column(at).slice(k, 1))
                    _, start, end, _ = tokens.words(data, offs)
                    raw, here, text = data.tobytes(), 0, []
                    for a, z in pairs:
                        text.append(raw[here : start[a]])
                        here = end[z - 1]
                    texts[k] = b"".join([*text, raw[here:]]).decode()
            cols = b.columns[:n]
            if texts:
                rows = pa.array([k in texts for k in range(b.num_rows)])
                cols[at] = pc.replace_with_mask(cols[at], rows, pa.array(texts.values(), cols[at].type))
                if "n_chars" in names:
                    c = names.index("n_chars")
                    cols[c] = pc.replace_with_mask(cols[c], rows, pa.array(map(len, texts.values()), cols[c].type))
            out = pa.record_batch(cols, names)
            yield out.filter(pa.array(~gone)) if gone.any() else out

    return _with_others(docs, rest).mapInArrow(run, docs.schema)


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.expr("aggregate(transform(hit_spans_, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select("doc_id", F.col("n_words_").alias("n_words"), n_hit.alias("n_hit"), F.size("hit_items_").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hit_items_"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
