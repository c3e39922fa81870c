"""Encoding and decoding with SentencePiece vocabularies of the merge type (BPE with byte fallback).

A text gets the vocabulary's space mark before it and in place of its spaces; its code points are the first symbols. The agenda holds all adjacent pairs of
symbols that together are a piece; the pair of the highest score goes first, the leftmost of equal ones, becomes one symbol and puts
its new neighbour pairs on the agenda, until the agenda is empty. Symbols that are no pieces become the pieces of their UTF-8 bytes.

No merge can cross a place that no piece of the vocabulary stretches over. Texts are cut at such places (before spaces, around line
feeds, between a letter and a punctuation mark), and each distinct segment is encoded once: the agendas of all short new
segments of a slice run side by side in numpy, one merge a segment in each round; long segments have a heap of their own. Whatever
is newly encoded in an Arrow batch is held against the sentencepiece library; a difference is an error. Vocabularies of which
some piece stretches over these places are encoded text by text.

Null and empty texts have no pieces but the end id. Repeated rows, and rows of one doc_id, each have their own result. A text of any
length is encoded whole. An empty table gives an empty table. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.llm.tokens import buffer

MARK = "▁"
#: Letters and punctuation marks between which segments end. Fixed values.
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
#: Where segments end: a piece in which this is found stretches over such a place.
CROSSED = re.compile(rf"[^ {MARK}][ {MARK}]|[{LETTERS}][{STOPS}]|.\n|\n.", re.DOTALL)
SEGMENT = re.compile(rf"[ {MARK}]*[{LETTERS}]+(?![^ {MARK}\n{STOPS}])|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
#: Segments of more symbols have an agenda of their own.
LONG = 48
#: So many bytes of texts at a time, whole texts; segments kept in a worker before the store is emptied.
SLICE_BYTES, KEPT = 1 << 20, 800_000


def default_model() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of a model, and the agenda over their adjacent pairs."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model)
        self.size, self.end = len(sp), sp.eos_id()
        self.bytes = np.full(256, -1, np.int32)
        own: dict[str, int] = {}
        for i in range(self.size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own[sp.id_to_piece(i)] = i
        if (self.bytes < 0).any() or sp.normalize("A ﬁ　") != f"{MARK}A{MARK}ﬁ　":
            raise ValueError("the vocabulary needs byte pieces, and texts as they are behind a space mark")
        symbols = dict(own)
        for c in set(chain.from_iterable(own)):
            symbols.setdefault(c, self.size + len(symbols))  # a letter of pieces that is no piece itself
        self.none = 2 * self.size + len(symbols) + 1
        self.letters = np.full(0x110000, self.none, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.letters[ord(s)] = i
        rows = sorted((symbols[p[:k]] * (self.none + 1) + symbols[p[k:]], i, sp.get_score(i)) for p, i in own.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.keys, self.merged, self.scores = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
        self.cut = SEGMENT.findall if not any(CROSSED.search(p) for p in own) else lambda text: [text]
        self.before = len(sp.encode("\n"))
        self.lengths = np.array([1 if sp.is_byte(i) else len(sp.id_to_piece(i).replace(MARK, " ").encode()) for i in range(self.size)], np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, merged symbol) of adjacent symbols; a score of minus infinity where they are no piece."""
        key = left * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.scores[at], -np.inf), self.merged[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that already have a space mark or a space where they want one, without end ids."""
        code = np.frombuffer("".join(texts).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner, symbol = np.repeat(np.arange(len(texts)), sizes), self.letters[code]
        short = sizes[owner] <= LONG
        parts = self._side_by_side(symbol[short], owner[short], code[short])
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k in np.flatnonzero(sizes > LONG):
            ids, places = self._agenda(symbol[at[k] : at[k + 1]].tolist())
            parts.append((np.array(ids, np.int64), np.full(len(ids), k), code[at[k] : at[k + 1]][places]))
        symbol, owner, code = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (symbol, owner, code)
        order = np.argsort(owner, kind="stable")
        return self._with_bytes(symbol[order], owner[order], code[order], len(texts))

    def _side_by_side(self, symbol: np.ndarray, owner: np.ndarray, code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(symbol, owner, code point) of the ended agendas; in each round every text merges the first pair of its agenda."""
        ended = []

        def look(at: np.ndarray) -> None:
            right = np.minimum(at + 1, len(symbol) - 1)
            score[at], merged[at] = self.pairs(symbol[at], symbol[right])
            score[at[(right == at) | (owner[at] != owner[right])]] = -np.inf

        score, merged = np.empty(len(symbol)), np.empty(len(symbol), np.int64)
        look(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            top = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(symbol))))
            over = top == -np.inf
            if over.any():
                ended.append((symbol[over], owner[over], code[over]))
                symbol, owner, code, score, merged, top = (x[~over] for x in (symbol, owner, code, score, merged, top))
                if not len(symbol):
                    break
            hit = np.flatnonzero(score == top)
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            symbol[hit] = merged[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, owner, code, score, merged = (x[stay] for x in (symbol, owner, code, score, merged))
            hit -= np.arange(len(hit))
            look(hit)
            look(hit[hit > 0] - 1)
        return ended

    def _agenda(self, symbol: list[int]) -> tuple[list[int], list[int]]:
        """(symbols, places of their first code points) of one text, by a heap of (score, place)."""
        n = len(symbol)
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def push(at: np.ndarray) -> None:
            left = np.array([symbol[i] for i in at])
            score, merged = self.pairs(left, np.array([symbol[after[i]] for i in at]))
            for i, s, m in zip(at, score.tolist(), merged.tolist(), strict=True):
                if s > -np.inf:
                    heapq.heappush(heap, (-s, i, after[i], symbol[i], symbol[after[i]], m))

        push(range(n - 1))
        while heap:
            _, i, j, left, right, m = heapq.heappop(heap)
            if after[i] != j or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], symbol[j], k = m, -1, after[j]
            after[i], after[j] = k, -1
            if k >= 0:
                before[k] = i
            push([x for x in (before[i], i) if x >= 0 and after[x] >= 0])
        places = [i for i, s in enumerate(symbol) if s >= 0]
        return [symbol[i] for i in places], places

    def _with_bytes(self, symbol: np.ndarray, owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        odd = symbol >= self.size
        width = np.where(odd, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        first = np.cumsum(width) - width
        ids = np.repeat(symbol, width).astype(np.int32)
        for c in np.unique(code[odd]).tolist():
            at = first[odd & (code == c)]
            for k, b in enumerate(chr(c).encode()):
                ids[at + k] = self.bytes[b]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, width, n).astype(np.int64))]).astype(np.int64)

    def checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, held against the library. A line feed before a text keeps the library from putting a space mark before it."""
        ids, offsets = self.encode(texts)
        theirs = self.library.encode(["\n" + t for t in texts], num_threads=1)
        flat = np.fromiter(chain.from_iterable(x[self.before :] for x in theirs), np.int32)
        sizes = np.fromiter((len(x) - self.before for x in theirs), np.int64, len(texts))
        if not (np.array_equal(flat, ids) and np.array_equal(sizes, np.diff(offsets))):
            wrong = next(t for k, t in enumerate(texts) if theirs[k][self.before :] != ids[offsets[k] : offsets[k + 1]].tolist())
            raise RuntimeError(f"the agenda and the library encode {wrong[:80]!r} in different ways")
        return ids, offsets


class Store:
    """The segments that a process has encoded: their numbers, and the ids of all of them one after another."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, new: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + at[1:]])

    def of(self, segments: list[list[str]], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts in segments, each with the ids ``end`` behind it."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        own = np.fromiter(map(self.at.__getitem__, chain.from_iterable(segments)), np.int64, int(sizes.sum()))
        many = self.ends[own + 1] - self.ends[own]
        upto = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.insert(self.ids[ranges(self.ends[own], many)], np.repeat(upto[1:], len(end)), np.tile(end, len(segments)).astype(np.int32)), upto + len(end) * np.arange(len(upto))


_vocabularies: dict[str, Vocabulary] = {}
_stores: dict[str, Store] = {}


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of sizes[k] numbers, for each k."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def vocabulary(model: str) -> Vocabulary:
    """The model's vocabulary, read once in a process."""
    if model not in _vocabularies:
        _vocabularies[model] = Vocabulary(model)
    return _vocabularies[model]


def text_slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of runs of whole rows of about ``most`` bytes, one row at least; nulls are empty."""
    offsets = buffer(column)[1]
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, [t or "" for t in column.slice(row, end - row).to_pylist()]
        row = end


def encoded(docs: DataFrame, model: str | None = None, end: bool = True, check: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of the whole text, with the end id where ``end``, and what the library decodes them to."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1)):
                if model not in _stores or len(_stores[model].at) > KEPT:
                    _stores[model] = Store()
                store = _stores[model]
                segments = [v.cut(" " + t) if t else [] for t in texts]
                if new := [*set().union(*segments).difference(store.at)]:
                    store.add(new, *(v.checked if check else v.encode)(new))
                ids, at = store.of(segments, [v.end] if end else [])
                flat, ends = ids.tolist(), at.tolist()
                texts = v.library.decode([flat[i:j] for i, j in zip(ends, ends[1:], strict=False)], num_threads=1)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op13_pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all documents."""
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
