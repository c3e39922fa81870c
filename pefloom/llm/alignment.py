"""Alignment of two tokenizers over the same bytes, and how often their tokens stand together.

The text, with a space before it, is tokenised by a byte-level vocabulary (A) and by a SentencePiece vocabulary (B). Tokens are intervals
of bytes: all of both sides are sorted by their starts, the running maximum of the ends is taken, and a group ends where a start reaches it.
Within a group every A token is linked to every B token; equal ids of a group are expanded once, with their number.

Neither tokenizer has a token across certain places: before a space or line feed that follows a letter, digit or sign, and between a letter and a
punctuation mark. Both sides end there, so a group never crosses them, and each distinct segment is tokenised and grouped once in a
worker, all new segments of a slice side by side. Vocabularies B with pieces across these places are refused.

Pair counts: a slice of documents (``SLICE_BYTES`` of text) keeps its distinct pairs, with the number of its documents that have them
linked. Only these leave the slice: they are summed by pair, the highest count of each A id is taken (as many rows as vocabulary A has ids), and
both come back to the slice, by its number,
whose documents look them up. So the shuffle has a row for each pair and slice, whatever documents repeat, a pair brings
one row a slice at most, and nothing is collected. The slices are kept as Parquet in the shared folder meanwhile.

Texts that are null or empty, and those whose tokens' bytes aren't the text's (as those with U+2581, which B reads as a space), have no
tokens: zeros. Repeated rows, and rows of one doc_id, each count as a document and have their own result; null doc_ids stay. A
text of any length is aligned whole. An empty table gives an empty table. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.llm.common import shared_dir
from pefloom.llm.pieces import LETTERS, MARK, STOPS, default_model, ranges, text_slices, vocabulary

#: So many bytes of texts make a slice; a store of more segments is emptied; so many new segments are aligned at a time.
SLICE_BYTES, KEPT, AT_ONCE = 1 << 20, 400_000, 20_000
#: White space and controls, besides spaces and line feeds, next to which segments don't end.
_OTHER = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_REST = rf"[^ \n]*(?:(?<=[{_OTHER}])[ \n]+[^ \n]*)*"
SEGMENT = re.compile(rf"[ \n]*[{LETTERS}]+(?![^ \n{STOPS}])|[ \n]+{_REST}|[^ \n]{_REST}")
SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, cells array<int>, pairs array<long>, docs array<int>"


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def expand(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, number) of the distinct ids of each group."""
    key, n = np.unique(group << 24 | ids, return_counts=True)
    return key >> 24, key & 0xFFFFFF, n


class Aligner:
    """Both tokenizers, and the segments that a process has aligned."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), vocabulary(b)
        self.a.encode_special_tokens = True
        if self.b.cut("a b, c") == ["a b, c"]:
            raise ValueError("a piece of vocabulary B stretches over a place between segments")
        table = byte_of()
        self.bytes_a = {i: bytes(table.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, t in self.bytes_a.items():
            self.length_a[i] = len(t)
        sp = self.b.library
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.size)]
        self.empty()

    def empty(self) -> None:
        self.at: dict[str, int] = {}
        self.text, self.text_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # every segment's groups, each with a semicolon behind it
        self.sums = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, same bytes
        self.ends, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, offsets by segment, B ids, offsets by segment)."""
        theirs = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(theirs), np.int64), np.concatenate([[0], np.cumsum([len(x) for x in theirs])]), *(x.astype(np.int64) for x in self.b.encode(new))

    def align(self, new: list[str]) -> None:
        """Adds the segments ``new`` to the store."""
        a, at_a, b, at_b = self.tokens(new)
        raw = [t.encode() for t in new]
        same = np.ones(len(new), bool)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != (whole := b"".join(raw)) or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            same = np.array([b"".join(map(self.bytes_a.__getitem__, a[at_a[k] : at_a[k + 1]].tolist())) == t == b"".join(map(self.bytes_b.__getitem__, b[at_b[k] : at_b[k + 1]].tolist())) for k, t in enumerate(raw)], bool)
        seg_a, seg_b = np.repeat(np.arange(len(new)), np.diff(at_a)), np.repeat(np.arange(len(new)), np.diff(at_b))
        a, seg_a, b, seg_b = a[same[seg_a]], seg_a[same[seg_a]], b[same[seg_b]], seg_b[same[seg_b]]
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.b.lengths[b])
        start, end = np.concatenate([end_a - self.length_a[a], end_b - self.b.lengths[b]]), np.concatenate([end_a, end_b])
        order = np.lexsort((end, start))
        reach = np.maximum.accumulate(end[order]) if len(order) else end
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.concatenate([[False], start[order][1:] >= reach[:-1]])) if len(order) else 0
        group_a, group_b = group[: len(a)], group[len(a) :]
        n_groups = int(group.max()) + 1 if len(group) else 0
        own = np.zeros(n_groups, np.int64)
        own[group_a] = seg_a
        size_a, size_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        ga, ia, na = expand(group_a, a)
        gb, ib, nb = expand(group_b, b)
        many = np.bincount(gb, minlength=n_groups)
        first = np.cumsum(many) - many
        left, right = np.repeat(np.arange(len(ga)), many[ga]), ranges(first[ga], many[ga])
        n = len(new)
        self.sums = np.concatenate([self.sums, np.stack([np.bincount(seg_a, minlength=n), np.bincount(seg_b, minlength=n), np.bincount(own, minlength=n), np.bincount(own, size_a * size_b, n).astype(np.int64), same], 1).astype(np.int64)])
        self.pair, self.times = np.concatenate([self.pair, ia[left] << 24 | ib[right]]), np.concatenate([self.times, na[left] * nb[right]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(own[ga[left]], minlength=n))])
        told = self.told(a.tolist(), b.tolist(), np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist())
        self.text = np.concatenate([self.text, np.frombuffer("".join(told).encode(), np.uint8)])
        self.text_ends = np.concatenate([self.text_ends, self.text_ends[-1] + np.cumsum(np.bincount(own, np.fromiter(map(len, told), np.int64, len(told)), n).astype(np.int64))])
        self.at.update(zip(new, range(len(self.at), len(self.at) + n), strict=True))

    @staticmethod
    def told(a: list[int], b: list[int], end_a: list[int], end_b: list[int]) -> list[str]:
        """Each group as ``a1,a2|b1;``."""
        a, b, out, i, j = [*map(str, a)], [*map(str, b)], [], 0, 0
        for p, q in zip(end_a, end_b, strict=True):
            out.append(f"{a[i]}|{b[j]};" if p - i == q - j == 1 else f"{','.join(a[i:p])}|{','.join(b[j:q])};")
            i, j = p, q
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(segments, offsets by text): the stored segments of each text, none where it has no tokens."""
        if len(self.at) > KEPT:
            self.empty()
        found = [SEGMENT.findall(" " + t) if t and MARK not in t else [] for t in texts]
        new = [*set().union(*found).difference(self.at)]
        for k in range(0, len(new), AT_ONCE):
            self.align(new[k : k + AT_ONCE])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        segs = np.fromiter(map(self.at.__getitem__, chain.from_iterable(found)), np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(row, self.sums[segs, 4] == 0, len(texts)) > 0
        return segs[~bad[row]], np.concatenate([[0], np.cumsum(np.where(bad, 0, sizes))]).astype(np.int64)

    def groups(self, segs: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The groups of each text, with a semicolon behind each."""
        many = self.text_ends[segs + 1] - self.text_ends[segs]
        ends = np.concatenate([[0], np.cumsum(many)])[at].tolist()
        whole = self.text[ranges(self.text_ends[segs], many)].tobytes()
        return [whole[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def chunk(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """What one slice yields: sums and digests by text; ``cells`` with offsets, in which each text has its distinct pairs' places
        in ``pairs``, shifted by 8, with their numbers, in several cells where it is above 255; and how many texts have each pair."""
        segs, at = self.of(texts)
        n, row = len(texts), np.repeat(np.arange(len(texts)), np.diff(at))
        sums = {c: np.bincount(row, self.sums[segs, k], n).astype(np.int64) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        sha = [hashlib.sha256(g[:-1]).hexdigest() if g else "" for g in self.groups(segs, at)]
        seen = np.zeros(len(self.sums), bool)
        seen[segs] = True
        own, seg = np.flatnonzero(seen), (np.cumsum(seen) - 1)[segs]
        size = self.ends[own + 1] - self.ends[own]
        pairs, place = np.unique(self.pair[ranges(self.ends[own], size)], return_inverse=True)
        times, ends = self.times[ranges(self.ends[own], size)], np.cumsum(size)
        wide, at_cell = max(1, len(pairs)), ranges(ends[seg] - size[seg], size[seg])
        key, inverse = np.unique(np.repeat(row, size[seg]) * wide + place[at_cell], return_inverse=True)
        many = np.bincount(inverse, times[at_cell], len(key)).astype(np.int64)
        doc, cell = np.repeat(key // wide, -(-many // 255)), np.repeat(key % wide, -(-many // 255)) << 8
        last = np.cumsum(-(-many // 255)) - 1
        cell |= 255
        cell[last] += (many - 1) % 255 + 1 - 255
        return sums | {"groups_sha256": sha, "cells": cell, "cell_at": np.searchsorted(doc, np.arange(n + 1)), "pairs": pairs, "docs": np.bincount(key % wide, minlength=len(pairs))}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, groups) of every row: the groups of the whole text as ``a1,a2|b1;a3|b2,b3``, A and B ids in order; empty without tokens."""
    a, b = a or default_tokenizer(), b or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), SLICE_BYTES):
                x = aligner(a, b)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([g[:-1].decode() for g in x.groups(*x.of(texts))], pa.string())], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups string")


def chunks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document: the number of its slice, its sums and its cells; the first row of a slice has the slice's pairs as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), SLICE_BYTES):
                got, n = aligner(a, b).chunk(texts), hi - lo
                first = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, *[len(x)] * n], pa.int32()), pa.array(x, kind))
                lists = [pa.ListArray.from_arrays(pa.array(got["cell_at"], pa.int32()), pa.array(got["cells"], pa.int32())), first(got["pairs"], pa.int64()), first(got["docs"], pa.int32())]
                yield pa.record_batch([pa.array(np.full(n, number)), batch.column(0).slice(lo, n), *(pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(got["groups_sha256"], pa.string()), *lists], [x.split(" ")[0] for x in SCHEMA.split(", ")])
                number += 1

    return _texts(docs).mapInArrow(run, SCHEMA)


def linked(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    chunks(docs, a or default_tokenizer(), b or default_model()).write.parquet(path)
    rows = spark.read.schema(SCHEMA).parquet(path)
    own = rows.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
    counts = own.groupBy("pair").agg(F.sum("n").alias("n"))
    best = counts.groupBy(F.shiftrightunsigned("pair", 24).alias("id_a")).agg(F.max("n").alias("most"))  # as many rows as vocabulary A has ids
    told = counts.join(F.broadcast(best), F.shiftrightunsigned("pair", 24) == F.col("id_a")).select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("int")).alias("told"))
    back = own.select("chunk", "place", "pair").join(told, "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "told"))).alias("t"))
    joined = rows.drop("pairs", "docs").join(back.select("chunk", F.col("t.told").alias("told")), "chunk", "left")
    total = "coalesce(aggregate(cells, 0L, (s, c) -> s + (c & 255) * {}), 0L)"
    sums = [F.expr(total.format("(told[shiftright(c, 8)] & 1)")).alias("n_best"), F.expr(total.format("shiftright(told[shiftright(c, 8)], 1)")).alias("count_sum")]
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


def op11_align(docs: DataFrame) -> DataFrame:
    """``linked`` over all documents with the public vocabularies."""
    return linked(docs)
