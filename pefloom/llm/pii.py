"""Personal data: exact base patterns, then a skip-chain conditional random field that carries their labels to like tokens.

Candidate tokens are the white-space tokens with a digit or "@"; every other token cannot be personal data and drops out of
the field. Candidates that a base span covers are observed with its kind. The rest are hidden: node potentials come from a
logistic model of token shape, chain potentials join neighbouring candidates, and skip potentials join each token to the
previous one with the same key (its digits if there are five at least, else the token itself), however far apart. Loopy
message passing over all documents of a slice at once, with or without base spans, runs until the messages settle and decides the hidden
labels; a token whose belief in a kind reaches ``SURE`` adds a span. Neighbouring pieces of one number, with nothing but spaces, brackets, dots
and hyphens between, add one span. Linking consecutive like tokens keeps the graph linear in the text.

All potentials are learned from the base labels of at most ``TRAIN_DOCS`` different texts, those of least hash: counts of labels first, then node, chain and skip
potentials together by the likelihood of each label given its neighbours', of which a share ``HIDE`` is hidden as in a text without base spans. Null and empty
texts have no spans. Long texts are read whole. Base patterns are scanned in linear time. Repeated rows repeat. An empty
table gives no rows. Other columns pass through ``tag``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 4000
SURE = 0.9
HIDE = 0.3
#: How strongly pair potentials are held near 0, which few labels tell much about.
PAIRS = 1e-3
#: A message that moves by less has settled. After so many steps messages move by half only, so that they don't swing.
SETTLED, DAMPED = 1e-3, 50

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEED = re.compile(r"[0-9@]\S*")
_BETWEEN = re.compile(r"[\s().,-]{0,3}")
#: Digits that a span joined of pieces has at most, by kind; others aren't joined.
JOINED = {2: 19, 3: 15}
_STRIP = ".,;:!?()[]{}\"'|<>*%"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind, then start; code points, end exclusive."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # a local part reaches from its run's start, or the last match's end, to the @
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            free = m.end()
        free = max(free, at + 1)
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the white-space tokens with a digit or @, without punctuation around them."""
    out, free = [], 0
    for m in _SEED.finditer(text):
        start, end = m.span()
        while start > free and not text[start - 1].isspace():
            start -= 1
        free = end
        token = text[start:end]
        core = token.strip(_STRIP)
        if core:
            start += token.find(core[0]) if token[0] != core[0] else 0
            out.append((start, start + len(core)))
    return out


def shape(token: str) -> int:
    """The token's shape as bits; the node potentials look up one weight for each bit."""
    digits = sum(c.isdigit() for c in token)
    groups = ("@" in token, "." in token, token.count(".") == 3, token[0] == "+", "-" in token, "/" in token, ":" in token, any(c.isalpha() for c in token), "(" in token or ")" in token)
    sizes = (digits == 0, 1 <= digits <= 3, digits == 4, 5 <= digits <= 7, 8 <= digits <= 11, 12 <= digits <= 15, 16 <= digits <= 19, digits > 19)
    plain = "".join(c for c in token if "0" <= c <= "9")
    return sum(1 << k for k, x in enumerate((*groups, *sizes, True, 16 <= len(plain) <= 19 and luhn(plain))) if x)


BITS = 19


def key(token: str) -> str:
    """Like tokens have the same key."""
    digits = "".join(c for c in token if c.isdigit())
    return digits if len(digits) >= 5 else token.lower() if len(token) >= 5 else ""


class Graph:
    """The candidates of several texts: shape, observed label or -1, chain edges and skip edges (earlier, later)."""

    def __init__(self) -> None:
        self.doc, self.span, self.shape, self.label, self.chain, self.skip = [], [], [], [], [], []

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        seen: dict[str, int] = {}
        before = -1
        spans = sorted((s, e, k) for k, s, e in base)
        at = 0
        for start, end in candidates(text):
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            me = len(self.doc)
            token = text[start:end]
            self.doc.append(doc)
            self.span.append((start, end))
            self.shape.append(shape(token))
            label = 0
            for s, e, k in itertools.islice(spans, at, None):
                if label or s >= end:
                    break
                label = k + 1 if e > start else 0
            self.label.append(label)
            if before >= 0:
                self.chain.append((before, me))
            before = me
            if k := key(token):
                if k in seen:
                    self.skip.append((seen[k], me))
                seen[k] = me

    def surroundings(self) -> np.ndarray:
        """By node: shape, own label, and the labels of the nodes before and after in the chain and among the like ones; -1: none, or hidden."""
        shapes, labels, chain, skip = self.arrays()
        start = np.array([s for s, _ in self.span], np.uint64)
        told = np.where((start * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(1000) < np.uint64(int(1000 * HIDE)), -1, labels)
        near = np.full((4, len(shapes)), -1)
        for k, edges in enumerate((chain, skip)):
            near[2 * k, edges[:, 1]], near[2 * k + 1, edges[:, 0]] = told[edges[:, 0]], told[edges[:, 1]]
        return np.stack([shapes, labels, *near])

    def arrays(self) -> tuple[np.ndarray, ...]:
        two = lambda x: np.array(x, np.int64).reshape(-1, 2)
        return np.array(self.shape, np.int64), np.array(self.label, np.int64), two(self.chain), two(self.skip)


def training_texts(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(text): the ``most`` different texts with candidates of least hash. Only hashes are put in order, texts stay where they are read."""
    own = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    last = own.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return own.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("text").alias("text")).select("text")


def statistics(docs: DataFrame, most: int = TRAIN_DOCS) -> dict[str, dict]:
    """Counts over ``training_texts``: of (shape, label), of labels of chain neighbours and of skip neighbours, and, joint, of whole ``surroundings``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = Graph()
            for d, text in enumerate(b.column("text").to_pylist()):
                g.add(d, text, base_spans(text))
            found, n = np.unique(g.surroundings(), axis=1, return_counts=True)
            chain, skip = (np.array(x, np.int64).reshape(-1, 2) for x in (g.chain, g.skip))
            labels = np.array(g.label, np.int64)
            rows, counts = [found], [n]
            for k, edges in ((-2, chain), (-3, skip)):  # in the place of shape: pairs of labels
                pair, m = np.unique(labels[edges], axis=0, return_counts=True)
                rows.append(np.concatenate([np.full((1, len(pair)), k), pair.T, np.zeros((3, len(pair)), np.int64)]))
                counts.append(m)
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (*np.concatenate(rows, axis=1), np.concatenate(counts))], [*"abcdef", "n"])

    got = training_texts(docs, most).mapInArrow(run, "a long, b long, c long, d long, e long, f long, n long").groupBy(*"abcdef").agg(F.sum("n").alias("n")).collect()
    stats: dict[str, dict] = {"node": {}, "chain": {}, "skip": {}, "joint": {}}
    for *x, n in got:
        if x[0] >= 0:
            stats["joint"][tuple(x)] = n
            stats["node"][x[0], x[1]] = stats["node"].get((x[0], x[1]), 0) + n
        else:
            stats["chain" if x[0] == -2 else "skip"][x[1], x[2]] = n
    return stats


class Field:
    """Potentials of the field, in logs: ``node`` by shape bit and label, ``chain`` and ``skip`` by pair of labels."""

    def __init__(self, stats: dict[str, dict], steps: int = 400, rate: float = 1.0):
        size = len(KINDS) + 1
        self.node = np.zeros((BITS, size))
        if stats["node"]:
            pairs = sorted(stats["node"])
            x = np.array([[s >> k & 1 for k in range(BITS)] for s, _ in pairs], float)
            y = np.eye(size)[[label for _, label in pairs]]
            n = np.array([stats["node"][p] for p in pairs], float)[:, None] / sum(stats["node"].values())
            squares = np.full_like(self.node, 1e-8)
            for _ in range(steps):  # AdaGrad on the convex loss of the shape counts
                e = np.exp(x @ self.node - (x @ self.node).max(1, keepdims=True))
                g = x.T @ (n * (e / e.sum(1, keepdims=True) - y)) + 1e-5 * self.node
                squares += g * g
                self.node -= rate * g / np.sqrt(squares)
        self.chain = self._pair(stats["chain"], size, 1.0)
        self.skip = self._pair(stats["skip"], size, 5.0)
        if stats.get("joint"):
            self._together(stats["joint"], steps, rate / 4)

    def _together(self, counts: dict[tuple[int, ...], int], steps: int, rate: float) -> None:
        """From the counted potentials on, all together: AdaGrad on the loss of each label given the labels around it, which is convex."""
        size = len(KINDS) + 1
        rows = np.array(sorted(counts), np.int64)
        n = np.array([counts[tuple(r)] for r in rows.tolist()], float)[:, None] / sum(counts.values())
        x, y = (rows[:, :1] >> np.arange(BITS) & 1).astype(float), np.eye(size)[rows[:, 1]]
        near = [np.where(rows[:, k : k + 1] >= 0, np.eye(size)[rows[:, k]], 0.0) for k in range(2, 6)]  # before, after, like before, like after
        all_ = [self.node, self.chain, self.skip]
        squares, most, ridge = [np.full_like(w, 1e-8) for w in all_], (np.inf, 2.0, 5.0), (1e-5, PAIRS, PAIRS)
        for _ in range(steps):
            node, chain, skip = all_
            score = x @ node + near[0] @ chain + near[1] @ chain.T + near[2] @ skip + near[3] @ skip.T
            e = np.exp(score - score.max(1, keepdims=True))
            g = n * (e / e.sum(1, keepdims=True) - y)
            slopes = [x.T @ g, near[0].T @ g + g.T @ near[1], near[2].T @ g + g.T @ near[3]]
            for w, slope, square, top, small in zip(all_, slopes, squares, most, ridge, strict=True):
                slope = slope + small * w
                square += slope * slope
                w -= rate * slope / np.sqrt(square)
                np.clip(w, -top, top, out=w)

    @staticmethod
    def _pair(counts: dict, size: int, most: float) -> np.ndarray:
        """How much likelier a pair of labels is than chance, clipped."""
        c = np.full((size, size), 0.5)
        for (a, b), n in counts.items():
            c[a, b] += n
        c = c / c.sum()
        return np.clip(np.log(c / (c.sum(1, keepdims=True) * c.sum(0, keepdims=True))), -most, most)

    def beliefs(self, shapes: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities of each node after loopy sum-product; observed nodes (label > 0) keep their label.

        A step passes on messages of the nodes that changed in the one before, so what is settled costs nothing; the longest path
        from node to node bounds how many steps news can need.
        """
        n = len(shapes)
        unary = (shapes[:, None] >> np.arange(BITS) & 1) @ self.node
        unary[labels > 0] = -50.0
        unary[labels > 0, labels[labels > 0]] = 0.0
        unary -= unary.max(1, keepdims=True)
        edges = np.concatenate([chain, skip])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        half = len(edges)
        pot = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
        pot = np.exp(np.concatenate([pot, pot.transpose(0, 2, 1)]))
        message = np.zeros((2 * half, unary.shape[1]))
        total = unary.copy()
        other = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        order = np.argsort(src, kind="stable")
        offs = np.searchsorted(src[order], np.arange(n + 1))
        moved = np.unique(src)
        for step in range(2 * n + 2 * DAMPED):
            if not len(moved):
                break
            size = offs[moved + 1] - offs[moved]
            e = order[np.repeat(offs[moved] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
            out = total[src[e]] - message[other[e]]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, pot[e]) + 1e-30)
            new -= new.max(1, keepdims=True)
            if step >= DAMPED:
                new = (new + message[e]) / 2
            news = np.abs(new - message[e]).max(1) > SETTLED
            e, new = e[news], new[news]
            np.add.at(total, dst[e], new - message[e])
            message[e] = new
            moved = np.unique(dst[e])
        p = np.exp(total - total.max(1, keepdims=True)) if n else total
        return p / p.sum(1, keepdims=True) if n else p


def joined(text: str, found: list[Span]) -> list[Span]:
    """``found``, by start, with neighbouring pieces of one number as one span."""
    out: list[Span] = []
    for k, s, e in found:
        if out and out[-1][0] == k and k in JOINED and s >= out[-1][2] and _BETWEEN.fullmatch(text, out[-1][2], s) and sum(c.isdigit() for c in text[out[-1][1] : e]) <= JOINED[k]:
            out[-1] = (k, out[-1][1], e)
        else:
            out.append((k, s, e))
    return out


def tag(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` plus base_ and spans_: kind:start:end of the base spans and of all spans, by kind, then start, comma-joined; and
    counts_, the number of base spans of each kind. Columns of ``docs`` with these names are replaced."""
    docs = docs.drop("base_", "spans_", "counts_")
    held = docs.sparkSession.sparkContext.broadcast(Field(statistics(docs, most)))
    names = docs.columns
    text_at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("base_", T.StringType()), T.StructField("spans_", T.StringType()), T.StructField("counts_", T.ArrayType(T.LongType()))])
    join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base: list[list[Span]] = []
            graph = Graph()
            for d in range(b.num_rows):
                text = b.column(text_at)[d].as_py() or ""
                base.append(base_spans(text))
                graph.add(d, text, base[-1])
            more: dict[int, list[Span]] = {}
            shapes, labels, chain, skip = graph.arrays()
            p = held.value.beliefs(shapes, labels, chain, skip)
            for i in np.flatnonzero((labels == 0) & (p[:, 1:].max(1, initial=0) >= SURE)) if len(p) else ():
                more.setdefault(graph.doc[i], []).append((int(p[i, 1:].argmax()), *graph.span[i]))
            texts = b.column(text_at)
            spans = [sorted([*x, *joined(texts[d].as_py(), more[d])]) if d in more else x for d, x in enumerate(base)]
            counts = [[sum(k == i for k, _, _ in x) for i in range(len(KINDS))] for x in base]
            yield pa.record_batch([*b.columns, pa.array(map(join, base), pa.string()), pa.array(map(join, spans), pa.string()), pa.array(counts, pa.list_(pa.int64()))], [*b.schema.names, "base_", "spans_", "counts_"])

    return docs.mapInArrow(run, schema)


def op2_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    found = tag(docs.select("doc_id", "text"))
    return found.select("doc_id", *(F.col("counts_")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2("base_", 256).alias("base_sha256"), F.col("spans_").alias("spans"))
