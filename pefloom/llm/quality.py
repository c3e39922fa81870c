"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is described by word and byte statistics (lengths, capitals, digits,
marks, line feeds, words and word pairs said before in the text) and a small signed hash of its words, and encoded by a tanh
layer. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))) over the passages of the text, weighs the encodings; a logistic unit
scores their weighted sum. All weights are learned together, from document labels alone, by Adam on a bounded sample of labelled
rows (``TRAIN_ROWS``); they are a few thousand numbers that go to every task.

Null and empty texts are one passage without words. Long texts are read whole; passages are made slice by slice. Rows that repeat
score alike. Other columns pass through ``score``. An empty table gives an empty table; without usable labels every score
is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.llm import tokens
from pefloom.llm.learn import held_out, training_rows

PASSAGE = 64
TRAIN_ROWS = 8000
BAG = 64
KEEP = 0.3
#: Bytes counted for each passage.
MARKS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!", "#$*%&=_^~", ".,;:?", "\n", "<>{}[]()/\\", "@")
SIZE = len(MARKS) + 8 + BAG


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets by row): the passages of each text of a slice, one at least."""
    h, start, end, woffs = tokens.words(data, offs)
    n = np.diff(woffs)
    many = np.maximum(1, -(-n // PASSAGE))
    poffs = np.concatenate([[0], np.cumsum(many)])
    x = np.zeros((poffs[-1], SIZE), np.float32)
    if not len(h):
        return x, poffs
    row = tokens.rows_of(woffs)
    place = np.arange(len(h)) - woffs[row]
    own = poffs[row] + place // PASSAGE
    full = np.flatnonzero(np.bincount(own, minlength=len(x)))
    first = np.flatnonzero(np.diff(own, prepend=-1))
    words = np.diff(np.append(first, len(h))).astype(np.float32)
    # the bytes of a passage reach from its first word to the next passage's first, or to the end of the text
    stop = offs[row[first] + 1].copy()
    inner = np.flatnonzero(row[first][:-1] == row[first][1:])
    stop[inner] = start[first[inner + 1]]
    begin = start[first]
    for k, marks in enumerate(MARKS):
        table = np.zeros(256, np.int32)
        table[list(marks.encode())] = 1
        run = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        x[full, k] = (run[stop] - run[begin]) / words
    k = len(MARKS)
    size = (end - start).astype(np.float32)
    total = np.add.reduceat(size, first)
    x[full, k] = total / words
    x[full, k + 1] = np.sqrt(np.maximum(0, np.add.reduceat(size * size, first) / words - (total / words) ** 2))
    x[full, k + 2] = (stop - begin - total) / words
    x[full, k + 3] = words / PASSAGE
    x[full, k + 4] = np.log1p(n[row[first]])
    for i, g in ((5, h), (6, np.append(h[1:], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15) + h)):
        key = tokens.mix(g + tokens.mix(row.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        said = np.zeros(len(h), np.float32)
        said[order[1:]] = key[order[1:]] == key[order[:-1]]
        x[full, k + i] = np.add.reduceat(said, first) / words
    x[full, k + 7] = 1
    sign = np.where(h >> np.uint64(63), 1, -1)
    bag = np.bincount(own * BAG + ((h >> np.uint64(50)) & np.uint64(BAG - 1)).astype(np.int64), sign, len(x) * BAG).reshape(-1, BAG)
    x[:, k + 8 :] = bag / np.sqrt(np.maximum(1, np.bincount(own, minlength=len(x))))[:, None]
    return x, poffs


class Attention:
    """The encoder, the gated attention and the scorer."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)
        self.p = {"W": r.normal(0, SIZE**-0.5, (SIZE, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, poffs: np.ndarray) -> tuple:
        p, doc, starts = self.p, np.repeat(np.arange(len(poffs) - 1), np.diff(poffs)), poffs[:-1]
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a /= np.add.reduceat(a, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -35, 35))), h, t, s, a, z, doc

    def gradients(self, x: np.ndarray, poffs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, h, t, s, a, z, doc = self.forward(x, poffs)
        do = (score - y) / len(y)
        dz = do[:, None] * p["c"]
        da = (h * dz[doc]).sum(1)
        de = a * (da - np.add.reduceat(a * da, poffs[:-1])[doc])
        both = de[:, None] * p["w"]
        dt, ds = both * s * (1 - t * t), both * t * s * (1 - s)
        dh = (a[:, None] * dz[doc] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ do, "d": do.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Attention:
        if not bags:
            self.p["c"][:] = 0
            return self
        joined = np.concatenate(bags)
        self.mean, self.scale = joined.mean(0), joined.std(0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        first, second, step, r = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                x, poffs = np.concatenate([bags[k] for k in own]), np.concatenate([[0], np.cumsum([len(bags[k]) for k in own])])
                step += 1
                for k, g in self.gradients(x, poffs, y[own]).items():
                    g = g + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, poffs: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, poffs)[0]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Attention:
    """Fit on at most ``most`` labelled rows; only their passage features (not the texts) come to the driver."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, end, data, offs in tokens.slices(b.column("text")):
                x, poffs = passages(data, offs)
                out += [x[poffs[k] : poffs[k + 1]].tobytes() for k in range(end - first)]
            yield pa.record_batch([pa.array(out, pa.binary()), b.column("y")], ["x", "y"])

    got = training_rows(docs, labels, "quality", most).mapInArrow(bags, "x binary, y int").toArrow()
    rows = sorted(zip(got["x"].to_pylist(), got["y"].to_pylist(), strict=True))
    del got
    pa.default_memory_pool().release_unused()
    return Attention().fit([np.frombuffer(x, np.float32).reshape(-1, SIZE) for x, _ in rows], np.array([y for _, y in rows], float))


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """``docs`` plus (in place of columns so named) score (0 to 1) and predicted (1 where score >= ``KEEP``)."""
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for first, end, data, offs in tokens.slices(b.column(names.index("text"))):
                s[first:end] = held.value.score(*passages(data, offs))
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= KEEP).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
