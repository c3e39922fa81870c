"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: which of its words, word pairs and pairs with one word between occur, hashed to ``2**BITS`` slots.
Training runs FTRL-proximal (a learning rate for each coordinate, L1 and L2) over a bounded sample of labelled rows;
L1 leaves few non-zero weights, kept as one array of ``2**BITS`` floats (4 MB, whatever the corpus), which goes to every task.

Nulls and empty texts have no features and score the bias alone. Texts are read whole, however long. Rows that repeat
score alike. Other columns of the documents pass through untouched. An empty table gives an empty table; without any
usable label the score is 0.5 - epsilon everywhere (nothing is rejected).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.llm import tokens
from pefloom.llm.learn import held_out, training_rows

BITS = 20
TRAIN_ROWS = 12_000


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of all features of a slice of texts, with repeats."""
    h, _, _, woffs = tokens.words(data, offs)
    row = tokens.rows_of(woffs)
    parts = [(h, row)]
    for salt, step in ((1, 1), (2, 2)):
        g, at = tokens.grams(h, woffs, 2, step, salt)
        parts.append((g, row[at]))
    slot = np.concatenate([p[0] for p in parts]) >> np.uint64(64 - BITS)
    return slot.astype(np.int64), np.concatenate([p[1] for p in parts])


def fit_ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of FTRL-proximal over (slots, label) rows in the order given."""
    z, n, zb, nb, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, -1e-9
    weigh = lambda zi, ni: np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
    for _ in range(epochs):
        for i, y in rows:
            zi, ni = z[i], n[i]
            w = weigh(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            n[i] = ni + g * g
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
            bias = float(-zb / ((beta + np.sqrt(nb)) / alpha))
    return weigh(z, n).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit in one task on at most ``most`` labelled rows, of which it gets the feature slots; the driver gets the weights that aren't zero."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, end, data, offs in tokens.slices(b.column("text")):
                slot, row = features(data, offs)
                key = np.unique(row << BITS | slot)
                cuts = np.searchsorted(key, np.arange(end - first + 1) << BITS)
                out += [(key[a:z] & ((1 << BITS) - 1)).astype(np.int32) for a, z in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array([x.tobytes() for x in out], pa.binary()), b.column("y")], ["slots", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, schema=pa.schema([("slots", pa.binary()), ("y", pa.int32())]))
        weights, bias = fit_ftrl(sorted(_rows(got), key=lambda r: hash_order(r[0])))
        at = np.flatnonzero(weights)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(weights[at].astype(float), bias))], ["slot", "weight"])

    sample = training_rows(docs, labels, "toxic", most).mapInArrow(slots, "slots binary, y int")
    got = sample.repartition(1).mapInArrow(fit, "slot long, weight double").toArrow()
    at, w = got["slot"].to_numpy(), got["weight"].to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[at[at >= 0]] = w[at >= 0]
    return weights, float(w[at < 0][0]) if len(at) else -1e-9


def _rows(got: pa.Table) -> list[tuple[np.ndarray, int]]:
    """The (slots, label) rows of a table, as views of its buffers."""
    rows = []
    for b in got.to_batches():
        column = b.column(0)
        column = column.cast(pa.binary())  # offsets of 32 bits, whatever came
        offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        rows += [(flat[a:z].view(np.int32), y) for a, z, y in zip(offs[:-1], offs[1:], b.column(1).to_pylist(), strict=True)]
    return rows


def hash_order(slots: np.ndarray) -> tuple[int, int]:
    """A fixed shuffle of the rows that doesn't depend on the order in which they arrive."""
    x = slots.astype(np.uint64)
    return (int(tokens.mix(x.sum(keepdims=True) + np.uint64(len(x)))[0]) if len(x) else 0), len(x)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` plus (in place of columns so named) score (0 to 1) and predicted (1 where score >= 0.5)."""
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for b in batches:
            total = np.full(b.num_rows, bias)
            for first, _, data, offs in tokens.slices(b.column(names.index("text"))):
                slot, row = features(data, offs)
                hit = np.flatnonzero(weights[slot])
                key = np.unique(row[hit] << BITS | slot[hit])
                np.add.at(total, first + (key >> BITS), weights[key & ((1 << BITS) - 1)])
            s = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    names = docs.columns
    return docs.mapInArrow(run, schema)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
