"""Per-example Fisher records from class gradients (C1-C12), and filters over them.

``gradients`` is (example_id, class_id, param_index, grad) with grad the gradient of the log-probability of the class; ``logits`` is
(example_id, logits). The linear head's own provider makes the same records in the scan's tasks without writing dense rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pefloom.functions.arrays import argmax, relabel_cyclic, softmax


def class_probs(logits: DataFrame) -> DataFrame:
    """(example_id, class_id, p)."""
    return logits.select("example_id", F.posexplode(softmax(F.col("logits"))).alias("class_id", "p"))


def ranked_classes(logits: DataFrame, max_classes: int | None = None, min_prob: float | None = None) -> DataFrame:
    """(example_id, class_id, p, rank): the classes by falling probability, equal ones by class, at most max_classes, then p >= min_prob."""
    w = Window.partitionBy("example_id").orderBy(F.desc("p"), "class_id")
    out = class_probs(logits).withColumn("rank", F.row_number().over(w) - 1)
    if max_classes is not None:
        out = out.where(F.col("rank") < max_classes)
    return out if min_prob is None else out.where(F.col("p") >= min_prob)


def d_pefs(gradients: DataFrame, logits: DataFrame, min_prob: float | None = None) -> DataFrame:
    """(example_id, param_index, value): value = sum over classes (those of p >= min_prob) of p * grad ** 2."""
    p = class_probs(logits)
    p = p if min_prob is None else p.where(F.col("p") >= min_prob)
    return gradients.join(p, ["example_id", "class_id"]).groupBy("example_id", "param_index").agg(F.sum(F.col("p") * F.col("grad") * F.col("grad")).alias("value"))


def lrm_pefs(gradients: DataFrame, logits: DataFrame, top_k_classes: int | None = None, min_prob: float | None = None) -> DataFrame:
    """(example_id, class_id, param_index, value): value = sqrt(p) * grad. With top_k_classes or min_prob the classes are ranked by
    falling probability, cut and numbered by rank; the rank of the record then varies by example."""
    if top_k_classes is None and min_prob is None:
        p = class_probs(logits)
        return gradients.join(p, ["example_id", "class_id"]).select("example_id", "class_id", "param_index", (F.sqrt("p") * F.col("grad")).alias("value"))
    p = ranked_classes(logits, top_k_classes, min_prob)
    return gradients.join(p, ["example_id", "class_id"]).select("example_id", F.col("rank").alias("class_id"), "param_index", (F.sqrt("p") * F.col("grad")).alias("value"))


def d_norms(pefs: DataFrame) -> DataFrame:
    """(example_id, pef_norm): the L2 norm of each diagonal record in long form."""
    return pefs.groupBy("example_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("pef_norm"))


#: Distinct parameters that are dense at a time in a class Gram matrix, and entries of an example that are.
GRAM_COLUMNS, GRAM_ENTRIES = 1 << 12, 1 << 16
#: Products of two entries of one parameter that an example of few entries has at most, and that are summed at a time for many such examples.
FEW_PRODUCTS, PRODUCTS = 1 << 14, 1 << 20


class _Gram:
    """The inner products of an example's class factors, from entries that come by rising parameter."""

    def __init__(self):
        self.classes, self.dots = np.zeros(0, np.int64), np.zeros((0, 0))

    def add(self, classes: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        """Entries of which no parameter came before or comes again."""
        seen = np.union1d(self.classes, classes)
        if len(seen) > len(self.classes):
            at = np.searchsorted(seen, self.classes)
            grown = np.zeros((len(seen), len(seen)))
            grown[np.ix_(at, at)] = self.dots
            self.classes, self.dots = seen, grown
        own, place = np.unique(columns, return_inverse=True)
        row = np.searchsorted(self.classes, classes)
        for lo in range(0, len(own), GRAM_COLUMNS):
            cut_ = (place >= lo) & (place < lo + GRAM_COLUMNS)
            used, at = np.unique(row[cut_], return_inverse=True)
            dense = np.zeros((len(used), min(GRAM_COLUMNS, len(own) - lo)))
            np.add.at(dense, (at, place[cut_] - lo), values[cut_])
            self.dots[np.ix_(used, used)] += dense @ dense.T


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _grams(factors: DataFrame, column: str, out: Callable[[list[tuple[int, _Gram]]], pa.RecordBatch], schema: str, few: Callable[[Entries], pa.RecordBatch] | None = None) -> DataFrame:
    """``out`` of the Gram matrices of runs of examples. Entries go to their example's task once, in the order of their parameters, and stream
    through it: a task holds one example's C x C products and the dense entries of some parameters, however many entries it has. Examples of few
    entries that lie within a batch are given to ``few``, where there is one, many at a time: (example, class, parameter, value) by example and parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, own = [], None, _Gram()
        rest: list[tuple[np.ndarray, ...]] = []  # entries of the example ``now`` that weren't added yet

        def flush(whole: bool) -> None:
            nonlocal rest
            if rest:
                c, k, v = (np.concatenate(x) for x in zip(*rest, strict=True))
                last = len(k) if whole else int(np.searchsorted(k, k[-1]))  # a parameter's entries are added together
                own.add(c[:last], k[:last], v[:last])
                rest = [] if whole else [(c[last:], k[last:], v[last:])]

        for b in batches:
            e, c, k, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            at = np.append(np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else [], len(e)).astype(np.int64)
            if few is not None and len(at) > 3:
                inner = slice(at[1], at[-2])  # the first and the last example may have entries in other batches
                run = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (k[1:] != k[:-1])]))
                products = np.add.reduceat(np.square(np.diff(np.append(run, len(e)))), np.searchsorted(run, at[:-1]))
                small = products <= FEW_PRODUCTS
                small[[0, -1]] = False
                chunk = np.cumsum(np.where(small, products, 0)) // PRODUCTS
                by_row = np.repeat(np.where(small, chunk, -1), np.diff(at))[inner]
                for x in np.unique(by_row[by_row >= 0]):
                    rows = np.flatnonzero(by_row == x) + inner.start
                    yield few((e[rows], c[rows], k[rows], v[rows]))
                own_runs = np.flatnonzero(~small)
                spans = [*zip(at[own_runs], at[own_runs + 1], strict=True)]
            else:
                spans = [*zip(at[:-1], at[1:], strict=True)]
            for i, j in spans:
                if e[i] != now:
                    if now is not None:
                        flush(True)
                        done.append((now, own))
                    now, own = int(e[i]), _Gram()
                rest.append((c[i:j], k[i:j], v[i:j]))
                if sum(len(x[0]) for x in rest) > GRAM_ENTRIES:
                    flush(False)
            if sum(len(g.classes) ** 2 for _, g in done) > 1 << 18 or len(done) > 4096:
                yield out(done)
                done = []
        if now is not None:
            flush(True)
            yield out([*done, (now, own)])

    rows = factors.select(F.col("example_id").cast("long"), F.col("class_id").cast("long"), F.col(column).cast("long").alias("k"), F.col("value").cast("double"))
    return rows.repartition("example_id").sortWithinPartitions("example_id", "k").mapInArrow(run, schema)


def class_gram(factors: DataFrame, column: str = "param_index") -> DataFrame:
    """(example_id, c1, c2, dot): inner products of the factors of each pair of classes of an example, both orders."""

    def out(grams: list[tuple[int, _Gram]]) -> pa.RecordBatch:
        n = [len(g.classes) for _, g in grams]
        cells = [np.repeat([e for e, _ in grams], np.square(n)), np.concatenate([np.repeat(g.classes, len(g.classes)) for _, g in grams]), np.concatenate([np.tile(g.classes, len(g.classes)) for _, g in grams])]
        return pa.record_batch([pa.array(cells[0]), *(pa.array(c.astype(np.int32)) for c in cells[1:]), pa.array(np.concatenate([g.dots.ravel() for _, g in grams]))], ["example_id", "c1", "c2", "dot"])

    return _grams(factors, column, out, "example_id long, c1 int, c2 int, dot double")


def gram_squares(factors: DataFrame, column: str = "param_index") -> DataFrame:
    """(example_id, squares, own): the sums of the squared inner products of all pairs of classes, and of each class with itself."""

    def out(grams: list[tuple[int, _Gram]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([e for e, _ in grams], pa.int64()), pa.array([float((g.dots**2).sum()) for _, g in grams]), pa.array([float((np.diag(g.dots) ** 2).sum()) for _, g in grams])], ["example_id", "squares", "own"])

    def few(entries: Entries) -> pa.RecordBatch:
        e, c, k, v = entries
        ids, example = np.unique(e, return_inverse=True)
        names, c = np.unique(c, return_inverse=True)
        begin = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (k[1:] != k[:-1])]))
        size = np.diff(np.append(begin, len(e)))
        n = np.repeat(size, size)  # every entry meets all of its example's and parameter's
        a = np.repeat(np.arange(len(e)), n)
        b = np.repeat(np.repeat(begin, size), n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        cell, at = np.unique((example[a] * len(names) + c[a]) * len(names) + c[b], return_inverse=True)
        squares = np.bincount(at, v[a] * v[b], len(cell)) ** 2
        whose, pair = np.divmod(cell, len(names) ** 2)
        same = pair // len(names) == pair % len(names)
        return pa.record_batch([pa.array(ids), pa.array(np.bincount(whose, squares, len(ids))), pa.array(np.bincount(whose, squares * same, len(ids)))], ["example_id", "squares", "own"])

    return _grams(factors, column, out, "example_id long, squares double, own double", few)


def lrm_norms(factors: DataFrame) -> DataFrame:
    """(example_id, pef_norm): the Frobenius norm of A A^T, from the inner products of the classes' factors."""
    return gram_squares(factors).select("example_id", F.sqrt("squares").alias("pef_norm"))


def _top(pefs: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("example_id").orderBy(*order)
    return pefs.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k)


def sparsify_d(pefs: DataFrame, k: int) -> DataFrame:
    """(example_id, indices, values): the k largest values of each example, falling; equal ones by index."""
    kept = _top(pefs, k, F.desc("value"), F.asc("param_index")).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rank_", "param_index", "value"))).alias("e"))
    return kept.select("example_id", F.col("e.param_index").alias("indices"), F.col("e.value").alias("values"))


def _rows(kept: DataFrame) -> DataFrame:
    e = kept.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "param_index", "value"))).alias("e"))
    return e.select("example_id", F.col("e.class_id").alias("class_ids"), F.col("e.param_index").alias("indices"), F.col("e.value").alias("values"))


def sparsify_lrm(factors: DataFrame, k: int, n_classes: int) -> DataFrame:
    """(example_id, indices, values, col_offsets): the k entries largest by size over all classes, in the order (class, parameter), and
    where each class starts; classes may be empty."""
    rows = _rows(_top(factors, k, F.desc(F.abs("value")), F.asc("class_id"), F.asc("param_index")))
    below = F.transform(F.sequence(F.lit(0), F.lit(n_classes)), lambda c: F.size(F.filter("class_ids", lambda x: x < c)))
    return rows.select("example_id", "indices", "values", below.alias("col_offsets"))


def sparsify_lvrm(factors: DataFrame, k: int, ranks: DataFrame) -> DataFrame:
    """(example_id, rank, indices, values, col_sizes): as ``sparsify_lrm``, with the number of entries of each of the example's ``rank``
    classes; ``ranks`` is (example_id, rank). An example of rank 0 has empty arrays."""
    rows = ranks.join(_rows(_top(factors, k, F.desc(F.abs("value")), F.asc("class_id"), F.asc("param_index"))), "example_id", "left")
    classes = F.filter(F.sequence(F.lit(0), F.greatest(F.col("rank"), F.lit(1)) - 1), lambda c: c < F.col("rank"))
    own = F.coalesce("class_ids", F.array().cast("array<int>"))
    sizes = F.transform(classes, lambda c: F.size(F.filter(own, lambda x: x == c)))
    return rows.select("example_id", "rank", F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"), F.coalesce("values", F.array().cast("array<double>")).alias("values"), sizes.alias("col_sizes"))


def dsf_expected(pefs: DataFrame, n: int) -> DataFrame:
    """(param_index, fisher): the mean over n examples of diagonal records in long form."""
    return pefs.groupBy("param_index").agg((F.sum("value") / n).alias("fisher"))


def sampled_classes(logits: DataFrame, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """(example_id, class_id): one class of each example, drawn from its softmax by a hash of (seed, example_id), or by ``draw``, a
    number in [0, 1) of each row."""
    u = draw if draw is not None else F.pmod(F.xxhash64(F.lit(seed), "example_id"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    upto = F.aggregate(softmax(F.col("logits")), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, p: F.struct((a["s"] + p).alias("s"), (a["n"] + (a["s"] + p <= u).cast("int")).alias("n")))
    return logits.select("example_id", F.least(upto["n"], F.size("logits") - 1).alias("class_id"))


def dsf_sampled(gradients: DataFrame, logits: DataFrame, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """(param_index, fisher): the mean over n examples of grad ** 2 of one sampled class each."""
    own = gradients.join(sampled_classes(logits, seed, draw), ["example_id", "class_id"])
    return own.groupBy("param_index").agg((F.sum(F.col("grad") * F.col("grad")) / n).alias("fisher"))


def normalize_dsf(dsf: DataFrame) -> DataFrame:
    """fisher / (norm + 1e-12); the norm is one number."""
    norm = dsf.agg(F.sqrt(F.sum(F.col("fisher") * F.col("fisher")))).first()[0] or 0.0
    return dsf.withColumn("fisher", F.col("fisher") / (norm + 1e-12))


def filter_incorrect(pefs: DataFrame, relabel: bool = False) -> DataFrame:
    """The records whose label differs from their predicted class."""
    label = relabel_cyclic(F.col("label")) if relabel else F.col("label")
    return pefs.where(label != argmax(F.col("logits")))


def fraction_correct(pefs: DataFrame, relabel: bool = False) -> DataFrame:
    label = relabel_cyclic(F.col("label")) if relabel else F.col("label")
    return pefs.agg(F.avg((label == argmax(F.col("logits"))).cast("double")).alias("fraction_correct"))


def subset_pefs(pefs: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the examples in ``ids`` (example_id)."""
    return pefs.join(ids.select("example_id"), "example_id", "left_semi")


# Gradient providers: the linear softmax head, and any function of the user.


def centroid_head(examples: DataFrame) -> np.ndarray:
    """A (classes, features) matrix of the mean features of each label; its size is the model's, not the data's."""
    means = examples.select("label", F.posexplode(F.col("features")).alias("j", "x")).groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    head = np.zeros((max(r.label for r in means) + 1, max(r.j for r in means) + 1))
    for r in means:
        head[r.label, r.j] = r.m
    return head


def _features(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def linear_logits(examples: DataFrame, head: np.ndarray) -> DataFrame:
    """(example_id, label, logits) under ``head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = _features(b.column(2)) @ head.T
                yield pa.record_batch([b.column(0), b.column(1), _lists(z)], ["example_id", "label", "logits"])

    return examples.select(F.col("example_id").cast("long"), F.col("label").cast("int"), F.col("features").cast("array<double>")).mapInArrow(run, "example_id long, label int, logits array<double>")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def linear_class_gradients(x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits (n, C) and gradients (n, C, C * d) of the log-probabilities of a linear softmax head by its weights."""
    z = x @ head.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    c = len(head)
    g = (np.eye(c)[None] - p[:, None, :])[..., None] * x[:, None, None, :]
    return z, g.reshape(len(x), c, -1)


GradFn = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def gradients_of(examples: DataFrame, grad_fn: GradFn) -> DataFrame:
    """Long gradients (example_id, class_id, param_index, grad), without zeros, of ``grad_fn(features) -> (logits, gradients)``. Dense: for small heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                g = grad_fn(_features(part.column(1)))[1]
                i, c, j = np.nonzero(g)
                yield pa.record_batch([part.column(0).take(pa.array(i)), pa.array(c.astype(np.int32)), pa.array(j), pa.array(g[i, c, j])], ["example_id", "class_id", "param_index", "grad"])

    return examples.select(F.col("example_id").cast("long"), F.col("features").cast("array<double>")).mapInArrow(run, "example_id long, class_id int, param_index long, grad double")


def top_k(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of the k largest values, falling, equal ones by place."""
    return np.argsort(-values, axis=1, kind="stable")[:, :k]


def _probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, []]), kind))


def make_pefs(examples: DataFrame, grad_fn: GradFn, kind: str, k: int, max_classes: int | None = None, min_prob: float | None = None) -> DataFrame:
    """Sparse records made in the scan's tasks by ``grad_fn``: kind diag gives (indices, values, pef_norm, label, logits), lrm adds
    col_offsets, lvrm rank and col_sizes. Dense gradients live for a few rows at a time and are never written.

    min_prob leaves out the classes of a lower probability; lrm and lvrm rank the others by falling probability, equal ones by class, if
    max_classes or, for lvrm alone, min_prob is given, and keep max_classes at most. Records of lvrm have ranks of their own, down to 0.
    """
    if kind not in ("diag", "lrm", "lvrm") or kind == "diag" and max_classes is not None or kind == "lrm" and min_prob is not None:
        raise ValueError(f"records of kind {kind} with max_classes {max_classes} and min_prob {min_prob}")
    columns = ["example_id", "indices", "values", "pef_norm", "label", "logits"]
    more = {"diag": [], "lrm": ["col_offsets"], "lvrm": ["rank", "col_sizes"]}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                part = b.slice(lo, 16)
                z, g = grad_fn(_features(part.column(2)))
                p = _probabilities(z)
                n, c, size = g.shape
                if kind == "diag":
                    v = np.einsum("nc,ncj->nj", p if min_prob is None else np.where(p >= min_prob, p, 0.0), g * g)
                    at, norm, own = top_k(v, k), np.sqrt((v * v).sum(1)), []
                    kept, param = [*np.take_along_axis(v, at, 1)], [*at]
                else:
                    a = np.sqrt(p)[:, :, None] * g
                    rank = np.full(n, c)
                    if kind == "lvrm" or max_classes is not None:
                        order = np.argsort(-p, axis=1, kind="stable")[:, :max_classes]
                        a, q = np.take_along_axis(a, order[:, :, None], 1), np.take_along_axis(p, order, 1)
                        rank = (q >= (min_prob if min_prob is not None else 0.0)).sum(1)
                        a[np.arange(a.shape[1]) >= rank[:, None]] = 0.0
                    gram = np.einsum("ncj,nkj->nck", a, a)
                    norm, flat = np.sqrt((gram * gram).sum((1, 2))), a.reshape(n, -1)
                    # factors beyond an example's rank come last and are no entries
                    size_of = np.abs(flat)
                    size_of[np.arange(flat.shape[1]) >= rank[:, None] * size] = -1.0
                    at = [np.sort(x[: min(k, r * size)]) for x, r in zip(top_k(size_of, k), rank, strict=True)]
                    kept, param = [f[x] for f, x in zip(flat, at, strict=True)], [x % size for x in at]
                    if kind == "lrm":
                        own = [_ragged([np.searchsorted(x // size, np.arange(r + 1)) for x, r in zip(at, rank, strict=True)], pa.int32())]
                    else:
                        own = [pa.array(rank, pa.int32()), _ragged([np.bincount(x // size, minlength=r) for x, r in zip(at, rank, strict=True)], pa.int32())]
                yield pa.record_batch([part.column(0), _ragged(param, pa.int64()), _ragged(kept, pa.float64()), pa.array(norm), part.column(1), _lists(z), *own], columns + more)

    schema = "example_id long, indices array<long>, values array<double>, pef_norm double, label int, logits array<double>" + "".join({"rank": ", rank int"}.get(m, f", {m} array<int>") for m in more)
    return examples.select(F.col("example_id").cast("long"), F.col("label").cast("int"), F.col("features").cast("array<double>")).mapInArrow(run, schema)


#: Entries of a task's vector that go out in one batch.
RANGE = 1 << 16


def summed_gradients(examples: DataFrame, grad_fn: GradFn, what: str, min_prob: float | None = None, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """(param_index, total) over all examples, without parameters of zeros alone: of the expected grad ** 2 (what "expected"), of that of one
    class drawn for each example ("sampled": by a hash of seed and example_id, or by ``draw``, a number in [0, 1)), or of the gradient of
    the label's class ("label"). Each task adds into one vector of the model's size; only that leaves it, range by range."""
    u = draw if draw is not None else F.pmod(F.xxhash64(F.lit(seed), F.col("example_id").cast("long")), F.lit(1 << 53)).cast("double") / float(1 << 53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                part = b.slice(lo, 16)
                z, g = grad_fn(_features(part.column(0)))
                p, row = _probabilities(z), np.arange(len(z))
                if what == "expected":
                    one = np.einsum("nc,ncj->j", p if min_prob is None else np.where(p >= min_prob, p, 0.0), g * g)
                elif what == "sampled":
                    own = np.minimum((np.cumsum(p, 1) <= part.column(2).to_numpy()[:, None]).sum(1), p.shape[1] - 1)
                    one = (g[row, own] ** 2).sum(0)
                else:
                    one = g[row, part.column(1).to_numpy()].sum(0)
                total = one if total is None else total + one
        if total is not None:
            for lo in range(0, len(total), RANGE):
                at = lo + np.flatnonzero(total[lo : lo + RANGE])
                yield pa.record_batch([pa.array(at), pa.array(total[at])], ["param_index", "total"])

    if what not in ("expected", "sampled", "label"):
        raise ValueError(what)
    rows = examples.select(F.col("features").cast("array<double>"), (F.col("label") if what == "label" else F.lit(0)).cast("int").alias("label"), u.cast("double").alias("u"))
    return rows.mapInArrow(run, "param_index long, total double").groupBy("param_index").agg(F.sum("total").alias("total"))


def dsf_of(examples: DataFrame, grad_fn: GradFn, n: int, what: str = "expected", **how) -> DataFrame:
    """(param_index, fisher): the data set's Fisher, expected or sampled, as the mean over n examples (``summed_gradients``)."""
    return summed_gradients(examples, grad_fn, what, **how).select("param_index", (F.col("total") / n).alias("fisher"))
