"""Factorisations of the matrix of Fisher records.

The matrix is (example_id, class_id, col, value), coefficients are (example_id, w ARRAY) for every example of a header, also those without
entries, and dictionaries are (col, h ARRAY). The matrix is kept in blocks of about as many entries each, by col and by example
(``blocks``), so that each step moves only dense rows and partial sums of length r, and no hot column makes a long task. Gram matrices are summed in
the tasks first; r x r matrices are all that reaches the driver. Each step's factors are written to the shared folder and those of the step before are
removed. A fit that is given a folder (``log``) notes its steps there; called again with the same matrix and parameters after its driver was lost, it goes on after the step
noted last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pefloom.functions.arrays import vector_sum
from pefloom.operators.blocks import Layout, lists_of, matrix_of
from pefloom.operators.matrix import sq_norm, tr_xx
from pefloom.plans.lineage import Steps, cut, release
from pefloom.sources.tables import Kind, check_agreement

TINY = 1e-12


# Helpers: rows of vectors as matrices, in the tasks.


def map_rows(df: DataFrame, key: str, inputs: list[str], f: Callable[..., np.ndarray], out: str) -> DataFrame:
    """(key, out): f over the matrices made of the array columns ``inputs``, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), lists_of(f(*(matrix_of(c) for c in b.columns[1:])))], [key, out])

    return df.select(key, *inputs).mapInArrow(run, f"{key} long, {out} array<double>")


def gram(df: DataFrame, column: str, r: int) -> np.ndarray:
    """The r x r sum over rows of the outer products of the array column with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r, r))
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0))
                total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(r)), lists_of(total)], ["i", "v"])

    rows = df.select(column).mapInArrow(run, "i long, v array<double>").groupBy("i").agg(vector_sum("v", r).alias("v")).collect()
    out = np.zeros((r, r))
    for row in rows:
        out[row.i] = row.v
    return out


def dot(df: DataFrame, a: str, b: str) -> float:
    """The sum over rows of the inner products of two array columns."""
    return df.agg(F.sum(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))).first()[0] or 0.0


# F16: starting values, seeded by key, whatever the partitioning.


def uniform(seed: int, *keys: Column | str) -> Column:
    """A hash of the keys as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


def init_factors(keys: DataFrame, key: str, r: int, out: str, kind: str = "uniform", seed: int = 0, scale: float = 1.0) -> DataFrame:
    """(key, out) for the distinct keys: uniform in [0, scale), normal with deviation ``scale``, lcg (((7 key + 3 k) mod 11 + 1) / 11 * scale) or const."""
    if kind == "uniform":
        one = lambda k: uniform(seed, F.col(key), F.lit(k)) * scale
    elif kind == "normal":
        one = lambda k: F.sqrt(-2 * F.log(1 - uniform(seed, F.col(key), F.lit(k)))) * F.cos(2 * np.pi * uniform(seed + 1, F.col(key), F.lit(k))) * scale
    elif kind == "lcg":
        one = lambda k: ((F.col(key) * 7 + 3 * k) % 11 + 1) / 11.0 * scale
    elif kind == "const":
        one = lambda k: F.lit(float(scale))
    else:
        raise ValueError(kind)
    return keys.select(F.col(key).cast("long").alias(key), F.array(*map(one, range(r))).alias(out))


def warm_start(start: DataFrame, given: DataFrame, key: str, out: str) -> DataFrame:
    """``start`` with the vectors of ``given`` (key, out) where it has the key."""
    return start.join(given.select(key, F.col(out).alias("given_")), key, "left").select(key, F.coalesce("given_", out).alias(out))


class Matrix:
    """The matrix in blocks by col and by example, with its header of examples and its columns. A layout is made when it is first used."""

    def __init__(self, a: DataFrame, header: DataFrame | None = None, columns: DataFrame | None = None):
        a = a if "class_id" in a.columns else a.withColumn("class_id", F.lit(0))
        self.a = cut(a.select(F.col("example_id").cast("long"), F.col("class_id").cast("int"), F.col("col").cast("long"), F.col("value").cast("double")))
        self.header = cut((header if header is not None else self.a).select(F.col("example_id").cast("long")).distinct())
        self.columns = cut((columns if columns is not None else self.a).select(F.col("col").cast("long")).distinct())

    @cached_property
    def by_col(self) -> Layout:
        return Layout(self.a, "col")

    @cached_property
    def by_row(self) -> Layout:
        return Layout(self.a, "example_id")

    def release(self) -> None:
        """Drops the layouts and the copies of the inputs; nothing may read the matrix after that."""
        for name in ("by_col", "by_row"):
            if name in self.__dict__:
                self.__dict__[name].release()
        for df in (self.a, self.header, self.columns):
            release(df)

    def times(self, h: DataFrame, r: int) -> DataFrame:
        """(example_id, class_id, ah): the product of the matrix with a dictionary (col, h)."""
        return self.by_col.product(h.select("col", "h"), "h", r, "ah")

    def transposed(self, rows: DataFrame, r: int) -> DataFrame:
        """(col, wa): the product of the transposed matrix with (example_id, x) or (example_id, class_id, x) rows."""
        return self.by_row.product(rows.select(*(c for c in ("example_id", "class_id", "x") if c in rows.columns)), "x", r, "wa")


def _with(rows: DataFrame, more: DataFrame, key: str, column: str, r: int) -> DataFrame:
    """``rows`` left-joined with (key, column), zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0), r)
    return rows.join(more.select(key, column), key, "left").withColumn(column, F.coalesce(column, zero))


def _multiply(rows: DataFrame, key: str, column: str, num: str, square: np.ndarray, eps: float, moving: int | None = None) -> DataFrame:
    """A multiplicative step: x *= num / (x square + eps), of the first ``moving`` entries or all."""

    def step(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        new = x * n / (x @ square + eps)
        if moving is not None:
            new[:, moving:] = x[:, moving:]
        return new

    return map_rows(rows, key, [column, num], step, column)


def _finite(loss: float) -> float:
    if not np.isfinite(loss):
        raise FloatingPointError("the factorisation diverged; use a smaller learning rate")
    return loss


# diagonal factorisation.


def fit_d(a: DataFrame, r: int, max_iter: int, eps: float = 1e-8, init: str = "uniform", seed: int = 0, init_w: DataFrame | None = None, init_h: DataFrame | None = None, log_every: int = 10, header: DataFrame | None = None, l1: float | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """(W, H, losses) with A ~ W H, both non-negative: multiplicative steps, W first, then H with the new W. ``l1`` projects W to that L1
    norm (and L2 norm 1) by component after its step (F2)."""
    m, steps = Matrix(a, header), Steps(a.sparkSession, log, fit="diagonal", r=r, eps=eps, init=init, seed=seed, l1=l1)
    if (noted := steps.last()) is not None:
        done, (w, h), losses = noted[0], (noted[1]["w"], noted[1]["h"]), noted[2]
    else:
        w, h = init_factors(m.header, "example_id", r, "w", init, seed), init_factors(m.columns, "col", r, "h", init, seed + 1)
        w = steps.keep("w", w if init_w is None else warm_start(w, init_w, "example_id", "w"))
        h = steps.keep("h", h if init_h is None else warm_start(h, init_h, "col", "h"))
        done, losses = 0, []
    square = sq_norm(m.a)
    for step in range(done + 1, max_iter + 1):
        w = steps.keep("w", _multiply(_with(w, m.times(h, r), "example_id", "ah", r), "example_id", "w", "ah", gram(h, "h", r), eps))
        if l1 is not None:
            w = steps.keep("w", hoyer_project(w, r, l1))
        wa = steps.keep("wa", m.transposed(w.withColumnRenamed("w", "x"), r))
        ww = gram(w, "w", r)
        h = steps.keep("h", _multiply(_with(h, wa, "col", "wa", r), "col", "h", "wa", ww, eps))
        if step % log_every == 0 or step == max_iter:
            losses.append((step, _finite(loss_d(square, ww, gram(h, "h", r), dot(h.join(wa, "col"), "h", "wa")))))
        steps.finish(step, ["w", "h"], losses)
    m.release()
    return w, h, losses


def loss_d(square: float, ww: np.ndarray, hh: np.ndarray, cross: float) -> float:
    """sqrt(|A|^2 + <W^T W, H H^T> - 2 <W^T A, H>)."""
    return float(np.sqrt(max(0.0, square + (ww * hh).sum() - 2 * cross)))


def coefficients(num: DataFrame, square: np.ndarray, start: DataFrame, iters: int, eps: float, log_every: int = 25) -> DataFrame:
    """(example_id, w, logged): all multiplicative steps of each row in its task; logged holds its parts of the loss, every log_every steps and last."""
    r = len(square)
    steps = sorted({*range(log_every, iters + 1, log_every), iters} - {0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, n, logged = matrix_of(b.column(1)), matrix_of(b.column(2)), []
                for step in range(1, iters + 1):
                    x = x * n / (x @ square + eps)
                    if step in steps:
                        logged.append(((x @ square) * x).sum(1) - 2 * (x * n).sum(1))
                yield pa.record_batch([b.column(0), lists_of(x), lists_of(np.stack(logged, 1) if logged else np.zeros((len(x), 0)))], ["example_id", "w", "logged"])

    return _with(start, num, "example_id", "num", r).select("example_id", "w", "num").mapInArrow(run, "example_id long, w array<double>, logged array<double>")


def fit_coeffs_d(a: DataFrame, h: DataFrame, r: int, max_iter: int, eps: float = 1e-7, init: str = "uniform", seed: int = 0, header: DataFrame | None = None, kinds: tuple[Kind, Kind] | None = None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(W, losses) against a frozen dictionary: one join and sum, then steps within the rows (F3). ``kinds`` of records and dictionary are compared first."""
    if kinds:
        check_agreement(*kinds)
    m = Matrix(a, header, h)
    num = m.times(h, r).groupBy("example_id").agg(vector_sum("ah", r).alias("num"))
    got = cut(coefficients(num, gram(h, "h", r), init_factors(m.header, "example_id", r, "w", init, seed), max_iter, eps))
    losses = _summed(got, max_iter, sq_norm(m.a), root=True)
    m.release()
    return got.select("example_id", "w"), losses


def _summed(got: DataFrame, iters: int, constant: float, root: bool, log_every: int = 25) -> list[tuple[int, float]]:
    steps = sorted({*range(log_every, iters + 1, log_every), iters} - {0})
    if not steps:
        return []
    total = got.agg(vector_sum("logged", len(steps)).alias("t")).first()[0]
    return [(s, _finite(float(np.sqrt(max(0.0, constant + (t or 0.0)))) if root else constant + (t or 0.0))) for s, t in zip(steps, total, strict=True)]


# Low-rank factorisation A_i A_i^T ~ sum_k W_ik g_k g_k^T; classes are keys, so fixed and variable ranks are the same.


def squared_by_example(ag: DataFrame, r: int) -> DataFrame:
    """(example_id, num): sums over classes of the squared products."""
    return ag.groupBy("example_id").agg(F.array(*(F.sum(F.col("ah")[k] * F.col("ah")[k]) for k in range(r))).alias("num"))


def loss_lrm(constant: float, ww: np.ndarray, gg: np.ndarray, cross: float) -> float:
    """tr_xx + <W^T W, (G G^T)^2> - 2 <W, num>."""
    return float(constant + (ww * gg * gg).sum() - 2 * cross)


class LowRank:
    """The state of a low-rank fit: the matrix, W, G and what both steps share, A G^T and G G^T. ``start`` gives (W, G) where ``steps`` hold none."""

    def __init__(self, m: Matrix, r: int, steps: Steps, start: Callable[[], tuple[DataFrame, DataFrame]]):
        self.m, self.r, self.steps = m, r, steps
        self.constant = tr_xx(self.m.a)
        self.done, self.losses = 0, []
        if (noted := steps.last()) is not None:
            self.done, own, self.losses = noted
            self.w, self.g, self.ag = own["w"], own["h"], own["ag"]
            self.gg = gram(self.g, "h", r)
        else:
            w, g = start()
            self.w = steps.keep("w", w)
            self.set_g(g)

    def set_g(self, g: DataFrame) -> None:
        self.g = self.steps.keep("h", g)
        self.ag = self.steps.keep("ag", self.m.times(self.g, self.r))
        self.gg = gram(self.g, "h", self.r)

    def run(self, phases: list[tuple[str, int, Callable[[], None]]], log_every: int) -> None:
        """All steps of the phases (name in the log, number of steps, step) that aren't done; steps count on over the phases in the folder."""
        before = 0
        for phase, iters, step in phases:
            for i in range(max(1, self.done - before + 1), iters + 1):
                step()
                if i % log_every == 0 or i == iters:
                    self.losses.append((phase, i, self.loss()))
                self.steps.finish(before + i, ["w", "h", "ag"], self.losses)
            before += iters
        self.m.release()

    def w_step(self, eps: float, moving: int | None = None) -> None:
        num = squared_by_example(self.ag, self.r)
        self.w = self.steps.keep("w", _multiply(_with(self.w, num, "example_id", "num", self.r), "example_id", "w", "num", self.gg * self.gg, eps, moving))

    def gradient(self, ortho: float = 0.0) -> DataFrame:
        """(col, h, grad): a quarter of the loss's gradient by G, and the regulariser's."""
        r, s = self.r, (gram(self.w, "w", self.r) * self.gg)
        if ortho:
            s = s + ortho * (self.gg - 2.0 / r * np.eye(r))
        weighed = self.ag.join(self.w, "example_id").select("example_id", "class_id", F.zip_with("w", "ah", lambda x, y: x * y).alias("x"))
        both = _with(self.g, self.m.transposed(weighed, r), "col", "wa", r)
        return _gradient(both, s)

    def g_step(self, lr: float, ortho: float = 0.0, moving: int | None = None) -> None:
        def step(h: np.ndarray, grad: np.ndarray) -> np.ndarray:
            new = h - 4 * lr * grad
            if moving is not None:
                new[:, moving:] = h[:, moving:]
            return new

        self.set_g(map_rows(self.gradient(ortho), "col", ["h", "grad"], step, "h"))

    def loss(self) -> float:
        num = _with(self.w, squared_by_example(self.ag, self.r), "example_id", "num", self.r)
        return _finite(loss_lrm(self.constant, gram(self.w, "w", self.r), self.gg, dot(num, "w", "num")))


def _gradient(both: DataFrame, s: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), b.column(1), lists_of(matrix_of(b.column(1)) @ s - matrix_of(b.column(2)))], ["col", "h", "grad"])

    return both.select("col", "h", "wa").mapInArrow(run, "col long, h array<double>, grad array<double>")


def g_scale(r: int, m: int) -> float:
    """The deviation of a random G: 1 / sqrt(r m / 2)."""
    return 1.0 / float(np.sqrt(r * m / 2.0))


def fit_lrm(a: DataFrame, r: int, iters_g_only: int, iters_joint: int, lr: float = 1e-3, lr_g_only: float | None = None, mu_eps: float = 1e-9, ortho: float = 0.0, seed: int = 0, init_w: DataFrame | None = None, init_g: DataFrame | None = None, log_every: int = 10, header: DataFrame | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, int, float]]]:
    """(W, G, losses): steps of G with W fixed, then of W and, with the new W, of G. The products of a joint step serve both."""
    m, first = Matrix(a, header), lr_g_only if lr_g_only is not None else lr
    steps = Steps(a.sparkSession, log, fit="low rank", r=r, iters_g_only=iters_g_only, rates=[first, lr], mu_eps=mu_eps, ortho=ortho, seed=seed)

    def start() -> tuple[DataFrame, DataFrame]:
        g = init_g if init_g is not None else init_factors(m.columns, "col", r, "h", "normal", seed + 1, g_scale(r, max(1, m.columns.count())))
        return init_w if init_w is not None else init_factors(m.header, "example_id", r, "w", "uniform"), g

    fit = LowRank(m, r, steps, start)

    def joint() -> None:
        fit.w_step(mu_eps)
        fit.g_step(lr, ortho)

    fit.run([("g_only", iters_g_only, lambda: fit.g_step(first, ortho)), ("joint", iters_joint, joint)], log_every)
    return fit.w, fit.g, fit.losses


def fit_coeffs_lrm(a: DataFrame, g: DataFrame, r: int, n_iters: int, mu_eps: float = 1e-9, init: str = "uniform", seed: int = 0, header: DataFrame | None = None, kinds: tuple[Kind, Kind] | None = None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(W, losses) against a frozen dictionary (F8, F9). ``kinds`` of records and dictionary are compared first."""
    if kinds:
        check_agreement(*kinds)
    m = Matrix(a, header, g)
    num, gg = squared_by_example(m.times(g, r), r), gram(g, "h", r)
    got = cut(coefficients(num, gg * gg, init_factors(m.header, "example_id", r, "w", init, seed), n_iters, mu_eps))
    losses = _summed(got, n_iters, tr_xx(m.a), root=False)
    m.release()
    return got.select("example_id", "w"), losses


def trim_column_map(column_map: DataFrame, n_cols: int) -> DataFrame:
    """A column map without the surplus entries at its end, for dictionaries saved with fewer columns than their map."""
    return column_map.where(F.col("col") < n_cols)


def expand_dictionary(a: DataFrame, g_frozen: DataFrame, r_frozen: int, r_new: int, iters_g_only: int, iters_new_only: int, iters_joint: int, lr: float = 1e-3, mu_eps: float = 1e-9, seed: int = 0, w_frozen: DataFrame | None = None, init_new: DataFrame | None = None, header: DataFrame | None = None, init_w: DataFrame | None = None, kinds: tuple[Kind, Kind] | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, int, float]]]:
    """(W, G, losses) with r_new components before the frozen ones: steps of the new G, then of the new W and G, then of all W and the
    new G. The frozen dictionary never moves (F10). ``kinds`` of records and dictionary are compared first."""
    if kinds:
        check_agreement(*kinds)
    r, m = r_frozen + r_new, Matrix(a, header, a.select("col").union(g_frozen.select("col")))
    steps = Steps(a.sparkSession, log, fit="expansion", r=[r_new, r_frozen], iters=[iters_g_only, iters_new_only], lr=lr, mu_eps=mu_eps, seed=seed)

    def start() -> tuple[DataFrame, DataFrame]:
        new = init_new if init_new is not None else init_factors(m.columns, "col", r_new, "h", "normal", seed + 1, g_scale(r_new, max(1, m.columns.count())))
        old = _with(new.withColumnRenamed("h", "new_"), g_frozen, "col", "h", r_frozen)
        w = init_w if init_w is not None else init_factors(m.header, "example_id", r, "w", "uniform", seed)
        if w_frozen is not None:
            w = w.join(w_frozen.select("example_id", F.col("w").alias("old_")), "example_id", "left").select("example_id", F.when(F.col("old_").isNotNull(), F.concat(F.slice("w", 1, r_new), "old_")).otherwise(F.col("w")).alias("w"))
        return w, old.select("col", F.concat("new_", "h").alias("h"))

    fit = LowRank(m, r, steps, start)

    def both(moving: int | None) -> None:
        fit.w_step(mu_eps, moving)
        fit.g_step(lr, moving=r_new)

    fit.run([("g_only", iters_g_only, lambda: fit.g_step(lr, moving=r_new)), ("joint", iters_new_only, lambda: both(r_new)), ("joint", iters_joint, lambda: both(None))], 10)
    return fit.w, fit.g, fit.losses


#: R factors that one task stacks; components within so much of the others' span count as dependent.
STACK, DEPENDENT = 16, 1e-13


def triangular(df: DataFrame, column: str, r: int) -> np.ndarray:
    """R of the QR decomposition of the matrix whose rows are the array column, with a diagonal that isn't negative: each task decomposes its own rows,
    then the r x r factors of ``STACK`` tasks are stacked and decomposed again, until one is left."""

    def qr(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((r, r))
        x = np.linalg.qr(np.concatenate(rows), mode="r")
        out[: len(x)] = x
        return out

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            if b.num_rows:
                own = qr([x for x in (own, matrix_of(b.column(0))) if x is not None])
        if own is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), lists_of(own.reshape(1, -1))], ["p", "x"])

    def stacked(t: pa.Table) -> pa.Table:
        at = np.argsort(t.column("p").to_numpy())
        return pa.table({"p": t.column("p").slice(0, 1), "x": lists_of(qr([*matrix_of(t.column("x"))[at].reshape(-1, r, r)]).reshape(1, -1))})

    factors = cut(df.select(column).mapInArrow(local, "p long, x array<double>"))
    while (n := factors.count()) > 1:
        old, factors = factors, cut(factors.groupBy(F.expr(f"p div {STACK}").alias("q")).applyInArrow(stacked, "p long, x array<double>").select(F.expr(f"p div {STACK}").alias("p"), "x"))
        release(old)
    if not n:
        return np.eye(r)
    out = np.array(factors.first().x).reshape(r, r)
    return out * np.where(np.diag(out) < 0, -1.0, 1.0)[:, None]


def orthonormalize(g: DataFrame, r: int, seed: int = 0) -> DataFrame:
    """G (col, h) with orthonormal components that span what the first ones span, by tall-skinny QR: twice, as the first pass leaves an error of
    the condition. A component that depends on those before it is taken by a random one, seeded by col."""
    g = cut(g)
    found = triangular(g, "h", r)
    bad = np.abs(np.diag(found)) <= DEPENDENT * np.maximum(np.linalg.norm(found, axis=0), TINY)
    if bad.any():
        drawn = init_factors(g, "col", r, "new_", "normal", seed + 7)
        keep = F.array(*(F.lit(not b) for b in bad.tolist()))
        g = cut(g.join(drawn, "col").select("col", F.zip_with(F.arrays_zip(F.col("h").alias("h"), F.col("new_").alias("n")), keep, lambda x, k: F.when(k, x["h"]).otherwise(x["n"])).alias("h")))
        found = triangular(g, "h", r)
    for last in (False, True):
        inverse = np.linalg.inv(found)
        g = cut(map_rows(g, "col", ["h"], lambda h, inverse=inverse: h @ inverse, "h"))
        found = np.eye(r) if last else triangular(g, "h", r)
    return g


def fit_stiefel(a: DataFrame, r: int, iters: int, lr: float = 1e-3, mu_eps: float = 1e-9, seed: int = 0, init_g: DataFrame | None = None, header: DataFrame | None = None, init_w: DataFrame | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, int, float]]]:
    """(W, G, losses) with G's components kept orthonormal by Cayley steps."""
    m, steps = Matrix(a, header), Steps(a.sparkSession, log, fit="orthonormal", r=r, lr=lr, mu_eps=mu_eps, seed=seed)

    def start() -> tuple[DataFrame, DataFrame]:
        g = init_g if init_g is not None else init_factors(m.columns, "col", r, "h", "normal", seed + 1)
        return init_w if init_w is not None else init_factors(m.header, "example_id", r, "w", "uniform", seed, 2.0 / r), orthonormalize(g, r)

    fit = LowRank(m, r, steps, start)

    def step() -> None:
        fit.w_step(mu_eps)
        both = steps.keep("both", fit.gradient().select("col", "h", F.transform("grad", lambda x: 4 * x).alias("d")))
        all_ = gram(both.select(F.concat("h", "d").alias("v")), "v", 2 * r)
        gg, gd, dd = all_[:r, :r], all_[:r, r:], all_[r:, r:]
        vu = np.block([[gd, gg], [-dd, -gd.T]])
        x = np.linalg.solve(np.eye(2 * r) + lr / 2 * vu, np.concatenate([gg, -gd.T]))
        fit.set_g(map_rows(both, "col", ["h", "d"], lambda h, d: h - lr * (d @ x[:r] + h @ x[r:]), "h"))

    fit.run([("joint", iters, step)], 1)
    return fit.w, fit.g, fit.losses


# projection to given norms.


def hoyer_project(w: DataFrame, r: int, l1: float, l2: float = 1.0) -> DataFrame:
    """W with every component (a column of n entries) moved to the nearest non-negative vector of L1 norm l1 and L2 norm l2.

    The nearest vector keeps the m largest entries, stretched about their mean and moved to the mean l1 / m, and sets the others to zero;
    m is the largest for which the m-th entry stays above zero. One range-partitioned sort of (component, entry) gives counts, sums
    and squares of each task's entries, the second pass over it runs them on and finds each component's m, whatever n is; r
    cuts and a row for each task and component are all that reaches the driver. Where so many entries tie for the largest that they can't have both norms,
they share l1, and the L2 norm is less.
    """
    cells = w.select("example_id", F.posexplode("w").alias("k", "x"))
    tasks = int(w.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k", F.desc("x"), "example_id"]
    cells = cut(cells.repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    local = cells.groupBy(F.spark_partition_id().alias("p"), "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()
    if not local:
        return w
    before = {(row.p, row.k): np.sum([[t.n, t.s, t.q] for t in local if t.k == row.k and t.p < row.p] or [[0, 0, 0]], axis=0).tolist() for row in local}

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, run = TaskContext.get().partitionId(), {}
        for b in batches:
            key, x = b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in np.unique(key).tolist():
                v = x[key == k]
                n0, s0, q0 = run.get(k, before.get((p, k), [0, 0, 0]))
                m, s, q = n0 + np.arange(1, len(v) + 1), s0 + np.cumsum(v), q0 + np.cumsum(v * v)
                run[k] = [m[-1], s[-1], q[-1]]
                grow = _stretch(m, s, q, l1, l2)
                at = np.flatnonzero((m * l2 * l2 >= l1 * l1 * (1 - 1e-12)) & (l1 / m + grow * (v - s / m) > 0))
                if len(at):
                    yield pa.record_batch([pa.array([k], pa.int32()), *(pa.array([float(y[at[-1]])]) for y in (m, s, q))], ["k", "m", "s", "q"])

    found = cells.mapInArrow(cuts, "k int, m double, s double, q double").groupBy("k").agg(F.max(F.struct("m", "s", "q")).alias("c")).collect()
    release(cells)
    if len(found) < r:
        raise ValueError(f"no vector of so few entries has an L1 norm of {l1} and an L2 norm of {l2}")
    m, s, q = (np.array([row.c[i] for row in sorted(found, key=lambda row: row.k)]) for i in range(3))
    grow = _stretch(m, s, q, l1, l2)

    def moved(x: np.ndarray) -> np.ndarray:
        tied = np.abs(x - s / m) <= 1e-9 * np.maximum(np.abs(s / m), 1.0)
        return np.where(grow > 0, np.maximum(l1 / m + grow * (x - s / m), 0.0), np.where(tied, l1 / m, 0.0))

    return map_rows(w, "example_id", ["w"], moved, "w")


def _stretch(m: np.ndarray, s: np.ndarray, q: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """By what m entries of sum s and squares q are stretched about their mean to have the L2 norm l2 at the mean l1 / m."""
    spread = q - s * s / m
    return np.where(spread > 1e-12 * np.maximum(q, TINY), np.sqrt(np.maximum(l2 * l2 - l1 * l1 / m, 0.0) / np.maximum(spread, 1e-300)), 0.0)


# scaling components.


def component_norms(h: DataFrame, r: int) -> np.ndarray:
    """The L2 norms of the r components."""
    total = h.agg(F.array(*(F.sum(F.col("h")[k] * F.col("h")[k]) for k in range(r))).alias("q")).first()[0]
    return np.sqrt(np.array([x or 0.0 for x in total]))


def _scaled(df: DataFrame, key: str, column: str, factors: np.ndarray) -> DataFrame:
    by = F.array(*map(F.lit, factors.tolist()))
    return df.select(key, F.zip_with(column, by, lambda x, c: x * c).alias(column))


def sparsify_dictionary(w: DataFrame, h: DataFrame, r: int, t: float) -> tuple[DataFrame, DataFrame]:
    """(W, (component, col, value)): components scaled to norm 1, W inversely, and the entries of value >= t kept."""
    norms = component_norms(h, r)
    cells = _scaled(h, "col", "h", 1 / (norms + TINY)).select("col", F.posexplode("h").alias("component", "value")).where(F.col("value") >= t)
    return _scaled(w, "example_id", "w", norms), cells.select("component", "col", "value")


def normalize_lrm_components(w: DataFrame, g: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
    """(W, G) with components of norm 1 and W multiplied by the squared norms, so that w g g^T stays."""
    norms = component_norms(g, r)
    return _scaled(w, "example_id", "w", norms * norms + TINY), _scaled(g, "col", "h", 1 / (norms + TINY))


def losses_frame(spark, losses: list[tuple]) -> DataFrame:
    """(phase, step, loss) of a fit's log."""
    rows = [(x if len(x) == 3 else ("fit", *x)) for x in losses]
    return spark.createDataFrame([(p, int(s), float(v)) for p, s, v in rows], "phase string, step int, loss double")
