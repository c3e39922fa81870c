"""Evaluating a model and its perturbations (E1-E5, E8-E10). Result tables are (example_id, label, logits, og_logits)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pefloom.functions import arrays as A
from pefloom.operators.factorize import TINY
from pefloom.operators.pefs import GradFn, summed_gradients


def _of(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    return df if ids is None else df.join(ids.select("example_id"), "example_id", "left_semi")


def correct(logits: str = "logits") -> Column:
    return (A.argmax(F.col(logits)) == F.col("label")).cast("double")


def accuracy(df: DataFrame, ids: DataFrame | None = None, logits: str = "logits") -> DataFrame:
    return _of(df, ids).agg(F.avg(correct(logits)).alias("accuracy"))


def cross_entropy(df: DataFrame, ids: DataFrame | None = None, logits: str = "logits") -> DataFrame:
    return _of(df, ids).agg(F.avg(A.cross_entropy(F.col(logits), F.col("label"))).alias("cross_entropy"))


def kl(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The mean KL(softmax(logits), softmax(og_logits))."""
    return _of(df, ids).agg(F.avg(A.kl(F.col("logits"), F.col("og_logits"))).alias("kl"))


def evaluate_perturbations(examples: DataFrame, head: np.ndarray, directions: np.ndarray, magnitude: float) -> DataFrame:
    """(component, sign, example_id, is_top, label, logits, og_logits): the head moved by +/- magnitude along each component's direction, on the
    examples chosen for it. ``examples`` is (component, is_top, example_id, label, features); directions are (r, C, d) and, like the head, of
    the model's size. One pass serves all components and signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            k = b.column(0).to_numpy()
            old = x @ head.T
            move = np.zeros_like(old)
            for c in np.unique(k):
                move[k == c] = x[k == c] @ directions[c].T
            lists = lambda z: pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            for sign in (1, -1):
                yield pa.record_batch([b.column(0), pa.array(np.full(len(k), sign, np.int32)), b.column(2), b.column(1), b.column(3), lists(old + sign * magnitude * move), lists(old)], ["component", "sign", "example_id", "is_top", "label", "logits", "og_logits"])

    rows = examples.select(F.col("component").cast("int"), "is_top", F.col("example_id").cast("long"), F.col("label").cast("int"), F.col("features").cast("array<double>"))
    return rows.mapInArrow(run, "component int, sign int, example_id long, is_top boolean, label int, logits array<double>, og_logits array<double>")


def perturbation_report(results: DataFrame) -> DataFrame:
    """(component, kl_ratio, accuracy, og_accuracy): the larger of both signs' ratio of mean KL on the top examples to that on the baseline,
    and accuracies on the top examples."""
    top = F.col("is_top")
    by_sign = results.groupBy("component", "sign").agg(F.avg(F.when(top, A.kl(F.col("logits"), F.col("og_logits")))).alias("kt"), F.avg(F.when(~top, A.kl(F.col("logits"), F.col("og_logits")))).alias("kb"), F.avg(F.when(top, correct())).alias("acc"), F.avg(F.when(top, correct("og_logits"))).alias("og"))
    return by_sign.groupBy("component").agg(F.max(F.try_divide("kt", "kb")).alias("kl_ratio"), F.max("acc").alias("accuracy"), F.max("og").alias("og_accuracy"))


#: Logits that a task holds at a time for all components (32 MB).
CELLS = 1 << 22


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return np.clip(e / e.sum(-1, keepdims=True), A.CLIP, 1.0)


def summed_report(top: DataFrame, baseline: DataFrame, head: np.ndarray, directions: np.ndarray, magnitude: float) -> DataFrame:
    """The rows of ``perturbation_report`` from sums: the head is moved and the outcomes are added up in the tasks, so a task leaves a row
    for each component and sign it met, and no row is made for each of components x signs x baseline examples.

    ``top`` is (component, example_id, label, features), ``baseline`` (example_id, label, features), each of its examples for all
    components. Rows without features are left out, those without a label count in the divergences alone. A component without top or
    baseline examples, or whose divergence on the baseline is zero for both signs, has no kl_ratio. Components that have neither have no row.
    """
    r, n_classes = len(directions), len(head)
    sums_ = ("kl_top", "n_top", "hits", "og_hits", "n_label", "kl_base", "n_base")
    moves = directions.transpose(2, 0, 1).reshape(directions.shape[2], -1)

    def add(total: np.ndarray, k: np.ndarray, x: np.ndarray, move: np.ndarray, label: np.ndarray, at: int) -> None:
        """Adds the divergences and hits of rows (..., C) to total[component, sign, at:]."""
        old = x @ head.T
        old = np.broadcast_to(old if move.ndim == 2 else old[:, None], move.shape)
        q, known, true = _probabilities(old), label >= 0, label if move.ndim == 2 else label[:, None]
        for i, sign in enumerate((1, -1)):
            new = old + sign * magnitude * move
            p = _probabilities(new)
            parts = [(p * np.log(p / q)).sum(-1), np.ones(move.shape[:-1])]
            if not at:
                parts += [(known & (new.argmax(-1) == true)).astype(float), (known & (old.argmax(-1) == true)).astype(float), known.astype(float)]
            for j, part in enumerate(parts):
                if move.ndim == 2:
                    np.add.at(total[:, i, at + j], k, part)
                else:
                    total[:, i, at + j] += part.sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r, 2, 7))
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy()
            label = b.column(1).to_numpy()
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for c in np.unique(k[k >= 0]):
                own = np.flatnonzero(k == c)
                add(total, k[own], x[own], x[own] @ directions[c].T, label[own], 0)
            base = np.flatnonzero(k < 0)
            few = max(1, CELLS // (r * n_classes))
            for i in range(0, len(base), few):
                part = x[base[i : i + few]]
                add(total, k, part, (part @ moves).reshape(len(part), r, n_classes), label[base[i : i + few]], 5)
        met = np.argwhere((total[:, :, 1] + total[:, :, 6]) > 0)
        rows = total[met[:, 0], met[:, 1]]
        yield pa.record_batch([pa.array(met[:, 0].astype(np.int32)), pa.array(met[:, 1].astype(np.int32)), *(pa.array(rows[:, j].copy()) for j in range(7))], ["component", "sign", *sums_])

    columns = [F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"), F.col("features").cast("array<double>").alias("features")]
    rows = top.select(F.col("component").cast("int").alias("component"), *columns).where("component >= 0").union(baseline.select(F.lit(-1).alias("component"), *columns)).where("features IS NOT NULL")
    sums = rows.mapInArrow(run, "component int, sign int, " + ", ".join(f"{c} double" for c in sums_)).groupBy("component", "sign").agg(*(F.sum(c).alias(c) for c in sums_))
    ratio = F.try_divide(F.try_divide("kl_top", "n_top"), F.try_divide("kl_base", "n_base"))
    return sums.groupBy("component").agg(F.max(ratio).alias("kl_ratio"), F.max(F.try_divide("hits", "n_label")).alias("accuracy"), F.max(F.try_divide("og_hits", "n_label")).alias("og_accuracy"))


def sign_pattern(gradients: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(param_index, sign): the sign of the gradient summed over the given examples."""
    return _of(gradients, ids).groupBy("param_index").agg(F.signum(F.sum("grad")).alias("sign"))


def sign_of(examples: DataFrame, grad_fn: GradFn, ids: DataFrame | None = None) -> DataFrame:
    """(param_index, sign): the sign of the summed gradient of the log-likelihood of the examples' labels, summed up in the tasks."""
    return summed_gradients(_of(examples, ids), grad_fn, "label").select("param_index", F.signum("total").alias("sign"))


def fisher_merge(params: DataFrame, sign: DataFrame, dsf: DataFrame, h: DataFrame, delta: float, lam: float, floor: float = 1e-6, legacy_cap: bool = False) -> DataFrame:
    """(param_index, theta): (w1 theta + w2 (theta - delta s)) / (w1 + w2) with w1 = (1 - lam) f and w2 = lam h; h (param_index, value) and the data
    set's Fisher f are scaled to norm 1 first, and f is held at ``floor`` from below (from above with legacy_cap)."""
    norm = lambda df, c: (df.agg(F.sqrt(F.sum(F.col(c) * F.col(c)))).first()[0] or 0.0) + TINY
    f = dsf.select("param_index", (F.col("fisher") / norm(dsf, "fisher")).alias("f"))
    f = f.withColumn("f", F.least("f", F.lit(floor)) if legacy_cap else F.greatest("f", F.lit(floor)))
    own = h.select("param_index", (F.col("value") / norm(h, "value")).alias("h"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    joined = params.join(f, "param_index", "left").join(own, "param_index", "left").join(sign, "param_index", "left")
    w1, w2 = (1 - lam) * F.coalesce(F.col("f"), F.lit(floor)), lam * zero("h")
    return joined.select("param_index", ((w1 * F.col("theta") + w2 * (F.col("theta") - delta * zero("sign"))) / (w1 + w2)).alias("theta"))


#: A layout of so many variables at most is looked up in the tasks (some 40 MB); a larger one is joined.
LAYOUT_ROWS = 1 << 19


def locate_params(df: DataFrame, layout: DataFrame) -> DataFrame:
    """``df`` with the variable each param_index falls in and its place there, without rows that fall in none; layout is (variable, start, end), a row
    for each variable of the model, and no two overlap.

    Layouts are counted. Up to ``LAYOUT_ROWS`` variables every task looks its rows up in the sorted starts. More are joined by buckets, as wide as a variable on
    average: a variable has a row in each bucket that it reaches, so there are at most twice as many rows as variables.
    """
    own = layout.select(F.col("variable").cast("string"), F.col("start").cast("long"), F.col("end").cast("long")).where("start < end")
    n, low, high = own.agg(F.count("*"), F.min("start"), F.max("end")).first()
    schema = StructType([*df.schema.fields, StructField("variable", StringType()), StructField("local_index", LongType())])
    if n > LAYOUT_ROWS:
        width = max(1, -(-(high - low) // n))
        spread = own.withColumn("bucket_", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
        rows = df.select(F.struct("*").alias("row_"), F.col("param_index").alias("at_")).withColumn("bucket_", F.expr(f"at_ div {width}"))
        met = rows.join(spread, "bucket_").where("at_ >= start AND at_ < end")
        return met.select(*(F.col("row_")[c].alias(c) for c in df.columns), "variable", (F.col("at_") - F.col("start")).alias("local_index"))
    table = own.orderBy("start").toArrow()
    names, start, end = table.column("variable").combine_chunks(), table.column("start").to_numpy(), table.column("end").to_numpy()
    place = df.columns.index("param_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not (n and b.num_rows):
                continue
            asked = b.column(place).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            at = np.searchsorted(start, asked, "right") - 1
            there = np.flatnonzero((at >= 0) & (asked < end[at]))
            rows = b.take(pa.array(there))
            yield pa.record_batch([*rows.columns, names.take(pa.array(at[there])), pa.array(asked[there] - start[at[there]])], schema.names)

    return df.mapInArrow(run, schema)


def params_per_variable(df: DataFrame, layout: DataFrame) -> DataFrame:
    return locate_params(df, layout).groupBy("variable").agg(F.count("*").alias("n_entries"))
