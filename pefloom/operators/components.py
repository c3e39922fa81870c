"""Reading components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pefloom.functions.arrays import argmax
from pefloom.operators.factorize import TINY, gram, map_rows
from pefloom.sources.tables import first_rows


def select_components(df: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of the listed components; all without a list."""
    return df if ids is None else df.where(F.col("component").isin(list(ids)))


def top_examples(w: DataFrame, k: int, components: Sequence[int] | None = None) -> DataFrame:
    """(component, rank, example_id, coeff): the k largest coefficients of each component, equal ones by example. The rank filter runs
    before the exchange, so each task sends k rows a component at most."""
    cells = select_components(w.select("example_id", F.posexplode("w").alias("component", "coeff")), components)
    order = Window.partitionBy("component").orderBy(F.desc("coeff"), F.asc("example_id"))
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("component", "rank", "example_id", "coeff")


def describe_top_examples(top: DataFrame, logits: DataFrame, raw: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``top`` with the raw columns, the names of the label and of the predicted class, and the coefficient with four decimals. ``top`` is
    k rows a component, which is what limits it."""
    names = F.array(*map(F.lit, labels))
    joined = top.join(logits.select("example_id", "label", "logits"), "example_id").join(raw, "example_id")
    told = {"label_name": F.try_element_at(names, F.col("label") + 1), "predicted_name": F.try_element_at(names, argmax(F.col("logits")) + 1), "coeff": F.round("coeff", 4)}
    return joined.withColumns(told).drop("label", "logits")


def top_examples_grid(w: DataFrame, n_rows: int, n_cols: int, components: Sequence[int] | None = None) -> DataFrame:
    """(component, row, col, example_id): the top n_rows * n_cols examples in cells, row by row."""
    top = top_examples(w, n_rows * n_cols, components)
    at = F.col("rank") - 1
    return top.select("component", F.floor(at / n_cols).cast("int").alias("row"), (at % n_cols).cast("int").alias("col"), "example_id")


def baseline_examples(df: DataFrame, n: int) -> DataFrame:
    """The first n examples by id."""
    return first_rows(df.select("example_id").distinct(), n)


def component_vector(dictionary: DataFrame, column_map: DataFrame, component: int, n_parameters: int | None = None, normalized: bool = False) -> DataFrame:
    """(param_index, value) of one component by original parameter; with n_parameters zeros fill the rest; normalized to norm 1 on demand.
    Takes dense (col, h) and sparse (component, col, value) dictionaries."""
    dense = "h" in dictionary.columns
    own = dictionary.select("col", F.col("h")[component].alias("value")) if dense else dictionary.where(F.col("component") == component).select("col", "value")
    out = own.join(column_map, "col").select("param_index", "value")
    if normalized:
        norm = out.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 0.0
        out = out.withColumn("value", F.col("value") / (norm + TINY))
    if n_parameters is not None:
        all_ = dictionary.sparkSession.range(n_parameters).withColumnRenamed("id", "param_index")
        out = all_.join(out, "param_index", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return out


def component_similarity(g: DataFrame, r: int) -> DataFrame:
    """(k1, k2, sim): abs(G G^T) of components scaled to norm 1."""
    m = gram(g, "h", r)
    norms = np.sqrt(np.diag(m)) + TINY
    sim = np.abs(m / norms / norms[:, None])
    return g.sparkSession.createDataFrame([(i, j, float(sim[i, j])) for i in range(r) for j in range(r)], "k1 int, k2 int, sim double")


def rejection(m: np.ndarray, k: int, max_sim: float) -> np.ndarray:
    """Coefficients of the rejected component k over all components, from their Gram matrix: its projections on each other component of
    similarity at most max_sim go, one after another in order, and the rest is scaled to norm 1."""
    norms = np.sqrt(np.diag(m)) + TINY
    c = np.zeros(len(m))
    c[k] = 1.0
    for i in range(len(m)):
        if i != k and abs(m[k, i]) / norms[k] / norms[i] <= max_sim:
            c[i] -= (m[i] @ c) / max(m[i, i], TINY)
    return c / (np.sqrt(max(c @ m @ c, 0.0)) + TINY)


def orthogonal_reject(g: DataFrame, r: int, k: int, max_sim: float) -> DataFrame:
    """(col, value): ``rejection`` of component k as one linear combination of the columns."""
    c = rejection(gram(g, "h", r), k, max_sim)
    return map_rows(g, "col", ["h"], lambda h: (h @ c)[:, None], "v").select("col", F.col("v")[0].alias("value"))
