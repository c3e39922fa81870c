"""Preparing the matrix of Fisher records (M1-M10): long form, pruning and re-indexing, norms, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.operators.pefs import gram_squares
from pefloom.sources.tables import flavour, number_rows


def pefs_to_long(pefs: DataFrame, legacy_offsets: bool = False) -> DataFrame:
    """(example_id, class_id, param_index, value) of records in row form. ``legacy_offsets``: col_offsets holds sizes after its first entry."""
    kind = flavour(pefs)
    own = F.posexplode(F.arrays_zip("indices", "values")).alias("pos", "e")
    if kind == "diag":
        return pefs.select("example_id", own).select("example_id", F.lit(0).alias("class_id"), F.col("e.indices").alias("param_index"), F.col("e.values").alias("value"))
    sizes = F.col("col_sizes") if kind == "lvrm" else F.slice("col_offsets", 2, F.greatest(F.size("col_offsets") - 1, F.lit(1)))
    if kind == "lvrm" or legacy_offsets:
        sizes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1))), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda s, x: s + x))
    rows = pefs.select("example_id", sizes.alias("ends"), own)
    class_id = F.size(F.filter("ends", lambda e: e <= F.col("pos")))
    return rows.select("example_id", class_id.alias("class_id"), F.col("e.indices").alias("param_index"), F.col("e.values").alias("value"))


def prune_columns(a: DataFrame, min_nnz: int = 1, force_keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matrix with col, map (col, param_index)): parameters with fewer than min_nnz stored entries go, unless listed in ``force_keep``
    (param_index); the others are numbered from 0 by rising index."""
    kept = a.groupBy("param_index").agg(F.count("*").alias("nnz")).where(F.col("nnz") >= min_nnz).select("param_index")
    if force_keep is not None:
        kept = kept.union(force_keep.select("param_index")).distinct()
    column_map = number_rows(kept, ["param_index"], "col").select("col", "param_index")
    return retain_columns(a, column_map), column_map


def retain_columns(a: DataFrame, column_map: DataFrame) -> DataFrame:
    """The entries whose parameter is in ``column_map``, with its col instead."""
    return a.join(column_map, "param_index").drop("param_index")


def normalize_d(a: DataFrame, norms: DataFrame, eps: float = 1e-9) -> DataFrame:
    """value / (pef_norm + eps); norms is (example_id, pef_norm)."""
    return a.join(norms.select("example_id", "pef_norm"), "example_id").withColumn("value", F.col("value") / (F.col("pef_norm") + eps)).drop("pef_norm")


def normalize_lrm(a: DataFrame, norms: DataFrame, eps: float = 1e-12) -> DataFrame:
    """value / max(sqrt(pef_norm), eps), as the record is A A^T; eps 1e-12 for fixed, 1e-6 for variable rank."""
    return a.join(norms.select("example_id", "pef_norm"), "example_id").withColumn("value", F.col("value") / F.greatest(F.sqrt("pef_norm"), F.lit(eps))).drop("pef_norm")


def tr_xx(a: DataFrame, legacy: bool = False) -> float:
    """The sum over examples of the squared inner products of class factors; ``legacy`` adds it once more, and the diagonal again."""
    all_, own = gram_squares(a, "col").agg(F.sum("squares"), F.sum("own")).first()
    return (2 * all_ + own if legacy else all_) if all_ is not None else 0.0


def sq_norm(a: DataFrame) -> float:
    return a.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0


def matrix_stats(a: DataFrame, column: str = "param_index") -> DataFrame:
    """One row: n_rows, n_cols, nnz, density. Rows are the examples with entries."""
    stats = a.agg(F.count_distinct("example_id").alias("n_rows"), F.count_distinct(column).alias("n_cols"), F.count("*").alias("nnz"))
    return stats.withColumn("density", F.col("nnz") / (F.col("n_rows") * F.col("n_cols")))


def validate_matrix(a: DataFrame, n_rows: int, n_cols: int, row: str = "example_id", column: str = "col") -> DataFrame:
    """(violation, row, col) of entries outside the matrix and of entries stored more than once."""
    out = a.select(F.when((F.col(column) < 0) | (F.col(column) >= n_cols), "column out of range").when((F.col(row) < 0) | (F.col(row) >= n_rows), "row out of range").alias("violation"), F.col(row).alias("row"), F.col(column).alias("col")).where("violation IS NOT NULL")
    twice = a.groupBy(F.col(row).alias("row"), F.col(column).alias("col")).count().where("count > 1").select(F.lit("repeated entry").alias("violation"), "row", "col")
    return out.unionByName(twice)


def validate_offsets(rows: DataFrame, offsets: str = "col_offsets", values: str = "values") -> DataFrame:
    """(example_id, violation) of offset arrays that don't start at 0, end elsewhere than at the number of values, or fall."""
    o = F.col(offsets)
    fall = F.exists(F.zip_with(F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(1))), F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(1))), lambda x, y: y < x), lambda x: F.coalesce(x, F.lit(False)))
    found = F.filter(F.array(F.when(F.element_at(o, 1) != 0, "start"), F.when(F.element_at(o, -1) != F.size(values), "end"), F.when(fall, "fall")), lambda x: x.isNotNull())
    return rows.select("example_id", F.explode(found).alias("violation"))


def threshold_to_sparse(dense: DataFrame, t: float = 0.0, mode: str = "abs_gt") -> DataFrame:
    """(row, col, value) of a table (row, values ARRAY): entries of abs(value) > t, or of value >= t with mode 'ge'."""
    cells = dense.select("row", F.posexplode("values").alias("col", "value")).withColumn("col", F.col("col").cast("long"))
    return cells.where(F.abs("value") > t if mode == "abs_gt" else F.col("value") >= t)
