"""Hand-written matrices for the matrix preparation."""

from __future__ import annotations

import pytest

from pefloom.operators import matrix as M
from pefloom.sources import tables as S

A = [(0, 0, 1.0), (0, 3, -4.0), (1, 1, 2.0), (1, 3, -0.5), (2, 1, 4.0), (2, 3, -0.5)]


def long(spark, rows):
    return spark.createDataFrame([(r, 0, c, v) for r, c, v in rows], "example_id long, class_id int, param_index long, value double")


@pytest.mark.parametrize(
    ("rows", "least", "columns", "cells"),
    [
        (A, 1, [0, 1, 3], {(0, 0, 1.0), (0, 2, -4.0), (1, 1, 2.0), (1, 2, -0.5), (2, 1, 4.0), (2, 2, -0.5)}),
        (A, 2, [1, 3], {(0, 1, -4.0), (1, 0, 2.0), (1, 1, -0.5), (2, 0, 4.0), (2, 1, -0.5)}),
        (A, 3, [3], {(0, 0, -4.0), (1, 0, -0.5), (2, 0, -0.5)}),
        ([(0, 0, 1.0), (0, 3, -4.0), (1, 2, 1.0), (1, 4, 0.5), (2, 1, 4.0), (2, 3, -0.5)], 2, [3], {(0, 0, -4.0), (2, 0, -0.5)}),
        ([], 1, [], set()),
    ],
)
def test_prune(spark, rows, least, columns, cells):
    out, column_map = M.prune_columns(long(spark, rows), least)
    assert [r.param_index for r in column_map.orderBy("col").collect()] == columns
    assert {(r.example_id, r.col, r.value) for r in out.collect()} == cells


def test_prune_keeps_forced_columns(spark):
    force = spark.createDataFrame([(0,), (7,)], "param_index long")
    _, column_map = M.prune_columns(long(spark, A), 3, force)
    assert [r.param_index for r in column_map.orderBy("col").collect()] == [0, 3, 7]


ROWS = [(0, [0, 8, 9], [1.0, 2.0, 3.0], [0, 0, 3]), (1, [4, 4, 7], [4.0, 5.0, 6.0], [0, 1, 3]), (2, [6, 9, 0], [7.0, 8.0, 9.0], [0, 2, 3]), (3, [1, 2, 3], [-1.0, -2.0, -3.0], [0, 3, 3])]


def test_records_to_long(spark):
    df = spark.createDataFrame(ROWS, "example_id long, indices array<long>, values array<double>, col_offsets array<int>")
    want = {(0, 1, 0, 1.0), (0, 1, 8, 2.0), (0, 1, 9, 3.0), (1, 0, 4, 4.0), (1, 1, 4, 5.0), (1, 1, 7, 6.0), (2, 0, 6, 7.0), (2, 0, 9, 8.0), (2, 1, 0, 9.0), (3, 0, 1, -1.0), (3, 0, 2, -2.0), (3, 0, 3, -3.0)}
    got = lambda d, **k: {(r.example_id, r.class_id, r.param_index, r.value) for r in M.pefs_to_long(d, **k).collect()}
    assert got(df) == want
    sizes = spark.createDataFrame([(i, x, v, [b - a for a, b in zip(o, o[1:], strict=False)]) for i, x, v, o in ROWS], "example_id long, indices array<long>, values array<double>, col_sizes array<int>")
    assert got(sizes) == want
    legacy = spark.createDataFrame([(i, x, v, [0, *(b - a for a, b in zip(o, o[1:], strict=False))]) for i, x, v, o in ROWS], df.schema)
    assert got(legacy, legacy_offsets=True) == want
    with pytest.raises(ValueError):
        S.flavour(df.drop("values"))


def test_validation(spark):
    good = spark.createDataFrame([(0, 0, 1.5), (0, 3, -2.3), (1, 0, 1.0), (1, 1, 4.0), (1, 2, -4.0), (1, 3, 1.0)], "example_id long, col long, value double")
    assert M.validate_matrix(good, 2, 4).count() == 0
    bad = good.union(spark.createDataFrame([(0, -3, 1.0), (0, 4, 1.0), (9, 1, 1.0), (1, 1, 2.0)], good.schema))
    assert sorted(r.violation for r in M.validate_matrix(bad, 2, 4).collect()) == ["column out of range", "column out of range", "repeated entry", "row out of range"]
    offsets = [(0, [0, 2, 6]), (1, [1, 2, 6]), (2, [0, 2, 5]), (3, [0, 2, 4, 3, 6])]
    rows = spark.createDataFrame([(i, o, [0.0] * 6) for i, o in offsets], "example_id long, col_offsets array<int>, values array<double>")
    assert sorted((r.example_id, r.violation) for r in M.validate_offsets(rows).collect()) == [(1, "start"), (2, "end"), (3, "fall")]


def test_threshold(spark):
    dense = spark.createDataFrame([(0, [1.0, 0.0, -4.0]), (1, [0.0, 2.0, -0.5])], "row long, values array<double>")
    cells = lambda t, mode="abs_gt": sorted((r.row, r.col, r.value) for r in M.threshold_to_sparse(dense, t, mode).collect())
    assert cells(0.0) == [(0, 0, 1.0), (0, 2, -4.0), (1, 1, 2.0), (1, 2, -0.5)]
    assert cells(3.0) == [(0, 2, -4.0)]
    assert cells(2.0, "ge") == [(1, 1, 2.0)]


def test_norm_constants(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 2.0), (0, 1, 1, 3.0)], "example_id long, class_id int, col long, value double")
    assert M.tr_xx(a) == pytest.approx(1 + 2 * 4 + 13**2)
    assert M.tr_xx(a, legacy=True) == pytest.approx(2 * (1 + 8 + 169) + 170)
    assert M.sq_norm(a) == 14.0
    norms = spark.createDataFrame([(0, 0.0)], "example_id long, pef_norm double")
    assert sorted(x.value for x in M.normalize_d(a, norms).collect()) == pytest.approx([1e9, 2e9, 3e9], rel=1e-3)
    assert M.normalize_lrm(a, norms).count() == 3


def test_number_rows_is_dense(spark):
    got = S.number_rows(spark.createDataFrame([(x * 7 % 101,) for x in range(101)], "k long").repartition(5), ["k"], "n").orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [(x, x) for x in range(101)]
