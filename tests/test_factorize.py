"""Factorisations against dense numpy."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pefloom.operators import components as T
from pefloom.operators import factorize as X
from pefloom.operators.blocks import Layout

R = 3


def frame(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a != 0)], "example_id long, col long, value double")


def dense(df, key, column, n):
    out = np.zeros((n, R))
    for r in df.collect():
        out[r[key]] = r[column]
    return out


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(3)
    w, h = r.uniform(size=(20, R)) * (r.uniform(size=(20, R)) < 0.6), r.uniform(size=(R, 15)) * (r.uniform(size=(R, 15)) < 0.5)
    a = w @ h
    return a, frame(spark, a)


def vectors(spark, x, key, column):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, {column} array<double>")


def test_diagonal_fit_follows_the_updates(spark, planted):
    a, df = planted
    r = np.random.default_rng(1)
    w, h = r.uniform(size=(20, R)), r.uniform(size=(15, R))
    header = spark.range(20).withColumnRenamed("id", "example_id")
    got_w, got_h, losses = X.fit_d(df, R, 4, init_w=vectors(spark, w, "example_id", "w"), init_h=vectors(spark, h, "col", "h"), log_every=1, header=header)
    kept = np.flatnonzero((a != 0).any(0))
    h[np.setdiff1d(np.arange(15), kept)] = 0
    want = []
    for _ in range(4):
        w = w * (a @ h) / (w @ (h.T @ h) + 1e-8)
        h = h * (a.T @ w) / (h @ (w.T @ w) + 1e-8)
        want.append(np.linalg.norm(a - w @ h.T))
    assert np.allclose(dense(got_w, "example_id", "w", 20), w) and np.allclose(dense(got_h, "col", "h", 15), h)
    assert np.allclose([x for _, x in losses], want) and all(x >= y - 1e-9 for x, y in zip(want, want[1:], strict=False))
    frozen, logged = X.fit_coeffs_d(df, got_h, R, 30, header=header)
    w = dense(frozen, "example_id", "w", 20)
    assert logged[-1][1] == pytest.approx(np.linalg.norm(a - w @ h.T)) and (w >= 0).all()


@pytest.fixture(scope="module")
def low(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(10, 2, 9)) * (r.uniform(size=(10, 2, 9)) < 0.6)
    rows = [(int(i), int(c), int(j), float(x[i, c, j])) for i, c, j in np.argwhere(x != 0)]
    w, g = r.uniform(size=(10, R)), r.normal(size=(9, R)) * 0.4
    return x, spark.createDataFrame(rows, "example_id long, class_id int, col long, value double"), w, g


def low_loss(x, w, g):
    return sum(np.linalg.norm(a.T @ a - (g * v) @ g.T) ** 2 for a, v in zip(x, w, strict=True))


def test_low_rank_step_is_the_gradient(spark, low):
    x, df, w, g = low
    _, got, losses = X.fit_lrm(df, R, 1, 0, lr=1e-3, init_w=vectors(spark, w, "example_id", "w"), init_g=vectors(spark, g, "col", "h"))
    num = np.zeros_like(g)
    for i, j in np.ndindex(*g.shape):
        d = np.zeros_like(g)
        d[i, j] = 1e-6
        num[i, j] = (low_loss(x, w, g + d) - low_loss(x, w, g - d)) / 2e-6
    assert np.allclose(dense(got, "col", "h", 9), g - 1e-3 * num, atol=1e-7)
    assert losses[-1][2] == pytest.approx(low_loss(x, w, g - 1e-3 * num), rel=1e-6)


def test_joint_fit_lowers_the_loss_whatever_the_partitions(spark, low):
    x, df, w, g = low
    runs = [X.fit_lrm(df.repartition(n), R, 0, 3, lr=1e-3, init_w=vectors(spark, w, "example_id", "w"), init_g=vectors(spark, g, "col", "h"), log_every=1) for n in (1, 6)]
    assert np.allclose(dense(runs[0][1], "col", "h", 9), dense(runs[1][1], "col", "h", 9))
    losses = [z for *_, z in runs[0][2]]
    assert losses == sorted(losses, reverse=True) and losses[0] < low_loss(x, w, g)
    with pytest.raises(FloatingPointError):
        X.fit_lrm(df, R, 40, 0, lr=1e6, init_w=vectors(spark, w, "example_id", "w"), init_g=vectors(spark, g, "col", "h"), log_every=1)


def test_expansion_leaves_the_frozen_dictionary(spark, low):
    x, df, w, g = low
    got_w, got_g, losses = X.expand_dictionary(df, vectors(spark, g[:, :2], "col", "h"), 2, 1, 1, 1, 2, w_frozen=vectors(spark, w[:, :2], "example_id", "w"))
    assert np.allclose(dense(got_g, "col", "h", 9)[:, 1:], g[:, :2])
    assert [p for p, *_ in losses] == ["g_only", "joint", "joint"] and losses[-1][2] == pytest.approx(low_loss(x, dense(got_w, "example_id", "w", 10), dense(got_g, "col", "h", 9)))


def test_stiefel_stays_orthonormal(spark, low):
    _, df, _, g = low
    _, got, _ = X.fit_stiefel(df, R, 3, lr=1e-2, init_g=vectors(spark, g, "col", "h"))
    m = dense(got, "col", "h", 9)
    assert np.allclose(m.T @ m, np.eye(R), atol=1e-10)


def test_hoyer_projection(spark):
    w = np.random.default_rng(2).uniform(size=(30, R))
    m = dense(X.hoyer_project(vectors(spark, w, "example_id", "w"), R, 2.5), "example_id", "w", 30)
    assert np.allclose(m.sum(0), 2.5) and np.allclose((m * m).sum(0), 1.0) and (m >= -1e-12).all()


def test_scaling_and_reading(spark, low):
    _, _, w, g = low
    got_w, got_g = X.normalize_lrm_components(vectors(spark, w, "example_id", "w"), vectors(spark, g, "col", "h"), R)
    u, v = dense(got_w, "example_id", "w", 10), dense(got_g, "col", "h", 9)
    assert np.allclose((v * u[3]) @ v.T, (g * w[3]) @ g.T)
    sim = {(r.k1, r.k2): r.sim for r in T.component_similarity(got_g, R).collect()}
    assert np.allclose([[sim[i, j] for j in range(R)] for i in range(R)], np.abs(v.T @ v))
    want = v[:, 0].copy()
    for k in (1, 2):
        if sim[0, k] <= 0.9:
            want -= (v[:, k] @ want) * v[:, k]
    got = np.array([r.value for r in T.orthogonal_reject(got_g, R, 0, 0.9).orderBy("col").collect()])
    assert np.allclose(got, want / np.linalg.norm(want))
    column_map = spark.createDataFrame([(i, 2 * i) for i in range(9)], "col long, param_index long")
    full = [r.value for r in T.component_vector(got_g, column_map, 1, n_parameters=18).orderBy("param_index").collect()]
    assert np.allclose(full[::2], v[:, 1]) and not any(full[1::2])
    ties = vectors(spark, np.ones((4, R)), "example_id", "w")
    assert [r.example_id for r in T.top_examples(ties, 2, [1]).orderBy("rank").collect()] == [0, 1]
    assert [(r.row, r.col, r.example_id) for r in T.top_examples_grid(ties, 2, 2, [0]).orderBy("row", "col").collect()] == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]


def test_blocks_are_even_on_zipf_columns(spark):
    """1e5 rows; the hottest column has a third of all entries."""
    r = np.random.default_rng(11)
    n, width = 100_000, 4
    col = np.concatenate([np.zeros(n * width // 3, np.int64), np.minimum(r.zipf(1.3, n * width - n * width // 3), 5000)])
    r.shuffle(col)
    row, cls, value = np.repeat(np.arange(n), width), np.tile(np.arange(width) % 2, n), r.normal(size=n * width)
    df = spark.createDataFrame(pd.DataFrame({"example_id": row, "class_id": cls.astype(np.int32), "col": col, "value": value}))
    h, x = r.normal(size=(5001, 2)), r.normal(size=(n, 2))
    for key, dense, size in (("col", spark.createDataFrame(pd.DataFrame({"col": np.arange(5001), "v": h.tolist()})), n), ("example_id", spark.createDataFrame(pd.DataFrame({"example_id": np.arange(n), "v": x.tolist()})), 5001)):
        layout = Layout(df, key, entries=8000)
        parts = [r.n for r in layout.rows.groupBy("part").agg(F.count("*").alias("n")).collect()]
        tasks = [r.n for r in layout.rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(parts) == n * width and max(parts) <= 2.5 * 8000 and max(tasks) <= 3 * np.median(tasks)
        assert key != "col" or max(layout.bands) > 10
        got = layout.product(dense, "v", 2, "out").toPandas()
        want = np.zeros((size, 2, 2))
        if key == "col":
            np.add.at(want, (row, cls), value[:, None] * h[col])
            found = want[got["example_id"], got["class_id"]]
        else:
            np.add.at(want[:, 0], col, value[:, None] * x[row])
            found = want[got["col"], 0]
        assert np.allclose(np.stack(got["out"]), found) and len(got) == len({*zip(row, cls, strict=True)} if key == "col" else {*col})
        layout.release()


def test_products_of_matrices_without_entries_or_dense_rows(spark):
    none = spark.createDataFrame([], "example_id long, class_id int, col long, value double")
    one = spark.createDataFrame([(3, 1, 7, 2.0), (3, 1, 7, 0.5), (4, 0, 8, 1.0)], "example_id long, class_id int, col long, value double")
    dense = spark.createDataFrame([(7, [1.0, 2.0])], "col long, h array<double>")
    assert Layout(none, "col").product(dense, "h", 2, "out").isEmpty()
    assert Layout(one, "col").product(dense.limit(0), "h", 2, "out").isEmpty()
    assert sorted(map(tuple, Layout(one, "col").product(dense, "h", 2, "out").collect())) == [(3, 1, [2.5, 5.0]), (4, 0, [0.0, 0.0])]


def test_start_of_nearly_dependent_components_is_orthonormal(spark):
    r = np.random.default_rng(6)
    g = r.normal(size=(400, R))
    g[:, 1] = g[:, 0] + 1e-9 * g[:, 1]
    m = dense(X.orthonormalize(vectors(spark, g, "col", "h").repartition(40), R), "col", "h", 400)
    assert np.abs(m.T @ m - np.eye(R)).max() < 1e-10 and np.allclose(np.abs(m[:, 0]), np.abs(g[:, 0]) / np.linalg.norm(g[:, 0]))
    q, upper = np.linalg.qr(g[:, [0, 2]])
    assert np.allclose(dense(X.orthonormalize(vectors(spark, g[:, [0, 2, 1]], "col", "h"), R), "col", "h", 400)[:, :2], q * np.sign(np.diag(upper)))
    g[:, 2] = 2 * g[:, 0]
    m = dense(X.orthonormalize(vectors(spark, g, "col", "h"), R), "col", "h", 400)
    assert np.abs(m.T @ m - np.eye(R)).max() < 1e-10
    few = dense(X.orthonormalize(vectors(spark, g[:4, [0, 1, 1]] + np.arange(3) ** 2, "col", "h").repartition(4), R), "col", "h", 4)
    assert np.abs(few.T @ few - np.eye(R)).max() < 1e-10


@pytest.mark.parametrize("share", [0.3, 0.6, 0.95])
def test_projection_is_the_nearest_vector(spark, share):
    r = np.random.default_rng(12)
    w = np.stack([r.normal(size=200), r.uniform(size=200), r.integers(0, 50, 200)], 1).astype(float)
    l1 = share * np.sqrt(200)
    m = dense(X.hoyer_project(vectors(spark, w, "example_id", "w").repartition(7), R, l1), "example_id", "w", 200)
    assert np.allclose(m.sum(0), l1) and np.allclose((m * m).sum(0), 1.0) and (m >= 0).all()
    for k in range(R):
        best = None
        v = -np.sort(-w[:, k])
        for n in range(1, 201):  # every number of kept entries
            spread = (v[:n] ** 2).sum() - v[:n].sum() ** 2 / n
            if n >= l1 * l1 and spread > 1e-12:
                x = l1 / n + np.sqrt(max(0.0, 1 - l1 * l1 / n) / spread) * (v[:n] - v[:n].mean())
                far = ((np.append(x, np.zeros(200 - n)) - v) ** 2).sum()
                if (x >= -1e-12).all() and (best is None or far < best):
                    best = far
        assert ((m[:, k] - w[:, k]) ** 2).sum() == pytest.approx(best, rel=1e-9)
    same = dense(X.hoyer_project(vectors(spark, np.ones((4, R)), "example_id", "w"), R, 1.5), "example_id", "w", 4)
    assert np.allclose(same, 1.5 / 4)
    top = np.repeat([[2.0], [1.0]], [4, 3], 0) * np.ones(R)
    assert np.allclose(dense(X.hoyer_project(vectors(spark, top, "example_id", "w"), R, 1.2), "example_id", "w", 7), np.repeat([[0.3], [0.0]], [4, 3], 0))
    with pytest.raises(ValueError, match="so few entries"):
        X.hoyer_project(vectors(spark, w[:3], "example_id", "w"), R, 2.0)


def folders(path):
    return sorted(os.listdir(f"{path}/tables")), sorted(n for n in os.listdir(f"{path}/log") if not n.startswith("."))


def test_stopped_fits_go_on_as_if_not_stopped(spark, planted, low, tmp_path, monkeypatch):
    _, d = planted
    _, df, w, g = low
    header = spark.range(20).withColumnRenamed("id", "example_id")
    wv, gv = vectors(spark, w, "example_id", "w"), vectors(spark, g, "col", "h")
    fits = {
        "d": lambda log: X.fit_d(d, R, 3, log_every=1, header=header, log=log),
        "lrm": lambda log: X.fit_lrm(df, R, 1, 2, init_w=wv, init_g=gv, log_every=1, log=log),
        "more": lambda log: X.expand_dictionary(df, gv, R, 2, 1, 1, 1, w_frozen=wv, log=log),
    }
    finish = X.Steps.finish
    for name, fit in fits.items():
        whole = fit(None)

        def lost(self, step, names, losses):
            tables = os.listdir(f"{path}/tables")
            assert len({t.partition("-")[0] for t in tables}) * 2 + 1 >= len(tables)  # two steps at most
            if step == 3:
                raise ConnectionError
            finish(self, step, names, losses)

        path = f"{tmp_path}/{name}"
        monkeypatch.setattr(X.Steps, "finish", lost)
        with pytest.raises(ConnectionError):
            fit(path)
        assert folders(path)[1] == ["000000002"]
        monkeypatch.setattr(X.Steps, "finish", finish)
        again = fit(path)
        tables, log = folders(path)
        assert log == ["000000003"] and len(tables) == (2 if name == "d" else 3)
        for i, key, column in ((0, "example_id", "w"), (1, "col", "h")):
            a, b = ({r[key]: r[column] for r in x[i].collect()} for x in (whole, again))
            assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-9, atol=1e-12) for k in a)
        assert [x[:-1] for x in whole[2]] == [x[:-1] for x in again[2]] and np.allclose([x[-1] for x in whole[2]], [x[-1] for x in again[2]])
    ended = fits["d"](f"{tmp_path}/d")  # nothing left to do
    assert ended[2] and len(folders(f"{tmp_path}/d")[0]) == 2
    with pytest.raises(ValueError, match="another loop"):
        X.fit_d(d, R, 3, eps=1e-3, log=f"{tmp_path}/d")


def test_stiefel_steps_follow_the_cayley_curve(spark, low):
    x, df, w, g = low
    start = dense(X.orthonormalize(vectors(spark, g, "col", "h"), R), "col", "h", 9)
    got_w, got, losses = X.fit_stiefel(df, R, 3, lr=1e-2, init_w=vectors(spark, w, "example_id", "w"), init_g=vectors(spark, g, "col", "h"))
    want, v = start, w.copy()
    for _ in range(3):
        products = x @ want
        v = v * (products**2).sum(1) / (v @ (want.T @ want) ** 2 + 1e-9)
        slope = 4 * sum((want * u) @ (want.T @ want) * u - a.T @ (a @ want) * u for a, u in zip(x, v, strict=True))
        skew = slope @ want.T - want @ slope.T
        want = np.linalg.solve(np.eye(9) + 5e-3 * skew, (np.eye(9) - 5e-3 * skew) @ want)
    assert np.allclose(dense(got, "col", "h", 9), want) and np.allclose(dense(got_w, "example_id", "w", 10), v)
    assert losses[-1][2] == pytest.approx(low_loss(x, v, want))
