"""Records against dense numpy, and the array functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pefloom.functions import arrays as A
from pefloom.operators import evaluate as E
from pefloom.operators import factorize as X
from pefloom.operators import matrix as M
from pefloom.operators import pefs as P
from pefloom.sources import tables as S


@pytest.fixture(scope="module")
def model(spark):
    r = np.random.default_rng(5)
    x, head = r.normal(size=(12, 4)), r.normal(size=(3, 4))
    df = spark.createDataFrame([(i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "example_id long, label int, features array<double>")
    z, g = P.linear_class_gradients(x, head)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    return x, head, df, z, g, p, (lambda f: P.linear_class_gradients(f, head))


def test_gradients_are_gradients(model):
    x, head, _, _, g, _, _ = model
    logp = lambda h: np.log(np.exp(x @ h.T) / np.exp(x @ h.T).sum(1, keepdims=True))
    step = np.zeros_like(head)
    step[1, 2] = 1e-6
    assert np.allclose((logp(head + step) - logp(head - step)) / 2e-6, g[:, :, 1 * 4 + 2], atol=1e-7)


def test_long_and_row_records_agree(spark, model):
    x, head, df, z, g, p, grad = model
    gradients, logits = P.gradients_of(df, grad), P.linear_logits(df, head)
    v = np.einsum("nc,ncj->nj", p, g * g)
    rows = P.sparsify_d(P.d_pefs(gradients, logits), 5).orderBy("example_id").collect()
    made = P.make_pefs(df, grad, "diag", 5).orderBy("example_id").collect()
    for i, (a, b) in enumerate(zip(rows, made, strict=True)):
        assert a.indices == b.indices == np.argsort(-v[i], kind="stable")[:5].tolist()
        assert np.allclose(a.values, b.values) and np.isclose(b.pef_norm, np.sqrt((v[i] ** 2).sum()))
    factors = P.lrm_pefs(gradients, logits)
    a = np.sqrt(p)[:, :, None] * g
    norm = [np.linalg.norm(m @ m.T) for m in a]
    assert np.allclose([r.pef_norm for r in P.lrm_norms(factors).orderBy("example_id").collect()], norm)
    low, made = P.sparsify_lrm(factors, 7, 3).orderBy("example_id").collect(), P.make_pefs(df, grad, "lrm", 7).orderBy("example_id").collect()
    for i, (b, c) in enumerate(zip(low, made, strict=True)):
        assert (b.indices, b.col_offsets) == (c.indices, c.col_offsets) and np.allclose(b.values, c.values) and np.isclose(c.pef_norm, norm[i])


def test_variable_rank(spark, model):
    _, head, df, _, _, p, grad = model
    gradients, logits = P.gradients_of(df, grad), P.linear_logits(df, head)
    ranks = logits.select("example_id", F.lit(2).alias("rank"))
    rows = P.sparsify_lvrm(P.lrm_pefs(gradients, logits, top_k_classes=2), 100, ranks).orderBy("example_id").collect()
    assert all(sum(r.col_sizes) == len(r.values) == 24 and len(r.col_sizes) == 2 for r in rows)
    none = P.sparsify_lvrm(P.lrm_pefs(gradients, logits, 5, min_prob=1.1), 4, logits.select("example_id", F.lit(0).alias("rank"))).collect()
    assert all(r.values == [] and r.col_sizes == [] for r in none) and len(none) == 12


def test_fisher_of_the_data_set(spark, model):
    _, head, df, _, g, p, grad = model
    gradients, logits = P.gradients_of(df, grad), P.linear_logits(df, head)
    f = {r.param_index: r.fisher for r in P.dsf_expected(P.d_pefs(gradients, logits), 12).collect()}
    assert np.allclose([f[j] for j in range(12)], np.einsum("nc,ncj->j", p, g * g) / 12)
    one, two = (sorted(map(tuple, P.dsf_sampled(gradients.repartition(n), logits, 12, 3).collect())) for n in (1, 5))
    assert np.allclose(one, two)
    unit = P.normalize_dsf(P.dsf_expected(P.d_pefs(gradients, logits), 12)).agg(F.sum(F.col("fisher") ** 2)).first()[0]
    assert unit == pytest.approx(1.0)


def test_ties_go_to_the_lower_index(spark):
    df = spark.createDataFrame([(0, j, 1.0) for j in (3, 1, 2)] + [(0, 0, 0.0)], "example_id long, param_index long, value double")
    assert P.sparsify_d(df, 2).first().indices == [1, 2]
    assert len(P.sparsify_d(df, 99).first().indices) == 4


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 2, "b", 0.6), ([1000.0, 0.0, 0.0], 0, "a", 5.0)], "l array<double>, y int, s string, x double")
    got = df.select(A.argmax(F.col("l")).alias("m"), A.softmax(F.col("l")).alias("p"), A.relabel_cyclic(F.col("y")).alias("r"), A.encode_label(F.col("s"), ["a", "b"]).alias("e"), A.bin_score(F.col("x")).alias("b"), A.kl(F.col("l"), F.col("l")).alias("k")).collect()
    assert [(r.m, r.r, r.e, r.k) for r in got] == [(1, 0, 1, 0.0), (0, 1, 0, 0.0)]
    assert got[0].b == np.digitize(0.6, A.SCORE_EDGES) and got[1].b == 24 and got[1].p == [1.0, 0.0, 0.0]
    for bad in (A.encode_label(F.lit("zz"), ["a"]), A.bin_score(F.lit(5.1))):
        with pytest.raises(Exception, match="unknown label|out of range"):
            df.select(bad).collect()


def test_padding_and_trimming(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (0, [6]), (1, [7, 8]), (2, [])], "batch long, ids array<int>")
    rows = df.select("batch", A.pad_tokens(F.col("ids"), 4).alias("ids"), A.pad_tokens(F.transform("ids", lambda _: F.lit(1)), 4).alias("mask"))
    assert sorted(r.ids for r in rows.collect()) == [[0, 0, 0, 0], [1, 2, 3, 4], [6, 0, 0, 0], [7, 8, 0, 0]]
    assert sorted((r.batch, r.ids) for r in A.trim_batch(rows, "batch", "mask", ["ids"]).collect()) == [(0, [1, 2, 3, 4]), (0, [6, 0, 0, 0]), (1, [7, 8]), (2, [])]


def test_tables_round_trip(spark, model, tmp_path):
    _, _, df, _, _, _, grad = model
    rows = P.make_pefs(df, grad, "diag", 6)
    S.write_pefs(rows, str(tmp_path / "p"))
    got = S.read_pefs(spark, str(tmp_path / "p"), n_examples=3, n_values=2).orderBy("example_id").collect()
    assert [r.example_id for r in got] == [0, 1, 2] and all(len(r.values) == 2 for r in got)
    assert S.read_columns(spark, str(tmp_path / "p"), "label").columns == ["example_id", "label"]
    dsf = P.dsf_expected(M.pefs_to_long(rows), 12)
    S.write_dsf(dsf, str(tmp_path / "f"))
    assert S.read_dsf(spark, str(tmp_path / "f")).count() == dsf.count()
    df.write.parquet(str(tmp_path / "task" / "train.parquet"))
    S.REGISTRY["own/task"] = str(tmp_path / "task")
    assert [r.example_id for r in S.load_examples(spark, "own/task", "train", take=2, skip=3).collect()] == [3, 4]
    with pytest.raises(KeyError):
        S.load_examples(spark, "none", "train")
    labelled = rows.withColumn("label", F.lit(0))
    wrong = P.filter_incorrect(labelled).count()
    assert P.fraction_correct(labelled).first()[0] == pytest.approx(1 - wrong / 12)


def entries(rows):
    return {(r.example_id, c, j): v for r in rows for c, (lo, hi) in enumerate(zip(np.cumsum([0, *r.col_sizes[:-1]]), np.cumsum(r.col_sizes), strict=False)) for j, v in zip(r.indices[lo:hi], r.values[lo:hi], strict=True)} if rows else {}


def test_records_of_varying_rank_are_made_in_the_tasks(spark, model):
    _, head, df, _, g, p, grad = model
    gradients, logits = P.gradients_of(df, grad), P.linear_logits(df, head)
    for most, least, k in ((2, 0.2, 5), (3, 0.3, 100), (1, 0.0, 3), (3, 0.999, 4), (5, 0.1, 7)):
        made = P.make_pefs(df, grad, "lvrm", k, max_classes=most, min_prob=least).orderBy("example_id").collect()
        ranks = [min(most, int((x >= least).sum())) for x in p]
        assert [r.rank for r in made] == ranks == [len(r.col_sizes) for r in made]
        long = P.sparsify_lvrm(P.lrm_pefs(gradients, logits, most, least), k, spark.createDataFrame([(i, n) for i, n in enumerate(ranks)], "example_id long, rank int")).orderBy("example_id").collect()
        a, b = entries(made), entries(long)
        assert a.keys() == b.keys() and np.allclose([*a.values()], [b[x] for x in a])
        for i, r in enumerate(made):
            f = (np.sqrt(p[i])[:, None] * g[i])[np.argsort(-p[i], kind="stable")[: ranks[i]]]
            assert np.isclose(r.pef_norm, np.linalg.norm(f @ f.T) if ranks[i] else 0.0)
    low = P.make_pefs(df, grad, "lrm", 6, max_classes=2).orderBy("example_id").collect()
    want = P.sparsify_lrm(P.lrm_pefs(gradients, logits, top_k_classes=2), 6, 2).orderBy("example_id").collect()
    assert [(r.indices, r.col_offsets) for r in low] == [(r.indices, r.col_offsets) for r in want]
    diag = P.make_pefs(df, grad, "diag", 12, min_prob=0.3).collect()
    for r in diag:
        v = np.einsum("c,cj->j", np.where(p[r.example_id] >= 0.3, p[r.example_id], 0), g[r.example_id] ** 2)
        assert np.allclose(r.values, v[r.indices]) and np.isclose(r.pef_norm, np.sqrt((v * v).sum()))
    for kind, how in (("lrm", {"min_prob": 0.1}), ("diag", {"max_classes": 1}), ("none", {})):
        with pytest.raises(ValueError, match="records of kind"):
            P.make_pefs(df, grad, kind, 3, **how)


def test_gram_of_a_thousand_classes(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(3, 1000, 60)) * (r.uniform(size=(3, 1000, 60)) < 0.2)
    rows = pd.DataFrame([(int(i), int(c), int(j), float(x[i, c, j])) for i, c, j in np.argwhere(x != 0)], columns=["example_id", "class_id", "param_index", "value"])
    df = spark.createDataFrame(rows).repartition(5)
    grams = np.einsum("icj,ikj->ick", x, x)
    got = {g.example_id: (g.squares, g.own) for g in P.gram_squares(df).collect()}
    assert all(np.allclose(got[i], ((grams[i] ** 2).sum(), (np.diag(grams[i]) ** 2).sum())) for i in range(3))
    norms = {g.example_id: g.pef_norm for g in P.lrm_norms(df).collect()}
    assert all(np.isclose(norms[i], np.linalg.norm(grams[i])) for i in range(3))
    cells = P.class_gram(df.where("class_id < 7")).toPandas()
    assert np.allclose(cells["dot"], grams[cells["example_id"], cells["c1"], cells["c2"]]) and len(cells) == 3 * 49
    assert P.lrm_norms(df.limit(0)).isEmpty()


def test_gram_in_parts():
    r = np.random.default_rng(9)
    whole, parts = P._Gram(), P._Gram()
    c, k, v = r.integers(0, 9, 4000), np.sort(r.integers(0, 9000, 4000)), r.normal(size=4000)
    whole.add(c, k, v)
    for lo, hi in ((0, 3000), (3000, 3001), (3001, 9000)):
        own = (k >= lo) & (k < hi)
        parts.add(c[own], k[own], v[own])
    x = np.zeros((9, 9000))
    np.add.at(x, (c, k), v)
    assert np.allclose(whole.dots, x @ x.T) and np.allclose(parts.dots, x @ x.T)


def test_fisher_vectors_are_summed_in_the_tasks(spark, model):
    _, head, df, _, g, p, grad = model
    gradients, logits = P.gradients_of(df, grad), P.linear_logits(df, head)
    total = lambda rows, c: {r.param_index: r[c] for r in rows.collect()}
    for made, long in ((P.dsf_of(df.repartition(3), grad, 12), P.dsf_expected(P.d_pefs(gradients, logits), 12)), (P.dsf_of(df, grad, 12, "sampled", seed=3), P.dsf_sampled(gradients, logits, 12, 3)), (P.dsf_of(df, grad, 12, min_prob=0.3), P.dsf_expected(P.d_pefs(gradients, logits, 0.3), 12))):
        a, b = total(made, "fisher"), total(long, "fisher")
        assert a.keys() == b.keys() and np.allclose([a[x] for x in sorted(a)], [b[x] for x in sorted(a)])
    ids = spark.createDataFrame([(1,), (4,), (5,)], "example_id long")
    sign = total(E.sign_of(df, grad, ids), "sign")
    assert sign == {j: np.sign(v) for j, v in enumerate(sum(g[i, i % 3] for i in (1, 4, 5)))}
    assert P.summed_gradients(df.limit(0), grad, "expected").isEmpty()
    # a task sends as many rows as the model has parameters, not one for each example and class
    assert P.summed_gradients(df.repartition(2), grad, "expected").count() == 12


@pytest.mark.parametrize("rows", [1 << 19, 10])
def test_places_of_a_hundred_thousand_variables(spark, monkeypatch, rows):
    monkeypatch.setattr(E, "LAYOUT_ROWS", rows)
    r = np.random.default_rng(3)
    end = np.cumsum(r.integers(1, 40, 100_000)) + 5
    start = np.concatenate([[5], end[:-1]])
    layout = spark.createDataFrame(pd.DataFrame({"variable": [f"v{k}" for k in range(len(end))], "start": start, "end": end}))
    asked = np.concatenate([[0, 4, 5, end[-1] - 1, end[-1], end[-1] + 9], r.integers(0, end[-1], 5000)])
    df = spark.createDataFrame(pd.DataFrame({"start": np.arange(len(asked)), "param_index": asked}))
    placed = E.locate_params(df, layout)
    assert "NestedLoop" not in placed._jdf.queryExecution().toString() and placed.columns == ["start", "param_index", "variable", "local_index"]
    want = {(i, int(a), f"v{np.searchsorted(start, a, 'right') - 1}", int(a - start[np.searchsorted(start, a, "right") - 1])) for i, a in enumerate(asked) if 5 <= a < end[-1]}
    assert {tuple(x) for x in placed.collect()} == want
    assert E.locate_params(df, layout.limit(0)).isEmpty()


def test_trimming_of_masks_with_holes(spark):
    r = np.random.default_rng(2)
    masks = [(k // 4, (r.uniform(size=n) < 0.02).astype(int).tolist(), list(range(n))) for k, n in enumerate([200] * 8 + [1, 0, 64, 65, 128, 128, 127, 129])]
    df = spark.createDataFrame(masks, "batch long, mask array<int>, ids array<int>").withColumn("row", F.monotonically_increasing_id())
    got = {x.row: (x.mask, x.ids) for x in A.trim_batch(df.where("batch < 2"), "batch", "mask", ["mask", "ids"]).collect()}
    assert len(got) == 8
    for x in df.where("batch < 2").collect():
        kept = sorted({j for b, m, _ in masks if b == x.batch for j, v in enumerate(m) if v})
        assert got[x.row] == ([x.mask[j] for j in kept], kept)
    assert A.trim_batch(df.where("batch = 2 AND size(mask) <= 1"), "batch", "mask", ["ids"]).count() == 2


def test_records_and_dictionary_must_agree(spark, model, tmp_path):
    _, _, df, _, _, _, grad = model
    kinds = {k: S.kind_of(P.make_pefs(df, grad, k, 4), 12) for k in ("diag", "lrm", "lvrm")}
    assert kinds == {"diag": ("diag", 12, 1), "lrm": ("lrm", 12, 3), "lvrm": ("lvrm", 12, -1)}
    S.write_kind(spark, str(tmp_path / "records"), kinds["lrm"])
    lrm = S.read_kind(spark, str(tmp_path / "records"))
    S.check_agreement(lrm, kinds["lvrm"])
    S.check_agreement(lrm, lrm)
    for other, said in ((lrm._replace(n_parameters=13), "parameters"), (kinds["diag"], "kind"), (lrm._replace(n_classes=2), "classes")):
        with pytest.raises(ValueError, match=said):
            X.fit_coeffs_lrm(None, None, 2, 1, kinds=(lrm, other))


def test_summed_report_is_the_report_of_all_rows(spark, monkeypatch):
    r = np.random.default_rng(5)
    head, directions = r.normal(size=(4, 6)), r.normal(size=(3, 4, 6))
    x = spark.createDataFrame([(i, int(r.integers(4)), r.normal(size=6).tolist()) for i in range(60)], "example_id long, label int, features array<double>")
    top = spark.createDataFrame([(k, int(i)) for k in (0, 1) for i in r.choice(60, 12, replace=False)] + [(1, 3), (1, 3)], "component int, example_id long").join(x, "example_id")
    base = x.where("example_id % 2 = 0").unionByName(x.limit(1)).repartition(5)
    each = base.select(F.explode(F.array(*map(F.lit, range(3)))).alias("component"), F.lit(False).alias("is_top"), "example_id", "label", "features")
    want = E.perturbation_report(E.evaluate_perturbations(top.select("component", F.lit(True).alias("is_top"), "example_id", "label", "features").union(each), head, directions, 1.5))
    monkeypatch.setattr(E, "CELLS", 30)
    told = E.summed_report(top, base, head, directions, 1.5)
    rows = lambda df: {t.component: [t.kl_ratio, t.accuracy, t.og_accuracy] for t in df.collect()}
    a, b = rows(want), rows(told)
    assert a.keys() == b.keys() == {0, 1, 2} and a[2] == b[2] == [None] * 3 and all(b[k] == pytest.approx(a[k]) for k in (0, 1))
    odd = base.union(spark.createDataFrame([(91, None, [0.0] * 6), (92, 1, None)], base.schema))
    same = rows(E.summed_report(top, odd, head, directions, 1.5))
    assert same[0][1:] == a[0][1:] and same[0][0] != a[0][0]
    assert rows(E.summed_report(top.limit(0), base.limit(0), head, directions, 1.5)) == {}
    alone = rows(E.summed_report(top, base.limit(0), head, directions, 1.5))[1]
    assert alone[0] is None and alone[1:] == pytest.approx(a[1][1:])


def test_grams_of_many_small_examples(spark, monkeypatch):
    """Examples of few entries had a Gram matrix each, one by one in Python; now only those at a batch's ends and large ones do."""
    import pyarrow as pa

    class Held:
        def select(self, *_):
            return self

        repartition = sortWithinPartitions = select

        def mapInArrow(self, f, _):
            self.run = f
            return self

    made = []

    class Counted(P._Gram):
        def __init__(self):
            made.append(self)
            super().__init__()

    monkeypatch.setattr(P, "_Gram", Counted)
    monkeypatch.setattr(P, "FEW_PRODUCTS", 60)
    monkeypatch.setattr(P, "PRODUCTS", 500)
    r = np.random.default_rng(6)
    e = np.concatenate([np.repeat(np.arange(900) * 3 - 50, r.integers(1, 6, 900)), np.repeat([100, 400, 1000], 300)])
    c, k, v = r.integers(-2, 5, len(e)), r.integers(0, 4, len(e)), r.normal(size=len(e))
    order = np.lexsort((k, e))
    e, c, k, v = e[order], c[order], k[order], v[order]
    frame = Held()
    P.gram_squares(frame)
    batches = [pa.record_batch([pa.array(x[i : i + 700]) for x in (e, c, k, v)], ["example_id", "class_id", "k", "value"]) for i in range(0, len(e), 700)] + [pa.record_batch([pa.array(x[:0]) for x in (e, c, k, v)], ["example_id", "class_id", "k", "value"])]
    got = [row for b in frame.run(iter(batches)) for row in b.to_pylist()]
    want = {}
    for i in np.unique(e):
        dense = np.zeros((7, 4))
        np.add.at(dense, (c[e == i] + 2, k[e == i]), v[e == i])
        want[int(i)] = ((dense @ dense.T) ** 2).sum(), (np.diag(dense @ dense.T) ** 2).sum()
    assert len(got) == len(want) and all(np.allclose((x["squares"], x["own"]), want[x["example_id"]]) for x in got)
    assert len(made) <= 3 * len(batches) + 3
