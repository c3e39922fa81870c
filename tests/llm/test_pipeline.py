"""The pipeline's stages on a small corpus, and the queries of the subpackage against their SQL."""

from __future__ import annotations

import os
import random
import re

import pandas as pd
import pytest

import corpus_pipeline
from pefloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def prose(r, n):
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(1)
    d = str(tmp_path)
    clean = ["\n".join(prose(r, 25) for _ in range(4)) for _ in range(150)]
    toxic = [prose(r, 40) + " vile scum " + prose(r, 40) for _ in range(60)]
    item = prose(r, 30)
    leaks = [prose(r, 40) + " " + item + " " + prose(r, 40) for _ in range(3)]
    base = prose(r, 200)
    near = [base] + [" ".join(w if k != at else "edited" for k, w in enumerate(base.split())) for at in (10, 150)]
    texts = clean + toxic + leaks + near + clean[:5] + ["\n".join([prose(r, 20), clean[7].split("\n")[2]])] + [item, "", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 210)) for i in range(210)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out/{k}")
        docs = spark.read.parquet(f"{d}/out/{k}")
        kept.append({x.doc_id: x for x in docs.collect()})
        assert name == "mix" or docs.columns == columns
    assert set(range(len(texts))) - set(kept[0]) == set(range(150, 210))
    gone = set(kept[0]) - set(kept[1])  # copies of clean documents lose all their lines, and so may near copies of one line
    assert set(range(216, 221)) <= gone <= set(range(214, 221))
    assert kept[1][221].text == texts[221].split("\n")[0]
    assert {213, 214, 215} & set(kept[2]) == {213} and set(range(150)) <= set(kept[2])
    assert 222 not in kept[3] and all(item not in kept[3][i].text and len(re.findall(r"\S+", kept[3][i].text)) == 80 for i in (210, 211, 212))
    assert set(range(150)) | {223, 224} <= set(kept[3])
    assert set(kept[4]) == set(kept[3]) and all(x.taken <= 2 * x.size for x in kept[4].values())
    again = {x.doc_id: (x.size, x.taken) for x in corpus_pipeline.run(spark, d).collect()}
    assert again == {i: (x.size, x.taken) for i, x in kept[4].items()}


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows, further columns with clashing names, and empty tables."""
    r = random.Random(2)
    d = str(tmp_path)
    clean = [prose(r, 60) for _ in range(60)]
    toxic = [prose(r, 30) + " vile scum " + prose(r, 30) for _ in range(60)]
    item = prose(r, 20)
    more = ["score", "Predicted", "h1", "root", "id_", "t_", "doc", "removed", "whole", "spans0", "label", "y"]
    texts = [*enumerate(clean + toxic), (None, prose(r, 50)), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, "!?"), (204, "long " + prose(r, 20000)), (0, clean[0]), (0, prose(r, 40)), (205, prose(r, 30) + " " + item)]
    rows = [(i, t, None, None if k % 3 else "s", None, *(f"{c}{k}" for c in more)) for k, (i, t) in enumerate(texts)]
    rows[-1] = (*rows[-1][:4], 5, *rows[-1][5:])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)] + [(None, None, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    own = {x[5]: x for x in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(f"{d}/out/{k}")
        docs = spark.read.schema(schema).parquet(f"{d}/out/{k}")
        got = docs.collect()
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert all(tuple(x)[5:] == own[x.score][5:] and x.doc_id == own[x.score][0] for x in got) and len({x.score for x in got}) == len(got)
        kept = {x.score: x for x in got}
        assert {f"score{k}" for k in [*range(60), *range(120, 129)]} <= kept.keys() and not any(f"score{k}" in kept for k in range(60, 120))
    assert kept["score129"].text == " ".join(texts[129][1].split()[:30]) + " " and kept["score129"].n_chars == len(kept["score129"].text)
    assert kept["score0"].text == kept["score127"].text == clean[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len(mixed) == len(got) and all(0 <= x.taken <= 2 * x.size for x in mixed)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/none/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), f"{d}/none").count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs, f"{d}/none").count() == corpus_pipeline.drop_benchmark(spark, docs, f"{d}/none").count() == len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    order = lambda r: [(v if isinstance(v, str) else "", 0.0 if v is None or isinstance(v, str) else float(v)) for v in r]
    rows = lambda d: sorted((tuple(None if pd.isna(v) else v for v in r) for r in d[columns].astype(object).to_numpy().tolist()), key=order)
    assert rows(a) == rows(b)
