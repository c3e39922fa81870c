"""The queries over the driver's tables for the Fisher operators, and their SQL.

``embeddings`` are the examples of a linear softmax head whose weights are the label centroids, ``lineitem`` is a sparse matrix (order, part,
summed quantity) with the line number as class, ``documents`` with ``labels`` and ``orders``, ``part`` stand for raw example data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pefloom.functions import arrays as A
from pefloom.operators import components as T
from pefloom.operators import evaluate as E
from pefloom.operators import factorize as X
from pefloom.operators import matrix as M
from pefloom.operators import pefs as P
from pefloom.plans.lineage import cut, shared_dir
from pefloom.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs.


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), "label", F.col("embedding").alias("features"))


def head_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray, P.GradFn]:
    x = examples(spark, sf_dir)
    head = P.centroid_head(x)
    return x, head, lambda f: P.linear_class_gradients(f, head)


def head_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, head, _ = head_of(spark, sf_dir)
    return P.linear_logits(x, head)


def order_matrix(spark: SparkSession, sf_dir: str, by_line: bool = False) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    cls = F.col("l_linenumber") if by_line else F.lit(0)
    keyed = lines.select(F.col("l_orderkey").alias("example_id"), cls.alias("class_id"), F.col("l_partkey").alias("param_index"), "l_quantity")
    return keyed.groupBy("example_id", "class_id", "param_index").agg(F.sum("l_quantity").alias("value"))


HEAD = """
x AS (SELECT vec_id AS example_id, label, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
b AS (SELECT label AS c, j, avg(v) AS m FROM x GROUP BY ALL),
z AS (SELECT example_id, x.label, c, sum(v * m) AS z FROM x JOIN b USING (j) GROUP BY ALL),
p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY example_id) AS p, ln(sum(exp(z)) OVER (PARTITION BY example_id)) AS lse FROM z),
q AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY z DESC, c) AS rank FROM p)"""

WIDE = "(SELECT max(j) + 1 FROM x)"


# Logits, labels, accuracy.


@query(f"WITH {HEAD} SELECT example_id, label, c AS predicted, round(p, 8) AS p_max, round(lse, 8) AS lse, round(lse - (SELECT z FROM z y WHERE y.example_id = q.example_id AND y.c = q.label), 8) AS loss FROM q WHERE rank = 1")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = head_logits(spark, sf_dir)
    logits = F.col("logits")
    return z.select("example_id", "label", A.argmax(logits).alias("predicted"), F.round(F.array_max(A.softmax(logits)), 8).alias("p_max"), F.round(A.logsumexp(logits), 8).alias("lse"), F.round(A.cross_entropy(logits, F.col("label")), 8).alias("loss"))


@query(f"""WITH {HEAD}, n AS (SELECT example_id, c, label, p, exp(2 * z) / sum(exp(2 * z)) OVER (PARTITION BY example_id) AS p2 FROM p),
k AS (SELECT example_id, sum(p2 * ln(greatest(p2, 1e-7) / greatest(p, 1e-7))) AS kl FROM n GROUP BY 1)
SELECT q.label, count(*) AS n, round(avg(CASE WHEN c = q.label THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(lse - (SELECT z FROM z y WHERE y.example_id = q.example_id AND y.c = q.label)), 6) AS cross_entropy, round(avg(kl), 6) AS kl
FROM q JOIN k USING (example_id) WHERE rank = 1 GROUP BY q.label""")
def evaluation_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = head_logits(spark, sf_dir).withColumnRenamed("logits", "og_logits").withColumn("logits", F.transform("og_logits", lambda x: 2 * x))
    return z.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(E.correct("og_logits")), 8).alias("accuracy"), F.round(F.avg(A.cross_entropy(F.col("og_logits"), F.col("label"))), 6).alias("cross_entropy"), F.round(F.avg(A.kl(F.col("logits"), F.col("og_logits"))), 6).alias("kl"))


@query(f"WITH {HEAD} SELECT example_id, label, c AS predicted FROM q WHERE rank = 1 AND c <> label")
def filter_incorrect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_incorrect(head_logits(spark, sf_dir)).select("example_id", "label", A.argmax(F.col("logits")).alias("predicted"))


@query(f"WITH {HEAD} SELECT round(avg(CASE WHEN c = label THEN 1.0 ELSE 0.0 END), 8) AS fraction_correct, round(avg(CASE WHEN c = (label + 1) % 3 THEN 1.0 ELSE 0.0 END), 8) AS relabelled FROM q WHERE rank = 1")
def fraction_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = cut(head_logits(spark, sf_dir))
    both = z.agg(F.round(F.avg(E.correct()), 8).alias("fraction_correct"), F.round(F.avg((A.relabel_cyclic(F.col("label")) == A.argmax(F.col("logits"))).cast("double")), 8).alias("relabelled"))
    return both


@query("SELECT vec_id AS example_id, label, (label + 1) % 3 AS relabelled FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def relabel_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("example_id"))
    return P.subset_pefs(examples(spark, sf_dir), ids).select("example_id", "label", A.relabel_cyclic(F.col("label")).alias("relabelled"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"SELECT o_orderkey AS example_id, CAST(list_position({list(PRIORITIES)}, o_orderpriority) - 1 AS INTEGER) AS label FROM orders")
def encode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), A.encode_label(F.col("o_orderpriority"), PRIORITIES).alias("label"))


@query("SELECT l_orderkey, l_linenumber, len(list_filter([i * 0.2::DOUBLE FOR i IN range(1, 25)], lambda e: e <= l_discount * 50)) AS bin FROM lineitem".replace("i * 0.2::DOUBLE", "CAST(i AS DOUBLE) * CAST(0.2 AS DOUBLE)"))
def bin_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.bin_score(F.col("l_discount") * 50).cast("long").alias("bin"))


TOKENS = "list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER))"


@query(f"SELECT doc_id AS example_id, array_to_string(list_concat({TOKENS}[1:128], list_resize(CAST([] AS INTEGER[]), greatest(0, 128 - len(string_split(text, ' '))), 0)), ',') AS input_ids, array_to_string(list_concat(list_resize(CAST([] AS INTEGER[]), least(128, len(string_split(text, ' '))), 1), list_resize(CAST([] AS INTEGER[]), greatest(0, 128 - len(string_split(text, ' '))), 0)), ',') AS attention_mask FROM documents")
def pad_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), ids.alias("ids"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return docs.select("example_id", joined(A.pad_tokens(F.col("ids"), 128)).alias("input_ids"), joined(A.pad_tokens(F.transform("ids", lambda _: F.lit(1)), 128)).alias("attention_mask"))


@query(f"""WITH t AS (SELECT doc_id AS example_id, doc_id // 8 AS batch, {TOKENS} AS ids FROM documents), m AS (SELECT batch, max(least(128, len(ids))) AS n FROM t GROUP BY 1)
SELECT example_id, n AS length, CAST(list_sum(ids[1:least(128, n)]) AS BIGINT) AS total FROM t JOIN m USING (batch)""")
def trim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.expr("doc_id div 8").alias("batch"), ids.alias("ids"))
    padded = docs.select("example_id", "batch", A.pad_tokens(F.col("ids"), 128).alias("ids"), A.pad_tokens(F.transform("ids", lambda _: F.lit(1)), 128).alias("mask"))
    out = A.trim_batch(padded, "batch", "mask", ["ids", "mask"])
    return out.select("example_id", F.size("ids").cast("long").alias("length"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# Records.


@query(f"""WITH {HEAD}, d AS (SELECT example_id, c * {WIDE} + j AS param_index, p * (1 - p) * v * v AS value FROM p JOIN x USING (example_id, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY value DESC, param_index) AS rank, sqrt(sum(value * value) OVER (PARTITION BY example_id)) AS norm FROM d)
SELECT example_id, rank, param_index, round(value, 9) AS value, round(norm, 8) AS pef_norm FROM r WHERE rank <= 8""")
def diagonal_pefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, grad = head_of(spark, sf_dir)
    e = P.make_pefs(x, grad, "diag", 8).select("example_id", "pef_norm", F.posexplode(F.arrays_zip("indices", "values")).alias("pos", "e"))
    return e.select("example_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("e.indices").alias("param_index"), F.round("e.values", 9).alias("value"), F.round("pef_norm", 8).alias("pef_norm"))


@query(f"WITH {HEAD}, g AS (SELECT example_id, c * {WIDE} + j AS param_index, p * (1 - p) * v * v AS value FROM p JOIN x USING (example_id, label)), f AS (SELECT param_index, sum(value) / (SELECT count(*) FROM embeddings) AS fisher FROM g GROUP BY 1) SELECT param_index, round(fisher / (sqrt(sum(fisher * fisher) OVER ()) + 1e-12), 8) AS fisher FROM f")
def dataset_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, head, grad = head_of(spark, sf_dir)
    return P.normalize_dsf(cut(P.dsf_of(x, grad, x.count()))).withColumn("fisher", F.round("fisher", 8))


@query(f"""WITH {HEAD}, g AS (SELECT x.example_id, k.c * {WIDE} + j AS param_index, sum(p.p * pow((CASE WHEN p.c = k.c THEN 1 ELSE 0 END - k.p) * v, 2)) AS value
  FROM p JOIN p k ON p.example_id = k.example_id JOIN x ON x.example_id = p.example_id WHERE p.p >= 0.101 GROUP BY ALL)
SELECT example_id, count(*) AS n, round(sqrt(sum(value * value)), 8) AS pef_norm FROM g GROUP BY 1""")
def diagonal_norms_min_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, head, grad = head_of(spark, sf_dir)
    rows = P.make_pefs(x, grad, "diag", head.size, min_prob=0.101).where("pef_norm > 0")
    return rows.select("example_id", F.size(F.filter("values", lambda v: v > 0)).cast("long").alias("n"), F.round("pef_norm", 8).alias("pef_norm"))


FACTORS = f"a AS (SELECT k.example_id, k.c AS class_id, o.c * {WIDE} + x.j AS param_index, sqrt(k.p) * ((CASE WHEN o.c = k.c THEN 1 ELSE 0 END) - o.p) * x.v AS value FROM p k JOIN p o USING (example_id) JOIN x USING (example_id))"


@query(f"""WITH {HEAD}, {FACTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY abs(value) DESC, class_id, param_index) AS rank FROM a),
s AS (SELECT example_id, sum(v * v) AS xx FROM x GROUP BY 1), n AS (SELECT a.example_id, sqrt(sum(pow((CASE WHEN a.c = b.c THEN a.p ELSE 0 END) - a.p * b.p, 2))) AS f FROM p a JOIN p b USING (example_id) GROUP BY 1)
SELECT r.example_id, class_id, param_index, round(value, 9) AS value, round(f * xx, 8) AS pef_norm FROM r JOIN s USING (example_id) JOIN n USING (example_id) WHERE rank <= 8""")
def low_rank_pefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, grad = head_of(spark, sf_dir)
    rows = P.make_pefs(x, grad, "lrm", 8)
    return M.pefs_to_long(rows).join(rows.select("example_id", "pef_norm"), "example_id").select("example_id", "class_id", "param_index", F.round("value", 9).alias("value"), F.round("pef_norm", 8).alias("pef_norm"))


@query(f"""WITH {HEAD}, y AS (SELECT example_id, c, p, rank - 1 AS class_id, count(*) FILTER (p >= 0.1005 AND rank <= 3) OVER (PARTITION BY example_id) AS n FROM q), w AS (SELECT * FROM y WHERE class_id < 3 AND p >= 0.1005),
a AS (SELECT k.example_id, k.class_id, o.c * {WIDE} + x.j AS param_index, sqrt(k.p) * ((CASE WHEN o.c = k.c THEN 1 ELSE 0 END) - o.p) * x.v AS value FROM w k JOIN p o USING (example_id) JOIN x USING (example_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY abs(value) DESC, class_id, param_index) AS rank FROM a)
SELECT e.vec_id AS example_id, CAST(coalesce(n, 0) AS INTEGER) AS rank, param_index, class_id, round(value, 9) AS value FROM embeddings e LEFT JOIN (SELECT DISTINCT example_id, n FROM y) c ON c.example_id = e.vec_id JOIN (SELECT * FROM r WHERE rank <= 6) t ON t.example_id = e.vec_id""")
def variable_rank_pefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, head, grad = head_of(spark, sf_dir)
    rows = cut(P.make_pefs(x, grad, "lvrm", 6, max_classes=3, min_prob=0.1005))
    long = M.pefs_to_long(rows).select("example_id", F.col("class_id").cast("long").alias("class_id"), "param_index", F.round("value", 9).alias("value"))
    return rows.select("example_id", "rank").join(long, "example_id")


@query()
def sampled_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, head, grad = head_of(spark, sf_dir)
    return P.dsf_of(x, grad, x.count(), "sampled", seed=7)


@query()
def callback_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a user's function, here a head with a bias, written, read again and cut to the two largest values."""
    x, head, _ = head_of(spark, sf_dir)
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"

    def with_bias(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return P.linear_class_gradients(np.concatenate([f, np.ones((len(f), 1))], 1), np.concatenate([head, np.zeros((len(head), 1))], 1))

    S.write_pefs(P.make_pefs(x, with_bias, "diag", 12), path)
    return S.read_pefs(spark, path, n_values=2).select("example_id", "indices", "values", "pef_norm")


@query(f"""WITH {HEAD}, b1 AS (SELECT example_id, label, j, v FROM x UNION ALL SELECT DISTINCT example_id, label, {WIDE}, CAST(1 AS DOUBLE) FROM x),
d AS (SELECT example_id, c * ({WIDE} + 1) + j AS param_index, p * (1 - p) * v * v AS value FROM p JOIN b1 USING (example_id, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY value DESC, param_index) AS rank, sqrt(sum(value * value) OVER (PARTITION BY example_id)) AS norm FROM d)
SELECT example_id, rank, param_index, round(value, 9) AS value, round(norm, 8) AS pef_norm FROM r WHERE rank <= 2""")
def callback_record_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``callback_records``, an entry a row."""
    e = callback_records(spark, sf_dir).select("example_id", "pef_norm", F.posexplode(F.arrays_zip("indices", "values")).alias("pos", "e"))
    return e.select("example_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("e.indices").alias("param_index"), F.round("e.values", 9).alias("value"), F.round("pef_norm", 8).alias("pef_norm"))


@query(f"""WITH {HEAD}, u AS (SELECT example_id, c, sum(p) OVER (PARTITION BY example_id ORDER BY c) AS upto, ((example_id * 7) % 11 + 0.5::DOUBLE) / 11 AS u, count(*) OVER (PARTITION BY example_id) AS n FROM p),
s AS (SELECT example_id, least(count(*) FILTER (upto <= u), max(n) - 1) AS c FROM u GROUP BY 1)
SELECT k.c * {WIDE} + j AS param_index, round(sum(pow((CASE WHEN s.c = k.c THEN 1 ELSE 0 END - k.p) * v, 2)) / (SELECT count(*) FROM embeddings), 9) AS fisher FROM s JOIN p k USING (example_id) JOIN x USING (example_id) GROUP BY 1""")
def drawn_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data-set Fisher of sampled classes by draws that SQL can state."""
    x, head, grad = head_of(spark, sf_dir)
    draw = ((F.col("example_id") * 7) % 11 + 0.5) / 11
    return P.dsf_of(x, grad, x.count(), "sampled", draw=draw).withColumn("fisher", F.round("fisher", 9))


@query(ORACLE_SQL["dataset_fisher"])
def dataset_fisher_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data-set Fisher written and read again."""
    path = f"{shared_dir(spark)}/dsf-{uuid.uuid4().hex}"
    S.write_dsf(dataset_fisher(spark, sf_dir), path)
    return S.read_dsf(spark, path)


@query(f"WITH {HEAD} SELECT example_id, label, c AS class_id, round(z, 8) AS logit FROM z")
def record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and logits written with records and read without these."""
    x, head, grad = head_of(spark, sf_dir)
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    S.write_pefs(P.make_pefs(x, grad, "diag", 8).select("example_id", "indices", "values", "pef_norm").join(P.linear_logits(x, head).select("example_id", "label", "logits"), "example_id"), path)
    return S.read_columns(spark, path, "label", "logits").select("example_id", "label", F.posexplode("logits").alias("class_id", "logit")).withColumn("logit", F.round("logit", 8))


@query("SELECT o_orderkey AS example_id, o_orderpriority AS priority FROM orders ORDER BY o_orderkey LIMIT 1200 OFFSET 100")
def loaded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of a registered task, skipping its first examples."""
    path = f"{shared_dir(spark)}/task-{uuid.uuid4().hex}"
    read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("priority")).write.parquet(f"{path}/train.parquet")
    S.REGISTRY["orders"] = path
    return S.load_examples(spark, "orders", "train", 1200, 100)


@query("SELECT vec_id AS example_id FROM embeddings ORDER BY vec_id LIMIT 50")
def baseline_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.baseline_examples(examples(spark, sf_dir), 50)


# The matrix.

ORDERS = "a AS (SELECT l_orderkey AS example_id, l_partkey AS param_index, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
PRUNED = f"{ORDERS}, kept AS (SELECT param_index, row_number() OVER (ORDER BY param_index) - 1 AS col FROM (SELECT param_index FROM a GROUP BY 1 HAVING count(*) >= 30)), m AS (SELECT example_id, col, value FROM a JOIN kept USING (param_index))"


@query(f"WITH {PRUNED} SELECT * FROM m")
def prune_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prune_columns(order_matrix(spark, sf_dir), 30)[0].select("example_id", "col", "value")


@query(f"WITH {ORDERS}, k AS (SELECT param_index FROM a GROUP BY 1 HAVING count(*) >= 30 UNION SELECT p_partkey FROM part WHERE p_size = 7) SELECT param_index, row_number() OVER (ORDER BY param_index) - 1 AS col FROM k")
def column_map_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    force = read(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("param_index"))
    return M.prune_columns(order_matrix(spark, sf_dir), 30, force)[1].select("param_index", "col")


@query(f"WITH {ORDERS}, n AS (SELECT example_id, sqrt(sum(value * value)) AS norm FROM a GROUP BY 1), k AS (SELECT p_partkey AS param_index, row_number() OVER (ORDER BY p_partkey) - 1 AS col FROM part WHERE p_size <= 10) SELECT example_id, col, round(value / (norm + 1e-9), 9) AS diagonal, round(value / greatest(sqrt(norm), 1e-12), 9) AS low_rank FROM a JOIN n USING (example_id) JOIN k USING (param_index)")
def retain_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = order_matrix(spark, sf_dir)
    keep = S.number_rows(read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("param_index")), ["param_index"], "col")
    norms, own = P.d_norms(a), M.retain_columns(a, keep)
    both = M.normalize_d(own.withColumn("raw", F.col("value")), norms).withColumnRenamed("value", "diagonal").withColumnRenamed("raw", "value")
    return M.normalize_lrm(both, norms).select("example_id", "col", F.round("diagonal", 9).alias("diagonal"), F.round("value", 9).alias("low_rank"))


@query(f"WITH {ORDERS} SELECT count(DISTINCT example_id) AS n_rows, count(DISTINCT param_index) AS n_cols, count(*) AS nnz, round(count(*) / (count(DISTINCT example_id) * count(DISTINCT param_index)), 12) AS density, round(sum(value * value), 3) AS sq_norm FROM a")
def matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = order_matrix(spark, sf_dir)
    return M.matrix_stats(a).withColumn("density", F.round("density", 12)).withColumn("sq_norm", F.round(F.lit(M.sq_norm(a)), 3))


@query("""WITH e AS (SELECT l_orderkey AS row, l_partkey AS col FROM lineitem)
SELECT 'column out of range' AS violation, row, col FROM e WHERE col < 0 OR col >= 150 UNION ALL SELECT 'row out of range', row, col FROM e WHERE NOT (col < 0 OR col >= 150) AND (row < 0 OR row >= 1000)
UNION ALL SELECT 'repeated entry', row, col FROM e GROUP BY row, col HAVING count(*) > 1""")
def validate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.validate_matrix(read(spark, sf_dir, "lineitem"), 1000, 150, "l_orderkey", "l_partkey")


@query("WITH a AS (SELECT l_orderkey AS example_id, l_linenumber AS c, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), g AS (SELECT a.example_id, a.c, b.c AS c2, sum(a.v * b.v) AS dot FROM a JOIN a b USING (example_id, k) GROUP BY ALL) SELECT example_id, round(sqrt(sum(dot * dot)), 6) AS pef_norm FROM g GROUP BY 1")
def low_rank_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lrm_norms(order_matrix(spark, sf_dir, by_line=True)).withColumn("pef_norm", F.round("pef_norm", 6))


@query("WITH a AS (SELECT l_orderkey AS example_id, l_linenumber AS c, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), g AS (SELECT a.example_id, a.c, b.c AS c2, sum(a.v * b.v) AS dot FROM a JOIN a b USING (example_id, k) GROUP BY ALL) SELECT CAST(sum(dot * dot) AS DOUBLE) AS tr_xx, CAST(2 * sum(dot * dot) + sum(dot * dot) FILTER (c = c2) AS DOUBLE) AS legacy FROM g")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cut(order_matrix(spark, sf_dir, by_line=True).withColumnRenamed("param_index", "col"))
    return spark.createDataFrame([(M.tr_xx(a), M.tr_xx(a, legacy=True))], "tr_xx double, legacy double")


@query("SELECT vec_id AS row, j AS col, v AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE abs(v) > 0.2")
def threshold_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    return M.threshold_to_sparse(dense, 0.2)


# F1-F16: factorisations, from starting values that SQL can state.

R = 3


def _lcg(key: str, k: str) -> str:
    return f"(({key} * 7 + 3 * {k}) % 11 + 1) / 11.0::DOUBLE"


FIT = f"{PRUNED}, k AS (SELECT unnest(range({R})) AS k), w0 AS (SELECT example_id, k, {_lcg('example_id', 'k')} AS w FROM (SELECT DISTINCT example_id FROM m), k), h0 AS (SELECT col, k, {_lcg('col', 'k')} AS h FROM kept, k)"


def _fit_step(i: int) -> str:
    """The CTEs of step i of a diagonal fit."""
    return f""", hh{i} AS (SELECT a.k, b.k AS l, sum(a.h * b.h) AS g FROM h{i} a JOIN h{i} b USING (col) GROUP BY ALL),
n{i} AS (SELECT example_id, k, sum(value * h) AS n FROM m JOIN h{i} USING (col) GROUP BY ALL),
d{i} AS (SELECT example_id, l AS k, sum(w * g) AS d FROM w{i} JOIN hh{i} USING (k) GROUP BY ALL),
w{i + 1} AS (SELECT example_id, k, w * coalesce(n, 0) / (d + 1e-8) AS w FROM w{i} LEFT JOIN n{i} USING (example_id, k) JOIN d{i} USING (example_id, k)),
ww{i} AS (SELECT a.k, b.k AS l, sum(a.w * b.w) AS g FROM w{i + 1} a JOIN w{i + 1} b USING (example_id) GROUP BY ALL),
o{i} AS (SELECT col, k, sum(value * w) AS n FROM m JOIN w{i + 1} USING (example_id) GROUP BY ALL),
e{i} AS (SELECT col, l AS k, sum(h * g) AS d FROM h{i} JOIN ww{i} USING (k) GROUP BY ALL),
h{i + 1} AS (SELECT col, k, h * coalesce(n, 0) / (d + 1e-8) AS h FROM h{i} LEFT JOIN o{i} USING (col, k) JOIN e{i} USING (col, k))"""


def pruned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(M.prune_columns(order_matrix(spark, sf_dir), 30)[0])


def exploded(df: DataFrame, key: str, column: str, digits: int) -> DataFrame:
    cells = df.select(key, F.posexplode(column).alias("component", "value"))
    return cells.select(key, F.col("component").cast("long").alias("component"), F.round("value", digits).alias("value"))


@query(f"WITH {FIT}{_fit_step(0)}{_fit_step(1)} SELECT example_id, k AS component, round(w, 5) AS value FROM w2")
def fit_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(X.fit_d(pruned_orders(spark, sf_dir), R, 2, init="lcg")[0], "example_id", "w", 5)


@query(f"WITH {FIT}{_fit_step(0)} SELECT col, k AS component, round(h, 5) AS value FROM h1".replace(f"{_lcg('example_id', 'k')} AS w", f"CASE WHEN example_id % 2 = 0 THEN (k + 1) / 2.0::DOUBLE ELSE {_lcg('example_id', 'k')} END AS w"))
def fit_diagonal_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of a step from coefficients that are given for every other example."""
    a = pruned_orders(spark, sf_dir)
    given = a.where("example_id % 2 = 0").select("example_id", F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5)).alias("w")).distinct()
    return exploded(X.fit_d(a, R, 1, init="lcg", init_w=given)[1], "col", "h", 5)


@query(f"""WITH {FIT}{_fit_step(0)}, g AS (SELECT a.k, b.k AS l, sum(a.h * b.h) AS g FROM h1 a JOIN h1 b USING (col) GROUP BY ALL)
SELECT 'fit' AS phase, 1 AS step, round(sqrt((SELECT sum(value * value) FROM m) + (SELECT sum(w.g * g.g) FROM ww0 w JOIN g USING (k, l)) - 2 * (SELECT sum(n * h) FROM o0 JOIN h1 USING (col, k))), 4) AS loss""")
def fit_diagonal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.losses_frame(spark, X.fit_d(pruned_orders(spark, sf_dir), R, 1, init="lcg")[2]).withColumn("loss", F.round("loss", 4))


@query(ORACLE_SQL["fit_diagonal"])
def fit_diagonal_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of ``fit_diagonal`` as two calls on one folder: the second goes on after the step that the first noted."""
    a, path = pruned_orders(spark, sf_dir), f"{shared_dir(spark)}/fit-{uuid.uuid4().hex}"
    X.fit_d(a, R, 1, init="lcg", log=path)
    return exploded(X.fit_d(a, R, 2, init="lcg", log=path)[0], "example_id", "w", 5)


def _coeff_step(i: int) -> str:
    return f""", d{i} AS (SELECT example_id, l AS k, sum(w * g) AS d FROM w{i} JOIN hh USING (k) GROUP BY ALL),
w{i + 1} AS (SELECT example_id, k, w * coalesce(n, 0) / (d + 1e-7) AS w FROM w{i} LEFT JOIN n USING (example_id, k) JOIN d{i} USING (example_id, k))"""


FROZEN = ", hh AS (SELECT a.k, b.k AS l, sum(a.h * b.h) AS g FROM h0 a JOIN h0 b USING (col) GROUP BY ALL), n AS (SELECT example_id, k, sum(value * h) AS n FROM m JOIN h0 USING (col) GROUP BY ALL)"


@query(f"WITH {FIT}{FROZEN}{_coeff_step(0)}{_coeff_step(1)}{_coeff_step(2)} SELECT example_id, k AS component, round(w, 6) AS value FROM w3")
def fit_coefficients_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pruned_orders(spark, sf_dir)
    h = X.init_factors(a.select("col").distinct(), "col", R, "h", "lcg")
    return exploded(X.fit_coeffs_d(a, h, R, 3, init="lcg")[0], "example_id", "w", 6)


LOW = f"""l AS (SELECT l_orderkey AS example_id, l_linenumber AS c, l_partkey AS col, sum(l_quantity) / 50.0 AS value FROM lineitem GROUP BY ALL), k AS (SELECT unnest(range({R})) AS k),
g0 AS (SELECT col, k, {_lcg('col', 'k')} * 0.01 AS g FROM (SELECT DISTINCT col FROM l), k), w0 AS (SELECT example_id, k, {_lcg('example_id', 'k')} AS w FROM (SELECT DISTINCT example_id FROM l), k)"""


def _low_products(i: int) -> str:
    return f""", ag{i} AS (SELECT example_id, c, k, sum(value * g) AS v FROM l JOIN g{i} USING (col) GROUP BY ALL), gg{i} AS (SELECT a.k, b.k AS l, sum(a.g * b.g) AS g FROM g{i} a JOIN g{i} b USING (col) GROUP BY ALL),
num{i} AS (SELECT example_id, k, sum(v * v) AS n FROM ag{i} GROUP BY ALL)"""


def _low_g(i: int, w: str, ortho: float = 0.0, moving: int = R) -> str:
    """The CTE of G after a step of its first ``moving`` components with W of table ``w``."""
    more = f" + {ortho} * any_value(q.g - CASE WHEN a.k = b.k THEN 2.0 / {R} ELSE 0 END)" if ortho else ""
    return f""", s{i} AS (SELECT a.k, b.k AS l, sum(a.w * b.w) * any_value(q.g){more} AS s FROM {w} a JOIN {w} b USING (example_id) JOIN gg{i} q ON q.k = a.k AND q.l = b.k GROUP BY ALL),
t{i} AS (SELECT col, k, sum(value * w * v) AS t FROM l JOIN ag{i} USING (example_id, c) JOIN {w} USING (example_id, k) GROUP BY ALL),
u{i} AS (SELECT col, l AS k, sum(g * s) AS u FROM g{i} JOIN s{i} USING (k) GROUP BY ALL),
g{i + 1} AS (SELECT col, k, g - CASE WHEN k < {moving} THEN 4 * 1e-4 * (u - t) ELSE 0 END AS g FROM g{i} JOIN t{i} USING (col, k) JOIN u{i} USING (col, k))"""


def _low_w(i: int, j: int, moving: int = R) -> str:
    """The CTE of W after its step number i + 1, of its first ``moving`` components, with the products j."""
    return f""", d{j} AS (SELECT example_id, l AS k, sum(w * g * g) AS d FROM w{i} JOIN gg{j} USING (k) GROUP BY ALL),
w{i + 1} AS (SELECT example_id, k, CASE WHEN k < {moving} THEN w * n / (d + 1e-9) ELSE w END AS w FROM w{i} JOIN num{j} USING (example_id, k) JOIN d{j} USING (example_id, k))"""


LOW_W = _low_w(0, 1)
LOW_TRACE = "(SELECT sum(dot * dot) FROM (SELECT a.example_id, a.c, b.c AS c2, sum(a.value * b.value) AS dot FROM l a JOIN l b USING (example_id, col) GROUP BY ALL))"


def low_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(order_matrix(spark, sf_dir, by_line=True).withColumnRenamed("param_index", "col").withColumn("value", F.col("value") / 50.0))


def low_start(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = X.init_factors(a.select("example_id").distinct(), "example_id", R, "w", "lcg")
    return w, X.init_factors(a.select("col").distinct(), "col", R, "h", "lcg", scale=0.01)


@query(f"WITH {LOW}{_low_products(0)}{_low_g(0, 'w0')}{_low_products(1)}{LOW_W}{_low_g(1, 'w1')} SELECT col, k AS component, round(g, 6) AS value FROM g2")
def fit_low_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = low_orders(spark, sf_dir)
    w, g = low_start(a)
    return exploded(X.fit_lrm(a, R, 1, 1, lr=1e-4, init_w=w, init_g=g)[1], "col", "h", 6)


@query(f"WITH {LOW}{_low_products(0)}{_low_g(0, 'w0')}{_low_products(1)}{LOW_W} SELECT example_id, k AS component, round(w, 4) AS value FROM w1")
def fit_low_rank_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients of the fit of ``fit_low_rank``."""
    a = low_orders(spark, sf_dir)
    w, g = low_start(a)
    return exploded(X.fit_lrm(a, R, 1, 1, lr=1e-4, init_w=w, init_g=g)[0], "example_id", "w", 4)


@query(f"WITH {LOW}{_low_products(0)}{_low_g(0, 'w0', ortho=50.0)} SELECT col, k AS component, round(g, 6) AS value FROM g1")
def fit_low_rank_ortho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step with the regulariser that keeps components apart."""
    a = low_orders(spark, sf_dir)
    w, g = low_start(a)
    return exploded(X.fit_lrm(a, R, 1, 0, lr=1e-4, ortho=50.0, init_w=w, init_g=g)[1], "col", "h", 6)


@query(f"""WITH {LOW}{_low_products(0)}{_low_g(0, 'w0')}{_low_products(1)}, ww AS (SELECT a.k, b.k AS l, sum(a.w * b.w) AS s FROM w0 a JOIN w0 b USING (example_id) GROUP BY ALL)
SELECT 'g_only' AS phase, 1 AS step, round({LOW_TRACE} + (SELECT sum(s * g * g) FROM ww JOIN gg1 USING (k, l)) - 2 * (SELECT sum(w * n) FROM w0 JOIN num1 USING (example_id, k)), 3) AS loss""")
def fit_low_rank_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = low_orders(spark, sf_dir)
    w, g = low_start(a)
    return X.losses_frame(spark, X.fit_lrm(a, R, 1, 0, lr=1e-4, init_w=w, init_g=g)[2]).withColumn("loss", F.round("loss", 3))


@query(f"WITH {LOW}{_low_products(0)}{_low_g(0, 'w0', moving=2)}{_low_products(1)}{_low_w(0, 1, 2)}{_low_g(1, 'w1', moving=2)}{_low_products(2)}{_low_w(1, 2)}{_low_g(2, 'w2', moving=2)} SELECT col, k AS component, round(g, 6) AS value FROM g3")
def expand_dictionary_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components added to a frozen one, a step of each phase, from a start that SQL can state."""
    a = low_orders(spark, sf_dir)
    w, g = low_start(a)
    new, old = g.select("col", F.slice("h", 1, 2).alias("h")), g.select("col", F.slice("h", 3, 1).alias("h"))
    return exploded(X.expand_dictionary(a, old, 1, 2, 1, 1, 1, lr=1e-4, init_new=new, init_w=w)[1], "col", "h", 6)


@query(f"""WITH {LOW}{_low_products(0)}, hh AS (SELECT k, l, g * g AS g FROM gg0), d0 AS (SELECT example_id, l AS k, sum(w * g) AS d FROM w0 JOIN hh USING (k) GROUP BY ALL), w1 AS (SELECT example_id, k, w * n / (d + 1e-9) AS w FROM w0 JOIN num0 USING (example_id, k) JOIN d0 USING (example_id, k)),
d1 AS (SELECT example_id, l AS k, sum(w * g) AS d FROM w1 JOIN hh USING (k) GROUP BY ALL) SELECT example_id, k AS component, round(w * n / (d + 1e-9), 4) AS value FROM w1 JOIN num0 USING (example_id, k) JOIN d1 USING (example_id, k)""")
def fit_coefficients_low_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = low_orders(spark, sf_dir)
    return exploded(X.fit_coeffs_lrm(a, low_start(a)[1], R, 2, init="lcg")[0], "example_id", "w", 4)


@query()
def expand_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = low_orders(spark, sf_dir)
    w, g = low_start(a)
    return exploded(X.expand_dictionary(a, g, R, 2, 1, 1, 1, lr=1e-4, w_frozen=w)[1], "col", "h", 6)


@query()
def fit_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(X.fit_stiefel(low_orders(spark, sf_dir), R, 2, lr=1e-4)[1], "col", "h", 6)


def _cayley(i: int) -> str:
    """The CTEs of a step of one component of norm 1: W, its gradient d, and G moved along the Cayley curve with a 2 x 2 inverse."""
    return f""", v{i} AS (SELECT example_id, c, sum(value * g) AS v FROM l JOIN g{i} USING (col) GROUP BY ALL), n{i} AS (SELECT example_id, sum(v * v) AS n FROM v{i} GROUP BY 1), q{i} AS (SELECT sum(g * g) AS q FROM g{i}),
w{i + 1} AS (SELECT example_id, w * n / (w * q * q + 1e-9) AS w FROM w{i} JOIN n{i} USING (example_id), q{i}), s{i} AS (SELECT sum(w * w) * any_value(q) AS s FROM w{i + 1}, q{i}),
t{i} AS (SELECT col, sum(value * w * v) AS t FROM l JOIN v{i} USING (example_id, c) JOIN w{i + 1} USING (example_id) GROUP BY 1), d{i} AS (SELECT col, g, 4 * (g * s - t) AS d FROM g{i} JOIN t{i} USING (col), s{i}),
x{i} AS (SELECT *, (1 + 5e-5 * gd) * (1 - 5e-5 * gd) + 5e-5 * gg * 5e-5 * dd AS det FROM (SELECT sum(g * g) AS gg, sum(g * d) AS gd, sum(d * d) AS dd FROM d{i})),
g{i + 1} AS (SELECT col, g - 1e-4 * (d * ((1 - 5e-5 * gd) * gg + 5e-5 * gg * gd) + g * (5e-5 * dd * gg - (1 + 5e-5 * gd) * gd)) / det AS g FROM d{i}, x{i})"""


@query(f"""WITH l AS (SELECT l_orderkey AS example_id, l_linenumber AS c, l_partkey AS col, sum(l_quantity) / 50.0 AS value FROM lineitem GROUP BY ALL), w0 AS (SELECT DISTINCT example_id, {_lcg('example_id', '0')} AS w FROM l),
start AS (SELECT DISTINCT col, {_lcg('col', '0')} AS g FROM l), g0 AS (SELECT col, g / sqrt(sum(g * g) OVER ()) AS g FROM start){_cayley(0)}{_cayley(1)} SELECT col, 0 AS component, round(g, 6) AS value FROM g2""".replace("0 AS component", "CAST(0 AS BIGINT) AS component"))
def fit_orthonormal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Cayley steps of a single component, whose linear system SQL can state."""
    a = low_orders(spark, sf_dir)
    w = X.init_factors(a.select("example_id").distinct(), "example_id", 1, "w", "lcg")
    g = X.init_factors(a.select("col").distinct(), "col", 1, "h", "lcg")
    return exploded(X.fit_stiefel(a, 1, 2, lr=1e-4, init_w=w, init_g=g)[1], "col", "h", 6)


@query(f"""WITH w AS (SELECT o_orderkey AS example_id, k, {_lcg('o_orderkey', 'k')} AS x FROM orders, (SELECT unnest(range({R})) AS k)), l AS (SELECT 0.5 * sqrt(count(*)) AS l1 FROM orders),
s AS (SELECT k, x, row_number() OVER o AS m, sum(x) OVER o AS s, sum(x * x) OVER o AS q FROM w WINDOW o AS (PARTITION BY k ORDER BY x DESC, example_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN q - s * s / m > 1e-12 * q THEN sqrt(greatest(1 - l1 * l1 / m, 0) / (q - s * s / m)) ELSE 0 END AS grow FROM s, l),
c AS (SELECT k, arg_max(grow, m) AS grow, arg_max(s / m, m) AS mean, arg_max(l1 / m, m) AS mid FROM g WHERE m >= l1 * l1 AND l1 / m + grow * (x - s / m) > 0 GROUP BY k)
SELECT example_id, k AS component, round(greatest(mid + grow * (x - mean), 0), 6) AS value FROM w JOIN c USING (k)""")
def hoyer_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.init_factors(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id")), "example_id", R, "w", "lcg")
    n = w.count()
    return exploded(X.hoyer_project(w, R, 0.5 * float(np.sqrt(n))), "example_id", "w", 6)


PARTS = f"h AS (SELECT p_partkey AS col, k, {_lcg('p_partkey', 'k')} AS h FROM part, (SELECT unnest(range({R})) AS k)), norm AS (SELECT k, sqrt(sum(h * h)) AS n FROM h GROUP BY 1)"


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.init_factors(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("col")), "col", R, "h", "lcg")


@query(f"""WITH {PARTS}, a0 AS (SELECT col, h FROM h WHERE k = 0), q0 AS (SELECT col, h / (SELECT sqrt(sum(h * h)) FROM a0) AS v FROM a0),
a1 AS (SELECT col, h - v * (SELECT sum(h * v) FROM h JOIN q0 USING (col) WHERE k = 1) AS h FROM h JOIN q0 USING (col) WHERE k = 1), q1 AS (SELECT col, h / (SELECT sqrt(sum(h * h)) FROM a1) AS v FROM a1),
a2 AS (SELECT col, h - q0.v * (SELECT sum(h * v) FROM h JOIN q0 USING (col) WHERE k = 2) - q1.v * (SELECT sum(h * v) FROM h JOIN q1 USING (col) WHERE k = 2) AS h FROM h JOIN q0 USING (col) JOIN q1 USING (col) WHERE k = 2), q2 AS (SELECT col, h / (SELECT sqrt(sum(h * h)) FROM a2) AS v FROM a2)
SELECT col, 0 AS component, round(v, 8) AS value FROM q0 UNION ALL SELECT col, 1, round(v, 8) FROM q1 UNION ALL SELECT col, 2, round(v, 8) FROM q2""".replace("0 AS component", "CAST(0 AS BIGINT) AS component"))
def orthonormal_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of an orthonormal fit."""
    return exploded(X.orthonormalize(part_dictionary(spark, sf_dir), R), "col", "h", 8)


@query(f"WITH {PARTS} SELECT k AS component, col, round(h / (n + 1e-12), 9) AS value FROM h JOIN norm USING (k) WHERE h / (n + 1e-12) >= 0.8 / sqrt((SELECT count(*) FROM part))")
def sparsify_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cut(part_dictionary(spark, sf_dir))
    cells = X.sparsify_dictionary(h.select(F.col("col").alias("example_id"), F.col("h").alias("w")), h, R, 0.8 / float(np.sqrt(h.count())))[1]
    return cells.select(F.col("component").cast("long").alias("component"), "col", F.round("value", 9).alias("value"))


@query(f"WITH {PARTS} SELECT col AS param_index, round(h * (n * n + 1e-12), 4) AS coeff, round(h / (n + 1e-12), 9) AS value FROM h JOIN norm USING (k) WHERE k = 1")
def normalize_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cut(part_dictionary(spark, sf_dir))
    w, g = X.normalize_lrm_components(h.select(F.col("col").alias("example_id"), F.col("h").alias("w")), h, R)
    own = T.component_vector(g, h.select("col", F.col("col").alias("param_index")), 1)
    return own.join(w.withColumnRenamed("example_id", "param_index"), "param_index").select("param_index", F.round(F.col("w")[1], 4).alias("coeff"), F.round("value", 9).alias("value"))


@query(f"WITH {PARTS} SELECT CAST(a.k AS INTEGER) AS k1, CAST(b.k AS INTEGER) AS k2, round(abs(sum(a.h * b.h)) / ((any_value(x.n) + 1e-12) * (any_value(y.n) + 1e-12)), 8) AS sim FROM h a JOIN h b USING (col) JOIN norm x ON x.k = a.k JOIN norm y ON y.k = b.k GROUP BY a.k, b.k")
def component_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.component_similarity(part_dictionary(spark, sf_dir), R).withColumn("sim", F.round("sim", 8))


@query(f"""WITH {PARTS}, a AS (SELECT x.col, x.h - y.h * (SELECT sum(p.h * q.h) FROM h p JOIN h q USING (col) WHERE p.k = 0 AND q.k = 1) / (SELECT n * n FROM norm WHERE k = 1) AS v FROM h x JOIN h y USING (col) WHERE x.k = 0 AND y.k = 1),
b AS (SELECT a.col, v - y.h * (SELECT sum(v * q.h) FROM a JOIN h q USING (col) WHERE q.k = 2) / (SELECT n * n FROM norm WHERE k = 2) AS v FROM a JOIN h y USING (col) WHERE y.k = 2)
SELECT col, round(v / (sqrt((SELECT sum(v * v) FROM b)) + 1e-12), 8) AS value FROM b""")
def orthogonal_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.orthogonal_reject(part_dictionary(spark, sf_dir), R, 0, 1.0).withColumn("value", F.round("value", 8))


@query(f"WITH {PARTS} SELECT CAST(k AS INTEGER) AS component, col, round(h / (n + 1e-12), 9) AS value FROM h JOIN norm USING (k) WHERE k IN (0, 2)")
def decomposition_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse dictionary written by component and read again for two of them."""
    h = cut(part_dictionary(spark, sf_dir))
    path = f"{shared_dir(spark)}/decomposition-{uuid.uuid4().hex}"
    w, cells = X.sparsify_dictionary(h.select(F.col("col").alias("example_id"), F.col("h").alias("w")), h, R, 0.0)
    S.write_decomposition(path, {"coefficients": w, "dictionary": cells})
    return S.read_decomposition(spark, path, ["dictionary"], [0, 2])["dictionary"].select("component", "col", F.round("value", 9).alias("value"))


@query(f"WITH {PARTS} SELECT CAST(k AS INTEGER) AS component, col, round(h, 9) AS value FROM h WHERE k IN (0, 2)")
def select_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = part_dictionary(spark, sf_dir).select("col", F.posexplode("h").alias("component", "value"))
    return T.select_components(cells, [0, 2]).select("component", "col", F.round("value", 9).alias("value"))


@query(f"""WITH {PARTS}, c AS (SELECT b.k, sum(a.h * b.h) / ((any_value(x.n) + 1e-12) * (any_value(y.n) + 1e-12)) AS sim FROM h a JOIN h b USING (col) JOIN norm x ON x.k = a.k JOIN norm y ON y.k = b.k WHERE a.k = 0 AND b.k > 0 GROUP BY b.k)
SELECT col, round(h / (n + 1e-12), 8) AS value FROM h JOIN norm USING (k) WHERE k = 0 AND (SELECT min(abs(sim)) FROM c) > 0.3""")
def orthogonal_reject_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is rejected where all other components are more similar than the bound."""
    return T.orthogonal_reject(part_dictionary(spark, sf_dir), R, 0, 0.3).withColumn("value", F.round("value", 8))


# Reading components.

#: The flagship: diagonal records, pruned and normalised, fitted for three steps to the mean records of the labels.
TOP = f"""WITH {HEAD}, d AS (SELECT example_id, label, c * {WIDE} + j AS col, p * (1 - p) * v * v AS value FROM p JOIN x USING (example_id, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY value DESC, col) AS rank, sqrt(sum(value * value) OVER (PARTITION BY example_id)) AS norm FROM d),
m AS (SELECT example_id, label, col, value / (norm + 1e-9) AS value FROM r WHERE rank <= 32),
h0 AS (SELECT label AS k, col, sum(value) / (SELECT count(*) FROM embeddings e WHERE e.label = m.label) AS h FROM m GROUP BY label, col),
w0 AS (SELECT vec_id AS example_id, k, CAST(1 AS DOUBLE) AS w FROM embeddings, (SELECT DISTINCT k FROM h0)){FROZEN}{_coeff_step(0)}{_coeff_step(1)}{_coeff_step(2)}"""


@query(f"{TOP} SELECT k AS component, row_number() OVER (PARTITION BY k ORDER BY w DESC, example_id) AS rank, example_id, round(w, 5) AS coeff FROM w3 QUALIFY rank <= 5")
def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which examples represent each component best?"""
    return T.top_examples(_label_coefficients(spark, sf_dir), 5).select("component", F.col("rank").cast("long").alias("rank"), "example_id", F.round("coeff", 5).alias("coeff"))


def _label_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, head, grad = head_of(spark, sf_dir)
    rows = cut(P.make_pefs(x, grad, "diag", 32))
    a = cut(M.normalize_d(M.pefs_to_long(rows), rows).select("example_id", "class_id", F.col("param_index").alias("col"), "value"))
    n, r = x.groupBy("label").agg(F.count("*").alias("n")), len(head)
    means = a.join(x.select("example_id", "label"), "example_id").groupBy("label", "col").agg(F.sum("value").alias("s")).join(F.broadcast(n), "label")
    h = means.groupBy("col").agg(F.array(*(F.sum(F.when(F.col("label") == k, F.col("s") / F.col("n")).otherwise(0.0)) for k in range(r))).alias("h"))
    return X.fit_coeffs_d(a, cut(h), r, 3, init="const", header=x)[0]


def document_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "n_chars")
    return docs.select("example_id", F.array(*(((F.col("n_chars") * 7 + 3 * k) % (101 + k)).cast("double") for k in range(R))).alias("w"))


DOC_W = f"w AS (SELECT doc_id AS example_id, k, CAST((n_chars * 7 + 3 * k) % (101 + k) AS DOUBLE) AS w FROM documents, (SELECT unnest(range({R})) AS k)), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, example_id) AS rank FROM w)"


@query(f"""WITH {DOC_W} SELECT CAST(k AS INTEGER) AS component, CAST(rank AS INTEGER) AS rank, t.example_id, round(w, 4) AS coeff, ['bad', 'good'][quality + 1] AS label_name, ['bad', 'good'][CASE WHEN 1 - toxic > toxic THEN 1 ELSE 2 END] AS predicted_name, lang
FROM t JOIN labels l ON l.doc_id = t.example_id JOIN documents d ON d.doc_id = t.example_id WHERE rank <= 50""")
def describe_top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), F.col("quality").alias("label"), F.array((1 - F.col("toxic")).cast("double"), F.col("toxic").cast("double")).alias("logits"))
    raw = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "lang")
    return T.describe_top_examples(T.top_examples(document_weights(spark, sf_dir), 50), logits, raw, ("bad", "good")).select("component", "rank", "example_id", "coeff", "label_name", "predicted_name", "lang")


@query(f"WITH {DOC_W} SELECT CAST(k AS INTEGER) AS component, CAST((rank - 1) // 4 AS INTEGER) AS row, CAST((rank - 1) % 4 AS INTEGER) AS col, example_id FROM t WHERE rank <= 12")
def top_examples_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_examples_grid(document_weights(spark, sf_dir), 3, 4)


# Perturbations.


@query(f"""{TOP}, t AS (SELECT k AS component, example_id FROM w3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY w DESC, example_id) <= 20),
chosen AS (SELECT component, example_id, true AS top FROM t UNION ALL SELECT c, vec_id, false FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 50), (SELECT DISTINCT c FROM b)),
size AS (SELECT c AS component, sqrt(sum(m * m)) AS size FROM b GROUP BY c),
y AS (SELECT component, sign, example_id, top, label, c, z AS og, z + CASE WHEN c = component THEN sign * 2.0 * z / size ELSE 0 END AS lg FROM chosen JOIN z USING (example_id) JOIN size USING (component), (VALUES (1), (-1)) s(sign)),
f AS (SELECT *, exp(lg) / sum(exp(lg)) OVER o AS pn, exp(og) / sum(exp(og)) OVER o AS po FROM y WINDOW o AS (PARTITION BY component, sign, example_id, top)),
e AS (SELECT component, sign, top, label, sum(greatest(pn, 1e-7) * ln(greatest(pn, 1e-7) / greatest(po, 1e-7))) AS kl, arg_max(c, [lg, -c]) AS now, arg_max(c, [og, -c]) AS was FROM f GROUP BY component, sign, example_id, top, label),
by_sign AS (SELECT component, sign, avg(kl) FILTER (top) / avg(kl) FILTER (NOT top) AS ratio, avg(CASE WHEN now = label THEN 1.0 ELSE 0.0 END) FILTER (top) AS acc, avg(CASE WHEN was = label THEN 1.0 ELSE 0.0 END) FILTER (top) AS og FROM e GROUP BY ALL)
SELECT CAST(component AS INTEGER) AS component, round(max(ratio), 6) AS kl_ratio, round(max(acc), 6) AS accuracy, round(max(og), 6) AS og_accuracy FROM by_sign GROUP BY 1""")
def perturbation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves the head along each label's centroid, and compares the top examples with the first 50."""
    x, head, _ = head_of(spark, sf_dir)
    top = T.top_examples(_label_coefficients(spark, sf_dir), 20).select("component", "example_id", F.lit(True).alias("is_top"))
    base = T.baseline_examples(x, 50)
    all_ = base.select(F.explode(F.sequence(F.lit(0), F.lit(len(head) - 1))).alias("component"), "example_id", F.lit(False).alias("is_top"))
    directions = np.stack([np.eye(len(head))[k][:, None] * head[k] / np.linalg.norm(head[k]) for k in range(len(head))])
    told = E.perturbation_report(E.evaluate_perturbations(top.union(all_).join(x, "example_id"), head, directions, 2.0))
    return told.select("component", *(F.round(c, 6).alias(c) for c in ("kl_ratio", "accuracy", "og_accuracy")))


@query(ORACLE_SQL["perturbation_report"])
def perturbation_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``perturbation_report`` from sums by component and sign that the tasks make."""
    x, head, _ = head_of(spark, sf_dir)
    top = T.top_examples(_label_coefficients(spark, sf_dir), 20).select("component", "example_id").join(x, "example_id")
    directions = np.stack([np.eye(len(head))[k][:, None] * head[k] / np.linalg.norm(head[k]) for k in range(len(head))])
    told = E.summed_report(top, T.baseline_examples(x, 50).join(x, "example_id"), head, directions, 2.0)
    return told.select("component", *(F.round(c, 6).alias(c) for c in ("kl_ratio", "accuracy", "og_accuracy")))


@query(f"WITH {HEAD}, g AS (SELECT c * {WIDE} + j AS param_index, sum((CASE WHEN c = label THEN 1 ELSE 0 END - p) * v) AS s FROM p JOIN x USING (example_id, label) GROUP BY 1) SELECT param_index, sign(round(s, 9)) AS sign FROM g".replace("sign(round(s, 9))", "CAST(sign(s) AS DOUBLE)"))
def sign_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, grad = head_of(spark, sf_dir)
    return E.sign_of(x, grad)


@query("""WITH t AS (SELECT p_partkey AS param_index, p_retailprice AS theta, p_size AS f, CASE WHEN p_size % 3 = 0 THEN p_size * 2.0 END AS h, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS s FROM part),
n AS (SELECT *, greatest(f / (sqrt(sum(f * f) OVER ()) + 1e-12), 1e-6) * 0.7 AS w1, coalesce(h, 0) / (sqrt(sum(h * h) OVER ()) + 1e-12) * 0.3 AS w2 FROM t)
SELECT param_index, round((w1 * theta + w2 * (theta - 0.5 * s)) / (w1 + w2), 6) AS theta FROM n""")
def fisher_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "param_index")
    sign = part.select("param_index", F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    h = part.where("p_size % 3 = 0").select("param_index", (F.col("p_size") * 2.0).alias("value"))
    dsf = part.select("param_index", F.col("p_size").cast("double").alias("fisher"))
    return E.fisher_merge(part.select("param_index", F.col("p_retailprice").alias("theta")), sign, dsf, h, 0.5, 0.3).withColumn("theta", F.round("theta", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS param_index, CASE WHEN l_partkey < 64 THEN 'kernel' WHEN l_partkey < 100 THEN 'bias' ELSE 'head' END AS variable, CASE WHEN l_partkey < 64 THEN l_partkey WHEN l_partkey < 100 THEN l_partkey - 64 ELSE l_partkey - 100 END AS local_index FROM lineitem WHERE l_partkey >= 0 AND l_partkey < 1000000")
def locate_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head reaches to the largest part key, so every row is located; the SQL ends at 1,000,000, beyond all keys of the test tables."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("param_index"))
    last = rows.agg(F.max("param_index")).first()[0]
    layout = spark.createDataFrame([("kernel", 0, 64), ("bias", 64, 100), ("head", 100, max(100, last or 0) + 1)], "variable string, start long, end long")
    return E.locate_params(rows, layout)
