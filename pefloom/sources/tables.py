"""Readers and writers of the library's tables (S1-S6): Parquet folders keyed by example_id, col or component."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a decomposition consists of, each a folder of its own.
PARTS = ("coefficients", "dictionary", "column_map", "losses")
#: Where example tables lie, by "group/task".
REGISTRY: dict[str, str] = {}


def flavour(pefs: DataFrame) -> str:
    """diag, lrm or lvrm, by the columns."""
    names = set(pefs.columns)
    if not {"example_id", "indices", "values"} <= names:
        raise ValueError(f"not a table of Fisher records: {sorted(names)}")
    return "lvrm" if "col_sizes" in names else "lrm" if "col_offsets" in names else "diag"


#: Up to so many first rows are taken by sorting within each task; more are numbered.
SORTED_ROWS = 1000


def first_rows(df: DataFrame, take: int | None = None, skip: int = 0, key: str = "example_id") -> DataFrame:
    """Rows skip .. skip + take - 1 in the order of ``key``."""
    if take is not None and skip + take <= SORTED_ROWS:
        return df.orderBy(key).offset(skip).limit(take)
    numbered = number_rows(df, [key], "row_number_").where(F.col("row_number_") >= skip)
    return (numbered if take is None else numbered.where(F.col("row_number_") < skip + take)).drop("row_number_")


def read_pefs(spark: SparkSession, path: str, n_examples: int | None = None, n_values: int | None = None) -> DataFrame:
    """Fisher records; the first n_examples by id, and of diagonal ones the n_values largest entries of each."""
    pefs = spark.read.parquet(path)
    kind = flavour(pefs)
    if n_examples is not None:
        pefs = first_rows(pefs, n_examples)
    if n_values is not None:
        if kind != "diag":
            raise ValueError("n_values is for diagonal records, whose values fall")
        pefs = pefs.withColumns({"values": F.slice("values", 1, n_values), "indices": F.slice("indices", 1, n_values)})
    return pefs


def write_pefs(pefs: DataFrame, path: str, partitions: int | None = None) -> None:
    flavour(pefs)
    by = ("example_id",) if partitions is None else (partitions, "example_id")
    pefs.repartitionByRange(*by).write.mode("overwrite").parquet(path)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """example_id and the named columns, for instance logits or label, of a table of records."""
    return spark.read.parquet(path).select("example_id", *columns)


def write_decomposition(path: str, parts: dict[str, DataFrame]) -> None:
    """A folder for each part; a sparse dictionary (component, col, value) is partitioned by component."""
    for name, df in parts.items():
        if name not in PARTS:
            raise ValueError(f"unknown part {name}")
        out = df.write.mode("overwrite")
        (out.partitionBy("component") if name == "dictionary" and "component" in df.columns else out).parquet(f"{path}/{name}")


def read_decomposition(spark: SparkSession, path: str, parts: Sequence[str] = PARTS, components: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """The named parts; ``components`` reads only these partitions of a sparse dictionary, or these entries of a dense one."""
    out = {p: spark.read.parquet(f"{path}/{p}") for p in parts}
    if components is not None and "dictionary" in out:
        d = out["dictionary"]
        dense = lambda: d.withColumn("h", F.array(*(F.col("h")[c] for c in components)))
        out["dictionary"] = d.where(F.col("component").isin(list(components))) if "component" in d.columns else dense()
    return out


def read_dsf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("param_index", "fisher")


def write_dsf(dsf: DataFrame, path: str) -> None:
    dsf.select("param_index", "fisher").write.mode("overwrite").parquet(path)


def load_examples(spark: SparkSession, task: str, split: str, take: int | None = None, skip: int = 0) -> DataFrame:
    """The table of a registered task's split (``REGISTRY[task]/split.parquet``); take and skip count rows by example_id."""
    if task not in REGISTRY:
        raise KeyError(f"no task {task}; known: {sorted(REGISTRY)}")
    df = spark.read.parquet(f"{REGISTRY[task]}/{split}.parquet")
    return df if take is None and not skip else first_rows(df, take, skip)


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` plus a dense number from 0 in the order of ``order``, without a single task for all rows.

    Rows are ranged by the order, numbered within each range, and each range starts where the smaller ones end. The ranges
    are fixed before they are counted.
    """
    from pefloom.plans.lineage import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n_"))  # a row for each partition
    starts = sizes.withColumn("start_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.withColumn("at_", within).join(F.broadcast(starts), "range_").withColumn(name, (F.col("at_") + F.col("start_")).cast("long")).drop("range_", "at_", "start_")


class Kind(NamedTuple):
    """What records or a dictionary were made of: diag, lrm or lvrm, and the model's numbers of parameters and classes; -1 classes where the rank varies."""

    flavour: str
    n_parameters: int
    n_classes: int


def kind_of(pefs: DataFrame, n_parameters: int) -> Kind:
    """The kind of records in row form."""
    name = flavour(pefs)
    first = pefs.select("col_offsets").first() if name == "lrm" else None
    return Kind(name, n_parameters, {"diag": 1, "lvrm": -1}.get(name, len(first[0]) - 1 if first else -1))


def write_kind(spark: SparkSession, path: str, kind: Kind) -> None:
    """Keeps the kind beside the table of records or the decomposition at ``path``."""
    spark.createDataFrame([kind], "flavour string, n_parameters long, n_classes int").coalesce(1).write.mode("overwrite").parquet(f"{path}.kind")


def read_kind(spark: SparkSession, path: str) -> Kind:
    return Kind(*spark.read.parquet(f"{path}.kind").select("flavour", "n_parameters", "n_classes").first())


def check_agreement(records: Kind, dictionary: Kind) -> None:
    """An error where records don't go with a dictionary: other parameters, diagonal against low-rank, or other classes where both have a fixed number."""
    if records.n_parameters != dictionary.n_parameters:
        raise ValueError(f"records of {records.n_parameters} parameters against a dictionary of {dictionary.n_parameters}")
    if (records.flavour == "diag") != (dictionary.flavour == "diag"):
        raise ValueError(f"records of kind {records.flavour} against a dictionary of kind {dictionary.flavour}")
    if records.n_classes != dictionary.n_classes and -1 not in (records.n_classes, dictionary.n_classes):
        raise ValueError(f"records of {records.n_classes} classes against a dictionary of {dictionary.n_classes}")
