"""What several operators share: connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.plans.lineage import Folder, cut, shared_dir

__all__ = ["Folder", "connected_components", "cut", "shared_dir", "with_root"]


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (a, b: two longs); root is the smallest id of its component.

    Alternating large-star and small-star steps over the edge table, each written to the shared folder, until every
    edge leads straight to a root. Nothing but one count per step reaches the driver. Loops and null ends are ignored;
    no edges give no rows.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most):
        ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("low")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 OR up > 0 AND low > 0").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    raise RuntimeError("components did not settle")


def with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the column root of its id; an id without links is its own root."""
    return members.join(roots.withColumnRenamed("root", "root_"), "id", "left").withColumn("root", F.coalesce("root_", "id")).drop("root_")
