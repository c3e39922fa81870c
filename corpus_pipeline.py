"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and mixing, each over all that the one before kept.

All stages take nulls in any column, texts that are empty or very long, repeated rows, empty tables (which give empty tables) and further columns
of any name; all but the last give the columns that they got, and further columns pass through with their values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pefloom.llm import decontaminate, linededup, mix, neardup, toxicity
from pefloom.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the labelled ones among them, doesn't reject.

    Null and empty texts, and all texts where no document is labelled, are never rejected. A score of exactly 0.5 is. Repeated rows share their fate.
    Columns named like the score's own are set aside meanwhile.
    """
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    aside = {c: f"{c}-{uuid.uuid4().hex}" for c in docs.columns if c.lower() in ("score", "predicted")}
    kept = toxicity.score(docs.withColumnsRenamed(aside), model).where("predicted = 0")
    return kept.select(*(F.col(f"`{aside[c]}`").alias(c) if c in aside else c for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat earlier ones; a document of which no line with words stays goes.

    First is the least (doc_id, line number), null ids before others. Documents without words stay. Repeated rows share their decisions, so
    they all keep a line of which they are the first.
    """
    return linededup.dedup_lines(docs, drop_empty=True)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id and, at a tie, least hash of the text.

    Rows that repeat that one stay with it. Rows with a null doc_id and texts without words are near to nothing and stay.
    """
    return neardup.drop_near(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of benchmark items; a document that is nearly all such passages goes.

    Null and empty texts stay, and all documents where the benchmark is empty. Repeated rows share their fate.
    """
    return decontaminate.remove_hits(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A row for every row of ``docs``, whatever its doc_id; those without words take none. A null source is a source, last in order.
    """
    return mix.taken_words(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
]

#: Learned scores, SimHash and seeded permutations have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage is written to the shared folder as Parquet and read again by the next."""
    docs, base = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
