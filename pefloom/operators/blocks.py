"""The sparse matrix in blocks of about as many entries each, and its products with tall dense tables.

A layout deals the entries by one side, columns or rows. The entries of each key of that side are counted, the keys are put in order, and
the running sum of the counts says in which block a key falls, so that blocks hold about ``entries`` entries whatever the keys' counts
are. A block with a hot key is cut into bands by the other side's key: a second key, so that no part of the matrix exceeds its share. A
part is sorted by the other side once and stays where it is; in each product the dense rows of its keys come to it, to each
band of a hot block, and one numpy kernel a part yields a row for each key of the other side instead of sums for every entry.

The driver holds one start and one number of bands for each block, which is as many as entries / ``entries``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pefloom.functions.arrays import vector_sum
from pefloom.plans.lineage import cut, release

#: Entries of a block; small matrices have smaller blocks, of ``LEAST`` entries or more, so that every task has some.
ENTRIES, LEAST, BLOCKS_A_TASK = 1 << 18, 1 << 12, 8
#: A part's number is its block, shifted by so many bits, and its band.
BANDS = 20


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of arrays of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists_of(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(float).ravel()))


def _long(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


class Layout:
    """``a`` (example_id, class_id, col, value) dealt by ``key``, col or example_id."""

    def __init__(self, a: DataFrame, key: str, entries: int = ENTRIES):
        self.key, self.other = key, ["example_id", "class_id"] if key == "col" else ["col"]
        a = a.select(F.col("example_id").cast("long"), F.col("class_id").cast("int"), F.col("col").cast("long"), F.col("value").cast("double"))
        tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = cut(a.groupBy(key).agg(F.count("*").alias("n")).repartitionByRange(tasks, key).sortWithinPartitions(key))
        sums = {r.p: r.n for r in counts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()}  # a row a partition
        total = sum(sums.values())
        share = min(entries, max(LEAST, -(-total // (BLOCKS_A_TASK * tasks)))) if entries == ENTRIES else entries
        before = {p: sum(n for q, n in sums.items() if q < p) for p in sums}

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = before.get(TaskContext.get().partitionId(), 0)
            for b in batches:
                n = b.column(1).to_numpy()
                upto = run + np.cumsum(n)
                run = int(upto[-1]) if len(n) else run
                block = (upto - n) // share
                at = starts_of(block)
                yield pa.record_batch([pa.array(block[at]), b.column(0).take(pa.array(at)), pa.array(np.add.reduceat(n, at) if len(at) else n)], ["block", "first", "n"])

        found = counts.select(F.col(key).cast("long"), "n").mapInArrow(blocks, "block long, first long, n long")
        own = sorted((r["first"], r.n) for r in found.groupBy("block").agg(F.min("first").alias("first"), F.sum("n").alias("n")).collect())
        release(counts)
        self.first = np.array([f for f, _ in own] or [0], np.int64)
        self.bands = np.array([min(-(-n // share), 1 << BANDS) if n > 2 * share else 1 for _, n in own] or [1], np.int64)
        parts = int(self.bands.sum())
        self.tasks = max(1, min(parts, max(tasks, parts // 16)))
        order = ["part", *self.other, *(c for c in ("example_id", "class_id", "col") if c not in self.other)]
        self.rows = a.mapInArrow(self._deal, "example_id long, class_id int, col long, value double, part long").repartition(self.tasks, "part").sortWithinPartitions(*order).persist()

    @property
    def _deal(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        first, bands, own, other = self.first, self.bands, 2 if self.key == "col" else 0, 0 if self.key == "col" else 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = np.clip(np.searchsorted(first, b.column(own).to_numpy(), "right") - 1, 0, None)
                band = (b.column(other).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % bands[block]
                yield pa.record_batch([*b.columns, pa.array(block << BANDS | band)], ["example_id", "class_id", "col", "value", "part"])

        return run

    def placed(self, dense: DataFrame) -> DataFrame:
        """``dense``, whose first column is the key, with the part of each band that its rows go to."""
        first, bands, schema = self.first, self.bands, StructType([*dense.schema.fields, StructField("part", LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = np.clip(np.searchsorted(first, b.column(0).to_numpy(), "right") - 1, 0, None)
                row = np.repeat(np.arange(len(block)), bands[block])
                band = np.arange(len(row)) - np.repeat(np.cumsum(bands[block]) - bands[block], bands[block])
                yield pa.record_batch([*(c.take(pa.array(row)) for c in b.columns), pa.array(block[row] << BANDS | band)], [*b.schema.names, "part"])

        return dense.mapInArrow(run, schema)

    def product(self, dense: DataFrame, column: str, r: int, out: str) -> DataFrame:
        """(other key, out): for each key of the other side the sum over its entries of value * dense vector; dense is (key, [class_id,]
        column). Entries without a dense row count as zero."""
        other, key, by_class = self.other, self.key, "class_id" in dense.columns

        def kernel(entries: pa.Table, rows: pa.Table) -> pa.Table:
            own, value = _long(entries, key), entries.column("value").to_numpy()
            keys, inverse = np.unique(_long(rows, key), return_inverse=True)
            if not len(keys) or not len(own):
                return pa.table({**{c: entries.column(c).slice(0, 0) for c in other}, out: lists_of(np.zeros((0, r)))})
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            there = keys[at] == own
            if by_class:
                n = 1 + max(int(_long(entries, "class_id").max()), int(_long(rows, "class_id").max()))
                code, own = inverse * n + _long(rows, "class_id"), at * n + _long(entries, "class_id")
                order = np.argsort(code)
                at = np.minimum(np.searchsorted(code[order], own), len(order) - 1)
                there &= code[order][at] == own
            else:
                order = np.argsort(inverse, kind="stable")
            x = matrix_of(rows.column(column))[order]
            value = np.where(there, value, 0.0)
            begin = starts_of(*(_long(entries, c) for c in other))
            sums = np.stack([np.add.reduceat(value * x[at, k], begin) for k in range(r)], 1)
            return pa.table({**{c: entries.column(c).take(pa.array(begin)) for c in other}, out: lists_of(sums)})

        schema = ("example_id long, class_id int" if key == "col" else "col long") + f", {out} array<double>"
        parts = self.rows.groupBy("part").cogroup(self.placed(dense).groupBy("part")).applyInArrow(kernel, schema)
        return parts.groupBy(*other).agg(vector_sum(out, r).alias(out))

    def release(self) -> None:
        self.rows.unpersist()
