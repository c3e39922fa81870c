"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; only where it is unset and all of Spark is in one process, as in tests, one of
    this machine. Unset on a cluster, it is an error."""
    sc = spark.sparkContext
    if (d := sc.getCheckpointDir()) is None:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        d = d or tempfile.mkdtemp(prefix="pefloom-")
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, without its lineage: it outlives executors and is computed once.

    The driver then collects its garbage, so that Spark's cleaner drops the shuffle files that only the lineage needed.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def release(df: DataFrame) -> None:
    """Removes the files of ``df``, which ``cut`` made and nothing reads any more."""
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        Folder(df.sparkSession, path.get()).remove()


class Folder:
    """A folder of the shared file system, whichever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at)) if self.fs.exists(self.at) else []

    def sub(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def remove(self) -> None:
        self.fs.delete(self.at, True)

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        """A small file, there as a whole or not at all."""
        draft = self.sub(f"_{name}")
        out = draft.fs.create(draft.at)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(draft.at, self.sub(name).at):
            raise OSError(f"cannot write {self.path}/{name}")


class Steps:
    """The tables of a loop in a folder that the cluster shares, and a log of its last finished step.

    ``keep`` writes a table and reads it again. ``finish`` notes a step with the tables that the next one needs, all at once in one small file,
    and removes every other table, so the folder holds two steps at most: the noted one and the one in the making. A loop that gets the folder of
    one that was lost goes on after the step noted last (``last``). ``of`` says what the loop computes; the folder of another loop is an error. Only one loop
    at a time may use a folder. Without a folder, one of a new name is taken, and the tables of the last step stay in it as the result.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, **of):
        self.spark, self.of = spark, json.loads(json.dumps(of))
        base = Folder(spark, path or f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}")
        self.tables, self.log, self.at = base.sub("tables"), base.sub("log"), {}

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.tables.path}/{self.at[name][0]}")

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        file = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.tables.path}/{file}")
        self.at[name] = file, df.schema.json()
        return self._read(name, df.schema)

    def finish(self, step: int, names: list[str], losses: list) -> None:
        """Notes that ``step`` is finished and that the tables ``names`` are its state."""
        own = {n: self.at[n] for n in names}
        self.log.write(f"{step:09d}", json.dumps({"of": self.of, "step": step, "tables": own, "losses": losses}))
        for old in self.log.names():
            if old != f"{step:09d}":
                self.log.sub(old).remove()
        held = {file for file, _ in own.values()}
        for file in self.tables.names():
            if file not in held:
                self.tables.sub(file).remove()
        self.spark.sparkContext._jvm.System.gc()

    def last(self) -> tuple[int, dict[str, DataFrame], list[tuple]] | None:
        """The step noted last, its tables and losses; None where none is noted."""
        noted = [n for n in self.log.names() if n.isdigit()]
        if not noted:
            return None
        note = json.loads(self.log.read(noted[-1]))
        if note["of"] != self.of:
            raise ValueError(f"the steps in {self.log.path} are of another loop: {note['of']}")
        self.at.update({n: tuple(t) for n, t in note["tables"].items()})
        return note["step"], {n: self._read(n, StructType.fromJson(json.loads(t[1]))) for n, t in note["tables"].items()}, [tuple(x) for x in note["losses"]]
