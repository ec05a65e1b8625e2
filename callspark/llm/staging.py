"""Tables written out between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a written table, as rows in memory, up to which a join may broadcast it.
BROADCAST_BYTES = 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on a local master (tests), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark, "_callspark_folder", None) or tempfile.mkdtemp(prefix="spark-callspark-")
        spark._callspark_folder = folder
    return folder.rstrip("/")


def _row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory."""
    total = F.lit(16 + 8 * len(schema)).cast("long")
    for field in schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            total += F.coalesce(F.size(F.col(field.name)), F.lit(0)) * 8
        elif isinstance(field.dataType, T.StructType):
            total += 8 * len(field.dataType)
    return total


def packed(docs: DataFrame) -> DataFrame:
    """(row, at_id, at_hash, text): the given columns as one, so that none of them has a name that an operator uses."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("at_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("at_hash", F.xxhash64("text"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from its packed rows."""
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


#: Stages begun inside ``passing`` by this thread; runs of other threads have a list of their own.
_watched: ContextVar[list[Stage] | None] = ContextVar("stages of a run", default=None)


class Stage:
    """Writes tables under one folder of a run and reads them back; a step that is superseded can go.

    Reading back cuts the lineage, survives the loss of executors, and gives sizes that are known: ``rows`` of
    what was written, and ``side`` for the way a join should take it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str, dict]] = {}
        watched = _watched.get()
        if watched is not None:
            watched.append(self)

    def write(self, df: DataFrame, name: str, **counts) -> DataFrame:
        """``df``, written and read again; ``counts`` are more aggregates to have of its rows."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        seen = Observation()
        more = {"rows": F.count(F.lit(1)), "bytes": F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0))} | counts
        df.observe(seen, *(v.alias(k) for k, v in more.items())).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path, seen.get)
        return out

    def rows(self, table: DataFrame) -> int:
        return self.counted(table)["rows"]

    def counted(self, table: DataFrame) -> dict:
        return self.paths[id(table)][2]

    def small(self, table: DataFrame) -> bool:
        return self.counted(table)["bytes"] <= BROADCAST_BYTES

    def side(self, table: DataFrame, made: DataFrame | None = None) -> DataFrame:
        """``made`` (rows of ``table`` at most) with the hint to broadcast it if ``table`` is small, else to merge."""
        return (table if made is None else made).hint("broadcast" if self.small(table) else "merge")

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads, and lets Spark's cleaner find the shuffle files of ended steps."""
        for table in tables:
            self._delete(self.paths.pop(id(table))[1])
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Removes the run's folder, when its result has been written."""
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing() -> Iterator[None]:
    """Removes, at its end, the folders of all stages that began inside; their results must have been written by then."""
    stages: list[Stage] = []
    outer = _watched.set(stages)
    try:
        yield
    finally:
        _watched.reset(outer)
        for stage in stages:
            stage.clear()
