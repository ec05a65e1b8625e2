"""Positions of rows within their key, and runs of equal keys, when one key may hold any share of the rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callspark.llm.staging import Stage


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from the row's before; the first row counts as a change. Null equals null."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for key in keys:
        codes = pc.dictionary_encode(table[key].combine_chunks(), null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches that are sorted by these keys; a run is held as a whole."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        at = np.flatnonzero(_changes(table, keys))
        for first, last in zip(at[:-1], at[1:]):
            yield table.slice(first, last - first)
        held = table.slice(at[-1])
    if held is not None:
        yield held


def _count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, reached, leading = TaskContext.get().partitionId(), None, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = _changes(pa.Table.from_batches([batch]), ["key"])
        keys = batch.column(batch.schema.get_field_index("key"))
        if last is not None:
            change[0] = keys[0].as_py() != last[0]
        first = np.flatnonzero(change)
        begins = np.zeros(n, dtype=np.int64)
        begins[first] = first
        begins = np.maximum.accumulate(begins)
        at = np.arange(n) - begins
        head = int(first[0]) if len(first) else n
        at[:head] += reached
        lead = np.zeros(n, dtype=bool)
        if last is None:  # the first batch: its first key leads
            lead[: int(first[1]) if len(first) > 1 else n] = True
            leading = len(first) <= 1
        elif leading:
            lead[:head] = True
            leading = head == n
        last, reached = (keys[n - 1].as_py(),), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(n, part)), pa.array(lead)], names=[*batch.schema.names, "at", "part", "lead"])


def numbered(stage: Stage, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``at``, each row's place (from 0) among the rows of its ``key`` in the given order, nulls first.

    Rows are dealt out by ranges of (key, order), so one key with a third of all rows is spread over a third of
    the tasks; each task counts its own, and what a key had in earlier tasks is added afterwards. Only that
    correction, a row a partition at most, goes through the driver. Rows that tie in all of ``order`` get some
    order among themselves. ``df`` must have neither ``at``, ``part`` nor ``lead``.
    """
    spark = df.sparkSession
    by = [F.col("key").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType(df.schema.fields[:]).add("at", "long").add("part", "long").add("lead", "boolean")
    counted = stage.write(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_count_off, schema), name)
    leads = counted.where("lead").groupBy("part", "key").count()
    leads = sorted(leads.collect(), key=lambda r: r.part)
    shift = []
    if len(leads) > 1:
        of = spark.createDataFrame([(x,) for x in {r.key for r in leads}], f"of {df.schema['key'].dataType.simpleString()}")
        tails = counted.where("not lead").join(F.broadcast(of), F.col("key").eqNullSafe(F.col("of")), "left_semi")
        before: dict = defaultdict(int, {r.key: r["count"] for r in tails.groupBy("key").count().collect()})
        for r in leads:
            if before[r.key]:
                shift.append((r.part, before[r.key]))
            before[r.key] += r["count"]
    out = counted
    if shift:
        moved = spark.createDataFrame(shift, "of_part long, shift long")
        out = out.join(F.broadcast(moved), F.col("part") == F.col("of_part"), "left")
        out = out.withColumn("at", F.expr("at + if(lead, coalesce(shift, 0L), 0L)"))
    return out.select(*df.columns, "at")
