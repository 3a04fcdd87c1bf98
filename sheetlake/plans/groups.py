"""Solving many small groups per task in Arrow: no call, and no exchange, per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray | list]
#: Rows of results that leave a task together.
LOT = 20_000


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new group begins; nulls are equal to each other."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        code = pc.dictionary_encode(table.column(key).combine_chunks())
        code = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of rows that hold whole groups only, with the starts of the groups."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        here = here if held is None else pa.concat_tables([held, here])
        starts = group_starts(here, keys)
        held = here.slice(starts[-1])
        if len(starts) > 1:
            yield here.slice(0, starts[-1]), starts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _plain(column: pa.ChunkedArray) -> np.ndarray | list:
    if pa.types.is_nested(column.type) or pa.types.is_string(column.type):
        return column.to_pylist()
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def solve_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], solve: Callable[[Columns], Columns], schema: str
) -> DataFrame:
    """``solve`` for every group of ``keys``, its rows sorted by ``order``; groups must fit one task.

    ``solve`` takes the columns of one group and returns those of its result.  A task sorts its rows and
    passes over them once, so a group costs a slice and a call, whatever the number of groups.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = list(keys)
    fields = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Columns] = []
        size = 0

        def lot() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.asarray(x[f]) for x in out])) for f in fields], fields
            )

        for table, starts in whole_groups(batches, names):
            columns = {c: _plain(table.column(c)) for c in table.column_names}
            for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
                found = solve({c: x[lo:hi] for c, x in columns.items()})
                if len(found[fields[0]]):
                    out.append(found)
                    size += len(found[fields[0]])
                if size >= LOT:
                    yield lot()
                    out, size = [], 0
        if out:
            yield lot()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def scan_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object],
    step: Callable[[object, Columns], tuple[object, Columns]], schema: str,
) -> DataFrame:
    """Pass over the sorted rows of every group, a stretch at a time, with a state carried from one to the next.

    For decisions that depend on all rows before.  A group may be larger than a task's memory: only its
    state and one stretch are held.  ``step`` takes the state and the columns of a stretch of one group and
    returns the new state and the result's columns.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = list(keys)
    fields = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
            columns = {c: _plain(table.column(c)) for c in table.column_names}
            starts = group_starts(table, names)
            out: list[Columns] = []
            for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
                key = tuple(table.column(c)[int(lo)].as_py() for c in names)
                if last is None or key != last[0]:
                    last, state = (key,), start()
                state, found = step(state, {c: x[lo:hi] for c, x in columns.items()})
                out.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.asarray(x[f]) for x in out])) for f in fields], fields
            )

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
