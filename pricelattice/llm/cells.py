"""Bounded cells: rows that meet in one place, handed to a function one cell at a time as they stream by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that one cell holds at most (twice as many where two parts of a bucket meet).
PART = 128


def run_cells(members: DataFrame, columns: list[str], work: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """``a, b`` as returned by ``work`` for the rows of each ``cell``; cells of one row are passed over. A task holds one cell at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, out = [], None, []
        for batch in batches:
            for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", *columns))):
                if cell != name:
                    if len(held) > 1:
                        out += work(held)
                    held, name = [], cell
                held.append(tuple(row))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if len(held) > 1:
            out += work(held)
        yield _pairs(out)

    return members.select("cell", *columns).repartition("cell").sortWithinPartitions("cell", columns[0]).mapInArrow(run, "a bigint, b bigint")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])
