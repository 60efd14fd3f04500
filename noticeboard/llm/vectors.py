"""What the operators on vectors share: which rows are kept, exact integers, sums by cell over all tasks.

Kept are vectors without null, NaN or infinite entries. An entry of 2^40 or more in size counts as infinite, since sums
of its integer couldn't be exact. Vectors of another length than most of them have (of equally many, the longer) count as lacking
entries and go too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import ship

LIMIT = 2.0**40
SCALE = 1024
#: integers whose squares and sums over a batch fit a long
SAFE = 1 << 27


def kept(df: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """The rows of df that are kept, and their vectors' length (0 without any)."""
    c = f"`{vec_col}`"
    kind = df.schema[vec_col].dataType
    if getattr(kind, "elementType", None) is None or kind.elementType.simpleString() not in ("float", "double"):
        df = df.withColumn(vec_col, F.col(c).cast("array<double>"))
    whole = df.filter(f"{c} is not null and forall({c}, x -> x is not null and abs(x) < {LIMIT:.1f}D)")
    most = whole.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    return whole.filter(F.size(c) == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) the vectors of a batch as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def scaled(x: np.ndarray, shift: int = 0) -> np.ndarray:
    """floor(1024 * x) + shift, exactly."""
    return np.floor(x * SCALE).astype(np.int64) + shift


def fitting(x: np.ndarray) -> np.ndarray:
    """x itself where its squares can be added up in longs, else as Python's integers."""
    return x if not x.size or np.abs(x).max() < SAFE else x.astype(object)


def sums(df: DataFrame, columns: list[str], start: Callable, add: Callable, *, exact: bool) -> dict[int, int | float]:
    """Sums by cell over all rows: each task adds up its batches, then Spark adds up the tasks' cells.

    start() makes a task's state, add(state, batch) changes it; a state is an array whose places are the cells. The
    number of cells must have a bound, since they go to the driver. exact: integers of any size, else doubles.
    """
    ship(df.sparkSession)
    kind, value = ("decimal(38,0)", pa.decimal128(38, 0)) if exact else ("double", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for b in batches:
            if b.num_rows:
                add(state, b)
        flat = state.reshape(-1)
        at = np.flatnonzero(flat)
        values = pa.array([Decimal(int(v)) for v in flat[at]], value) if exact else pa.array(flat[at])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), values], names=["cell", "value"])

    cells = df.select(*columns).mapInArrow(run, f"cell bigint, value {kind}")
    rows = cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    return {r["cell"]: int(r["value"]) if exact else r["value"] for r in rows}
