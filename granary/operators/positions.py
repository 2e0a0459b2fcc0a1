"""Rows by position: numbering without a global sort, and slices, lists and masks of positions."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.types import POSITION


def numbered(df: DataFrame, start: int, stage: str, name: str = POSITION) -> tuple[DataFrame, int]:
    """df with consecutive positions from start on, in the order of its partitions, and the number of its rows.

    The rows of each partition are counted, and a row's place in its partition is added to the count of those before.
    A plan without a shuffle is counted and read on its own, the same way twice. Any other is first written under
    ``stage`` with partition and place: adaptive plans deal rows out differently when fewer columns are asked for.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    # the lower 33 bits number the rows of a partition
    place, part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), F.spark_partition_id()
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        df.select(part.alias("__part"), place.alias("__place"), *columns).write.option("compression", "zstd").parquet(stage)
        df = df.sparkSession.read.parquet(stage)
        place, part = F.col("__place"), F.col("__part")
    counts = df.select(part.alias("p")).groupBy("p").count().orderBy("p").collect()  # one row for each partition
    n = np.zeros(counts[-1]["p"] + 1 if counts else 0, np.int64)
    for r in counts:
        n[r["p"]] = r["count"]
    before = (np.cumsum(n) - n + start).tolist()
    # one literal, folded once, however many partitions
    base = F.element_at(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), part + 1) if before else F.lit(start)
    return df.select((base.cast("long") + place).alias(name), *columns), int(n.sum())


def row_number(value: Any, nrows: int) -> int:
    """A position as given, counted from the end if negative."""
    if isinstance(value, bool | np.bool_):
        raise TypeError("a truth value is no position")
    if isinstance(value, tuple):
        raise IndexError("rows have one dimension")
    k = operator.index(value)
    if not -nrows <= k < nrows:
        raise IndexError(f"position {k} is not among {nrows} rows")
    return k + nrows * (k < 0)


def in_slice(rows: slice, nrows: int) -> tuple[Column, bool]:
    """Which positions a slice takes, and whether from the end backwards."""
    if rows.step == 0:
        raise ValueError("the step of a slice cannot be zero")
    start, stop, step = rows.indices(nrows)
    pos = F.col(POSITION)
    got = range(start, stop, step)
    if not got:
        return F.lit(False), step < 0
    low, high = min(got[0], got[-1]), max(got[0], got[-1])
    out = pos.between(low, high)
    if abs(step) > 1:
        out = out & ((pos - low) % abs(step) == 0)
    return out, step < 0


def positions_of(rows: Any, nrows: int) -> list[int]:
    """The positions that a list or a mask asks for, in its order."""
    got = np.asarray(rows)
    if got.ndim != 1:
        raise IndexError("rows have one dimension")
    if got.dtype.kind == "b":
        if len(got) != nrows:
            raise IndexError(f"a mask of {len(got)} does not fit {nrows} rows")
        return np.flatnonzero(got).tolist()
    if len(got) and got.dtype.kind not in "iu":
        raise TypeError("positions are integers")
    return [row_number(int(k), nrows) for k in got]


def taken(df: DataFrame, positions: Sequence[int], ordinal: str = "__ord") -> DataFrame:
    """The rows at positions, as often as each is asked for, with the place of each in the list.

    The list is the caller's own; the scan is also told its bounds, so that files and row groups beyond them are skipped."""
    spark = df.sparkSession
    if not positions:
        return df.where(F.lit(False)).withColumn(ordinal, F.lit(0).cast("long"))
    schema = T.StructType([T.StructField(ordinal, T.LongType()), T.StructField(POSITION, T.LongType())])
    asked = spark.createDataFrame(list(enumerate(positions)), schema)
    near = df.where(F.col(POSITION).between(min(positions), max(positions)))
    return near.join(asked, POSITION)


def chosen(df: DataFrame, rows: Any, nrows: int) -> tuple[DataFrame, list[Column]]:
    """The rows that a slice, list or mask asks for, and what to sort them by."""
    if isinstance(rows, slice):
        where, backwards = in_slice(rows, nrows)
        pos = F.col(POSITION)
        return df.where(where), [pos.desc() if backwards else pos.asc()]
    if isinstance(rows, tuple):
        raise IndexError("rows have one dimension")
    if isinstance(rows, str) or not hasattr(rows, "__len__"):
        raise SchemaError("rows are a slice, a list of positions or a mask")
    return taken(df, positions_of(rows, nrows)), [F.col("__ord").asc()]
