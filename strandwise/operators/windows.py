"""Windows of one width over a track: blocks of the track as arrays, the windows that begin in a block as rows of a matrix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a block, and values of all the windows that one group of rows has, or that one matrix holds.
BLOCK, GROUP_VALUES, MATRIX_VALUES = 1 << 16, 8_000_000, 1_000_000


def over_windows(windows: DataFrame, track: DataFrame, width: int, work: Callable[[np.ndarray, pa.Table], pa.Table], schema: str, block: int = BLOCK) -> DataFrame:
    """``work`` of the values of the windows (rows of a matrix, zero without signal) and their rows, put together.

    ``windows`` has chrom, s (the first base) and any other columns; the track is in run-length form. A track's run
    goes to the blocks that see it, so no pair of window and run is made; blocks with many windows are dealt to groups.
    """
    placed = windows.where("chrom is not null and s is not null").withColumn("__block", F.floor(F.col("s") / F.lit(block)))
    most = placed.groupBy("chrom", "__block").count().agg(F.max("count")).first()[0] or 0
    groups = -(-most * width // GROUP_VALUES) or 1
    dealt = placed.withColumn("__group", F.pmod(F.xxhash64(*windows.columns), F.lit(groups)).cast("int"))
    low, high = F.floor((F.col("start") - (width - 1)) / F.lit(block)), F.floor((F.col("end") - 1) / F.lit(block))
    runs = track.where((F.col("value") != 0) & (F.col("end") > F.col("start"))).select("chrom", "start", "end", F.col("value").cast("double").alias("value"), F.explode(F.sequence(low, high)).alias("__block"))
    if groups > 1:
        runs = runs.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        runs = runs.withColumn("__group", F.lit(0))
    span, rows = block + width - 1, max(1, MATRIX_VALUES // width)

    def worked(key: tuple, own: pa.Table, seen: pa.Table) -> pa.Table:
        base = key[1].as_py() * block
        values = np.zeros(span)
        if own.num_rows:
            a = np.clip(seen["start"].to_numpy() - base, 0, span)
            n = np.clip(seen["end"].to_numpy() - base, 0, span) - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            values[at] = np.repeat(seen["value"].to_numpy(), n)
        every = np.lib.stride_tricks.sliding_window_view(values, width)
        first = own["s"].to_numpy() - base
        return pa.concat_tables([work(every[first[i:i + rows]], own.slice(i, rows)) for i in range(0, max(own.num_rows, 1), rows)])

    return dealt.groupBy("chrom", "__block", "__group").cogroup(runs.groupBy("chrom", "__block", "__group")).applyInArrow(worked, schema)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def turned(rows: np.ndarray, table: pa.Table, strand: str = "strand") -> np.ndarray:
    """The windows on minus strands from their end to their start."""
    minus = np.array([x == "-" for x in table[strand].to_pylist()], bool)
    rows[minus] = rows[minus, ::-1]
    return rows
