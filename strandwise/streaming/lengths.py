"""Fragments as a stream: counts by length that grow, and copies that are dropped as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_lengths(fragments: DataFrame) -> DataFrame:
    """Counts by contig and length of an unbounded table; the state is one row for each of them. Write it in complete or update mode."""
    return fragments.groupBy("chrom", (F.col("e") - F.col("s")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def first_copies(fragments: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first fragment of equal coordinates within the watermark's delay; later state goes as the watermark moves."""
    return fragments.withWatermark(time, delay).dropDuplicatesWithinWatermark(["chrom", "s", "e"])
