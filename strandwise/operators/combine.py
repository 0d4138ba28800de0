"""Results of parts put together: additive columns are summed, derived ones made anew from the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def shares(df: DataFrame, value: str, name: str, scale: float = 1.0) -> DataFrame:
    """A column's share of its total, times a scale; nothing is shared out of a total of zero."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.coalesce(F.try_divide(F.col(value) * F.lit(scale), F.col("__total").cast("double")), F.lit(0.0))).drop("__total")  # one row


def metrics(parts: DataFrame, additive: set[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, value): additive metrics are summed, the others kept where all parts agree, else ``mixed``."""
    number = F.sum(F.when(F.col(metric).isin(*additive), F.expr(f"try_cast({value} as double)")).otherwise(F.lit(0.0)))
    found = parts.groupBy(metric).agg(number.alias("__sum"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    whole = F.when(F.col("__sum") == F.floor("__sum"), F.col("__sum").cast("long").cast("string")).otherwise(F.col("__sum").cast("string"))
    other = F.when(F.col("__low").eqNullSafe(F.col("__high")), F.col("__low")).otherwise(F.lit("mixed"))
    return found.select(metric, F.when(F.col(metric).isin(*additive), whole).otherwise(other).alias(value))


def correlations(parts: DataFrame, keys: list[str], total: DataFrame, scale: float = 1e6) -> DataFrame:
    """(keys, raw, opportunities, value, percent, per_million) of parts (keys, raw, opportunities); ``total`` has one row (total) of all parts' signal."""
    whole = summed(parts, keys, ["raw", "opportunities"]).withColumn("value", F.coalesce(F.try_divide(F.col("raw").cast("double"), F.col("opportunities")), F.lit(0.0)))
    both = shares(whole, "value", "percent", 100.0).crossJoin(F.broadcast(total.select(F.col("total").cast("double").alias("__t"))))  # one row
    return both.withColumn("per_million", F.coalesce(F.try_divide(F.col("raw") * F.lit(scale), F.col("__t") * F.col("__t")), F.lit(0.0))).drop("__t")


def run_lengths(parts: DataFrame, length: str = "length", n: str = "n") -> DataFrame:
    """One row of quantiles of run lengths from the parts' counts, put together first."""
    from .spacing import run_summary

    return run_summary(summed(parts, [length], [n]), length, n)


def headers(contigs: DataFrame, source: str = "source", order: str = "ord", chrom: str = "chrom", length: str = "length") -> DataFrame:
    """(ord, chrom, length): one header of several files'. Spellings of a contig are one, with ``chr`` where any has it.

    A contig of two lengths, or a file with two spellings of one, is an error when the result is computed.
    """
    from ..functions.contigs import contig_key

    found = contigs.withColumn("__key", contig_key(F.col(chrom)))
    files = found.groupBy("__key", source).agg(F.count_distinct(chrom).alias("names"), F.min(order).alias("first"))
    twice = files.groupBy("__key").agg(F.max("names").alias("names"), F.min(F.struct(source, "first")).alias("at"))
    one = found.groupBy("__key").agg(F.min(length).alias("low"), F.max(length).alias(length), F.min_by(chrom, F.struct(~F.lower(chrom).startswith("chr"), F.col(source), F.col(order))).alias(chrom))
    both = one.join(twice, "__key")
    told = F.raise_error(F.concat(F.lit("contig with two lengths or spellings: "), F.col(chrom))).cast("long")
    return both.select(F.col("at").alias(order), chrom, F.when((F.col("low") != F.col(length)) | (F.col("names") > 1), told).otherwise(F.col(length)).alias(length))
