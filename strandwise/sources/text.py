"""Readers and writers of interval text: BED and its kin, tables with headings, bedGraph and WIG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contigs import bed_score, contig_key


def interval_rows(spark: SparkSession, paths: str | list[str], columns: dict[str, int] | None = None, strict: bool = True) -> DataFrame:
    """(source, chrom, s, e, further columns by 1-based position as strings); gzip files are read as they are.

    Blank, comment, track and browser lines are skipped; a line is cut at tabs if it has one, else at white space.
    Intervals are zero-based and half-open. Broken lines raise an error that shows them, or are left out if not strict.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("source"), F.rtrim("value").alias("line"))
    lines = lines.where("line <> ''").where(~F.col("line").rlike(r"^\s*(#|track(\s|$)|browser(\s|$))"))
    parts = F.when(F.col("line").contains("\t"), F.split("line", "\t")).otherwise(F.split(F.trim("line"), r"\s+"))
    lines = lines.withColumn("parts", parts)
    number = lambda k: F.expr(f"try_cast(try_element_at(parts, {k}) as bigint)")
    rows = lines.select("source", "line", F.try_element_at("parts", F.lit(1)).alias("chrom"), number(2).alias("s"), number(3).alias("e"), *[F.try_element_at("parts", F.lit(k)).alias(n) for n, k in (columns or {}).items()])
    good = F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("s") >= 0) & (F.col("e") > F.col("s"))
    if strict:
        told = F.raise_error(F.concat(F.lit("no interval: "), F.col("line"))).cast("long")
        return rows.withColumn("s", F.when(good, F.col("s")).otherwise(told)).drop("line")
    return rows.where(F.coalesce(good, F.lit(False))).drop("line")


def fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_id, chrom, s, e): fragments of several files, numbered in the order given, with one key for each contig."""
    out = None
    for i, path in enumerate(paths, 1):
        rows = interval_rows(spark, path).select(F.lit(i).alias("source_id"), contig_key(F.col("chrom")).alias("chrom"), "s", "e")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no fragment files")
    return out


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, length): contigs of a table of sizes; ``ord`` keeps their order (byte place in the one small file)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").where(~F.col("value").startswith("#"))
    return rows.select(F.monotonically_increasing_id().alias("ord"), parts[0].alias("chrom"), parts[1].cast("long").alias("length"))


def headed(spark: SparkSession, path: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns of a tab-separated table with headings, found under any of their names, whatever case and marks they have."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    plain = lambda text: "".join(c if c.isalnum() else "_" for c in text.strip().lower())
    at = {plain(c): c for c in df.columns}
    chosen = []
    for wanted, others in names.items():
        found = next((at[plain(o)] for o in (wanted, *others) if plain(o) in at), None)
        if found is None:
            raise ValueError(f"no column {wanted} in {path}")
        chosen.append(F.col(f"`{found}`").alias(wanted))
    return df.select(*chosen)


def contig_spellings(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Contigs that come under more than one spelling: the reader's check before a join by key."""
    return df.select(chrom).distinct().groupBy(contig_key(F.col(chrom)).alias("key")).agg(F.array_sort(F.collect_set(chrom)).alias("spellings")).where(F.size("spellings") > 1)


def _ordered(df: DataFrame, start: str) -> DataFrame:
    return df.repartitionByRange("chrom", start).sortWithinPartitions("chrom", start)


def validated(track: DataFrame) -> DataFrame:
    """A run-length track whose touching runs of equal value are one; empty, negative or overlapping runs are an error."""
    from ..operators.intervals import running
    from ..operators.signals import compressed

    seen = running(track.select("chrom", "start", "end", "value"), ["chrom"], ["start", "end"], {"__reach": ("max", F.col("end"))}, inclusive=False)
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | F.coalesce(F.col("__reach") > F.col("start"), F.lit(False))
    told = F.raise_error(F.concat_ws(" ", F.lit("run is empty, negative or overlaps:"), F.col("chrom"), F.col("start").cast("string"))).cast("long")
    return compressed(seen.withColumn("start", F.when(bad, told).otherwise(F.col("start"))).drop("__reach"), ["chrom"])


def write_bedgraph(track: DataFrame, path: str, gzip: bool = False) -> None:
    """Runs in contig and place order, one file for each range; equal neighbours are one, values that are not finite an error."""
    track = validated(track)
    value = F.col("value").cast("double")
    odd = F.isnan(value) | value.isNull() | (F.abs(value) == float("inf"))
    checked = F.when(odd, F.raise_error(F.lit("value is not finite")).cast("string")).otherwise(F.regexp_replace(value.cast("string"), r"\.0$", ""))
    _ordered(track, "start").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), checked)).write.option("compression", "gzip" if gzip else "none").text(path)


def write_wig(track: DataFrame, path: str) -> None:
    """Variable-step WIG with spans (one-based), a heading wherever contig or span change inside a file."""
    rows = _ordered(track, "start").withColumn("span", F.col("end") - F.col("start")).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("part").orderBy("chrom", "start")
    fresh = ~(F.lag("chrom").over(before).eqNullSafe(F.col("chrom")) & F.lag("span").over(before).eqNullSafe(F.col("span")))
    head = F.when(fresh, F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.lit(" span="), F.col("span").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    line = F.concat(head, (F.col("start") + 1).cast("string"), F.lit(" "), F.regexp_replace(F.col("value").cast("double").cast("string"), r"\.0$", ""))
    rows.select("part", "chrom", "start", line.alias("line")).sortWithinPartitions("chrom", "start").select("line").write.option("compression", "gzip").text(path)


def bed8(regions: DataFrame, label: str, scale: float | None = None) -> DataFrame:
    """Lines of eight-column BED from (chrom, start, end, centre, score); scores are whole under a scale, else with six digits."""
    score: Column = bed_score(F.col("score"), scale).cast("string") if scale is not None else F.format_string("%.6f", F.abs("score").cast("double"))
    name = F.concat(F.col("chrom"), F.lit(":"), F.col("centre").cast("string"), F.lit(f"_{label}"))
    return regions.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), name, score, F.lit("."), F.col("centre").cast("string"), (F.col("centre") + 1).cast("string")).alias("value"), "chrom", "start")


def write_bed(lines: DataFrame, path: str, gzip: bool = False) -> None:
    _ordered(lines, "start").select("value").write.option("compression", "gzip" if gzip else "none").text(path)


def rgb(text: Column) -> Column:
    """Three whole numbers from 0 to 255, else 128,128,128."""
    return F.when(text.rlike(r"^\s*(25[0-5]|2[0-4]\d|1?\d?\d)\s*,\s*(25[0-5]|2[0-4]\d|1?\d?\d)\s*,\s*(25[0-5]|2[0-4]\d|1?\d?\d)\s*$"), F.regexp_replace(text, r"\s", "")).otherwise(F.lit("128,128,128"))
