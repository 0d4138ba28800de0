"""Regions of positive mean-centred score, with the minima between them and the coverage inside; all in whole numbers.

The score of a base is (triangles) / K - (centring) / UNIT with K = 2 h (mode div 2). Both parts come from events, so a
stretch between events is a line, and the places where it is over zero are found without a row for each base. Values
are kept as score * K * UNIT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import first_after, last_before, overlap_join, point_join, running
from .signals import UNIT, islands, steps


def weight(mode: int = 167) -> int:
    """K: what the triangles' values are divided by."""
    return 2 * ((mode - 1) // 2) * (mode // 2)


def centred_lines(fragments: DataFrame, mode: int = 167, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, value, slope): the centred score at the first base of each stretch, and its change a base."""
    keys, h = keys or ["chrom"], (mode - 1) // 2
    length = F.col("e") - F.col("s")
    n = F.when(length >= mode, length).otherwise(2 * mode - length)
    low, share = F.least(F.col("s"), F.col("e") - mode), F.floor(F.lit(UNIT) / n)
    places = []
    for a in (F.col("s"), F.col("e") - F.lit(mode)):
        places += [(a + 1, 1, 0), (a + h + 1, -1, 0), (a + mode - h, -1, 0), (a + mode, 1, 0)]
    places += [(low, 0, 1), (low + n, 0, -1)]
    events = F.explode(F.array(*[F.struct(p.cast("long").alias("pos"), F.lit(d).cast("long").alias("d"), (share * c).cast("long").alias("c")) for p, d, c in places])).alias("x")
    summed = fragments.select(*keys, events).select(*keys, "x.*").groupBy(*keys, "pos").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    made = steps(summed, keys, {"slope": F.col("d"), "moment": F.col("d") * F.col("pos"), "centre": F.col("c")})
    value = (F.col("slope") * (F.col("start") + 1) - F.col("moment")) * F.lit(UNIT) - F.col("centre") * F.lit(weight(mode))
    return made.select(*keys, "start", "end", value.alias("value"), (F.col("slope") * F.lit(UNIT)).alias("slope"))


def turned(lines: DataFrame) -> DataFrame:
    """The same lines with the other sign: what breakpoints are called on."""
    return lines.withColumn("value", -F.col("value")).withColumn("slope", -F.col("slope"))


def over_zero(lines: DataFrame) -> DataFrame:
    """The part of each stretch that is over zero, with its largest value and the first place of that."""
    rise, fall = F.greatest(F.col("slope"), F.lit(1)), F.greatest(-F.col("slope"), F.lit(1))
    up = F.col("start") + F.greatest(F.lit(0), _floor_div(-F.col("value"), rise) + 1)
    down = F.least(F.col("end"), F.col("start") - _floor_div(-F.col("value"), fall))
    begin = F.when(F.col("slope") > 0, up).otherwise(F.col("start"))
    stop = F.when(F.col("slope") < 0, down).otherwise(F.col("end"))
    place = F.when(F.col("slope") > 0, F.col("end") - 1).otherwise(F.col("begin"))
    part = lines.withColumn("begin", begin).withColumn("stop", stop).where((F.col("stop") > F.col("begin")) & ((F.col("slope") != 0) | (F.col("value") > 0)))
    keep = [c for c in lines.columns if c not in ("start", "end", "value", "slope")]
    return part.withColumn("place", place).select(*keep, F.col("begin").alias("start"), F.col("stop").alias("end"), (F.col("value") + F.col("slope") * (F.col("place") - F.col("start"))).alias("top"), "place")


def _floor_div(a: Column, b: Column) -> Column:
    """``div`` cuts towards zero; the rest tells whether one is too many."""
    a, b = a.cast("long"), b.cast("long")
    rest = F.pmod(a, b)
    return F.try_divide((a - rest).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("long")


def positive_regions(lines: DataFrame, least: int = 50, bridge: int = 0, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, centre, score, place): maximal regions over zero that bridge at most ``bridge`` other bases."""
    keys = keys or ["chrom"]
    parts = islands(over_zero(lines), keys, bridge)
    top = F.max(F.struct(F.col("top"), (-F.col("place")).alias("p"))).alias("best")
    found = parts.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), top).where(F.col("end") - F.col("start") >= least)
    return found.select(*keys, "start", "end", F.floor((F.col("start") + F.col("end")) / 2).alias("centre"), F.col("best.top").alias("score"), (-F.col("best.p")).alias("place"))


def minima_between(regions: DataFrame, lines: DataFrame, chrom: str = "chrom") -> DataFrame:
    """(chrom, pos, value): the first smallest value between each region and the next of its contig."""
    before = running(regions.select(chrom, "start", "end"), [chrom], ["start"], {"gap": ("last", F.col("end"))}, inclusive=False)
    gaps = before.where("gap < start").select(chrom, F.col("gap").alias("s"), F.col("start").alias("e"))
    met = overlap_join(gaps, lines.select(chrom, F.col("start").alias("s"), F.col("end").alias("e"), "value", "slope"), "inner", chrom)
    a, b = F.greatest("s", "r_s"), F.least("e", "r_e") - 1
    place = F.when(F.col("r_slope") < 0, b).otherwise(a)
    low = met.select(chrom, "s", place.alias("pos"), (F.col("r_value") + F.col("r_slope") * (place - F.col("r_s"))).alias("value"))
    return low.groupBy(chrom, "s").agg(F.min(F.struct("value", "pos")).alias("m")).select(chrom, F.col("m.pos").alias("pos"), F.col("m.value").alias("value"))


def flanked(regions: DataFrame, minima: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Regions with the nearest minima strictly before and after their centre; where there is none, the region's own centre and score."""
    valued = minima.select(chrom, "pos", F.struct("pos", "value").alias("m"))
    both = first_after(valued, last_before(valued, regions.withColumn("pos", F.col("centre")), chrom, "pos", "m", "m_up"), chrom, "pos", "m", "m_down")
    out = [F.coalesce(F.col(f"m_{side}.{c}"), F.col(own)).alias(f"{side}_{name}") for side in ("up", "down") for c, own, name in (("pos", "centre", "pos"), ("value", "score", "score"))]
    return both.select(*regions.columns, *out)


def with_largest_cover(regions: DataFrame, cover: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Regions with the largest coverage inside and its first place; no coverage is zero at the region's start."""
    track = cover.select(chrom, F.col("start").alias("s"), F.col("end").alias("e"), "value")
    met = overlap_join(regions.select(chrom, F.col("start").alias("s"), F.col("end").alias("e")), track, "inner", chrom)
    best = met.groupBy(chrom, "s").agg(F.max(F.struct(F.col("r_value").alias("v"), (-F.greatest("s", "r_s")).alias("p"))).alias("best"))
    own = best.select(F.col(chrom).alias("__c"), F.col("s").alias("__s"), "best")
    joined = regions.join(own, (F.col(chrom) == F.col("__c")) & (F.col("start") == F.col("__s")), "left")
    return joined.select(*regions.columns, F.coalesce("best.v", F.lit(0)).alias("max_coverage"), F.coalesce(-F.col("best.p"), F.col("start")).alias("max_position"))


def covered(records: DataFrame, cover: DataFrame, least: float, pos: str = "pos", chrom: str = "chrom") -> DataFrame:
    """Records whose coverage at a position reaches a threshold; no coverage is zero."""
    if least < 0:
        raise ValueError("the threshold is zero or more")
    track = cover.select(F.col(chrom), F.col("start").alias("s"), F.col("end").alias("e"), "value")
    asked = records.select(F.col(chrom).alias("c"), F.col(pos).alias("p"), F.struct(*records.columns).alias("row"))
    found = point_join(asked, track.withColumnRenamed(chrom, "c"), "left", "c", "p")
    return found.where(F.coalesce("r_value", F.lit(0)) >= least).select("row.*")

