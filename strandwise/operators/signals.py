"""Per-base signals as events: each fragment gives a few signed changes, and running sums give the signal.

Running sums go in two levels, so that no task holds a contig: sums of blocks first, their prefix over the few blocks
of a contig, then a window inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import running

#: Bases in a block of a running sum.
BLOCK = 1 << 20
#: Shares of a fragment's kernel are integers of this size, so that sums do not depend on their order.
UNIT = 10**12


def changes(df: DataFrame, keys: list[str], *pairs: tuple[Column, Column]) -> DataFrame:
    """Sums of (position, change) events by key and position."""
    events = df.select(*keys, F.explode(F.array(*[F.struct(p.cast("long").alias("pos"), d.cast("long").alias("d")) for p, d in pairs])).alias("x")).select(*keys, "x.pos", "x.d")
    return events.groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")


def runs(events: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, start, end, value): the running sum of the changes between one event and the next, without stretches of zero."""
    return steps(events, keys, {"value": F.col("d")}, block).where("value <> 0")


def steps(events: DataFrame, keys: list[str], sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """(keys, start, end, running sums) from each event to the next one."""
    placed = events.withColumn("block", F.floor(F.col("pos") / F.lit(block)))
    totals = placed.groupBy(*keys, "block").agg(F.min("pos").alias("first"), *[F.sum(c).alias(n) for n, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("block").alias("__block"), F.lead("first").over(over).alias("__next"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    on = F.col("block") == F.col("__block")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, "block").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(*keys, "block", F.col("pos").alias("start"), F.lead("pos").over(inside).alias("end"), *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    found = local.join(carried, on).select(*keys, "start", F.coalesce("end", "__next").alias("end"), *[(F.col(n) + F.col(f"__{n}")).cast("long").alias(n) for n in sums])
    return found.where("end is not null")


def compressed(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Run-length form: touching runs of equal value become one."""
    last = running(df, keys, ["start"], {"__before": ("last", F.struct("end", value))}, inclusive=False)
    same = (F.col("__before.end") == F.col("start")) & F.col(f"__before.{value}").eqNullSafe(F.col(value))
    island = running(last.withColumn("__fresh", 1 - F.coalesce(same, F.lit(False)).cast("int")).drop("__before"), keys, ["start"], {"island": ("sum", F.col("__fresh"))}).drop("__fresh")
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(value).alias(value)).drop("island")


def coverage(fragments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Depth of fragments in run-length form; bases without any have no row."""
    keys = keys or ["chrom"]
    return runs(changes(fragments, keys, (F.col("s"), F.lit(1)), (F.col("e"), F.lit(-1))), keys)


def dyads(fragments: DataFrame, even: str = "split", keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, value): centres; of an even length the two middle bases share, or one of them has all."""
    keys = keys or ["chrom"]
    right, is_even = F.col("s") + F.expr("(e - s) div 2"), (F.col("e") - F.col("s")) % 2 == 0
    if even == "split":
        points = F.when(is_even, F.array(F.struct((right - 1).alias("pos"), F.lit(0.5).alias("w")), F.struct(right.alias("pos"), F.lit(0.5).alias("w")))).otherwise(F.array(F.struct(right.alias("pos"), F.lit(1.0).alias("w"))))
    else:
        shift = F.when(is_even, F.lit(1)).otherwise(F.lit(0)) if even == "left" else F.lit(0)
        points = F.array(F.struct((right - shift).alias("pos"), F.lit(1.0).alias("w")))
    return fragments.select(*keys, F.explode(points).alias("x")).groupBy(*keys, "x.pos").agg(F.sum("x.w").alias("value"))


def fragment_ends(fragments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, combined, left, right): fragments that begin or end at a base."""
    keys = keys or ["chrom"]
    ends = F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct((F.col("e") - 1).alias("pos"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    return fragments.select(*keys, F.explode(ends).alias("x")).groupBy(*keys, "x.pos").agg(F.sum(F.col("x.l") + F.col("x.r")).alias("combined"), F.sum("x.l").alias("left"), F.sum("x.r").alias("right"))


def capped(sparse: DataFrame, most: float, value: str = "value") -> DataFrame:
    """A sparse track whose sums are cut to a maximum after they are made."""
    return sparse.withColumn(value, F.least(F.col(value), F.lit(most)))


def positive_score(fragments: DataFrame, mode: int = 167, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, at_start, slope): a line on each stretch; times 1 / (2 h (mode div 2)) it is the score of two end triangles.

    A triangle at a has second differences +1 at a+1 and a+mode, -1 at a+h+1 and a+mode-h, h = (mode - 1) div 2. The
    value at q is the sum of d (q - p + 1) over changes d at p <= q.
    """
    keys, h = keys or ["chrom"], (mode - 1) // 2
    pairs = []
    for a in (F.col("s"), F.col("e") - F.lit(mode)):
        pairs += [(a + 1, F.lit(1)), (a + h + 1, F.lit(-1)), (a + mode - h, F.lit(-1)), (a + mode, F.lit(1))]
    made = steps(changes(fragments, keys, *pairs), keys, {"slope": F.col("d"), "moment": F.col("d") * F.col("pos")})
    return made.select(*keys, "start", "end", (F.col("slope") * (F.col("start") + 1) - F.col("moment")).alias("at_start"), "slope").where("slope <> 0 or at_start <> 0")


def centring(fragments: DataFrame, mode: int = 167, keys: list[str] | None = None) -> DataFrame:
    """What mean centring takes off the score: 1/n over each fragment's support, in run-length form, in units of 1/UNIT."""
    keys = keys or ["chrom"]
    length = F.col("e") - F.col("s")
    n = F.when(length >= mode, length).otherwise(2 * mode - length)
    low, share = F.least(F.col("s"), F.col("e") - mode), F.floor(F.lit(UNIT) / n)
    return runs(changes(fragments, keys, (low, share), (low + n, -share)), keys)


def boxcar_score(fragments: DataFrame, mode: int = 167, keys: list[str] | None = None) -> DataFrame:
    """Balanced boxcars over the support of n bases: quarters of -1, halves of +1, edges by n modulo 4; units of 1/UNIT of 1/(2n)."""
    keys = keys or ["chrom"]
    length = F.col("e") - F.col("s")
    n = F.when(length >= mode, length).otherwise(2 * mode - length)
    lo, share = F.least(F.col("s"), F.col("e") - mode), F.floor(F.lit(UNIT) / (2 * n))
    k, w = F.floor(n / 4), 4 - n % 4
    return runs(changes(fragments, keys, (lo + k, share * w), (lo + k + 1, share * (4 - w)), (lo + n - k - 1, share * (w - 4)), (lo + n - k, -share * w)), keys)


def triangle_score(fragments: DataFrame, mode: int = 167, keys: list[str] | None = None) -> DataFrame:
    """One triangle over the support, of mass 1: (keys, start, end, at_start, slope) in units of 1/UNIT."""
    keys = keys or ["chrom"]
    length = F.col("e") - F.col("s")
    n = F.when(length >= mode, length).otherwise(2 * mode - length)
    a, h = F.least(F.col("s"), F.col("e") - mode), F.floor((n - 1) / 2)
    share = F.floor(F.lit(UNIT) / (h * F.floor(n / 2)))
    pairs = [(a + 1, share), (a + h + 1, -share), (a + n - h, -share), (a + n, share)]
    made = steps(changes(fragments, keys, *pairs), keys, {"slope": F.col("d"), "moment": F.col("d") * F.col("pos")})
    return made.select(*keys, "start", "end", (F.col("slope") * (F.col("start") + 1) - F.col("moment")).alias("at_start"), "slope").where("slope <> 0 or at_start <> 0")


def protection_score(fragments: DataFrame, window: int = 120, keys: list[str] | None = None) -> DataFrame:
    """Windowed protection in run-length form: fragments over a window less those that end in it."""
    keys = keys or ["chrom"]
    length, at = F.col("e") - F.col("s"), F.col("s") - F.lit(window // 2)
    long = length >= window
    pairs = [
        (at + 1, F.lit(-1)),
        (F.when(long, at + window).otherwise(at + 2 * window - 1), F.when(long, F.lit(2)).otherwise(F.lit(1))),
        (at + length + 1, F.when(long, F.lit(-2)).otherwise(F.lit(0))),
        (at + length + window, F.when(long, F.lit(1)).otherwise(F.lit(0))),
    ]
    return runs(changes(fragments, keys, *pairs), keys)


def nonzero_mean(track: DataFrame) -> DataFrame:
    """Mean of the bases that are not zero, and their count."""
    width = F.col("end") - F.col("start")
    return track.where("value <> 0").agg((F.sum(F.col("value") * width) / F.sum(width)).alias("mean"), F.sum(width).alias("bases"))


def scaled(track: DataFrame, reference: float, scale: float = 100.0) -> DataFrame:
    return track.withColumn("value", F.col("value") * F.lit(scale) / F.lit(reference))


def islands(track: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Maximal runs of rows no more than ``gap`` bases apart, numbered within their key."""
    last = running(track, keys, ["start"], {"__before": ("max", F.col("end"))}, inclusive=False)
    fresh = last.withColumn("__fresh", F.coalesce((F.col("start") - F.col("__before") > gap).cast("int"), F.lit(1))).drop("__before")
    return running(fresh, keys, ["start"], {"island": ("sum", F.col("__fresh"))}).drop("__fresh")


def runs_above(track: DataFrame, threshold: float = 0.0, least: int = 1, most: int = 0, keys: list[str] | None = None, gap: int = 0) -> DataFrame:
    """Runs of values over a threshold: start, end, length, largest value, area; ``gap`` bridges bases that are not."""
    keys = keys or ["chrom"]
    width = F.col("end") - F.col("start")
    found = islands(track.where(F.col("value") > threshold), keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("value").alias("top"), F.sum(F.col("value") * width).alias("area"))
    found = found.drop("island").withColumn("length", F.col("end") - F.col("start")).where(F.col("length") >= least)
    return found.where(F.col("length") <= most) if most else found


def call_regions(track: DataFrame, least: int = 50, bridge: int = 0, negated: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Positive regions with their largest value and centre, halves cut towards zero; ``negated`` calls breakpoints on the turned signal."""
    keys = keys or ["chrom"]
    signal = track.withColumn("value", -F.col("value")) if negated else track
    found = runs_above(signal, 0, least, keys=keys, gap=bridge)
    return found.select(*keys, "start", "end", F.expr("(start + end) div 2").alias("centre"), F.col("top").alias("score"), "length")
