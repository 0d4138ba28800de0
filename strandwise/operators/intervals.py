"""Joins and algebra of half-open intervals.

Spark plans an inequality join as a nested loop, so intervals are dealt to bins of fixed width and joined on
(contig, bin); each pair is kept in one of the bins that both touch. Merging and subtracting work on events.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins of range joins; a side's rows are repeated once for each bin that they touch.
BIN = 1 << 12
#: Bases of a block of a running aggregate.
BLOCK = 1 << 20
#: Bases of a block whose first covering intervals one task finds.
COVER_BLOCK = 1 << 16


def binned(df: DataFrame, start: Column, end: Column, width: int = BIN, name: str = "bin") -> DataFrame:
    """One row for each bin that [start, end) touches."""
    low, high = F.floor(start / F.lit(width)), F.floor((end - 1) / F.lit(width))
    return df.where(end > start).withColumn(name, F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", chrom: str = "chrom", start: str = "s", end: str = "e", prefix: str = "r_", width: int = BIN) -> DataFrame:
    """Pairs of rows whose intervals share a base; right columns get a prefix. ``how``: inner, left_semi or left_anti.

    Semi and anti keep each left row once; they find the rows that meet by a row identifier of their own.
    """
    r = binned(right.select(*[F.col(c).alias(prefix + c) for c in right.columns]), F.col(prefix + start), F.col(prefix + end), width, prefix + "bin")
    if how == "inner":
        le = binned(left, F.col(start), F.col(end), width)
        same = (F.col(chrom) == F.col(prefix + chrom)) & (F.col("bin") == F.col(prefix + "bin"))
        meet = (F.col(start) < F.col(prefix + end)) & (F.col(prefix + start) < F.col(end))
        once = F.col("bin") == F.greatest(F.floor(F.col(start) / F.lit(width)), F.floor(F.col(prefix + start) / F.lit(width)))
        return le.join(r, same & meet & once).drop("bin", prefix + "bin")
    keys = left.select(chrom, start, end).distinct()
    met = overlap_join(keys, right.select(chrom, start, end), "inner", chrom, start, end, "__", width).select(chrom, start, end).distinct()
    on = [left[c].eqNullSafe(met[c]) for c in (chrom, start, end)]
    return left.join(met, on, how)


def point_join(points: DataFrame, intervals: DataFrame, how: str = "inner", chrom: str = "chrom", pos: str = "pos", start: str = "s", end: str = "e", prefix: str = "r_", width: int = BIN) -> DataFrame:
    """Points with the intervals that hold them; ``left`` keeps points in none."""
    p = points.withColumn("bin", F.floor(F.col(pos) / F.lit(width)))
    r = binned(intervals.select(*[F.col(c).alias(prefix + c) for c in intervals.columns]), F.col(prefix + start), F.col(prefix + end), width, prefix + "bin")
    on = (F.col(chrom) == F.col(prefix + chrom)) & (F.col("bin") == F.col(prefix + "bin")) & (F.col(prefix + start) <= F.col(pos)) & (F.col(pos) < F.col(prefix + end))
    return p.join(r, on, how).drop("bin", prefix + "bin")


def first_covering(points: DataFrame, intervals: DataFrame, order: str, value: str, chrom: str = "chrom", pos: str = "pos", start: str = "s", end: str = "e", prefix: str = "r_", block: int = COVER_BLOCK) -> DataFrame:
    """(chrom, pos, r_order, r_value): for each distinct point the first interval in the order that holds it; points in none have no row.

    No pair of point and interval is made. An interval's part of a block is two spans of the largest power of two that
    fits; of equal spans the first one is kept, so a block has 17 spans a base at most, however many intervals it has.
    Each span hands its first interval to its halves, down to single bases.
    """
    known = intervals.where(F.col(order).isNotNull() & F.col(value).isNotNull()).select(F.col(chrom).alias("__c"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("__first"))
    parts = binned(known, F.col("__s"), F.col("__e"), block, "__block")
    low = F.greatest(F.col("__s") - F.col("__block") * block, F.lit(0)).cast("int")
    high = F.least(F.col("__e") - F.col("__block") * block, F.lit(block)).cast("int")
    sized = parts.select("__c", "__block", "__first", low.alias("__low"), high.alias("__high"), (F.length(F.bin(high - low)) - 1).alias("__level"))
    both = F.array(F.col("__low"), F.col("__high") - F.call_function("shiftleft", F.lit(1), F.col("__level")))
    spans = sized.select("__c", "__block", "__level", F.explode(both).alias("__at"), "__first").groupBy("__c", "__block", "__level", "__at").agg(F.min("__first").alias("__first"))
    spans = spans.select("__c", "__block", "__level", "__at", F.col("__first.o").alias("o"), F.col("__first.v").alias("v"))
    asked = points.select(F.col(chrom).alias("__c"), F.col(pos).cast("long").alias("__p")).where("__c is not null and __p is not null").distinct().withColumn("__block", F.floor(F.col("__p") / F.lit(block)))
    types = dict(points.dtypes) | {prefix + c: t for c, t in intervals.dtypes}
    schema = f"`{chrom}` {types[chrom]}, `{pos}` long, `{prefix + order}` {types[prefix + order]}, `{prefix + value}` {types[prefix + value]}"

    def found(key: tuple, seen: pa.Table, known: pa.Table) -> pa.Table:
        places = seen["__p"].to_numpy()
        ranked = pc.sort_indices(known, [("o", "ascending"), ("v", "ascending")]).to_numpy()
        rank = np.empty(len(ranked), np.int64)
        rank[ranked] = np.arange(len(ranked))
        level, at = known["__level"].to_numpy(), known["__at"].to_numpy()
        best = np.full(block, len(ranked))
        for k in range(int(level.max(initial=0)), -1, -1):
            own = level == k
            np.minimum.at(best, at[own], rank[own])
            if k:
                half = 1 << (k - 1)
                best[half:] = np.minimum(best[half:], best[:-half])
        first = best[places - key[1].as_py() * block]
        held = first < len(ranked)
        rows = pa.array(ranked[first[held]])
        return pa.table([seen["__c"].filter(pa.array(held)), pa.array(places[held]), known["o"].take(rows), known["v"].take(rows)], [chrom, pos, prefix + order, prefix + value])

    return asked.groupBy("__c", "__block").cogroup(spans.groupBy("__c", "__block")).applyInArrow(found, schema)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos", low: int = 1, high: int = 2000, prefix: str = "r_") -> DataFrame:
    """Pairs with equal keys and low <= right position - left position <= high.

    Bins are as wide as the band; a left row looks into the one or two bins where its partners can be.
    """
    width = high - low + 1
    first = F.floor((F.col(pos) + low) / F.lit(width))
    le = left.withColumn("bin", F.explode(F.array_distinct(F.array(first, F.floor((F.col(pos) + high) / F.lit(width))))))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn(prefix + "bin", F.floor(F.col(prefix + pos) / F.lit(width)))
    on = F.col("bin") == F.col(prefix + "bin")
    for key in keys:
        on = on & (F.col(key) == F.col(prefix + key))
    return le.join(r, on & F.col(prefix + pos).between(F.col(pos) + low, F.col(pos) + high)).drop("bin", prefix + "bin")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = True, descending: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with running aggregates of each key in the order of its columns, in two levels, so that no task holds a contig.

    ``values`` names (kind, column) with kind sum, max or last (the last that is not null); each takes the rows before
    a row and, if ``inclusive``, the row. Blocks of the first column of the order are aggregated first, their running
    aggregates carried over the few blocks of a key, and windows stay inside a block. Rows of equal order count as
    in any order for sum and max; give a total order for the rest.
    """
    placed = df.withColumn("__block", F.floor(F.col(order[0]) / F.lit(block)))
    place = F.struct(*order)

    def whole(kind: str, c: Column) -> Column:
        if kind == "last":
            known = F.when(c.isNotNull(), place)
            return (F.min_by if descending else F.max_by)(c, known)
        return F.sum(c) if kind == "sum" else F.max(c)

    def over(kind: str, c: Column, window) -> Column:
        return F.last(c, ignorenulls=True).over(window) if kind == "last" else (F.sum(c) if kind == "sum" else F.max(c)).over(window)

    totals = placed.groupBy(*keys, "__block").agg(*[whole(k, c).alias(n) for n, (k, c) in values.items()])
    before = Window.partitionBy(*keys).orderBy(F.desc("__block") if descending else F.asc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__kb"), *[over(k, F.col(n), before).alias(f"__carried_{n}") for n, (k, _) in values.items()])
    inside = Window.partitionBy(*keys, "__block").orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = placed.select("*", *[over(k, c, inside).alias(f"__local_{n}") for n, (k, c) in values.items()])
    on = F.col("__block") == F.col("__kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(carried, on)

    def both(n: str, kind: str) -> Column:
        mine, theirs = F.col(f"__local_{n}"), F.col(f"__carried_{n}")
        if kind == "max":
            return F.greatest(mine, theirs)
        return F.coalesce(mine, theirs) if kind == "last" else F.coalesce(mine + theirs, mine, theirs)

    return joined.select(*df.columns, *[both(n, k).alias(n) for n, (k, _) in values.items()])


def merged(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Unions of intervals that overlap or touch, for each key."""
    reached = running(df.where(F.col(end) > F.col(start)).select(*keys, start, end), keys, [start, end], {"reach": ("max", F.col(end))}, inclusive=False)
    fresh = reached.withColumn("fresh", (F.col("reach").isNull() | (F.col(start) > F.col("reach"))).cast("int"))
    island = running(fresh, keys, [start, end], {"island": ("sum", F.col("fresh"))})
    return island.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def subtracted(df: DataFrame, holes: DataFrame, keys: list[str], start: str = "s", end: str = "e", chrom: str = "chrom") -> DataFrame:
    """What is left of each key's merged intervals outside the holes of their contig; touching pieces stay apart at holes."""
    own = merged(df, keys, start, end)
    cut = merged(holes, [chrom], start, end)
    for_keys = overlap_join(own, cut, "inner", chrom, start, end, "h_").select(*keys, F.col(start).alias("of"), F.greatest(start, f"h_{start}").alias("a"), F.least(end, f"h_{end}").alias("b"))
    events = own.select(*keys, F.col(start).alias("of"), F.col(end).alias("limit"), F.col(start).alias("a"), F.col(start).alias("b")).unionByName(for_keys.withColumn("limit", F.lit(None).cast("long")), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "of").orderBy("a", "b")
    whole = Window.partitionBy(*keys, "of")
    pieces = events.withColumn("limit", F.max("limit").over(whole)).select(*keys, F.col("b").alias(start), F.coalesce(F.lead("a").over(order), F.col("limit")).alias(end))
    return pieces.where(F.col(end) > F.col(start))


def _nearest(df: DataFrame, anchors: DataFrame, chrom: str, pos: str, value: str, name: str, strict: bool, ahead: bool) -> DataFrame:
    """Both sides in one order; a strict side stands behind anchors of its position, the other one before them."""
    known = df.select(F.col(chrom).alias("__c"), F.col(pos).alias("__p"), F.lit(int(strict != ahead)).alias("__side"), F.col(value).alias("__v"), F.lit(None).alias("__row"))
    asked = anchors.select(F.col(chrom).alias("__c"), F.col(pos).alias("__p"), F.lit(int(strict == ahead)).alias("__side"), F.lit(None).cast(dict(df.dtypes)[value]).alias("__v"), F.struct(*anchors.columns).alias("__row"))
    both = asked.unionByName(known.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)))
    found = running(both, ["__c"], ["__p", "__side", "__v"], {"__found": ("last", F.col("__v"))}, descending=ahead)
    return found.where("__row is not null").select("__row.*", F.col("__found").alias(name))


def last_before(df: DataFrame, anchors: DataFrame, chrom: str = "chrom", pos: str = "pos", value: str = "pos", name: str = "before", strict: bool = True) -> DataFrame:
    """As-of join: for each anchor the value at the largest smaller position (or equal, if not strict) of the contig."""
    return _nearest(df, anchors, chrom, pos, value, name, strict, False)


def first_after(df: DataFrame, anchors: DataFrame, chrom: str = "chrom", pos: str = "pos", value: str = "pos", name: str = "after", strict: bool = True) -> DataFrame:
    """As-of join to the other side: the smallest larger (or equal) position."""
    return _nearest(df, anchors, chrom, pos, value, name, strict, True)
