"""Order-dependent operators on positions: neighbours, flanks, ranks, duplicates, matching."""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contigs import safe_ratio
from .intervals import binned, first_after, last_before, point_join, running
from .lineage import cut
from .select import hashed

#: Rows of a contig that a window over neighbours holds.
GROUP = 100_000
#: Bases of a block whose intervals and pairs of neighbours one task counts.
INSIDE_BLOCK = 1 << 14
POLICIES = ("highest-score", "first", "keep", "error")


def limited_copies(fragments: DataFrame, most: int = 1, keys: tuple[str, ...] = ("chrom", "s", "e"), order: str = "source_id", number: str | None = None) -> DataFrame:
    """At most ``most`` rows of equal coordinates, those of the first sources; 0 keeps all. ``number`` names a column for their count from 1."""
    if not most:
        return fragments
    if most == 1 and number is None:  # a plain aggregation combines before it shuffles
        rest = [c for c in fragments.columns if c not in (*keys, order)]
        first = [] if order in keys else [F.min(order).alias(order)]
        if not first and not rest:
            return fragments.select(*keys).distinct().select(*fragments.columns)
        return fragments.groupBy(*keys).agg(*first, *[F.min_by(c, order).alias(c) for c in rest]).select(*fragments.columns)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    kept = fragments.withColumn("__n", n).where(F.col("__n") <= most)
    return kept.drop("__n") if number is None else kept.withColumnRenamed("__n", number)


def one_per_position(peaks: DataFrame, policy: str = "highest-score", chrom: str = "chrom", pos: str = "pos", score: str = "score", order: str = "event_id") -> DataFrame:
    """Peaks at one position by policy; ``error`` raises when the result is computed."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    if policy == "keep":
        return peaks
    by = [F.desc(score), F.asc(order)] if policy == "highest-score" else [F.asc(order)]
    found = peaks.withColumn("__n", F.row_number().over(Window.partitionBy(chrom, pos).orderBy(*by)))
    if policy == "error":
        return found.withColumn(pos, F.when(F.col("__n") > 1, F.raise_error(F.lit("several peaks at one position")).cast("long")).otherwise(F.col(pos))).drop("__n")
    return found.where("__n = 1").drop("__n")


def neighbour_distances(peaks: DataFrame, orders: int = 10, chrom: str = "chrom", pos: str = "pos", state: str | None = None) -> DataFrame:
    """(chrom, ord, distance[, state]): from each peak to its next ones, as far as they lie in the contig; no zero distances."""
    own = [F.col(state).alias("__state")] if state else []
    rows = running(peaks.select(F.col(chrom).alias("__chrom"), F.col(pos).alias("__pos"), *own), ["__chrom"], ["__pos"], {"__number": ("sum", F.lit(1))})
    group = F.floor((F.col("__number") - 1) / F.lit(GROUP))
    halo = F.when((F.col("__number") - 1) % GROUP < orders, F.array(group, group - 1)).otherwise(F.array(group))  # a group sees the first rows of the next
    seen = rows.withColumn("__own", group).withColumn("__group", F.explode(halo))
    window = Window.partitionBy("__chrom", "__group").orderBy("__number")
    leads = F.array(*[F.struct(F.lit(q).alias("ord"), F.lead("__pos", q).over(window).alias("to"), *([F.lead("__state", q).over(window).alias("to_state")] if state else [])) for q in range(1, orders + 1)])
    ahead = seen.select("*", leads.alias("leads")).where("__own = __group")
    found = ahead.select("__chrom", "__pos", *(["__state"] if state else []), F.explode("leads").alias("x")).where(F.col("x.to") > F.col("__pos"))
    same = [F.when(F.col("__state") == F.col("x.to_state"), F.col("__state")).alias("state")] if state else []
    return found.select(F.col("__chrom").alias(chrom), F.col("x.ord").alias("ord"), (F.col("x.to") - F.col("__pos")).alias("distance"), *same)


def distance_histogram(distances: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Counts by order and distance over all, by contig, by state and by both, as grouping sets; null marks what is pooled."""
    distances.createOrReplaceTempView("__strandwise_distances")
    return distances.sparkSession.sql(f"""
        select ord, distance, {chrom}, state, grouping(state) as all_states, count(*) as n from __strandwise_distances
        group by grouping sets ((ord, distance), (ord, distance, {chrom}), (ord, distance, state), (ord, distance, {chrom}, state))
        having grouping(state) = 1 or state is not null""")  # fmt: skip


def histogram_summary(histogram: DataFrame, keys: list[str], value: str = "distance", count: str = "n") -> DataFrame:
    """Total, mean, median (average of the middle ranks), smallest mode, least and largest value of weighted values."""
    return histogram.groupBy(*keys).agg(
        F.sum(count).alias("total"), (F.sum(F.col(value) * F.col(count)) / F.sum(count)).alias("mean"), F.expr(f"percentile({value}, 0.5, {count})").alias("median"),
        F.min_by(value, F.struct(-F.col(count), F.col(value))).alias("mode"), F.min(value).alias("least"), F.max(value).alias("largest"),
    )


def line_fit(points: DataFrame, x: str, y: str, keys: list[str] | None = None, flat: float | None = None) -> DataFrame:
    """Least squares of y on x: slope, intercept, r2 (``flat`` where y does not vary), points; nulls for under two points."""
    r2 = F.when(F.regr_syy(F.col(y), F.col(x)) == 0, F.lit(flat).cast("double")).otherwise(F.regr_r2(F.col(y), F.col(x)))
    fitted = [F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), r2.alias("r2"), F.count(F.col(x)).alias("points")]
    return points.groupBy(*(keys or [])).agg(*fitted)


def flanks(sites: DataFrame, centres: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Sites with the nearest centres strictly before and after, their spacing, and a status."""
    known = centres.select(F.col(chrom).alias("__k")).distinct()
    both = first_after(centres, last_before(centres, sites, chrom, pos), chrom, pos)
    both = both.join(known, F.col(chrom) == F.col("__k"), "left")
    status = F.when(F.col("__k").isNull(), "no_matching_contig").when(F.col("before").isNull() | F.col("after").isNull(), "missing_flank").otherwise("ok")
    return both.withColumn("status", status).withColumn("spacing", F.col("after") - F.col("before")).drop("__k")


def kth_neighbour(sites: DataFrame, centres: DataFrame, offset: int, chrom: str = "chrom", pos: str = "pos", strand: str = "strand") -> DataFrame:
    """Sites with the centre that is ``offset`` centres away downstream (upstream if negative); null where there is none."""
    numbered = running(centres.select(chrom, pos).distinct(), [chrom], [pos], {"number": ("sum", F.lit(1))})
    before = last_before(numbered, sites, chrom, pos, "number", "low")
    after = first_after(numbered, before, chrom, pos, "number", "high")
    step = F.when(F.col(strand) == "-", -offset).otherwise(offset)
    wanted = F.when(step > 0, F.coalesce("high", F.col("low") + 1) + step - 1).when(step < 0, F.coalesce("low", F.col("high") - 1) + step + 1)
    lookup = numbered.select(F.col(chrom).alias("__c"), F.col("number").alias("__n"), F.col(pos).alias("neighbour"))
    return after.withColumn("wanted", wanted).join(lookup, (F.col(chrom) == F.col("__c")) & (F.col("wanted") == F.col("__n")), "left").drop("__c", "__n", "low", "high", "wanted")


def equal_rank_bins(df: DataFrame, bins: int, *order: Column) -> DataFrame:
    """``ntile`` over the whole table in two levels: ranks within range partitions, then the partitions' offsets.

    Sizes differ by one at most, the earlier bins are the larger.
    """
    ranked = global_rank(df, *order)
    n = ranked.count()
    size, more = divmod(n, bins)
    cut = more * (size + 1)
    bin_ = F.when(F.col("rank") <= cut, F.floor((F.col("rank") - 1) / F.lit(size + 1))).otherwise(more + F.floor((F.col("rank") - 1 - cut) / F.lit(max(size, 1))))
    return ranked.withColumn("bin", (bin_ + 1).cast("long"))


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with their rank in a total order, without one task that holds them all.

    Rows go to range partitions; ranks inside are shifted by the counts of the partitions before, a table as small as
    the number of partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    base, offsets = 0, []
    for part, n in counts:
        offsets.append((part, base))
        base += n
    shifts = spark.createDataFrame(offsets or [(0, 0)], "__part int, __base long")
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(shifts), "__part").withColumn("rank", F.col("__base") + F.col("__local")).drop("__part", "__base", "__local")


def matched_one_to_one(query: DataFrame, target: DataFrame, most: int | None = None, chrom: str = "chrom", pos: str = "pos", rounds: int = 200) -> DataFrame:
    """(chrom, query, target, distance): closest pairs first, each position used once; positions are distinct.

    Each round pairs positions that are nearest to each other in the order (distance, query, target) and takes them
    out; what is left goes on, until no pair is near enough. Chains that need more than ``rounds`` rounds (evenly
    spaced positions settle one pair a round) are finished by tasks, one for each run of positions whose neighbours
    are within ``most``. Equal to the global greedy choice.
    """
    left = query.select(chrom, F.col(pos).alias("p")).distinct()
    right = target.select(chrom, F.col(pos).alias("p")).distinct()
    found = None
    for _ in range(rounds):
        sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        seen = {f"{way}{side}": ("last", F.when(F.col("side") == side, F.col("p"))) for way in ("lo",) for side in (0, 1)}
        sides = running(sides, [chrom], ["p", "side"], seen)
        sides = running(sides, [chrom], ["p", "side"], {n.replace("lo", "hi"): v for n, v in seen.items()}, descending=True)
        q_side = sides.where("side = 0").withColumnsRenamed({"lo1": "lo", "hi1": "hi"})
        t_side = sides.where("side = 1").withColumnsRenamed({"lo0": "lo", "hi0": "hi"})
        best = lambda own: F.array_min(F.filter(F.array(F.struct(F.abs(F.col("p") - F.col("lo")).alias("d"), F.col("lo").alias("o")), F.struct(F.abs(F.col("p") - F.col("hi")).alias("d"), F.col("hi").alias("o"))), lambda x: x["o"].isNotNull()))
        q = q_side.withColumn("b", best("q")).where("b is not null").select(chrom, F.col("p").alias("query"), F.col("b.o").alias("target"), F.col("b.d").alias("distance"))
        t = t_side.withColumn("b", best("t")).where("b is not null").select(F.col(chrom).alias("__c"), F.col("b.o").alias("__q"), F.col("p").alias("__t"))
        pairs = q.join(t, (F.col(chrom) == F.col("__c")) & (F.col("query") == F.col("__q")) & (F.col("target") == F.col("__t"))).drop("__c", "__q", "__t")
        if most is not None:
            pairs = pairs.where(F.col("distance") <= most)
        pairs = cut(pairs)
        if not pairs.limit(1).count():
            break
        found = pairs if found is None else found.unionByName(pairs)
        left = left.join(pairs.select(F.col(chrom).alias("__c"), F.col("query").alias("__p")), (F.col(chrom) == F.col("__c")) & (F.col("p") == F.col("__p")), "left_anti")
        left = cut(left)
        right = right.join(pairs.select(F.col(chrom).alias("__c"), F.col("target").alias("__p")), (F.col(chrom) == F.col("__c")) & (F.col("p") == F.col("__p")), "left_anti")
        right = cut(right)
    else:
        rest = _finished(left, right, most, chrom)
        found = rest if found is None else found.unionByName(rest)
    return found if found is not None else query.sparkSession.createDataFrame([], f"{chrom} string, query long, target long, distance long")


def _finished(left: DataFrame, right: DataFrame, most: int | None, chrom: str) -> DataFrame:
    """The greedy pairs of what the rounds left; no pair reaches over a gap of more than ``most``."""
    sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select(F.col(chrom), F.col("p").cast("long").alias("p"), "side")
    order = Window.partitionBy(chrom).orderBy("p", "side")
    apart = F.lit(0) if most is None else F.coalesce((F.col("p") - F.lag("p").over(order) > most).cast("int"), F.lit(0))
    runs = sides.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def paired(key: tuple, table: pa.Table) -> pa.Table:
        p, side = np.asarray(table["p"]), np.asarray(table["side"])
        rows = np.lexsort((side, p))
        pairs = np.array(nearest_pairs(p[rows].tolist(), side[rows].tolist(), most), np.int64).reshape(-1, 3)
        return pa.table([pa.array([key[0].as_py()] * len(pairs), pa.string()), *[pa.array(c) for c in pairs.T]], [chrom, "query", "target", "distance"])

    return runs.groupBy(chrom, "run").applyInArrow(paired, f"`{chrom}` string, query long, target long, distance long")


def nearest_pairs(places: list[int], side: list[int], most: int | None = None) -> list[tuple[int, int, int]]:
    """(query, target, distance) of the greedy choice; places are sorted, with queries (side 0) before equal targets.

    The next pair is always of two neighbours, so a heap over neighbours is enough; taken ones are linked out.
    """
    before, after = list(range(-1, len(places) - 1)), list(range(1, len(places) + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(places) and side[a] != side[b] and (most is None or places[b] - places[a] <= most):
            q, t = (a, b) if side[a] == 0 else (b, a)
            heapq.heappush(heap, (places[b] - places[a], places[q], places[t], a, b))

    for a in range(len(places) - 1):
        offer(a, a + 1)
    found, taken = [], [False] * len(places)
    while heap:
        d, q, t, a, b = heapq.heappop(heap)
        if taken[a] or taken[b]:
            continue
        taken[a] = taken[b] = True
        found.append((q, t, d))
        low, high = before[a], after[b]
        if low >= 0:
            after[low] = high
        if high < len(places):
            before[high] = low
        offer(low, high)
    return found


def distances_inside(points: DataFrame, intervals: DataFrame, keys: list[str], low: int = 1, high: int = 2000) -> DataFrame:
    """(keys, distance) of neighbours inside one interval each; adjacency ends with the interval."""
    met = point_join(points, intervals.select("chrom", "s", "e", *keys))
    order = Window.partitionBy("chrom", "r_s", "r_e", *[f"r_{k}" for k in keys]).orderBy("pos")
    gap = met.withColumn("distance", F.col("pos") - F.lag("pos").over(order)).where(F.col("distance").between(low, high))
    return gap.select(*[F.col(f"r_{k}").alias(k) for k in keys], "distance")


def distances_inside_counts(points: DataFrame, intervals: DataFrame, keys: list[str], label: str, low: int = 1, high: int = 2000, block: int = INSIDE_BLOCK) -> DataFrame:
    """(label, distance, n): counts of ``distances_inside`` (``keys`` and the label tell intervals apart) by label, without a row for each pair; distances from 1 on.

    Neighbouring places are pairs in order; an interval holds a run of them, so it adds one at the run's first pair and
    takes it off behind the last. An interval goes to the blocks where it can hold a pair's first place.
    """
    places = points.select(F.col("chrom").alias("__c"), F.col("pos").cast("long").alias("__p")).where("__c is not null and __p is not null").distinct()
    pairs = running(places, ["__c"], ["__p"], {"__q": ("last", F.col("__p"))}, inclusive=False, descending=True)
    pairs = pairs.where((F.col("__q") - F.col("__p")).between(max(low, 1), high)).withColumn("__block", F.floor(F.col("__p") / F.lit(block)))
    own = intervals.select("chrom", "s", "e", label, *keys).distinct().select(F.col("chrom").alias("__c"), F.col("s").alias("__s"), F.col("e").alias("__e"), F.col(label).alias("__label"))
    parts = binned(own, F.col("__s"), F.col("__e"), block, "__block")
    base = F.col("__block") * block
    first, past = F.greatest(F.col("__s") - base, F.lit(0)).cast("int"), F.least(F.col("__e") - base, F.lit(block + high + 1)).cast("int")
    parts = parts.groupBy("__c", "__block", "__label", first.alias("__a"), past.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))

    def counted(key: tuple, pairs: pa.Table, parts: pa.Table) -> pa.Table:
        base = key[1].as_py() * block
        order = np.argsort(pairs["__p"].to_numpy())
        p, q = pairs["__p"].to_numpy()[order] - base, pairs["__q"].to_numpy()[order] - base
        a, b = np.searchsorted(p, parts["__a"].to_numpy()), np.searchsorted(q, parts["__b"].to_numpy())
        known = parts["__label"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes, n, labels, gaps, sums = known.indices.to_numpy(), parts["__n"].to_numpy(), [], [], []
        for code in range(len(known.dictionary)):
            mine = (codes == code) & (b > a)
            steps = np.bincount(a[mine], n[mine], len(p) + 1) - np.bincount(b[mine], n[mine], len(p) + 1)
            by_gap = np.bincount(q - p, np.cumsum(steps)[:-1], high + 1)
            some = np.flatnonzero(by_gap)
            labels, gaps, sums = [*labels, np.full(len(some), code)], [*gaps, some], [*sums, by_gap[some]]
        whole = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
        return pa.table([known.dictionary.take(pa.array(whole(labels))), pa.array(whole(gaps)), pa.array(whole(sums))], [label, "distance", "n"])

    found = pairs.groupBy("__c", "__block").cogroup(parts.groupBy("__c", "__block")).applyInArrow(counted, f"`{label}` {dict(intervals.dtypes)[label]}, distance long, n long")
    return found.groupBy(label, "distance").agg(F.sum("n").alias("n"))


def boundary_ranks(n: int, boundaries: list[float]) -> list[tuple[float, float, int, int]]:
    """(lower, upper, first, past) ranks of the bins between percentages; counts by largest remainders, the earlier first."""
    if n < 1 or len(boundaries) < 2 or any(not 0 <= b <= 100 for b in boundaries) or any(a >= b for a, b in zip(boundaries, boundaries[1:])):
        raise ValueError("boundaries rise from 0 to 100, and there is a row at least")
    edges = sorted({0.0, 100.0, *map(float, boundaries)})
    exact = [n * (b - a) / 100 for a, b in zip(edges, edges[1:])]
    counts = [math.floor(x) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: (counts[k] - exact[k], k))[: n - sum(counts)]:
        counts[k] += 1
    at = dict(zip(edges, [0, *accumulate(counts)]))
    out = [(a, b, at[a], at[b]) for a, b in zip(map(float, boundaries), map(float, boundaries[1:]))]
    if any(first >= past for *_, first, past in out):
        raise ValueError("a bin has no rows; use wider ones")
    return out


def bins_from_boundaries(df: DataFrame, boundaries: list[float], *order: Column) -> DataFrame:
    """Rows with (lower, upper), the percentages of their slice of the order; rows in no slice are left out."""
    ranked = global_rank(df, *order)
    place = None
    for lower, upper, first, past in boundary_ranks(ranked.count(), boundaries):
        own = F.struct(F.lit(lower).alias("lower"), F.lit(upper).alias("upper"))
        here = (F.col("rank") > first) & (F.col("rank") <= past)
        place = F.when(here, own) if place is None else place.when(here, own)
    return ranked.withColumn("__bin", place).where("__bin is not null").select(*df.columns, "__bin.*")


def filled(histogram: DataFrame, low: int, high: int, value: str = "distance", n: str = "n") -> DataFrame:
    """(value, n, percent) of each value from low to high, zeros too."""
    grid = histogram.sparkSession.range(low, high + 1).withColumnRenamed("id", value)
    own = histogram.select(F.col(value).cast("long").alias(value), n).where(F.col(value).between(low, high))
    total = own.agg(F.sum(n).alias("__total"))
    both = grid.join(own, value, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long"))).crossJoin(F.broadcast(total))  # one row
    return both.select(value, n, F.coalesce(F.try_divide(F.col(n) * F.lit(100.0), F.col("__total")), F.lit(0.0)).alias("percent"))


def run_summary(histogram: DataFrame, value: str = "length", n: str = "n") -> DataFrame:
    """Count, extremes, quantiles, mean and smallest mode of weighted values, in one row."""
    q = F.expr(f"percentile({value}, array(0.25, 0.5, 0.75), {n})").alias("q")
    found = histogram.agg(F.coalesce(F.sum(n), F.lit(0)).alias("runs"), F.min(value).alias("least"), q, (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"), F.max(value).alias("largest"), F.min_by(value, F.struct(-F.col(n), F.col(value))).alias("mode"))
    return found.select("runs", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q3"), "largest", "mode")


def row_average(histogram: DataFrame, order: str, value: str, rows: int) -> DataFrame:
    """Mean of an odd number of rows about each one in order; fewer at both ends. A histogram is a row for each distance."""
    half = rows // 2
    window = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(-half, half)
    return histogram.withColumn("smooth", F.avg(value).over(window))


def ranked_by_ratio(heights: DataFrame, key: str, top: str, bottom: str) -> DataFrame:
    """(key, ratio, rank): finite ratios first, then infinite ones, then undefined ones; ties by name. A row for each category."""
    found = heights.withColumn("ratio", safe_ratio(F.col(top), F.col(bottom)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.isnan("ratio"), F.col("ratio") == float("inf"), "ratio", F.col(key).cast("string"))
    return found.select(key, "ratio", F.row_number().over(order).cast("long").alias("rank"))


def drawn(df: DataFrame, n: int, seed: int, columns: list[str]) -> DataFrame:
    """A fixed random sample of n rows at most, by a hash of the seed and the columns."""
    return df.orderBy(hashed(seed, *columns), *columns).limit(n)


def natural_key(name: Column) -> Column:
    """A key that sorts digits inside names as numbers."""
    return F.transform(F.split(F.regexp_replace(F.lower(name), r"([0-9]+)", "\u0001$1\u0001"), "\u0001"), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(F.regexp_replace(x, "^0+(?=[0-9])", ""), 20, "0")).otherwise(x))
