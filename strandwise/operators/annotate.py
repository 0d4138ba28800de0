"""States, gene sets, filters, score tables and expression: operators over annotated intervals."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics
from .intervals import first_covering, merged, overlap_join, point_join, subtracted
from .select import masked
from .windows import lists, over_windows, turned

UNASSIGNED = "NA"
#: Bases of a block whose regions one task compares with their points.
SPACING_BLOCK = 1 << 16


def state_labels(points: DataFrame, states: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Each point's states, sorted and joined by a bar; points in none are NA.

    Points meet the merged intervals of each state: a row for each state of a point, however many intervals hold it.
    """
    found = point_join(points, merged(states.select("chrom", label, "s", "e"), ["chrom", label]), "left")
    return found.groupBy(*keys).agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(f"r_{label}")), "|"), F.lit("")), F.lit(UNASSIGNED)).alias("state"))


def first_state(points: DataFrame, states: DataFrame, keys: list[str], label: str = "label", order: str = "ord") -> DataFrame:
    """Each point's first state in source order; null in none."""
    found = first_covering(points, states, order, label).withColumnsRenamed({"chrom": "__c", "pos": "__p"})
    met = points.join(found, (F.col("chrom") == F.col("__c")) & (F.col("pos") == F.col("__p")), "left")
    return met.groupBy(*keys).agg(F.min_by(f"r_{label}", f"r_{order}").alias("state"))


def state_coverage(states: DataFrame, blacklist: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Bases of each state's merged intervals, outside the blacklist."""
    own = states.select("chrom", label, "s", "e")
    pieces = merged(own, ["chrom", label]) if blacklist is None else subtracted(own, blacklist, ["chrom", label])
    return pieces.groupBy(label).agg(F.sum(F.col("e") - F.col("s")).alias("bases"))


def enrichment(counts: DataFrame, coverage: DataFrame, label: str = "label") -> DataFrame:
    """Share of assigned peaks over share of bases, and peaks per million bases; no value where a share is not defined."""
    everything = Window.partitionBy(F.lit(1))  # a row for each state
    joined = coverage.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    peaks, bases = F.sum("n").over(everything), F.sum("bases").over(everything)
    return joined.withColumn("enrichment", F.try_divide(F.try_divide(F.col("n").cast("double"), peaks), F.try_divide(F.col("bases").cast("double"), bases))).withColumn("per_mb", F.try_divide(F.col("n") * F.lit(1e6), F.col("bases")))


def rule_expression(rule: str, states: str = "states") -> Column:
    """A Boolean rule over state names as a filter: ``&`` binds before ``|``, parentheses group; nothing else is known."""
    tokens = [t for t in re.findall(r"[&|()]|[^&|()]+", rule) if t.strip()]
    tokens = [t.strip() for t in tokens]
    if any("!" in t for t in tokens):
        raise ValueError("rules have no negation")
    at = 0

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if at >= len(tokens) or tokens[at] in "&|)":
            raise ValueError(f"rule ends early: {rule}")
        token = tokens[at]
        at += 1
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"parenthesis is open: {rule}")
            at += 1
            return inner
        return F.array_contains(F.col(states), token)

    made = either()
    if at != len(tokens):
        raise ValueError(f"rule goes on after its end: {rule}")
    return made


def gene_sets(genes: DataFrame, states: DataFrame, rules: dict[str, str], exclude: dict[str, list[str]] | None = None, leftover: str | None = None, gene: str = "gene_id", label: str = "label") -> DataFrame:
    """(gene, set): genes whose overlapping states fulfil a set's rule, less the candidates of the sets that it excludes.

    Without any exclusion, genes in more than one candidate set are in none. ``leftover`` names the set of genes that
    are in no candidate set. Genes meet the merged intervals of each state.
    """
    own = merged(states.select("chrom", label, "s", "e"), ["chrom", label])
    met = overlap_join(genes, own, "inner").groupBy(gene).agg(F.collect_set(f"r_{label}").alias("states"))
    candidates = met.select(gene, *[rule_expression(r).alias(n) for n, r in rules.items()])
    if exclude:
        final = {n: F.col(n) & ~F.greatest(F.lit(False), F.lit(False), *[F.col(x) for x in exclude.get(n, [])]) for n in rules}
    else:
        total = sum((F.col(n).cast("int") for n in rules), F.lit(0))
        final = {n: F.col(n) & (total == 1) for n in rules}
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in final.items()]), lambda x: x.isNotNull())
    out = candidates.select(gene, F.explode(named).alias("set_name"))
    if leftover:
        taken = candidates.where(" or ".join(f"`{n}`" for n in rules)).select(F.col(gene).alias("__g"))
        out = out.unionByName(genes.join(taken, F.col(gene) == F.col("__g"), "left_anti").select(gene, F.lit(leftover).alias("set_name")))
    return out


def filtered_peaks(peaks: DataFrame, score: Column, least_length: int | None = None, most_length: int | None = None, least: float | None = None, most: float | None = None, percentile: float | None = None) -> DataFrame:
    """Length limits first, then a score range or a percentile of the scores that are left; limits are inclusive."""
    if percentile is not None and (least is not None or most is not None):
        raise ValueError("a percentile goes without score limits")
    length, out = F.col("e") - F.col("s"), peaks
    if least_length is not None:
        out = out.where(length >= least_length)
    if most_length is not None:
        out = out.where(length <= most_length)
    if least is not None:
        out = out.where(score >= least)
    if most is not None:
        out = out.where(score <= most)
    if percentile is not None:
        cut = out.agg(F.percentile(score, F.lit(percentile / 100)).alias("__cut"))
        out = out.crossJoin(F.broadcast(cut)).where(score >= F.col("__cut")).drop("__cut")  # one row
    return out


def score_table(scores: DataFrame, key: str, score: str, width: float | None = None) -> DataFrame:
    """Score histogram by key: halves go up to whole scores, or bins of a width from the least score, with shares and running sums."""
    if width is None:
        bins = scores.withColumn("bin", F.floor(F.col(score) + 0.5).cast("long"))
    else:
        ends = scores.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
        place = F.floor((F.col(score) - F.col("lo")) / F.lit(width))
        last = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / F.lit(width)) - 1, F.lit(0))
        bins = scores.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(place, last).cast("long"))  # one row
    counted = bins.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("fraction", F.col("n") / F.sum("n").over(whole)).withColumn("cumulative", F.sum("n").over(order))


def score_summary(scores: DataFrame, key: str, score: str) -> DataFrame:
    q = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = scores.groupBy(key).agg(F.count(score).alias("n"), F.min(score).alias("least"), q.alias("q"), F.avg(score).alias("mean"), F.max(score).alias("largest"), F.stddev_pop(score).alias("std"))
    return found.select(key, "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q3"), "largest", "std")


def box_stats(values: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whiskers at the extreme values within 1.5 ranges of the box, and the count of values outside."""
    q = values.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(F.col(key).alias("__k"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    both = values.join(q, F.col(key) == F.col("__k"))
    inside = F.col(value).between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return both.groupBy(key, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("long")).alias("outside"))


def gene_regions(genes: DataFrame, flank: int = 10_000) -> DataFrame:
    """Body and strand-aware flanks of genes, cut off at zero."""
    forward = F.col("strand") == "+"
    left, right = F.struct(F.greatest(F.lit(0).cast("long"), F.col("s") - flank).alias("a"), F.col("s").alias("b")), F.struct(F.col("e").alias("a"), (F.col("e") + flank).alias("b"))
    parts = F.array(
        F.struct(F.lit("body").alias("region"), F.struct(F.col("s").alias("a"), F.col("e").alias("b")).alias("i")),
        F.struct(F.lit("upstream").alias("region"), F.when(forward, left).otherwise(right).alias("i")),
        F.struct(F.lit("downstream").alias("region"), F.when(forward, right).otherwise(left).alias("i")),
    )
    rest = [c for c in genes.columns if c not in ("s", "e")]
    return genes.select(*rest, F.explode(parts).alias("x")).select(*rest, "x.region", F.col("x.i.a").alias("s"), F.col("x.i.b").alias("e"))


def adjacent_spacing(regions: DataFrame, points: DataFrame, keys: list[str], block: int = SPACING_BLOCK) -> DataFrame:
    """Points in each region and the median distance of neighbours; null for fewer than two, no row without points.

    Regions go to the block that they begin in, with the points up to the farthest end; there the counts are
    differences of ranks and the medians come from all gaps at once, so no pair of region and point is made. Regions
    that share their keys are one region; these, if any, are joined with their points.
    """
    own = regions.where("e > s").select("chrom", "s", "e", *keys, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__same"))
    places = points.select("chrom", "pos").where("chrom is not null and pos is not null").distinct()
    single = own.where("__same = 1").drop("__same").withColumn("__block", F.floor(F.col("s") / F.lit(block)))
    reach = single.groupBy("chrom", "__block").agg(F.max("e").alias("e")).select("chrom", "__block", (F.col("__block") * block).alias("s"), "e")
    dealt = point_join(places, reach).select("chrom", F.col("r___block").alias("__block"), "pos")

    def worked(key: tuple, asked: pa.Table, seen: pa.Table) -> pa.Table:
        at = np.sort(seen["pos"].to_numpy())
        low, high = np.searchsorted(at, asked["s"].to_numpy()), np.searchsorted(at, asked["e"].to_numpy())
        held = np.flatnonzero(high > low)
        low, high = low[held], high[held]
        spacing = numerics.range_medians(np.diff(at), low, np.maximum(high - 1, low))
        return pa.table([*[asked[k].take(pa.array(held)) for k in keys], pa.array(high - low), pa.array(spacing, mask=np.isnan(spacing))], [*keys, "peaks", "spacing"])

    types = dict(regions.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", peaks long, spacing double"
    found = single.groupBy("chrom", "__block").cogroup(dealt.groupBy("chrom", "__block")).applyInArrow(worked, schema)
    inside = point_join(places, own.where("__same > 1").drop("__same"), "inner").select(*[F.col(f"r_{k}").alias(k) for k in keys], "pos")
    order = Window.partitionBy(*keys).orderBy("pos")  # the points of one region
    gaps = inside.withColumn("gap", F.col("pos") - F.lag("pos").over(order))
    return found.unionByName(gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("peaks"), F.median("gap").cast("double").alias("spacing")))


def windowed_signal(anchors: DataFrame, track: DataFrame, half: int, keys: list[str]) -> DataFrame:
    """(keys, offset, value) for the bases around each anchor that the run-length track covers; minus strands are turned."""
    around = anchors.select(*keys, "chrom", F.col("pos").alias("anchor"), "strand", (F.col("pos") - half).alias("s"), (F.col("pos") + half + 1).alias("e"))
    runs = track.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "value")
    met = overlap_join(around, runs, "inner")
    base = F.explode(F.sequence(F.greatest("s", "r_s"), F.least("e", "r_e") - 1)).alias("base")
    turn = F.when(F.col("strand") == "-", F.lit(-1)).otherwise(F.lit(1))
    return met.select(*keys, "anchor", "strand", F.col("r_value").alias("value"), base).select(*keys, ((F.col("base") - F.col("anchor")) * turn).alias("offset"), "value")


def aggregate_profile(anchors: DataFrame, track: DataFrame, half: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, offset, total, anchors, mean): bases without signal count as zero.

    The track's runs meet the windows as intervals and are summed as events by offset, so a window costs as many rows
    as runs lie in it, not as it has bases.
    """
    keys = keys or []
    around = anchors.select(*keys, "chrom", F.col("pos").alias("anchor"), "strand", (F.col("pos") - half).alias("s"), (F.col("pos") + half + 1).alias("e"))
    runs = track.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "value")
    met = overlap_join(around, runs, "inner").select(*keys, "anchor", "strand", F.col("r_value").alias("value"), F.greatest("s", "r_s").alias("a"), F.least("e", "r_e").alias("b"))
    minus = F.col("strand") == "-"
    lo = F.when(minus, F.col("anchor") - F.col("b") + 1).otherwise(F.col("a") - F.col("anchor"))
    hi = F.when(minus, F.col("anchor") - F.col("a") + 1).otherwise(F.col("b") - F.col("anchor"))
    events = met.select(*keys, F.explode(F.array(F.struct(lo.alias("offset"), F.col("value").alias("d")), F.struct(hi.alias("offset"), (-F.col("value")).alias("d")))).alias("x")).groupBy(*keys, "x.offset").agg(F.sum("x.d").alias("d"))
    n = around.groupBy(*keys).agg(F.count(F.lit(1)).alias("anchors"))
    grid = n.select(*keys, "anchors", F.explode(F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long"))).alias("offset"))
    window = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)  # 2 half + 1 rows a key
    found = grid.join(events, [*keys, "offset"], "left").withColumn("total", F.sum(F.coalesce("d", F.lit(0))).over(window))
    return found.select(*keys, "offset", "total", "anchors", (F.col("total") / F.col("anchors")).alias("mean"))


def masked_profile(anchors: DataFrame, track: DataFrame, blacklist: DataFrame, half: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, offset, total, valid, mean): blacklisted bases are neither signal nor places; no mean where no place is valid."""
    keys = keys or []
    hidden = merged(blacklist.select("chrom", "s", "e"), ["chrom"]).select("chrom", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(1).cast("long").alias("value"))
    seen = aggregate_profile(anchors, masked(track, blacklist), half, keys)
    gone = aggregate_profile(anchors, hidden, half, keys).select(*keys, "offset", F.col("total").alias("hidden"))
    both = seen.join(gone, [*keys, "offset"]).withColumn("valid", F.col("anchors") - F.col("hidden").cast("long"))
    return both.select(*keys, "offset", "total", "valid", F.try_divide(F.col("total"), F.col("valid")).alias("mean"))


def signal_matrix(anchors: DataFrame, track: DataFrame, half: int, keys: list[str], sizes: dict[str, int]) -> DataFrame:
    """(keys, signal): the values of each window in order of offset, turned on minus strands; NaN beyond the contig, zero without signal."""
    found = windowed_signal(anchors, track, half, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("offset", "value"))).alias("m"))  # at most 2 half + 1 entries
    length = F.coalesce(*[F.when(F.col("chrom") == c, F.lit(n)) for c, n in sizes.items()])
    turn = F.when(F.col("strand") == "-", F.lit(-1)).otherwise(F.lit(1))
    rows = anchors.select(*keys, "pos", length.alias("__length"), turn.alias("__turn")).join(found, keys, "left")
    base = lambda o: F.col("pos") + o * F.col("__turn")
    value = lambda o: F.when((base(o) >= 0) & (base(o) < F.col("__length")), F.coalesce(F.try_element_at("m", o), F.lit(0)).cast("double")).otherwise(F.lit(float("nan")))
    return rows.select(*keys, F.transform(F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long")), value).alias("signal"))


def profile_shares(counts: DataFrame, profile: str = "profile", length: str = "length", n: str = "n") -> DataFrame:
    """Counts of length profiles as percent of the profile and of the length, and min-max within the profile."""
    by, at = Window.partitionBy(profile), Window.partitionBy(length)
    span = F.max(n).over(by) - F.min(n).over(by)
    return counts.withColumn("profile_percent", F.coalesce(F.try_divide(F.lit(100.0) * F.col(n), F.sum(n).over(by)), F.lit(0.0))).withColumn("length_percent", F.coalesce(F.try_divide(F.lit(100.0) * F.col(n), F.sum(n).over(at)), F.lit(0.0))).withColumn("minmax", F.coalesce(F.try_divide((F.col(n) - F.min(n).over(by)).cast("double"), span), F.lit(0.0)))


def length_zscores(counts: DataFrame, profile: str = "profile", length: str = "length", n: str = "n") -> DataFrame:
    """Zero-filled grid of profile percents, standardised over the profiles at each length (population deviation)."""
    shares = profile_shares(counts, profile, length, n).select(profile, length, "profile_percent")
    profiles = counts.select(profile).distinct()
    lengths = counts.select(length).distinct()
    grid = lengths.join(profiles.groupBy().agg(F.collect_list(profile).alias("__p"))).select(length, F.explode("__p").alias(profile))
    full = grid.join(shares, [profile, length], "left").withColumn("v", F.coalesce("profile_percent", F.lit(0.0)))
    at = Window.partitionBy(length)
    return full.select(profile, length, F.coalesce(F.try_divide(F.col("v") - F.avg("v").over(at), F.stddev_pop("v").over(at)), F.lit(0.0)).alias("z"))


def weighted_middle(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """First value at which the running count reaches half, and the smallest most frequent value."""
    order = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("run", F.sum(n).over(order)).withColumn("whole", F.sum(n).over(Window.partitionBy(key)))
    return run.groupBy(key).agg(F.min(F.when(2 * F.col("run") >= F.col("whole"), F.col(value))).alias("median"), F.min_by(value, F.struct(-F.col(n), F.col(value))).alias("mode"))


def by_target(peaks: DataFrame, score: str, target: int) -> DataFrame:
    """Peaks from the percentile on that leaves about ``target`` of them, its threshold included; all where there are fewer."""
    total = peaks.count()
    if total <= target:
        return peaks
    return filtered_peaks(peaks, F.col(score), percentile=100 * (1 - target / total))


def in_score_bins(df: DataFrame, score: str, bounds: list[float]) -> DataFrame:
    """Rows with the number of their score bin: a bound belongs to the bin above, the last bin has no upper end."""
    place = None
    for k, low in enumerate(bounds):
        here = F.col(score) >= low if k == len(bounds) - 1 else (F.col(score) >= low) & (F.col(score) < bounds[k + 1])
        place = F.when(here, k) if place is None else place.when(here, k)
    return df.withColumn("bin", place).where("bin is not null")


def shared_histogram(scores: DataFrame, key: str, score: str, bins: int | None = None, mode: str = "count") -> DataFrame:
    """(key, bin, n, value) with edges that all keys share and a row for each bin: whole scores (halves up, zero among them) or ``bins`` equal ones, the last closed."""
    ends = scores.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if ends["lo"] is None:
        return scores.select(key, F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("value")).limit(0)
    if bins is None:
        low, high, width = min(0, math.floor(ends["lo"] + 0.5)), max(0, math.floor(ends["hi"] + 0.5)), 1.0
        place = F.floor(F.col(score) + 0.5)
    else:
        lo, hi = float(ends["lo"]), float(ends["hi"])
        if lo == hi:
            lo, hi = lo - max(abs(lo) * 0.01, 0.5), hi + max(abs(hi) * 0.01, 0.5)
        low, high, width = 0, bins - 1, (hi - lo) / bins
        place = F.least(F.floor((F.col(score) - lo) / F.lit(width)), F.lit(bins - 1))
    counted = scores.groupBy(key, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(key).agg(F.sum("n").alias("total"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    full = grid.join(counted, [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    part = F.col("n") / F.col("total")
    value = {"count": F.col("n").cast("double"), "fraction": part, "percent": part * 100, "density": part / F.lit(width)}[mode]
    return full.select(key, "bin", "n", value.alias("value"))


def state_coverage_with_union(states: DataFrame, label: str = "label") -> DataFrame:
    """Bases of each state and, in ``together``, of all states as one."""
    whole = merged(states.select("chrom", "s", "e"), ["chrom"]).agg(F.sum(F.col("e") - F.col("s")).alias("together"))
    return state_coverage(states, label=label).crossJoin(F.broadcast(whole))  # one row


def state_colours(states: DataFrame, label: str = "label", rgb: str = "rgb", order: str = "ord") -> DataFrame:
    """(label, rgb, conflicts): the first colour of each label that is one, and how many others it has."""
    return states.groupBy(label).agg(F.min_by(rgb, order).alias(rgb), (F.count_distinct(rgb) - 1).alias("conflicts"), F.min(order).alias(order))


def checked_genes(genes: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Genes, an error where an id comes twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(gene))
    return genes.withColumn(gene, F.when(n > 1, F.raise_error(F.concat(F.lit("gene comes twice: "), F.col(gene).cast("string"))).cast(dict(genes.dtypes)[gene])).otherwise(F.col(gene)))


def expressed(expression: DataFrame, profiles: int, over: float = 0.0, gene: str = "gene_id", value: str = "value") -> DataFrame:
    """Rows of the genes that are over a value in so many profiles at least."""
    kept = expression.where(F.col(value) > over).groupBy(gene).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= profiles).select(gene)
    return expression.join(kept, gene, "left_semi")


def gene_windows(genes: DataFrame, sizes: dict[str, int], window: int = 10_000, blacklist: DataFrame | None = None, gene: str = "gene_id", least_valid: float = 0.0) -> DataFrame:
    """(gene, chrom, strand, s, valid): windows from each gene's start in its direction; those beyond a contig are left out, as are those with too few valid bases."""
    length = F.coalesce(*[F.when(F.col("chrom") == c, F.lit(n)) for c, n in sizes.items()])
    plus = F.col("strand") == "+"
    around = genes.select(gene, "chrom", "strand", F.when(plus, F.col("s")).otherwise(F.col("e") - window).alias("s"), F.when(plus, F.col("s") + window).otherwise(F.col("e")).alias("e"))
    around = around.where((F.col("s") >= 0) & (F.col("e") <= length))
    if blacklist is None:
        return around.withColumn("valid", F.lit(1.0)).drop("e")
    holes = merged(blacklist.select("chrom", "s", "e"), ["chrom"])
    hidden = overlap_join(around, holes).groupBy(gene).agg(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).alias("hidden"))
    both = around.join(hidden, gene, "left").withColumn("valid", 1 - F.coalesce("hidden", F.lit(0)) / F.lit(window))
    return both.where(F.col("valid") >= least_valid).drop("e", "hidden")


def gene_signal(genes: DataFrame, track: DataFrame, sizes: dict[str, int], window: int = 10_000, blacklist: DataFrame | None = None, gene: str = "gene_id", least_valid: float = 0.0) -> DataFrame:
    """(gene, signal, valid): values of the windows of ``gene_windows`` in each gene's direction."""
    def laid(rows: np.ndarray, own: pa.Table) -> pa.Table:
        return pa.table([own[gene], lists(turned(rows, own)), own["valid"]], [gene, "signal", "valid"])

    return over_windows(gene_windows(genes, sizes, window, blacklist, gene, least_valid), track, window, laid, f"`{gene}` {dict(genes.dtypes)[gene]}, signal array<double>, valid double")


def gene_moments(genes: DataFrame, track: DataFrame, sizes: dict[str, int], window: int = 10_000, blacklist: DataFrame | None = None, gene: str = "gene_id", least_valid: float = 0.0) -> DataFrame:
    """(gene, total, moment, valid): sums of the signal of ``gene_signal``, and of the signal times its place, without handing on the signal."""
    def summed(rows: np.ndarray, own: pa.Table) -> pa.Table:
        rows = turned(rows, own)
        return pa.table([own[gene], pa.array(rows.sum(1)), pa.array(rows @ np.arange(window, dtype=float)), own["valid"]], [gene, "total", "moment", "valid"])

    return over_windows(gene_windows(genes, sizes, window, blacklist, gene, least_valid), track, window, summed, f"`{gene}` {dict(genes.dtypes)[gene]}, total double, moment double, valid double")


def ranked_profiles(correlations: DataFrame, sample: str, profile: str, r: str) -> DataFrame:
    """Profiles ranked in each sample, the most negative correlation first, ties by name; those that are not finite have no rank."""
    order = Window.partitionBy(sample).orderBy(r, F.lower(profile))
    return correlations.where(F.col(r).isNotNull() & ~F.isnan(r)).withColumn("rank", F.row_number().over(order).cast("long"))


def rank_change(ranked: DataFrame, sample: str, profile: str, controls: list[str]) -> DataFrame:
    """Ranks with the mean rank over the control samples less their own."""
    base = ranked.where(F.col(sample).isin(*controls)).groupBy(F.col(profile).alias("__p")).agg(F.avg("rank").alias("__base"))
    return ranked.join(base, F.col(profile) == F.col("__p"), "left").withColumn("change", F.col("__base") - F.col("rank")).drop("__p", "__base")


def venn(members: DataFrame, gene: str = "gene_id", name: str = "set_name") -> DataFrame:
    """(sets, n): how many genes are in just these sets."""
    own = members.groupBy(gene).agg(F.array_join(F.array_sort(F.collect_set(name)), "&").alias("sets"))
    return own.groupBy("sets").agg(F.count(F.lit(1)).alias("n"))


def exclusive(members: DataFrame, gene: str = "gene_id", name: str = "set_name") -> DataFrame:
    """Members, an error where a gene is in two sets."""
    n = F.count(F.lit(1)).over(Window.partitionBy(gene))
    return members.withColumn(name, F.when(n > 1, F.raise_error(F.concat(F.lit("gene is in two sets: "), F.col(gene).cast("string")))).otherwise(F.col(name)))


def row_key(signal: Column, mode: str) -> list[Column]:
    """Order of the rows of a heat map: centre, max, mean_absolute (largest first) or rise_after_min (shortest first)."""
    middle = F.element_at(signal, (F.size(signal) / 2).cast("int") + 1)
    if mode == "center":
        return [-middle]
    if mode == "max":
        return [-F.array_max(F.filter(signal, lambda v: ~F.isnan(v)))]
    if mode == "mean_absolute":
        fine = F.filter(signal, lambda v: ~F.isnan(v))
        return [-F.aggregate(fine, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(fine)]
    if mode == "rise_after_min":
        left = F.slice(signal, 1, (F.size(signal) / 2).cast("int") + 1)
        at = F.array_position(left, F.array_min(left))
        after = F.slice(signal, (at + 1).cast("int"), F.size(signal))
        rise = F.array_position(F.transform(after, lambda v: v >= 0), F.lit(True))
        none = (F.array_min(left) >= 0) | (rise == 0)
        return [F.when(none, F.lit(float("inf"))).otherwise(rise.cast("double")), -middle]
    raise ValueError(f"unknown order {mode}")


def sorted_rows(rows: DataFrame, mode: str, *ties: Column) -> DataFrame:
    """Rows with their rank in an order of heat maps; ``unsorted`` is the order of the ties alone."""
    from .spacing import global_rank

    keys = [] if mode == "unsorted" else row_key(F.col("signal"), mode)
    return global_rank(rows, *keys, *ties)


def central_crop(signal: Column, columns: int, breadth: float) -> Column:
    """The middle part of a row, an odd number of columns."""
    if breadth >= 1:
        return signal
    keep = max(1, min(int(columns * breadth), columns))
    keep = min(columns, keep + 1) if keep % 2 == 0 else keep
    return F.slice(signal, columns // 2 - keep // 2 + 1, keep)


def with_metadata(profiles: DataFrame, metadata: DataFrame, profile: str = "profile", columns: list[str] | None = None) -> DataFrame:
    """Profiles with what is known of them, found by their name without regard to case and spacing; blank where nothing is."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\\s_]+", " ")))
    columns = columns or [c for c in metadata.columns if c != profile]
    own = metadata.select(key(F.col(profile)).alias("__key"), *columns).dropDuplicates(["__key"])
    return profiles.join(own, key(F.col(profile)) == F.col("__key"), "left").select(*profiles.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
