"""Tables about matched pairs of positions, and checks of inputs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.contigs import contig_key, significance

BOUNDS = (5, 10, 20, 50, 100)


def signed_histogram(pairs: DataFrame, distance: str, low: float = -250, high: float = 250, width: float = 1.0) -> DataFrame:
    """(bin, n, density): bins from ``low``, the last one closed, empty ones too; density is over all pairs, also those outside."""
    bins = max(1, round((high - low) / width))
    place = F.when(F.col(distance) == high, F.lit(bins - 1)).otherwise(F.floor((F.col(distance) - low) / F.lit(width))).cast("long")
    counted = pairs.where(F.col(distance).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    grid = pairs.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(total))  # one row
    return grid.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total") * width), F.lit(0.0)).alias("density"))


def distance_bin(distance: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """Number of the bin (..b0], (b0..b1], ..., over the last bound."""
    out = F.when(distance <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(distance <= b, i)
    return out.otherwise(len(bounds))


def distance_bin_correlation(pairs: DataFrame, distance: str, a: str, b: str, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    return pairs.groupBy(distance_bin(F.abs(distance), bounds).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"))


def percentile_summary(pairs: DataFrame, group: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), q.alias("q"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return found.select(group, "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "largest")


def average_percentile_rank(scores: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """100 (average rank - 1) / (n - 1) within each key, 100 for a single row: the ranks of Spearman's correlation."""
    per = scores.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("ties"))
    order = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("rank", F.coalesce(F.sum("ties").over(order), F.lit(0)) + (F.col("ties") + 1) / 2).withColumn("__n", F.sum("ties").over(Window.partitionBy(*keys)))
    return ranked.select(*keys, score, F.when(F.col("__n") == 1, F.lit(100.0)).otherwise(F.try_divide(100 * (F.col("rank") - 1), F.col("__n") - 1)).alias("percentile"))


def group_tests(samples: dict[str, np.ndarray], paired: bool, parametric: bool = False) -> list[tuple[str, str, float, float, float]]:
    """(a, b, statistic, p, adjusted p) of all pairs of named samples of one group; a group's samples are small.

    Paired samples: Wilcoxon or paired t; others: Mann-Whitney or Welch. Samples under two values have no test.
    """
    names, rows = sorted(samples), []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            x, y = samples[a], samples[b]
            if min(len(x), len(y)) < 2:
                continue
            test = (numerics.paired_t if parametric else numerics.wilcoxon) if paired else (numerics.welch if parametric else numerics.mann_whitney)
            rows.append((a, b, *test(np.asarray(x, float), np.asarray(y, float))))
    adjusted = numerics.holm(np.array([r[3] for r in rows])) if rows else []
    return [(*r, float(q)) for r, q in zip(rows, adjusted) if not math.isnan(r[3])]


def input_report(rows: DataFrame, sizes: DataFrame, chrom: str = "chrom", start: str = "s", end: str = "e") -> DataFrame:
    """(check, failed, passed) counts of rows: intervals in order and not negative, known contigs, ends inside them."""
    lengths = sizes.select(contig_key(F.col("chrom")).alias("__k"), F.col("length").alias("__length"))
    known = rows.withColumn("__key", contig_key(F.col(chrom))).join(F.broadcast(lengths) if lengths.count() <= 100_000 else lengths, F.col("__key") == F.col("__k"), "left")
    tests = {"interval": (F.col(start) >= 0) & (F.col(end) > F.col(start)), "contig": F.col("__k").isNotNull(), "inside": F.col("__k").isNotNull() & (F.col(end) <= F.col("__length"))}
    counted = known.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.coalesce(t, F.lit(False)).cast("long")).alias(n) for n, t in tests.items()])
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), (F.col("__n") - F.coalesce(n, F.lit(0))).alias("failed"), F.coalesce(n, F.lit(0)).alias("passed")) for n in tests]))
    return counted.select(parts.alias("x")).select("x.*")


def _p_value(r: str, n: str) -> Column:
    """Two-sided p of a correlation, for a row of each group."""
    p = F.pandas_udf(lambda r, n: pd.Series([numerics.correlation_p(float(a), int(b)) if a is not None else math.nan for a, b in zip(r, n)]), "double")
    return p(F.col(r).cast("double"), F.col(n))


def pair_statistics(pairs: DataFrame, key: str, x: str, y: str, ranks: bool = False) -> DataFrame:
    """(key, n, r, r_p, slope, intercept, r2[, rho, rho_p]) of finite pairs; no value for under two pairs or a constant side."""
    fine = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    found = fine.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.nanvl(F.corr(x, y), F.lit(None)).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    found = found.withColumn("r_p", _p_value("r", "n"))
    if not ranks:
        return found
    ranked = fine
    for side, name in ((x, "__x"), (y, "__y")):
        own = average_percentile_rank(fine, side, [key]).select(F.col(key).alias("__k"), F.col(side).alias("__v"), F.col("percentile").alias(name))
        ranked = ranked.join(own, (F.col(key) == F.col("__k")) & (F.col(side) == F.col("__v"))).drop("__k", "__v")
    rho = ranked.groupBy(F.col(key).alias("__k")).agg(F.nanvl(F.corr("__x", "__y"), F.lit(None)).alias("rho"))
    return found.join(rho, F.col(key) == F.col("__k")).drop("__k").withColumn("rho_p", _p_value("rho", "n"))


def match_accounts(query: DataFrame, target: DataFrame, pairs: DataFrame, most: float | None, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(chrom, pos, status) of each query position: matched, no_contig, beyond_distance (a target at an end of the contig is too far) or unique_assignment."""
    ends = target.groupBy(F.col(chrom).alias("__c")).agg(F.min(pos).alias("__low"), F.max(pos).alias("__high"))
    own = pairs.select(F.col(chrom).alias("__pc"), F.col("query").alias("__q"))
    asked = query.select(chrom, pos).distinct().join(ends, F.col(chrom) == F.col("__c"), "left").join(own, (F.col(chrom) == F.col("__pc")) & (F.col(pos) == F.col("__q")), "left")
    far = F.greatest(F.abs(F.col("__low") - F.col(pos)), F.abs(F.col("__high") - F.col(pos)))
    beyond = F.lit(False) if most is None else far > most
    status = F.when(F.col("__q").isNotNull(), "matched").when(F.col("__c").isNull(), "no_contig").when(beyond, "beyond_distance").otherwise("unique_assignment")
    return asked.select(chrom, pos, status.alias("status"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, second): values of both sets that belong to one line."""
    return a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys)


def tested_groups(values: DataFrame, part: str, group: str, value: str) -> DataFrame:
    """(part, a, b, n_a, n_b, statistic, p, adjusted, stars): Mann-Whitney of each two groups of a part, adjusted by Holm in the part.

    Ranks come from counts of different values, so no task holds a part's rows; groups of a part are few.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(part, group, value).agg(F.count(F.lit(1)).alias("n"))
    groups = counted.select(F.col(part).alias("__p"), F.col(group).alias("other")).distinct()
    both = counted.join(groups, (F.col(part) == F.col("__p")) & (F.col(group) != F.col("other"))).drop("__p")
    first = F.col(group) < F.col("other")
    sides = both.groupBy(part, F.least(group, "other").alias("a"), F.greatest(group, "other").alias("b"), value).agg(F.sum(F.when(first, F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(first, 0).otherwise(F.col("n"))).alias("nb"))
    order = Window.partitionBy(part, "a", "b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("na") + F.col("nb")
    ranked = sides.withColumn("rank", F.coalesce(F.sum(t).over(order), F.lit(0)) + (t + 1) / 2)
    td = t.cast("double")
    sums = ranked.groupBy(part, "a", "b").agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na") * F.col("rank")).alias("ranks"), F.sum(td * td * td - td).alias("ties"))
    sums = sums.withColumn("statistic", F.col("ranks") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    kind = dict(values.dtypes)

    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        rows["p"] = [numerics.mann_whitney_p(u, n, m, ties) for u, n, m, ties in zip(rows["statistic"], rows["n_a"], rows["n_b"], rows["ties"])]
        rows["adjusted"] = numerics.holm(rows["p"].to_numpy(float))
        return rows[[part, "a", "b", "n_a", "n_b", "statistic", "p", "adjusted"]]

    found = sums.groupBy(part).applyInPandas(worked, f"{part} {kind[part]}, a {kind[group]}, b {kind[group]}, n_a long, n_b long, statistic double, p double, adjusted double")
    return found.withColumn("stars", significance(F.col("adjusted")))
