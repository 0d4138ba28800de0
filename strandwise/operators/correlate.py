"""Distance correlations of sparse signals by band joins, and their opportunities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import band_join, overlap_join


def windows(sizes: DataFrame, width: int = 100_000, least: int = 2, chrom: str = "chrom", length: str = "length") -> DataFrame:
    """Windows (chrom, window, s, e) side by side over each contig; a short tail goes if it is under ``least``."""
    found = sizes.where(F.col(length) > 0).select(chrom, length, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(length) - 1) / F.lit(width)))).alias("window"))
    found = found.select(chrom, "window", (F.col("window") * width).alias("s"), F.least((F.col("window") + 1) * width, F.col(length)).alias("e"))
    return found.where(F.col("e") - F.col("s") >= least)


def in_windows(points: DataFrame, width: int = 100_000, pos: str = "pos") -> DataFrame:
    return points.withColumn("window", F.floor(F.col(pos) / F.lit(width)))


def auto_correlation(points: DataFrame, dmax: int = 2000, keys: tuple[str, ...] = ("chrom", "window"), pos: str = "pos", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, distance, raw): sum of value times value at distances 1 to dmax inside each region."""
    pairs = band_join(points, points, list(dict.fromkeys([*keys, *by])), pos, 1, dmax)
    return pairs.groupBy(*by, (F.col(f"r_{pos}") - F.col(pos)).alias("distance")).agg(F.sum(F.col(value) * F.col(f"r_{value}")).alias("raw"))


def cross_correlation(left: DataFrame, right: DataFrame, dmax: int = 500, keys: tuple[str, ...] = ("chrom", "window"), pos: str = "pos", value: str = "value") -> DataFrame:
    """(lag, raw): sum of left times right over right position minus left position from -dmax to dmax."""
    pairs = band_join(left, right, list(keys), pos, -dmax, dmax)
    return pairs.groupBy((F.col(f"r_{pos}") - F.col(pos)).alias("lag")).agg(F.sum(F.col(value) * F.col(f"r_{value}")).alias("raw"))


def opportunities(regions: DataFrame, dmax: int = 2000, signed: bool = False, start: str = "s", end: str = "e") -> DataFrame:
    """(distance, opportunities): places of each region that have a partner; regions are counted by length first."""
    lengths = regions.groupBy((F.col(end) - F.col(start)).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    lag = F.explode(F.sequence(F.lit(-dmax if signed else 1), F.lit(dmax))).alias("distance")
    return lengths.select("length", "n", lag).groupBy("distance").agg(F.sum(F.col("n") * F.greatest(F.col("length") - F.abs("distance"), F.lit(0))).alias("opportunities"))


def masked_opportunities(segments: DataFrame, dmax: int = 2000, keys: tuple[str, ...] = ("chrom", "window"), start: str = "s", end: str = "e") -> DataFrame:
    """Opportunities where only the given segments of each region are valid: pairs of segments within reach."""
    own = segments.select(F.struct(*keys).alias("region"), F.col(start).alias("s"), F.col(end).alias("e"))
    far = own.withColumn("e", F.col("e") + dmax)  # what a partner of one of its bases can be in
    reach = overlap_join(far, own, "inner", "region").select((F.col("e") - dmax).alias(end), F.col("s").alias(start), F.col("r_s").alias("rs"), F.col("r_e").alias("re"))
    lag = F.explode(F.sequence(F.greatest(F.lit(1), F.col("rs") - F.col(end) + 1), F.least(F.lit(dmax), F.col("re") - F.col(start) - 1))).alias("distance")
    sized = reach.where("least({0}, re - {1} - 1) >= greatest(1, rs - {2} + 1)".format(dmax, start, end)).select(start, end, "rs", "re", lag)
    both = F.least(F.col(end), F.col("re") - F.col("distance")) - F.greatest(F.col(start), F.col("rs") - F.col("distance"))
    return sized.groupBy("distance").agg(F.sum(F.greatest(both, F.lit(0))).alias("opportunities"))


def absolute(signed: DataFrame, lag: str = "lag", *values: str) -> DataFrame:
    """Sums of both signs of a lag; lag zero counts once."""
    return signed.groupBy(F.abs(F.col(lag)).cast("long").alias("distance")).agg(*[F.sum(v).alias(v) for v in values])


def per_opportunity(raw: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(raw, count), F.lit(0.0))


def lag_sums(x: np.ndarray, y: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sums of x[i] y[i + lag] for lags from low to high; FFT where many lags are asked for."""
    if high - low > 512:
        size = 1 << int(np.ceil(np.log2(len(x) + len(y))))
        full = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
        return np.round(full[np.arange(low, high + 1) % size], 6)
    out = np.zeros(high - low + 1)
    for k, lag in enumerate(range(low, high + 1)):
        a, b = max(0, -lag), min(len(x), len(y) - lag)
        if b > a:
            out[k] = x[a:b] @ y[a + lag:b + lag]
    return out


def _by_density(points: DataFrame, width: int, share: float, keys: list[str]) -> DataFrame:
    """Regions in which over a share of the bases has a point."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share * width).select(*keys)


def _laid(rows: pd.DataFrame, first: int, width: int, pos: str, value: str) -> np.ndarray:
    out = np.zeros(width)
    np.add.at(out, rows[pos].to_numpy(np.int64) - first, rows[value].to_numpy(float))
    return out


def auto_correlation_by_density(points: DataFrame, width: int = 100_000, dmax: int = 2000, share: float = 0.1, keys: tuple[str, ...] = ("chrom", "window"), pos: str = "pos", value: str = "value") -> DataFrame:
    """(distance, raw) as ``auto_correlation``: sparse regions by a band join, dense ones as arrays of ``width`` bases."""
    dense = _by_density(points, width, share, list(keys))

    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _laid(rows, int(rows["window"].iloc[0]) * width, width, pos, value)
        return pd.DataFrame({"distance": np.arange(1, dmax + 1), "raw": lag_sums(x, x, 1, dmax)})

    thick = points.join(dense, list(keys), "left_semi").groupBy(*keys).applyInPandas(worked, "distance long, raw double")
    thin = auto_correlation(points.join(dense, list(keys), "left_anti"), dmax, keys, pos, value).select(F.col("distance").cast("long").alias("distance"), F.col("raw").cast("double").alias("raw"))
    return thin.unionByName(thick).groupBy("distance").agg(F.sum("raw").alias("raw"))


def cross_correlation_by_density(left: DataFrame, right: DataFrame, width: int = 100_000, dmax: int = 500, share: float = 0.1, keys: tuple[str, ...] = ("chrom", "window"), pos: str = "pos", value: str = "value") -> DataFrame:
    """(lag, raw) of every lag from -dmax to dmax: regions where a side is dense as arrays, all others by a band join."""
    names = list(keys)
    dense = _by_density(left, width, share, names).unionByName(_by_density(right, width, share, names)).distinct()

    def worked(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"lag": np.empty(0, np.int64), "raw": np.empty(0)})
        first = int(a["window"].iloc[0]) * width
        return pd.DataFrame({"lag": np.arange(-dmax, dmax + 1), "raw": lag_sums(_laid(a, first, width, pos, value), _laid(b, first, width, pos, value), -dmax, dmax)})

    sides = [df.join(dense, names, "left_semi").select(*[F.col(c).alias(c) for c in (*names, pos)], F.col(value).cast("double").alias(value)) for df in (left, right)]  # names of their own, as both may come from one table
    thick = sides[0].groupBy(*names).cogroup(sides[1].groupBy(*names)).applyInPandas(worked, "lag long, raw double")
    thin = cross_correlation(left.join(dense, names, "left_anti"), right, dmax, keys, pos, value).select(F.col("lag").cast("long").alias("lag"), F.col("raw").cast("double").alias("raw"))
    found = thin.unionByName(thick).groupBy("lag").agg(F.sum("raw").alias("raw"))
    grid = left.sparkSession.range(-dmax, dmax + 1).withColumnRenamed("id", "lag")
    return grid.join(found, "lag", "left").select("lag", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def reported(raw: DataFrame, chances: DataFrame, total: float, scale: float = 1e6, distance: str = "distance") -> DataFrame:
    """(distance, value, percent, raw, opportunities, per_million): raw over opportunities, its share of all distances, raw over the square of the signal's total."""
    both = chances.join(raw, distance, "left").withColumn("raw", F.coalesce(F.col("raw").cast("double"), F.lit(0.0))).withColumn("value", per_opportunity(F.col("raw"), F.col("opportunities")))
    whole = both.agg(F.sum("value").alias("__all"))
    pairs = F.col("raw") * F.lit(scale / (total * total)) if total else F.lit(0.0)
    return both.crossJoin(F.broadcast(whole)).select(distance, "value", F.coalesce(F.try_divide(F.col("value") * 100, F.col("__all")), F.lit(0.0)).alias("percent"), "raw", "opportunities", pairs.alias("per_million"))  # one row


def by_totals(raw: DataFrame, a: float, b: float) -> DataFrame:
    """Raw sums over the product of both signals' totals; zero where a signal is empty."""
    return raw.withColumn("value", F.col("raw") / F.lit(a * b) if a * b else F.lit(0.0))


def with_both(regions: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Regions that have both signals."""
    return regions.join(a.select(*keys).distinct(), keys, "left_semi").join(b.select(*keys).distinct(), keys, "left_semi")


def shift_summary(values: DataFrame, dmax: int, window: int = 50, chosen: tuple[int, ...] = (-20, -10, -5, 0, 5, 10, 20), against: tuple[int, ...] = (5, -5, 10, -10, 20, -20)) -> DataFrame:
    """(metric, lag, value): the lag of the largest value, overall and near zero (the smallest on ties), values at chosen lags, and their difference from lag zero."""
    grid = values.sparkSession.range(-dmax, dmax + 1).withColumnRenamed("id", "lag")
    full = grid.join(values.select(F.col("lag").cast("long").alias("lag"), "value"), "lag", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    best = lambda keep: F.max(F.when(keep, F.struct("value", (-F.col("lag")).alias("l"))))
    at = {lag: F.max(F.when(F.col("lag") == lag, F.col("value"))).alias(f"v{lag}".replace("-", "m")) for lag in {*chosen, *against, 0}}
    one = full.agg(best(F.lit(True)).alias("all"), best(F.abs("lag") <= window).alias("near"), *at.values())
    name = lambda lag: f"v{lag}".replace("-", "m")
    rows = [F.struct(F.lit("max_lag_all").alias("metric"), (-F.col("all.l")).alias("lag"), F.col("all.value").alias("value")), F.struct(F.lit(f"max_lag_within_{window}bp").alias("metric"), (-F.col("near.l")).alias("lag"), F.col("near.value").alias("value"))]
    rows += [F.struct(F.lit(f"lag_{lag}").alias("metric"), F.lit(lag).cast("long").alias("lag"), F.col(name(lag)).alias("value")) for lag in chosen if abs(lag) <= dmax]
    rows += [F.struct(F.lit(f"lag_{lag}_minus_lag_0").alias("metric"), F.lit(lag).cast("long").alias("lag"), (F.col(name(lag)) - F.col("v0")).alias("value")) for lag in against if abs(lag) <= dmax]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
