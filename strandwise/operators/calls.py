"""Callers and smoothers that need a region's or block's values in order; they run as Arrow batches of bounded arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from . import signals
from .windows import lists, over_windows, turned

#: Bases of a block of a smoothed track, and those that it sees on each side.
BLOCK, HALO = 100_000, 1_100


def half_away(value: float) -> int:
    """The nearest whole number, halves away from zero: the sign times the floor of the magnitude and a half."""
    return int(math.copysign(math.floor(abs(value) + 0.5), value))


def source_median(values: np.ndarray) -> float:
    """The upper of two middle values of an even count; of an odd count the mean of the middle one and the next."""
    ordered, n = np.sort(values), len(values)
    low, up = n // 2, half_away(n / 2)
    return float(ordered[low]) if up == low else float(ordered[min(up, n - 1)] + ordered[low]) / 2


def stretches(places: np.ndarray, values: np.ndarray) -> list[tuple[float, int, int, float]]:
    """(sum, first, last, largest) of unbroken places; the place right after each gap only ends the stretch and is lost."""
    out, at = [], 0
    while at < len(places):
        end = at
        while end + 1 < len(places) and places[end + 1] == places[end] + 1:
            end += 1
        out.append((float(values[at:end + 1].sum()), int(places[at]), int(places[end]), float(values[at:end + 1].max())))
        at = end + 2
    return out


def protected_calls(start: int, values: np.ndarray, least: int = 50, most: int = 150, widest: int = 450, cutoff: float = 5.0) -> list[tuple[int, int, int, float]]:
    """(start, end, centre, score) in zero-based half-open places for one region of positive signal from ``start``."""
    if not least <= len(values) <= widest:
        return []
    over = values >= source_median(values)
    found = stretches(start + 1 + np.flatnonzero(over), values[over])
    if not found:
        return []
    whole = len(values) <= most
    chosen = [max(found)] if whole else [x for x in found if least <= x[2] - x[1] + 1 <= most]
    return [(a - 1, b, a + half_away((b - a) / 2) - 1, top) for _, a, b, top in chosen if top > cutoff]


def call_protected(track: DataFrame, gap: int = 5, least: int = 50, most: int = 150, widest: int = 450, cutoff: float = 5.0) -> DataFrame:
    """Peaks of a protection track in run-length form: positive runs up to ``gap`` bases apart are one region, zeros between."""
    regions = signals.islands(track.where("value > 0"), ["chrom"], gap).groupBy("chrom", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("runs"))
    regions = regions.where((F.col("e") - F.col("s")).between(least, widest)).drop("island")

    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chrom, s, e, runs in zip(batch["chrom"], batch["s"], batch["e"], batch["runs"]):
                values = np.zeros(e - s)
                for r in runs:
                    values[r["start"] - s:r["end"] - s] = r["value"]
                rows += [(chrom, *c) for c in protected_calls(s, values, least, most, widest, cutoff)]
            yield pd.DataFrame(rows, columns=["chrom", "start", "end", "centre", "score"])

    return regions.mapInPandas(called, "chrom string, start long, end long, centre long, score double")


def blocks(track: DataFrame, sizes: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(chrom, length, block, runs): the runs that each block of a contig sees, its halo included; empty blocks too."""
    grid = sizes.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block"))
    low, high = F.floor((F.col("start") - halo) / F.lit(block)), F.floor((F.col("end") - 1 + halo) / F.lit(block))
    dealt = track.select("chrom", F.struct("start", "end", F.col("value").cast("double").alias("value")).alias("r"), F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("block"))
    kept = dealt.groupBy("chrom", "block").agg(F.collect_list("r").alias("runs"))  # at most block + 2 halo runs
    return grid.join(kept, ["chrom", "block"], "left")


def adjusted_protection(track: DataFrame, sizes: DataFrame, window: int = 1000, smooth: int = 21, order: int = 2, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(chrom, start, raw, smoothed, adjusted, smoothed_adjusted): arrays of each block's bases.

    The baseline is the running median of the raw track; contigs shorter than its window have zeros, and the first base
    of one that is just as long is zero.
    """
    schema = "chrom string, start long, raw array<double>, smoothed array<double>, adjusted array<double>, smoothed_adjusted array<double>"

    def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chrom, length, number, runs in zip(batch["chrom"], batch["length"], batch["block"], batch["runs"]):
                first, last = int(number) * block, min((int(number) + 1) * block, int(length))
                low, high = max(0, first - halo), min(int(length), last + halo)
                raw = np.zeros(high - low)
                for r in runs if runs is not None else ():
                    raw[max(r["start"] - low, 0):max(r["end"] - low, 0)] = r["value"]
                base, fine = numerics.running_median(raw, window), numerics.reflected_savgol(raw, smooth, order)
                plain, even = raw - base, fine - base
                if length < window:  # nothing is adjusted in a contig that has no whole window
                    plain, even = np.zeros(len(raw)), np.zeros(len(raw))
                elif length == window:
                    plain[0] = even[0] = 0.0
                own = slice(first - low, last - low)
                yield pd.DataFrame([(chrom, first, raw[own], fine[own], plain[own], even[own])], columns=["chrom", "start", "raw", "smoothed", "adjusted", "smoothed_adjusted"])

    return blocks(track, sizes, block, halo).mapInPandas(worked, schema)


def wps_peaks(fragments: DataFrame, sizes: DataFrame, protection: int = 120, gap: int = 5, least: int = 50, most: int = 150, widest: int = 450, cutoff: float = 5.0) -> DataFrame:
    """(chrom, start, end, centre, score): protection, adjusted by its running median and smoothed, and the calls on what is positive."""
    found = adjusted_protection(signals.protection_score(fragments, protection), sizes)
    bases = found.select("chrom", "start", F.posexplode("smoothed_adjusted").alias("i", "value")).where("value > 0")
    track = bases.select("chrom", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + 1).alias("end"), "value")
    return call_protected(track, gap, least, most, widest, cutoff)


def profile_peaks(profile: DataFrame, keys: list[str], distance: str = "distance", value: str = "value", low: float = 200, high: float = 1200, resolution: float = 160.0) -> DataFrame:
    """(keys, number, peak, slope, intercept, r2, slope_se): periodic peaks of each key's profile with the fitted line; a profile is a few thousand rows."""
    types = dict(profile.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", number int, peak double, slope double, intercept double, r2 double, slope_se double"

    def called(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(distance)
        peaks, fit = numerics.repeat_length(rows[distance].to_numpy(float), rows[value].to_numpy(float), low, high, resolution)
        return pd.DataFrame([(*key, i + 1, float(p), fit["slope"], fit["intercept"], fit["r2"], fit["slope_se"]) for i, p in enumerate(peaks)], columns=[*keys, "number", "peak", "slope", "intercept", "r2", "slope_se"])

    return profile.groupBy(*keys).applyInPandas(called, schema)


def smoothed_histogram(histogram: DataFrame, keys: list[str], window: int = 21, order: int = 2, value: str = "distance", count: str = "n") -> DataFrame:
    """(keys, distance, n, smooth): zero-filled between the ends of each cluster, polynomial smoothing, nothing under zero.

    Clusters more than a window apart do not see each other; half a window of zeros stands on both sides of each.
    """
    types = dict(histogram.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", distance long, n long, smooth double"

    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, half, out = rows.sort_values(value), window // 2, []
        d, n = rows[value].to_numpy(np.int64), rows[count].to_numpy(np.int64)
        for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d) > window) + 1):
            at = np.arange(d[part[0]] - half, d[part[-1]] + half + 1)
            full = np.zeros(len(at), np.int64)
            full[d[part] - at[0]] = n[part]
            smooth = np.maximum(numerics.savgol(full, window, order), 0)
            out.append(pd.DataFrame({"distance": at, "n": full, "smooth": smooth}))
        frame = pd.concat(out)
        for name, k in zip(keys, key):
            frame[name] = k
        return frame[[*keys, "distance", "n", "smooth"]]

    return histogram.groupBy(*keys).applyInPandas(worked, schema)


def gene_spectra(profiles: DataFrame, key: str, low: int = 120, high: int = 280, filtered: bool = True) -> DataFrame:
    """(key, period, power) from one signal array of each gene; ``profiles`` has key and signal."""
    periods = np.arange(low, high + 1)
    kind = dict(profiles.dtypes)[key]

    def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, signal in zip(batch[key], batch["signal"]):
                x = np.asarray(signal, float)
                power = numerics.periodogram(numerics.recursive_filter(x) if filtered else x, periods)
                yield pd.DataFrame({key: k, "period": periods.astype(np.int32), "power": power})

    return profiles.select(key, "signal").mapInPandas(worked, f"{key} {kind}, period int, power double")


def site_spectra(sites: DataFrame, track: DataFrame, half: int, key: str, low: int = 120, high: int = 280, filtered: bool = True) -> DataFrame:
    """(key, powers): the spectrum at each whole period from ``low`` to ``high`` of the track around each site that has any signal; minus strands are turned."""
    periods = np.arange(low, high + 1)

    def worked(rows: np.ndarray, own: pa.Table) -> pa.Table:
        some = rows.any(1)
        x = turned(rows, own)[some]
        return pa.table([own[key].filter(pa.array(some)), lists(numerics.periodogram(numerics.recursive_filter(x) if filtered else x, periods))], [key, "powers"])

    around = sites.select(key, "chrom", "strand", (F.col("pos") - half).alias("s"))
    return over_windows(around, track, 2 * half + 1, worked, f"`{key}` {dict(sites.dtypes)[key]}, powers array<double>")


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"{k} {types[k]}, " for k in keys)


def fixed_distributions(histogram: DataFrame, keys: list[str], low: int, high: int, window: int = 21, order: int = 2, value: str = "distance", count: str = "n") -> DataFrame:
    """(keys, total, mode, mean, median) of each key's smoothed percents over a fixed range; a key is a row for each distance."""
    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = numerics.fixed_distribution(rows[value].to_numpy(np.int64), rows[count].to_numpy(float), low, high, window, order)
        total = float(rows[count][rows[value].between(low, high)].sum())
        return pd.DataFrame([(*key, total, found["mode"], found["mean"], found["median"])], columns=[*keys, "total", "mode", "mean", "median"])

    return histogram.groupBy(*keys).applyInPandas(worked, _schema(histogram, keys) + "total double, mode double, mean double, median double")


def fragment_size_repeat(counts: DataFrame, keys: list[str], low: int = 100, high: int = 1000, resolution: float = 160.0, length: str = "length", count: str = "n") -> DataFrame:
    """(keys, peaks, slope, intercept, r2, slope_se, spacing, quality) of the peaks of each key's fragment lengths."""
    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        peaks, fit = numerics.fragment_size_peaks(rows[length].to_numpy(), rows[count].to_numpy(float), low, high, resolution)
        spacing = float(np.diff(peaks).mean()) if len(peaks) > 1 else math.nan
        return pd.DataFrame([(*key, [float(p) for p in peaks], fit["slope"], fit["intercept"], fit["r2"], fit["slope_se"], spacing, fit["quality"])], columns=[*keys, "peaks", "slope", "intercept", "r2", "slope_se", "spacing", "quality"])

    return counts.groupBy(*keys).applyInPandas(worked, _schema(counts, keys) + "peaks array<double>, slope double, intercept double, r2 double, slope_se double, spacing double, quality string")


def directional_repeats(profile: DataFrame, keys: list[str], resolution: float = 160.0, low: float = 0.0, high: float | None = None, exclusion: tuple[float, float] | None = None, place: str = "offset", value: str = "mean") -> DataFrame:
    """(keys, side, peaks, slope, intercept, r2, quality): both fits of each key's signed profile; a profile is a few thousand rows."""
    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place)
        found = numerics.directional_repeat_length(rows[place].to_numpy(float), rows[value].to_numpy(float), resolution, low, high, exclusion)
        return pd.DataFrame([(*key, side, fit["n"], fit["slope"], fit["intercept"], fit["r2"], fit["quality"]) for side, fit in found.items()], columns=[*keys, "side", "peaks", "slope", "intercept", "r2", "quality"])

    return profile.groupBy(*keys).applyInPandas(worked, _schema(profile, keys) + "side string, peaks int, slope double, intercept double, r2 double, quality string")


def downsampled(counts: DataFrame, profile: str, length: str, n: str, target: int | None = None, seed: int = 1) -> DataFrame:
    """Counts of each profile drawn anew to ``target`` or the smallest profile's total; draws are seeded by the profile's name."""
    if target is None:
        target = counts.groupBy(profile).agg(F.sum(n).alias("t")).agg(F.min("t")).first()[0] or 0
    types = dict(counts.dtypes)

    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(length)
        own = rows[n].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        drawn = rng.multinomial(target, own / own.sum()) if own.sum() else np.zeros(len(own), np.int64)
        return pd.DataFrame({profile: key[0], length: rows[length].to_numpy(), n: drawn.astype(np.int64)})

    return counts.groupBy(profile).applyInPandas(worked, f"{profile} {types[profile]}, {length} {types[length]}, {n} long")
