"""Small numerical functions on arrays, in numpy alone: smoothing, peak calling, spectra, tests."""

from __future__ import annotations

import math

import numpy as np


def savgol_weights(window: int, order: int) -> np.ndarray:
    """Rows: the fitted polynomial's value at each place of a window, as weights of its values."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window is odd and wider than the order")
    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return x @ np.linalg.pinv(x)


def savgol(values: np.ndarray, window: int, order: int = 2) -> np.ndarray:
    """Local polynomial smoothing; the first and last half windows take the fits of the end windows. Short input comes back as it is."""
    values = np.asarray(values, float)
    if window < 3 or len(values) < window:
        return values.copy()
    weights, half = savgol_weights(window, order), window // 2
    inner = np.lib.stride_tricks.sliding_window_view(values, window) @ weights[half]
    return np.concatenate([weights[:half] @ values[:window], inner, weights[half + 1:] @ values[-window:]])


def reflected_savgol(values: np.ndarray, window: int = 21, order: int = 2) -> np.ndarray:
    """The same with ends turned about their end value: differences beyond an end are taken negative on the left, positive on the right."""
    values = np.asarray(values, float)
    half = window // 2
    if len(values) < window:
        return values.copy()
    left = values[0] - np.abs(values[1:half + 1][::-1] - values[0])
    right = values[-1] + np.abs(values[-half - 1:-1][::-1] - values[-1])
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([left, values, right]), window) @ savgol_weights(window, order)[half]


def running_median(values: np.ndarray, window: int = 1000) -> np.ndarray:
    """Median of an even window, put right of its middle; ends repeat the first and last value; NaN if the input is shorter."""
    values = np.asarray(values, float)
    if len(values) < window:
        return np.full(len(values), np.nan)
    inner = np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(values[a:a + 20_000 + window - 1], window), 1) for a in range(0, len(values) - window + 1, 20_000)])
    before = window // 2
    return np.concatenate([np.full(before, inner[0]), inner, np.full(len(values) - before - len(inner), inner[-1])])


def range_medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Medians of values[low:high] (the mean of two middle ones) for many ranges, NaN for empty ones.

    The ranges go together through a wavelet matrix: a level for each bit of the values' ranks, each with the counts
    of zero bits, so a range costs a few steps a level however long it is.
    """
    n = high - low
    if not len(values) or not len(low):
        return np.full(len(low), np.nan)
    levels, ranks = np.unique(values, return_inverse=True)
    sides = []
    for k in (np.maximum(n - 1, 0) // 2, np.maximum(n, 1) // 2):
        now, a, b, code = ranks, low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for bit in range(max(len(levels) - 1, 1).bit_length() - 1, -1, -1):
            one = (now >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            a0, b0 = zeros[a], zeros[b]
            up = k >= b0 - a0
            k = np.where(up, k - (b0 - a0), k)
            code = np.where(up, code | (1 << bit), code)
            a, b = np.where(up, a - a0 + zeros[-1], a0), np.where(up, b - b0 + zeros[-1], b0)
            now = np.concatenate([now[~one], now[one]])
        sides.append(levels[np.where(n > 0, code, 0)].astype(float))
    return np.where(n > 0, (sides[0] + sides[1]) / 2, np.nan)


def moving_average_by_distance(distances: np.ndarray, values: np.ndarray, window: float) -> np.ndarray:
    """Mean of the values within half a window of each distance; distances rise."""
    half = (window - 1) / 2
    low, high = np.searchsorted(distances, distances - half, "left"), np.searchsorted(distances, distances + half, "right")
    run = np.concatenate([[0.0], np.cumsum(values)])
    return (run[high] - run[low]) / (high - low)


def smoothing_windows(resolution: float) -> tuple[int, int]:
    """Widths for detection and refinement: a third and a sixth of the resolution, snapped to 10 k + 1."""
    snap = lambda t: 1 if t < 11 else 10 * int((t - 1) // 10) + 1
    return snap(resolution / 3), snap(resolution / 6)


def plateau_maxima(values: np.ndarray) -> np.ndarray:
    """Middles of runs of equal values that lie over both neighbours; ends do not count."""
    edges = np.flatnonzero(np.concatenate([[True], np.diff(values) != 0]))
    level, last = values[edges], np.append(edges[1:], len(values)) - 1
    up = np.zeros(len(level), bool)
    if len(level) > 2:
        up[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (edges[up] + last[up]) // 2


def separated(places: np.ndarray, distances: np.ndarray, gap: float, *strengths: np.ndarray) -> np.ndarray:
    """Strongest first (by each curve in turn, then the smaller distance), each at least ``gap`` from all kept."""
    kept: list[int] = []
    for i in sorted(places.tolist(), key=lambda i: (*(-s[i] for s in strengths), distances[i])):
        if all(abs(distances[i] - distances[j]) >= gap for j in kept):
            kept.append(i)
    return np.array(sorted(kept), int)


def resolution_peaks(distances: np.ndarray, values: np.ndarray, resolution: float = 160.0) -> np.ndarray:
    """Periodic peaks of a profile: found on the broad curve, moved to the top of the fine curve nearby, kept apart twice.

    A peak moves to the best local maximum of the fine curve within half the resolution (ties: the nearest, then the
    larger raw value), or to the best place there if it has none. Moved peaks are ranked by the broad curve where they
    were found, then by the fine curve and the raw values where they are.
    """
    distances, values = np.asarray(distances, float), np.asarray(values, float)
    if not len(distances):
        return np.empty(0)
    broad, fine = (moving_average_by_distance(distances, values, w) for w in smoothing_windows(resolution))
    first = separated(plateau_maxima(broad), distances, resolution, broad, values)
    tops, moved = plateau_maxima(fine), []
    for i in first:
        near = tops[np.abs(distances[tops] - distances[i]) <= resolution / 2]
        if not len(near):
            near = np.flatnonzero(np.abs(distances - distances[i]) <= resolution / 2)
        j = min(near.tolist(), key=lambda j: (-fine[j], abs(distances[j] - distances[i]), -values[j], distances[j]))
        moved.append((-broad[i], -fine[j], -values[j], distances[j]))
    kept: list[float] = []
    for *_, place in sorted(moved):
        if all(abs(place - other) >= resolution for other in kept):
            kept.append(place)
    return np.array(sorted(kept))


def line(x: np.ndarray, y: np.ndarray, flat_r2: float = math.nan) -> dict[str, float]:
    """Least squares with the slope's standard error; NaN under two points or for equal x."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    x, y, nan = x[ok], y[ok], math.nan
    if len(x) < 2 or np.ptp(x) == 0:
        return {"slope": nan, "intercept": nan, "r2": nan, "slope_se": nan, "n": len(x)}
    sxx = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / sxx
    intercept = y.mean() - slope * x.mean()
    rest, whole = ((y - slope * x - intercept) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    return {"slope": slope, "intercept": intercept, "r2": 1 - rest / whole if whole else flat_r2, "slope_se": math.sqrt(rest / (len(x) - 2) / sxx) if len(x) > 2 else nan, "n": len(x)}


def repeat_length(distances: np.ndarray, values: np.ndarray, low: float = 200, high: float = 1200, resolution: float = 160.0) -> tuple[np.ndarray, dict[str, float]]:
    """Peaks of a profile between two distances, and the line of distance on peak number."""
    keep = (distances >= low) & (distances <= high)
    peaks = resolution_peaks(distances[keep], values[keep], resolution)
    return peaks, line(np.arange(1, len(peaks) + 1), peaks, 1.0)


def fit_quality(fit: dict) -> str:
    """pass, or why a fit of peak numbers is not to be trusted."""
    if fit["n"] < 3:
        return "insufficient_peaks"
    if not math.isfinite(fit["slope"]):
        return "fit_failed"
    return "pass" if math.isfinite(fit["r2"]) and fit["r2"] >= 0.9 else "low_r_squared"


def directional_repeat_length(positions: np.ndarray, values: np.ndarray, resolution: float = 160.0, low: float = 0.0, high: float | None = None, exclusion: tuple[float, float] | None = None) -> dict[str, dict]:
    """One call over a signed profile; each side is fitted outward from the central peak, which has number 0 on both.

    The central peak is the one nearest zero within half the resolution, if there is one. Peaks beyond [low, high] or
    inside the excluded positions are left out after they are numbered.
    """
    peaks = resolution_peaks(positions, values, resolution)
    high = float(np.max(np.abs(positions))) if high is None else high
    near = [p for p in peaks if abs(p) <= resolution / 2]
    centre = min(near, key=lambda p: (abs(p), p)) if near else None
    out: dict[str, dict] = {}
    for side, sign in (("positive", 1), ("negative", -1)):
        outward = sorted(abs(p) for p in peaks if p != centre and p * sign > 0)
        numbered = ([(0, abs(centre), centre)] if centre is not None else []) + [(k, d, d * sign) for k, d in enumerate(outward, 1)]
        used = [(k, d) for k, d, p in numbered if low <= d <= high and not (exclusion and exclusion[0] <= p <= exclusion[1])]
        fit = line([k for k, _ in used], [d for _, d in used], 1.0)
        out[side] = {**fit, "quality": fit_quality(fit)}
    return out


def fragment_size_peaks(lengths: np.ndarray, counts: np.ndarray, low: int = 100, high: int = 1000, resolution: float = 160.0) -> tuple[np.ndarray, dict]:
    """Peaks of the density of fragment lengths from ``low`` to the largest one up to ``high``, and the fitted line."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, float)
    top = min(high, int(lengths[counts > 0].max(initial=0)))
    if top - low < 2:
        return np.empty(0), {**line([], []), "quality": "insufficient_peaks"}
    full = np.zeros(top - low + 1)
    inside = (lengths >= low) & (lengths <= top)
    np.add.at(full, lengths[inside] - low, counts[inside])
    if not full.sum():
        return np.empty(0), {**line([], []), "quality": "insufficient_peaks"}
    peaks = resolution_peaks(np.arange(low, top + 1), full / full.sum(), resolution)
    fit = line(np.arange(1, len(peaks) + 1), peaks, 1.0)
    return peaks, {**fit, "quality": fit_quality(fit)}


def fixed_distribution(distances: np.ndarray, counts: np.ndarray, low: int, high: int, window: int = 21, order: int = 2) -> dict:
    """Percent of each distance of a fixed range, smoothed where a whole window fits (zero elsewhere, nothing under zero, 100 again), and its mode, mean and median."""
    full = np.zeros(high - low + 1)
    inside = (distances >= low) & (distances <= high)
    np.add.at(full, np.asarray(distances, np.int64)[inside] - low, np.asarray(counts, float)[inside])
    at, nan = np.arange(low, high + 1), math.nan
    if not full.sum():
        return {"distance": at, "percent": full, "smooth": full.copy(), "mode": nan, "mean": nan, "median": nan}
    percent, half = full * 100 / full.sum(), window // 2
    smooth = np.zeros(len(full))
    if len(full) >= window:
        smooth[half:len(full) - half] = np.maximum(savgol(percent, window, order)[half:len(full) - half], 0)
    if not smooth.sum():
        return {"distance": at, "percent": percent, "smooth": smooth, "mode": nan, "mean": nan, "median": nan}
    smooth *= 100 / smooth.sum()
    middle = min(int(np.searchsorted(np.cumsum(smooth), 50.0)), len(at) - 1)
    return {"distance": at, "percent": percent, "smooth": smooth, "mode": float(at[int(smooth.argmax())]), "mean": float(at @ smooth / smooth.sum()), "median": float(at[middle])}


def density(values: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Gaussian kernel estimate with Scott's bandwidth; zeros under two values, one at the nearest grid point for equal ones."""
    values, out = np.asarray(values, float), np.zeros(len(grid))
    if len(values) < 2:
        return out
    spread = values.std(ddof=1)
    if spread == 0:
        out[int(np.argmin(np.abs(grid - values[0])))] = 1.0
        return out
    width = spread * len(values) ** -0.2
    return np.array([np.exp(-0.5 * ((g - values) / width) ** 2).mean() for g in grid]) / (width * math.sqrt(2 * math.pi))


def recursive_filter(values: np.ndarray, taps: int = 24, warm: int = 300) -> np.ndarray:
    """y_t = x_t + sum of y_{t-k} / (5 + 4 (k - 1)), started on the first values repeated; of one signal or of each row.

    The filter is linear, so a block of outputs is the block's inputs and the outputs before it times two fixed
    matrices: 64 outputs a step.
    """
    values = np.asarray(values, float)
    x = np.concatenate([values[..., :warm], values], -1)
    weights, size = 1 / (5 + 4 * np.arange(taps)), 64
    unit = np.zeros((size, size + taps))  # an output of the block by its inputs, then by the outputs before it, last first
    for t in range(size):
        unit[t, t] = 1
        for k in range(1, taps + 1):
            if t - k >= 0:
                unit[t] += weights[k - 1] * unit[t - k]
            else:
                unit[t, size + k - t - 1] += weights[k - 1]
    length, head = x.shape[-1], x.shape[:-1]
    padded = np.concatenate([x, np.zeros((*head, -length % size))], -1)
    out, last = np.empty(padded.shape), np.zeros((*head, taps))
    for a in range(0, padded.shape[-1], size):
        out[..., a:a + size] = np.concatenate([padded[..., a:a + size], last], -1) @ unit.T
        last = out[..., a + size - taps:a + size][..., ::-1]
    return out[..., min(warm, values.shape[-1]):length]


def periodogram(values: np.ndarray, periods: np.ndarray, trim: float = 0.1, pad: float = 0.3, taper: float = 0.3) -> np.ndarray:
    """Spectrum at whole periods of one signal or of each row: trimmed mean off, line off, cosine taper at both ends, padded, smoothed by (1/8, 1/4, 1/4, 1/4, 1/8)."""
    x = np.asarray(values, float)
    n = x.shape[-1]
    cut = int(trim * n)
    x = x - np.sort(x, -1)[..., cut:n - cut].mean(-1, keepdims=True)
    t = np.arange(n) - (n - 1) / 2
    x = x - x.mean(-1, keepdims=True) - t * ((x @ t) / (t @ t))[..., None]
    edge = int(taper * n)
    ramp = 0.5 * (1 - np.cos(np.pi * (np.arange(edge) + 0.5) / edge)) if edge else np.empty(0)
    x[..., :edge] *= ramp
    x[..., n - edge:] *= ramp[::-1]
    size = _fast_length(math.ceil(n * (1 + pad)))
    power = np.abs(np.fft.rfft(x, size)) ** 2 / n
    power[..., 0] = power[..., 1]
    wide = np.concatenate([power[..., 2:0:-1], power, power[..., -2:-4:-1]], -1)
    m = power.shape[-1]
    smooth = sum(w * wide[..., i:i + m] for i, w in enumerate([1 / 8, 1 / 4, 1 / 4, 1 / 4, 1 / 8]))
    place = np.clip(size / np.asarray(periods, float), 0, m - 1)
    left = np.minimum(place.astype(int), m - 2)
    return smooth[..., left] + (place - left) * (smooth[..., left + 1] - smooth[..., left])


def _fast_length(n: int) -> int:
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_test_p(t: float, degrees: float) -> float:
    return beta_share(degrees / 2, 0.5, degrees / (degrees + t * t)) if math.isfinite(t) else 0.0


def correlation_p(r: float, n: int) -> float:
    if n < 3 or not math.isfinite(r):
        return math.nan
    return t_test_p(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2)


def welch(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    t = float((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    return t, t_test_p(t, (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))


def paired_t(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    d = np.asarray(a, float) - b
    t = float(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))
    return t, t_test_p(t, len(d) - 1)


def average_ranks(values: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """U of the first sample and its two-sided p by the normal approximation with ties and continuity."""
    both = np.concatenate([a, b])
    n, m = len(a), len(b)
    u = average_ranks(both)[:n].sum() - n * (n + 1) / 2
    _, ties = np.unique(both, return_counts=True)
    return float(u), mann_whitney_p(u, n, m, float((ties.astype(float) ** 3 - ties).sum()))


def mann_whitney_p(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided normal p of U; ``ties`` is the sum of t^3 - t over runs of equal values."""
    if n + m < 2 or not n or not m:
        return math.nan
    var = n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))
    z = (abs(u - n * m / 2) - 0.5) / math.sqrt(var) if var > 0 else 0.0
    return min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2)))


def wilcoxon(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Smaller rank sum of the signed differences without zeros, and its two-sided normal p."""
    d = np.asarray(a, float) - b
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    ranks = average_ranks(np.abs(d))
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    _, ties = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(w), min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)))


def holm(p: np.ndarray) -> np.ndarray:
    """Step-down adjusted p-values: monotone and at most one."""
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.maximum.accumulate(p[order] * (len(p) - np.arange(len(p)))))
    return out


def cluster_order(matrix: np.ndarray) -> list[int]:
    """Order of rows by average linkage on Euclidean distances: the two nearest groups join, the smaller index first."""
    groups = {i: [i] for i in range(len(matrix))}
    gap = np.sqrt(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(-1)) if len(matrix) else np.zeros((0, 0))
    while len(groups) > 1:
        keys = sorted(groups)
        a, b = min(((a, b) for i, a in enumerate(keys) for b in keys[i + 1:]), key=lambda k: gap[np.ix_(groups[k[0]], groups[k[1]])].mean())
        groups[a] += groups.pop(b)
    return next(iter(groups.values()), [])
