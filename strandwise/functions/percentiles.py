"""Sequences of percentiles and their labels."""

from __future__ import annotations

import math


def stepped(start: float, stop: float, step: float) -> list[float]:
    """Percentiles from start to stop, the stop always among them, whatever rounding the steps bring."""
    if step <= 0:
        raise ValueError("a step is over zero")
    low, high = sorted(min(100.0, max(0.0, x)) for x in (start, stop))
    n = math.floor((high - low) / step + 1e-9)
    values = [round(low + k * step, 12) for k in range(n + 1)]
    if high - values[-1] > 1e-9:
        values.append(round(high, 12))
    return values


def parsed(tokens: list[str]) -> list[float]:
    """Different percentiles of comma lists, in the order given."""
    values: list[float] = []
    for part in (p.strip() for t in tokens for p in t.split(",")):
        value = float(part)
        if not 0 <= value <= 100:
            raise ValueError(f"{part} is no percentile")
        if round(value, 12) not in {round(v, 12) for v in values}:
            values.append(value)
    if not values:
        raise ValueError("no percentile")
    return values


def bins(values: list[float]) -> list[tuple[float, float]]:
    """Bins between rising percentiles."""
    if len(values) < 2 or any(a >= b for a, b in zip(values, values[1:])):
        raise ValueError("bins need percentiles that rise")
    return list(zip(map(float, values), map(float, values[1:])))


def label(value: float | None) -> str:
    """Up to six digits, without zeros at the end."""
    return "" if value is None else f"{value:.6f}".rstrip("0").rstrip(".")
