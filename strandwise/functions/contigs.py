"""Scalar expressions on names, identifiers and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contig_key(name: Column) -> Column:
    """One key for the spellings of a contig: without ``chr``, and MT for M and MT in any case."""
    bare = F.regexp_replace(name, "(?i)^chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), F.lit("MT")).otherwise(bare)


def gene_key(name: Column) -> Column:
    """An Ensembl gene id without its version; other names as they are."""
    return F.regexp_replace(name, r"^(ENS[A-Z]*G\d+)\.\d+$", "$1")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / F.lit(2)).cast("long")


def dyad(start: Column, end: Column) -> Column:
    """The centre of a fragment; of two middle bases the right one."""
    return start + F.floor((end - start) / F.lit(2)).cast("long")


def bed_score(value: Column, scale: float = 1.0) -> Column:
    """Integer score of BED files: absolute, scaled, halves to even, between 0 and 1000."""
    return F.least(F.lit(1000), F.bround(F.abs(value) * F.lit(scale)).cast("int"))


def expression_value(value: Column, mode: str = "log2p1", floor: float = 0.04) -> Column:
    if mode == "none":
        return value
    if mode == "log2p1":
        return F.log2(value + F.lit(1.0))
    if mode == "log2-floor":
        return F.log2(F.greatest(value, F.lit(floor)))
    raise ValueError(f"unknown transform {mode}")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Division that gives infinity over zero for positive tops, NaN for the rest and for what is not finite."""
    odd = F.isnan(top) | F.isnan(bottom) | (F.abs(top) == float("inf")) | (F.abs(bottom) == float("inf"))
    over = F.when(top > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(odd, F.lit(float("nan"))).when(bottom == 0, over).otherwise(F.try_divide(top, bottom))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate: NaN where a side does not vary (``corr`` divides by zero there), null without pairs.

    Such a side is told by its ends, as means that are put together from tasks are off by their rounding.
    """
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    flat = [F.min(F.when(pair, F.col(c))) == F.max(F.when(pair, F.col(c))) for c in (x, y)]
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.when(F.regr_count(y, x) > 0, F.when(flat[0] | flat[1], F.lit(float("nan"))).otherwise(F.try_divide(F.regr_sxy(y, x), spread)))


def snapped_window(target: Column) -> Column:
    """Widths of smoothing windows: 1 below 11, else one more than a multiple of ten."""
    return F.when(target < 11, F.lit(1)).otherwise(10 * F.floor((target - 1) / 10) + 1).cast("long")


def significance(p: Column) -> Column:
    """Stars of a p-value; NA where it is not finite."""
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), "NA").when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def state_category(state: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The category of the first rule (category, kind, pattern) that fits; kinds are exact, prefix and regex; else the state."""
    out = None
    for category, kind, pattern in rules:
        fits = {"exact": state == pattern, "prefix": state.startswith(pattern), "regex": state.rlike(pattern)}[kind]
        out = F.when(fits, category) if out is None else out.when(fits, category)
    return state if out is None else out.otherwise(state)
