"""Choices of rows, anchors and windows: samples, strands, contigs, masks, rejects; and values of a track at points."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import first_after, last_before, overlap_join, point_join, running, subtracted
from .lineage import cut

STRANDS = {"plus": "+", "minus": "-"}


def hashed(seed: int, *columns: str) -> Column:
    """32 bits of an MD5 of the seed and the columns: the same on every run and in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def sampled(df: DataFrame, share: float, seed: int, columns: list[str]) -> DataFrame:
    """Each row by itself with a probability; limit duplicates first, as the counter counts what is left out here too."""
    if not 0 <= share <= 1:
        raise ValueError("a share is from 0 to 1")
    return df.where(hashed(seed, *columns) < F.lit(share * 2**32))


def on_strand(df: DataFrame, which: str = "both", strand: str = "strand") -> DataFrame:
    if which not in (*STRANDS, "both"):
        raise ValueError("strands are plus, minus or both")
    return df if which == "both" else df.where(F.col(strand) == STRANDS[which])


def with_strand(df: DataFrame, policy: str, seed: int, columns: list[str], strand: str = "strand") -> DataFrame:
    """Rows without a strand go forward, get one by a hash, or are left out (``skip``)."""
    known = F.coalesce(F.col(strand).isin("+", "-"), F.lit(False))
    if policy == "skip":
        return df.where(known)
    if policy not in ("forward", "random"):
        raise ValueError("policies are forward, random and skip")
    other = F.lit("+") if policy == "forward" else F.when(hashed(seed, *columns) % 2 == 0, "+").otherwise("-")
    return df.withColumn(strand, F.when(known, F.col(strand)).otherwise(other))


def anchors_off(anchors: DataFrame, blacklist: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Anchors whose one base is not blacklisted."""
    spans = anchors.withColumn("s", F.col(pos)).withColumn("e", F.col(pos) + 1)
    return overlap_join(spans, blacklist, "left_anti", chrom).drop("s", "e")


def masked(track: DataFrame, blacklist: DataFrame) -> DataFrame:
    """A run-length track without its blacklisted bases."""
    runs = track.select("chrom", "value", F.col("start").alias("s"), F.col("end").alias("e"), F.col("start").alias("run"))
    return subtracted(runs, blacklist, ["chrom", "run", "value"]).select("chrom", F.col("s").alias("start"), F.col("e").alias("end"), "value")


def rejected(anchors: DataFrame, track: DataFrame, half: int, keys: list[str], zeros: int, most: float) -> DataFrame:
    """(keys, status, zeros, top): windows by their longest run of zeros, then their largest value; the first failure counts."""
    around = anchors.select(*keys, "chrom", (F.col("pos") - half).alias("s"), (F.col("pos") + half + 1).alias("e"))
    runs = track.where("value <> 0").select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "value")
    met = overlap_join(around, runs).select(*keys, F.struct(F.greatest("s", "r_s").alias("a"), F.least("e", "r_e").alias("b")).alias("x"), "r_value")
    inside = met.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.max("r_value").alias("top"))  # at most 2 half + 1 a window
    both = around.join(inside, keys, "left")
    stops = F.concat(F.array(F.col("s")), F.coalesce(F.transform("xs", lambda x: x["b"]), F.array().cast("array<bigint>")))
    begins = F.concat(F.coalesce(F.transform("xs", lambda x: x["a"]), F.array().cast("array<bigint>")), F.array(F.col("e")))
    longest = F.array_max(F.zip_with(begins, stops, lambda a, b: a - b))
    found = both.select(*keys, longest.alias("zeros"), F.coalesce("top", F.lit(0)).alias("top"))
    status = F.when(F.col("zeros") >= zeros, "zeros").when(F.col("top") > most, "maximum").otherwise("accepted")
    return found.select(*keys, status.alias("status"), "zeros", "top")


def bare(name: str) -> str:
    name = re.sub("(?i)^chr", "", name)
    return "MT" if name.upper() in ("M", "MT") else name


def resolved(name: str, known: Sequence[str]) -> str:
    """The contig of that name, or the only one that differs by its prefix or the spelling of the mitochondrion."""
    if name in known:
        return name
    same = [k for k in known if bare(k) == bare(name)]
    if len(same) != 1:
        raise ValueError(f"contig {name} " + ("is not known" if not same else "is ambiguous"))
    return same[0]


def regions(tokens: Sequence[str], sizes: dict[str, int]) -> list[tuple[str, int, int]]:
    """Contigs and intervals chosen by tokens (a,b; all; autosomes; 1-5; chr2:10-90), united, in the contigs' order."""
    known, found = list(sizes), []
    for token in (t.strip() for raw in tokens for t in raw.split(",")):
        if not token:
            continue
        if token.lower() in ("all", "autosomes"):
            found += [(c, 0, sizes[c]) for c in known if token.lower() == "all" or bare(c).isdigit()]
        elif ":" in token:
            name, places = token.split(":", 1)
            span = re.fullmatch(r"(\d+)-(\d+)", places)
            name = resolved(name, known)
            if not span or not int(span[1]) < int(span[2]) <= sizes[name]:
                raise ValueError(f"{token} is no interval of a contig of {sizes[name]} bases")
            found.append((name, int(span[1]), int(span[2])))
        elif numbers := re.fullmatch(r"(?i)(?:chr)?(\d+)-(?:chr)?(\d+)", token):
            a, b = int(numbers[1]), int(numbers[2])
            found += [(c, 0, sizes[c]) for k in range(min(a, b), max(a, b) + 1) for c in [resolved(str(k), known)]]
        else:
            name = resolved(token, known)
            found.append((name, 0, sizes[name]))
    out: list[tuple[str, int, int]] = []
    for name, s, e in sorted(set(found), key=lambda r: (known.index(r[0]), r[1], r[2])):
        if out and out[-1][0] == name and s <= out[-1][2]:
            out[-1] = (name, out[-1][1], max(out[-1][2], e))
        else:
            out.append((name, s, e))
    return out


def in_regions(df: DataFrame, chosen: list[tuple[str, int, int]], chrom: str = "chrom", start: str = "s", end: str = "e") -> DataFrame:
    """Rows that meet a chosen region. A few regions, so they are a filter that reaches the scan."""
    test = F.lit(False)
    for name, s, e in chosen:
        test = test | ((F.col(chrom) == name) & (F.col(start) < e) & (F.col(end) > s))
    return df.where(test)


def at_points(points: DataFrame, track: DataFrame, sizes: dict[str, int], most: float | None = None) -> DataFrame:
    """Points with the track's value, limited to ``most`` on both sides; no signal is zero, ``inside`` tells known places."""
    runs = track.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "value")
    met = point_join(points, runs, "left")
    value = F.coalesce(F.when(F.isnan(F.col("r_value").cast("double")), None).otherwise(F.col("r_value")), F.lit(0))
    if most is not None:
        value = F.greatest(F.least(value, F.lit(most)), F.lit(-most))
    length = F.coalesce(*[F.when(F.col("chrom") == c, F.lit(n)) for c, n in sizes.items()]) if sizes else F.lit(None).cast("long")
    return met.select(*points.columns, F.coalesce(F.col("pos").between(0, length - 1), F.lit(False)).alias("inside"), value.alias("value"))


def fetched(fragments: DataFrame, ranges: DataFrame, most: int = 1) -> DataFrame:
    """Rows of ``ranges`` with the fragments that meet them (s, e of the fragment), at most ``most`` of equal coordinates."""
    from .spacing import limited_copies

    kept = limited_copies(fragments, most)
    others = [c for c in ranges.columns if c not in ("chrom", "s", "e")]
    return overlap_join(ranges, kept).select(*others, "chrom", F.col("r_s").alias("s"), F.col("r_e").alias("e"))


def fetched_sums(fragments: DataFrame, ranges: DataFrame, most: int = 1) -> DataFrame:
    """Rows of ``ranges`` with first start, count and bases of what ``fetched`` gives them; none where nothing meets them.

    Those that begin before a range's end less those that end up to its start meet it, and the least start of those
    that end behind its start is the first: running sums of starts and ends, and as-of joins, without pairs.
    """
    from .spacing import limited_copies

    kept = limited_copies(fragments, most).where("e > s")
    size = F.col("e") - F.col("s")
    ends = F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(0).alias("side")), F.struct(F.col("e").alias("pos"), F.lit(1).alias("side"))))
    places = kept.select("chrom", "s", size.alias("size"), ends.alias("x")).groupBy("chrom", "x.pos", "x.side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bases"), F.min("s").alias("first"))
    places = cut(places.withColumnsRenamed({"n": "own_n", "bases": "own_bases", "first": "own_first"}))  # two rows a base at most, read several times
    sums = {"n": ("sum", F.col("own_n")), "bases": ("sum", F.col("own_bases"))}
    begun = cut(running(places.where("side = 0"), ["chrom"], ["pos"], sums))
    over = cut(running(places.where("side = 1"), ["chrom"], ["pos"], sums))
    over = cut(running(over, ["chrom"], ["pos"], {"first": ("max", -F.col("own_first"))}, descending=True))
    known = begun.select("chrom", F.col("pos").alias("e"), F.struct("n", "bases").alias("sums"))
    done = over.select("chrom", F.col("pos").alias("s"), F.struct("n", "bases").alias("sums"))
    later = over.select("chrom", F.col("pos").alias("s"), (-F.col("first")).alias("first"))
    asked = cut(last_before(known, ranges.where("e > s"), pos="e", value="sums", name="__begun", strict=True))
    asked = cut(last_before(done, asked, pos="s", value="sums", name="__over", strict=False))
    asked = first_after(later, asked, pos="s", value="first", name="first", strict=True)
    count = lambda c: F.coalesce(F.col(f"__begun.{c}"), F.lit(0)) - F.coalesce(F.col(f"__over.{c}"), F.lit(0))
    return asked.withColumn("n", count("n")).withColumn("bases", count("bases")).where("n > 0").drop("__begun", "__over")


def by_ranges(fragments: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Fragments once for each range of lengths that has theirs, named."""
    length = F.col("e") - F.col("s")
    fits = F.filter(F.array(*[F.when(length.between(lo, hi), F.lit(n)) for n, lo, hi in ranges]), lambda x: x.isNotNull())
    return fragments.withColumn("name", F.explode(fits))


def region_mean(scores: DataFrame, score: str) -> DataFrame:
    """Plain mean of the finite scores, their count and that of the others."""
    fine = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return scores.agg(F.avg(F.when(fine, F.col(score))).alias("mean"), F.sum(fine.cast("long")).alias("n"), F.sum((~fine).cast("long")).alias("not_finite"))
