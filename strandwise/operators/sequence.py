"""Sequence composition of fragments; sequences come in chunks (chrom, start, seq) of a reference."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fragment_sequences(fragments: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Fragments with their upper-case sequence, put together from chunks of ``width`` bases; N outside the reference."""
    pieces = fragments.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / F.lit(width)), F.floor((F.col("e") - 1) / F.lit(width)))))
    c = chunks.select(F.col("chrom").alias("__c"), F.floor(F.col("start") / F.lit(width)).alias("__k"), F.upper("seq").alias("seq"))
    met = pieces.join(c, (F.col("chrom") == F.col("__c")) & (F.col("chunk") == F.col("__k")), "left")
    at = F.greatest(F.col("s") - F.col("chunk") * width, F.lit(0))
    until = F.least(F.col("e") - F.col("chunk") * width, F.lit(width))
    part = F.rpad(F.coalesce(F.substring(F.col("seq"), (at + 1).cast("int"), (until - at).cast("int")), F.lit("")), (until - at).cast("int"), "N")
    keys = [x for x in fragments.columns]
    joined = met.select(*keys, F.struct("chunk", part.alias("p")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count(F.lit(1)).alias("__n"))
    return joined.select(*keys, F.array_join(F.transform("xs", lambda x: x["p"]), "").alias("sequence")).where(F.length("sequence") == F.col("e") - F.col("s"))


def is_acgt(sequence: Column) -> Column:
    return sequence.rlike("^[ACGT]+$")


def dinucleotide_profile(sequences: DataFrame) -> DataFrame:
    """(position, covered, dinucleotide counts): position is relative to the dyad; only sequences of A, C, G and T count."""
    clean = sequences.where(is_acgt(F.col("sequence")))
    pairs = F.transform(F.sequence(F.lit(1), F.length("sequence") - 1), lambda i: F.struct((i - 1 - F.floor(F.length("sequence") / 2)).alias("position"), F.substring(F.col("sequence"), i, F.lit(2)).alias("pair")))
    at = clean.where(F.length("sequence") > 1).select(F.explode(pairs).alias("x")).select("x.position", "x.pair")
    weak = F.col("pair").isin("AA", "AT", "TA", "TT")
    strong = F.col("pair").isin("CC", "CG", "GC", "GG")
    return at.groupBy("position").agg(F.count(F.lit(1)).alias("covered"), F.sum(weak.cast("long")).alias("ww"), F.sum(strong.cast("long")).alias("ss"))


def randomized(fragments: DataFrame, block: int = 100_000, seed: int = 12345) -> DataFrame:
    """Fragments moved to a uniform place inside their block of the contig, never to where they were; lengths stay.

    Draws are hashes of the seed and the fragment, so that a lost task gives the same rows again. A fragment that has
    no other place keeps its own.
    """
    first = F.floor(F.col("s") / F.lit(block)) * block
    room = F.greatest(F.lit(block) - (F.col("e") - F.col("s")), F.lit(0))
    old = F.col("s") - first
    draw = F.pmod(F.xxhash64("chrom", "s", "e", "source_id", F.lit(seed)), F.greatest(room, F.lit(1)))
    moved = F.when(room <= 0, old).otherwise(draw + (draw >= old).cast("long"))
    return fragments.select("source_id", "chrom", (first + moved).alias("s"), (first + moved + F.col("e") - F.col("s")).alias("e"))


def tied_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


#: Places relative to the dyad where the minor and the major groove face the histones, as half-open ranges.
MINOR = ((-69, -66), (-59, -56), (-48, -45), (-37, -34), (-27, -24), (-17, -14), (14, 17), (24, 27), (34, 37), (45, 48), (56, 59), (66, 69))
MAJOR = ((-64, -61), (-53, -51), (-42, -40), (-32, -29), (-22, -19), (-12, -9), (9, 12), (19, 22), (29, 32), (40, 42), (51, 53), (61, 64))
HALF_CORE = 73


def core_intervals(fragments: DataFrame) -> DataFrame:
    """147 bases around each dyad, in place of the fragment's ends."""
    dyad = F.col("s") + F.expr("(e - s) div 2")
    rest = [c for c in fragments.columns if c not in ("s", "e")]
    return fragments.select(*rest, (dyad - HALF_CORE).alias("s"), (dyad + HALF_CORE + 1).alias("e"))


def core_type(core: Column) -> Column:
    """type1 to type4 by whether weak and strong pairs prefer the minor groove; null unless the core is 147 bases of A, C, G, T.

    Counts at the major groove are scaled by the number of places; weak pairs prefer by >=, strong ones by >.
    """
    def count(ranges: tuple, pairs: list[str]) -> Column:
        places = F.array(*[F.lit(p + HALF_CORE + 1) for a, b in ranges for p in range(a, b)])
        return F.size(F.filter(places, lambda p: F.substring(core, p, F.lit(2)).isin(pairs)))

    scale = F.lit(sum(b - a for a, b in MINOR) / sum(b - a for a, b in MAJOR))
    weak, strong = ["AA", "AT", "TA", "TT"], ["CC", "CG", "GC", "GG"]
    weak_minor = count(MINOR, weak) >= count(MAJOR, weak) * scale
    strong_minor = count(MINOR, strong) > count(MAJOR, strong) * scale
    kind = F.when(weak_minor & ~strong_minor, "type1").when(weak_minor & strong_minor, "type2").when(~weak_minor & ~strong_minor, "type3").otherwise("type4")
    return F.when((F.length(core) == 2 * HALF_CORE + 1) & is_acgt(core), kind)


def dinucleotide_counts(sequences: DataFrame) -> DataFrame:
    """(position, pair, n, covered, fraction): all pairs at each position relative to the dyad; covered counts the fragments there."""
    clean = sequences.where(is_acgt(F.col("sequence")) & (F.length("sequence") > 1))
    pairs = F.transform(F.sequence(F.lit(1), F.length("sequence") - 1), lambda i: F.struct((i - 1 - F.floor(F.length("sequence") / 2)).alias("position"), F.substring(F.col("sequence"), i, F.lit(2)).alias("pair")))
    counted = clean.select(F.explode(pairs).alias("x")).groupBy("x.position", "x.pair").agg(F.count(F.lit(1)).alias("n"))
    covered = counted.groupBy("position").agg(F.sum("n").alias("covered"))
    return counted.join(covered, "position").withColumn("fraction", F.col("n") / F.col("covered"))


def expected_positions(low: int, high: int) -> list[int]:
    """Positions relative to the dyad that pairs of fragments of these lengths can have."""
    return list(range(-(high // 2), max(n - 1 - n // 2 for n in range(low, high + 1))))


def matched_randomized(fragments: DataFrame, chunks: DataFrame, blacklist: DataFrame, block: int = 100_000, seed: int = 12345, most: int = 0) -> DataFrame:
    """(source_id, chrom, s, e, new_s, outcome, anchor): fragments moved inside their block to a place with the same pair of bases.

    A coin picks the first or the last pair as the anchor; places that have it there, are of A, C, G and T alone, off
    the blacklist and not the fragment's own are drawn from evenly (matched). Without one the other anchor is tried
    (fallback), then any such place (uniform); else the fragment is skipped. ``most`` limits how often a coordinate is
    used (0: no limit). Draws are seeded by the contig and the block, so a repeated task gives the same rows.
    """
    own = fragments.select("source_id", "chrom", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.floor(F.col("s") / F.lit(block)).alias("block"))
    parts = chunks.select("chrom", F.floor(F.col("start") / F.lit(block)).alias("block"), F.col("start").cast("long").alias("s"), F.upper("seq").alias("seq"))
    holes = blacklist.select("chrom", "s", "e").withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / F.lit(block)), F.floor((F.col("e") - 1) / F.lit(block)))))
    ground = parts.withColumn("e", F.lit(None).cast("long")).unionByName(holes.select("chrom", "block", "s", "e", F.lit(None).cast("string").alias("seq")))

    def moved(key: tuple, rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        names = ["source_id", "chrom", "s", "e", "new_s", "outcome", "anchor"]
        if not len(rows):
            return pd.DataFrame(columns=names)
        first, letters = int(key[1]) * block, np.full(block, ord("N"), np.uint8)
        hidden = np.zeros(block, bool)
        for s, e, seq in zip(base["s"], base["e"], base["seq"]):
            a = int(s) - first
            if seq is not None:
                text = np.frombuffer(seq.encode(), np.uint8)
                text = text[max(0, -a):max(0, block - a)]
                letters[max(a, 0):max(a, 0) + len(text)] = text
            else:
                hidden[max(a, 0):max(int(e) - first, 0)] = True
        bad = np.concatenate([[0], np.cumsum(hidden | ~np.isin(letters, np.frombuffer(b"ACGT", np.uint8)))])
        pair = letters[:-1].astype(np.int32) * 256 + letters[1:]
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode()), int(key[1])])
        free, placed, used, out = {}, {}, {}, []

        def open_places(n: int) -> np.ndarray:
            if n not in free:
                at = np.arange(max(block - n + 1, 0))
                free[n] = at[bad[at + n] == bad[at]]
            return free[n]

        def anchored(n: int, code: int, side: str) -> np.ndarray:
            if (n, code, side) not in placed:
                at = open_places(n)
                placed[n, code, side] = at[pair[at if side == "start" else at + n - 2] == code] if len(at) else at
            return placed[n, code, side]

        def pick(places: np.ndarray, mine: int, n: int) -> int | None:
            places = places[places != mine] if mine >= 0 else places
            if most:
                places = places[[used.get((int(p), n), 0) < most for p in places]]
            return int(places[rng.integers(len(places))]) if len(places) else None

        for source, s, e in rows.sort_values(["s", "e", "source_id"])[["source_id", "s", "e"]].itertuples(index=False):
            n, mine = int(e - s), int(s) - first
            sides = ["start", "end"] if rng.random() < 0.5 else ["end", "start"]
            new, outcome, anchor = None, "skipped", ""
            inside = mine + n <= block and n >= 2
            for k, side in enumerate(sides if inside else []):
                code = int(pair[mine if side == "start" else mine + n - 2])
                new = pick(anchored(n, code, side), mine, n)
                if new is not None:
                    outcome, anchor = ("matched", "fallback")[k], side
                    break
            if new is None and n <= block:
                new = pick(open_places(n), mine, n)
                outcome = "uniform" if new is not None else "skipped"
            if new is not None:
                used[new, n] = used.get((new, n), 0) + 1
            out.append((source, key[0], int(s), int(e), None if new is None else new + first, outcome, anchor))
        frame = pd.DataFrame(out, columns=names)
        frame["new_s"] = frame["new_s"].astype("Int64")
        return frame

    kind = dict(fragments.dtypes)["source_id"]
    return own.groupBy("chrom", "block").cogroup(ground.groupBy("chrom", "block")).applyInPandas(moved, f"source_id {kind}, chrom string, s long, e long, new_s long, outcome string, anchor string")


def randomization_report(moved: DataFrame) -> DataFrame:
    """(metric, value): outcomes, anchors, coordinates used twice and their share."""
    placed = moved.where("new_s is not null")
    met = placed.groupBy("chrom", "new_s", (F.col("e") - F.col("s")).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    counts = met.agg(F.count(F.lit(1)).alias("unique_coordinates"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.max("k"), F.lit(0)).alias("largest_multiplicity"), F.coalesce(F.try_divide(F.sum(F.col("k") - 1).cast("double"), F.sum("k")), F.lit(0.0)).alias("collision_fraction"))
    wide = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in counts.columns])).alias("x")).select("x.*")
    own = moved.groupBy(F.col("outcome").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    sides = moved.where("anchor <> ''").groupBy(F.concat(F.lit("anchor_"), F.col("anchor")).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return own.unionByName(sides).unionByName(wide)
