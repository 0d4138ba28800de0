"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a small Hamming distance. Bits that go together are grouped into partitions, and
each partition i gets a threshold t_i of its own with sum(t_i + 1) = distance + 1, so two fingerprints within the
distance are within t_i in some partition. Dynamic programming picks the thresholds with the least estimated work.
A fingerprint's signatures in a partition are its bits there with every choice of t_i of them masked; equal
signatures are candidates, and every candidate pair is verified on all 64 bits.

Only different fingerprints are compared, so copies cost nothing. Pairs are never rows: tasks walk sorted
signatures, compare within a bucket and hand on a spanning forest. Buckets over a bound are cut into cells, each a
pair of their parts, so that no task holds a whole one and no pair is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, arrow_batches, by_hot_key, discard, fresh_name, staged

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Numbers of partitions among which the least estimated work decides.
PARTITIONS = (2, 3, 4)
#: Work of making, moving and sorting one signature, in verified pairs.
SIGNATURE_WORK = 50.0
#: Members of a bucket that one task compares; larger buckets are cut into cells of two such parts.
BUCKET = 2048
#: Edges that a task gathers before it reduces them to a forest.
EDGES = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, highest bit first. Lower-cases A-Z, cuts at ASCII white space; no words: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())])
    ones = np.zeros(BITS, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(bits[at:at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print, the fingerprint as a signed long, for each row."""
    arrow_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, print long")


def bit_table(prints: np.ndarray) -> np.ndarray:
    """(n, 64) bits, the highest first."""
    return np.unpackbits(prints.astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = bit_table(np.asarray(batch.column(0))).astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS, dtype=np.int64), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel())], ["i", "j", "both"])


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count of fingerprints, share of ones of each bit and correlations, all over the whole table."""
    n = prints.count()
    rows = prints.mapInArrow(_bit_counts, "i long, j long, both long").groupBy("i", "j").agg(F.sum("both").alias("both")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["both"]
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return n, share, (both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each grows by the bit that goes most with those it has."""
    strength = np.abs(correlation) - np.eye(BITS)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (strength[b, group].sum(), -b)))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _pairs_within(n: int, share: np.ndarray, correlation: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs within 0..most bits in a partition: differing bits as independent, enlarged by their correlations."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for b in group:
        d = 2 * share[b] * (1 - share[b])
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    sub = correlation[np.ix_(group, group)] ** 2
    more = math.exp(min((sub.sum() - np.trace(sub)) / 2, 20.0))
    return [float(min(1.0, chance[: t + 1].sum() * more) * n * (n - 1) / 2) for t in range(most + 1)]


def allocated(n: int, share: np.ndarray, correlation: np.ndarray, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds (-1: partition not used) of the least estimated work, by dynamic programming."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in PARTITIONS:
        groups = grouped_bits(correlation, parts)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            pairs = _pairs_within(n, share, correlation, group, 2)
            costs = {-1: 0.0} | {t: SIGNATURE_WORK * n * math.comb(len(group), t) + pairs[t] for t in range(3)}
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in state.items():
                for t, more in costs.items():
                    k = used + t + 1
                    if k <= distance + 1 and (k not in after or cost + more < after[k][0]):
                        after[k] = (cost + more, [*chosen, t])
            state = after
        if distance + 1 in state and (best is None or state[distance + 1][0] < best[0]):
            best = (state[distance + 1][0], groups, state[distance + 1][1])
    assert best is not None
    return best[1], best[2]


def signatures(prints: np.ndarray, groups: list[list[int]], thresholds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all signatures of all fingerprints; keys of other partitions or masks never meet."""
    u, keys = prints.astype(np.uint64), []
    for part, (group, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        value = np.zeros(len(u), np.uint64)
        for place, bit in enumerate(group):
            value |= ((u >> np.uint64(BITS - 1 - bit)) & np.uint64(1)) << np.uint64(place)
        for mask_id, masked in enumerate(combinations(range(len(group)), t)):
            keep = np.uint64((1 << len(group)) - 1 - sum(1 << p for p in masked))
            keys.append((np.uint64((part * 1024 + mask_id) << 32) | (value & keep)).astype(np.int64))
    return np.tile(np.arange(len(u)), len(keys)), np.concatenate(keys) if keys else np.empty(0, np.int64)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: each node with the smallest node that it reaches, roots left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def linked_in_order(key: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints within the distance among neighbours of equal key; keys are sorted."""
    found_a, found_b, step = [], [], 1
    at = np.arange(len(key))
    while True:
        at = at[at < len(key) - step]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = np.bitwise_count((prints[at] ^ prints[at + step]).astype(np.uint64)) <= distance
        found_a.append(prints[at[near]])
        found_b.append(prints[at[near] + 0 + step])
        step += 1
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: verified pairs within each bucket, reduced to a forest."""
    key, prints = np.empty(0, np.int64), np.empty(0, np.int64)
    us, vs, held = [], [], 0

    def take(k: np.ndarray, p: np.ndarray) -> None:
        nonlocal us, vs, held
        a, b = linked_in_order(k, p)
        us.append(a)
        vs.append(b)
        held += len(a)
        if held > EDGES:
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [a], [b], 0

    for batch in batches:
        key = np.concatenate([key, np.asarray(batch.column(0))])
        prints = np.concatenate([prints, np.asarray(batch.column(1))])
        if len(key):
            last = np.searchsorted(key, key[-1])
            take(key[:last], prints[:last])
            key, prints = key[last:], prints[last:]
    take(key, prints)
    a, b = forest(np.concatenate(us), np.concatenate(vs))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u > v) that connect what the fingerprints within the distance connect; ``prints`` has different ones."""
    n, share, correlation = bit_statistics(prints)
    groups, thresholds = allocated(n, share, correlation, distance)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0))
            row, key = signatures(own, groups, thresholds)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "print"])

    keyed = prints.mapInArrow(signed, "key long, print long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(f"members > {BUCKET}")
    large = staged(sizes.select("key", F.ceil(F.col("members") / F.lit(BUCKET // 2)).cast("int").alias("parts")), "simhash-large")
    count = large.count()
    if count:
        wide = keyed.join(F.broadcast(large) if count <= BROADCAST_ROWS else large, "key", "left")
        part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != part)
        cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda o: F.xxhash64(F.least(o, part), F.greatest(o, part))))
        keyed = wide.select("key", "print", F.explode(cells).alias("cell")).select(F.when(F.col("cell") == 0, F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("key"), "print")
    return staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "u long, v long").distinct(), "simhash-links")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges with the smallest node of its component, by large and small stars."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last, now = now, staged(small, "components")
        if before is not None:
            discard(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print, component_id, copies for each row of ``docs``.

    component_id is the smallest id that links of at most three differing bits reach, the row's own included;
    copies counts the rows with the same fingerprint. A null text is an empty one; texts without words have the
    fingerprint zero and link like others. Null ids take no part in the smallest (null if there is no other).
    Repeated rows get equal rows, an empty table an empty result; other columns are not read.
    """
    own = staged(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = staged(own.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "simhash-distinct")
    stars = components(links(distinct.select("print")))
    rooted = distinct.join(stars, F.col("print") == F.col("node"), "left").select("print", "first", "copies", F.coalesce("root", "print").alias("root"))
    rooted = staged(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    classes = staged(by_hot_key(rooted.drop("first"), staged(least, "simhash-least"), "root", "prints", F.col("print")).select("print", "component_id", "copies"), "simhash-classes")
    return by_hot_key(own, classes, "print", "copies", F.col("doc_id")).select("doc_id", "print", "component_id", "copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's; rows with a null id stay, as they cannot be named.

    Rows that repeat an id count as one document, which goes only if each of its rows goes.
    """
    name = fresh_name("kept", docs.columns)
    found = simhash_components(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(found.hint("merge"), F.col(id_col).cast("long") == F.col(name), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
