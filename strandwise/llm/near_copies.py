"""Near copies by SimHash, and by the Jaccard similarity of word shingles, without loss: a prefix join, and a check of whole sets.

SimHash links fingerprints within a distance (``simhash``: partitions and thresholds by the pigeonhole principle). Texts
that are similar by their shingles but farther apart by fingerprints are linked by a join beside it.
There a text is the set of its shingles' hashes. In any order of all hashes, two sets of similarity s share one of the
first n - ceil(s * n) + 1 of each, so texts meet under these keys alone. The keys that two sets share bound what they
share at most; pairs that can reach the similarity are verified on all shingles. Shingles that are common in a bounded
number of texts come last in the order: so few texts meet by chance, and which ones are listed changes no result.
A first round verifies few pairs for each key, which links large groups; a second one verifies every pair that is not
linked by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .simhash import BUCKET, DISTANCE, SEED, components, fingerprint, links
from .store import arrow_batches, by_hot_key, fresh_name, release, small, staged, trimmed

SHINGLE, SIMILARITY = 5, 0.8
#: Candidate pairs that a task gathers before it hands on the different ones.
PAIRS = 1 << 18
#: Texts, about, that tell which shingles are common, and how many shingles are listed as such: the order alone depends on them.
COMMON_TEXTS, COMMON = 20_000, 1 << 18


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; words as for the fingerprints, a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist())])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))


def prefix(n: int, similarity: float = SIMILARITY) -> int:
    """Hashes of a set of n under which it meets every set of the similarity."""
    share = Fraction(similarity).limit_denominator(1000)
    return n + 1 - -(-n * share.numerator // share.denominator) if n else 0


def common_shingles(texts: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of shingles in several of COMMON_TEXTS texts, about, and in how many; the most common ones, COMMON at most."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *[shingles(t, shingle) for t in batch.column(0).to_pylist()]]))], ["key"])

    steps = 1 << 20
    share = steps * COMMON_TEXTS // max(texts.count(), COMMON_TEXTS)
    some = texts.where(F.pmod(F.col("hash"), F.lit(steps)) < share).dropDuplicates(["hash"]).select("text")
    keys = some.mapInArrow(trimmed(listed), "key long").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("texts"))
    found = keys.where("texts > 1").orderBy(F.desc("texts"), "key").limit(COMMON).toArrow()
    key, count = found.column("key").to_numpy(), found.column("texts").to_numpy()
    order = np.argsort(key)
    return key[order], count[order]


def head(own: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The hashes of a set under which it meets others: the least common ones, by hash where they are equally common."""
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, counts[at], 0), kind="stable")]
    return own[: prefix(len(own), similarity)]


def _close(a: np.ndarray, b: np.ndarray, share: Fraction) -> np.ndarray:
    return share.denominator * np.minimum(a, b) >= share.numerator * np.maximum(a, b)


def _pairs(share: Fraction, every: bool):
    """Candidate pairs of rows (key, n, node, root) that come sorted; without ``every``, two for each row at most."""
    def met(key: np.ndarray, n: np.ndarray, node: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
        at, step = np.arange(len(key)), 1
        if not every:
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            bucket = np.repeat(start, np.diff(np.append(start, len(key))))
            lead = bucket.copy()
            for a, b in zip(start, np.append(start[1:], len(key))):
                if b - a > 1:
                    lead[a:b] = a + np.searchsorted(n[a:b] * share.denominator, n[a:b] * share.numerator)
            for other in (lead, np.maximum(at - 1, bucket)):
                rows = at[(other != at) & _close(n, n[other], share)]
                yield np.column_stack([node[rows], node[other[rows]], n[rows], n[other[rows]]])
            return
        while True:
            at = at[at < len(key) - step]
            at = at[(key[at] == key[at + step]) & _close(n[at], n[at + step], share)]  # sizes ascend: no later one is close
            if not len(at):
                return
            rows = at[root[at] != root[at + step]]
            yield np.column_stack([node[rows], node[rows + step], n[rows], n[rows + step]])
            step += 1

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size = np.empty((0, 4), np.int64), [], 0

        def handed() -> pa.RecordBatch:
            pairs = np.concatenate([np.empty((0, 4), np.int64), *held])
            pairs = np.where((pairs[:, 0] <= pairs[:, 1])[:, None], pairs, pairs[:, [1, 0, 3, 2]])
            pairs, keys = np.unique(pairs, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in pairs.T], pa.array(keys)], ["v", "u", "n_v", "n_u", "keys"])

        for batch in _with_end(batches):
            if batch is not None:
                rows = np.concatenate([rows, np.column_stack([np.asarray(c) for c in batch.columns])])
            cut = len(rows) if batch is None or not len(rows) else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                for pairs in met(*rows[:cut].T):
                    held.append(pairs)
                    size += len(pairs)
                    if size > PAIRS:
                        yield handed()
                        held, size = [], 0
                rows = rows[cut:]
        yield handed()

    return walked


def _least_keys(similarity: float) -> str:
    """SQL of the keys that a pair shares at least: all that the one set has up to the end of its keys, less what may differ.

    Of the set whose keys end first, those that are not shared are in it alone.
    """
    share = Fraction(similarity).limit_denominator(1000)
    p, q = share.numerator, share.denominator
    rest = [f"ceil({n} * {p}L / {q}) - 1" for n in ("n_u", "n_v")]
    return f"ceil((n_u + n_v) * {p}L / {p + q}) - greatest({', '.join(rest)})"


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _edges_of_prints(own: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) of the nodes whose fingerprints SimHash links: each node with the smallest of its component."""
    prints = staged(own.select("node", "print").distinct(), "near-prints")
    stars = components(links(staged(prints.select("print").distinct(), "near-distinct"), distance))
    rooted = prints.join(stars.select(F.col("node").alias("print"), "root"), "print", "left").select("node", F.coalesce("root", "print").alias("root"))
    rooted = staged(rooted.distinct(), "near-print-roots")
    least = staged(rooted.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "near-print-least")
    return staged(by_hot_key(rooted, least, "root", "nodes", F.col("node")).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")), "near-print-links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int | None = None) -> DataFrame:
    """doc_id, component_id for each row of ``docs``: the smallest id that links of the similarity or more reach.

    With a ``distance`` fingerprints that differ in so many bits at most are links too (SimHash).
    Texts without words link with each other alone. Null ids take no part in the smallest (null if there is no other).
    Repeated rows get equal rows, an empty table an empty result; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    share = Fraction(similarity).limit_denominator(1000)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = [fingerprint(t) if distance is not None else bytes(8) for t in batch.column(1).to_pylist()]
            prints = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
            heads = [head(s, *common, similarity) for s in sets]
            cuts = np.cumsum([0, *map(len, heads)], dtype=np.int32)
            heads = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.int64), *heads])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), heads], ["doc_id", "hash", "node", "print", "n", "head"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "own"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(s, np.int64) for s in batch.column(c).to_pylist()] for c in (2, 3))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
            near = [share.denominator * k >= share.numerator * (len(x) + len(y) - k) for k, x, y in zip(both, a, b)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    def verified(pairs: DataFrame, part: float, name: str) -> DataFrame:
        met = pairs.groupBy("u", "v", "n_u", "n_v").agg(F.sum("keys").alias("keys"))
        used: list[DataFrame] = []
        pairs = staged(met.where(f"keys >= {part} * ({_least_keys(similarity)})").select("u", "v"), f"near-pairs-{name}", used)
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(firsts.select("node", "hash"), "node")
        own = texts.join(small(staged(nodes, f"near-nodes-{name}", used)), "hash").select("node", "text").dropDuplicates(["node"])
        own = staged(own.mapInArrow(trimmed(whole), "node long, own binary"), f"near-sets-{name}", used)
        sides = [own.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in ("u", "v")]
        near = staged(pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "own_u", "own_v").mapInArrow(trimmed(similar), "u long, v long"), f"near-links-{name}")
        release(used)
        return near

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    common = common_shingles(texts, shingle)
    keys = staged(texts.select("doc_id", "text", "hash").mapInArrow(trimmed(keyed), "doc_id long, hash long, node long, print long, n long, head array<long>"), "near-keys")
    own = staged(keys.select("doc_id", "hash", "node", "print"), "near-own")
    firsts = staged(own.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("hash").alias("hash"), F.count(F.lit(1)).alias("copies")), "near-firsts")
    heads = keys.select("node", "n", "head").dropDuplicates(["node"]).select(F.explode("head").alias("key"), "n", "node")
    heads = heads.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1")
    heads = staged(heads.select("key", "members", "n", "node"), "near-shared")
    release([keys])
    used: list[DataFrame] = []

    def walk(rows: DataFrame, every: bool) -> DataFrame:
        return rows.select("key", "n", "node", "root").repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(trimmed(_pairs(share, every)), "v long, u long, n_v long, n_u long, keys long")

    linked = verified(walk(heads.withColumn("root", F.col("node")), False), 0.25, "first")  # counts are partial here
    if distance is not None:
        linked = linked.unionByName(_edges_of_prints(own, distance))
    stars = components(linked)
    rooted = heads.join(stars, "node", "left").select("key", "members", "n", "node", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "near-rooted", used)
    release([heads])
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = rooted.join(apart, "key")
    parts, part = F.ceil(F.col("members") / F.lit(BUCKET // 2)).cast("int"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / F.lit(BUCKET // 2)).cast("int")).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda o: o != part)
    cells = F.when(F.col("members") <= BUCKET, F.array(F.col("key"))).otherwise(F.transform(others, lambda o: F.xxhash64("key", F.least(o, part), F.greatest(o, part))))
    rest = rest.select(F.explode(cells).alias("key"), "n", "node", "root")
    others = verified(walk(rest, True), 1.0, "rest")
    release(used)
    stars = components(linked.unionByName(others))

    rooted = staged(firsts.join(stars, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")), "near-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    classes = staged(by_hot_key(rooted.drop("first"), staged(least, "near-least"), "root", "nodes", F.col("node")).select("node", "component_id", "copies"), "near-classes")
    return by_hot_key(own.select("doc_id", "node"), classes, "node", "copies", F.col("doc_id")).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's, by SimHash's links and those of the similarity; rows with a null id stay, as they cannot be named.

    Rows that repeat an id count as one document, which goes only if each of its rows goes.
    """
    name = fresh_name("kept", docs.columns)
    found = near_copies(docs, id_col, text_col, distance=DISTANCE).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(found.hint("merge"), F.col(id_col).cast("long") == F.col(name), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
