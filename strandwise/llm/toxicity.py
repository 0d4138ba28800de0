"""Toxicity by two class-conditional Kneser-Ney models.

Each class has a model of expressions (words) over documents: an expression's continuation count is the number of
different training texts of that class in which it is met. Counts are discounted (Ney's estimate from the counts
of counts) and what is taken off goes to a lower order that both classes share, the expression's share of the
texts of both. Rare expressions have no count of their own at all: they take the shared backoff in both classes,
so that only the classes' backoff weights compare them. A document's score calibrates its length-normalised
log-likelihood ratio on labelled texts that were not counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, arrow_batches, fresh_name, staged, trimmed

#: Expressions that go to every task (8 + 4 bytes each), the heaviest; texts meet all others by a join.
HEAVY = 1 << 20
#: Calibration reads this many labelled rows at most, those of the smallest hash of the id.
CALIBRATION_ROWS = 20_000
#: Least counts of an expression, scaled to the smaller class, among which calibration chooses.
RARE = (5, 10, 20, 40)
#: Part of the training rows (of five parts by CRC-32 of the id) from which those rows are taken; all others are counted.
CALIBRATION_PART = 4
#: Weight of the prior that keeps calibration weights small.
RIDGE = 1.0
_STRIP = b".,;:!?\"'()[]{}<>#$%&*|~`"
_CACHE = 100_000


def expressions(text: str | None, cache: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the different words of a text: ASCII lower case, cut at white space, outer marks off."""
    found = set()
    for raw in set((text or "").encode("utf-8", "replace").lower().split()):
        key = cache.get(raw)
        if key is None:
            word = raw.strip(_STRIP)
            key = xxhash.xxh64_intdigest(word) & (2**63 - 1) if word else -1
            if len(cache) >= _CACHE:
                cache.clear()
            cache[raw] = key
        found.add(key)
    found.discard(-1)
    return np.sort(np.fromiter(found, np.int64, len(found)))


@dataclass
class Model:
    """Log ratio of the classes for each expression with own counts, and for all others; weights of the score."""

    rare: int
    keys: np.ndarray
    ratios: np.ndarray
    other: float
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    #: Expressions beyond HEAVY with what they add over ``other`` (key, more); none where all are heavy.
    rest: DataFrame | None = None

    def sums(self, words: np.ndarray) -> float:
        if not len(words):
            return 0.0
        if not len(self.keys):
            return self.other * len(words)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return float(np.where(self.keys[at] == words, self.ratios[at], self.other).sum())

    def light(self) -> Model:
        """What tasks get."""
        return replace(self, rest=None)

    def missed(self, words: np.ndarray) -> np.ndarray:
        """Expressions that are not heavy."""
        if not len(self.keys):
            return words
        return words[self.keys[np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)] != words]

    def scores(self, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        x = (features(sums, lengths) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def features(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = np.maximum(lengths, 1.0)
    return np.column_stack([sums / n, sums / np.sqrt(n), 1 / np.sqrt(n)])


def part_of(id_: int | None) -> int:
    return zlib.crc32(str(id_).encode()) % 5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, clean, toxic): texts of each class that have the expression, summed over the batch."""
    cache: dict = {}
    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_pylist(), np.int64)
        words = [expressions(t, cache) for t in texts]
        if not words:
            continue
        keys, at = np.unique(np.concatenate(words), return_inverse=True)
        of = np.repeat(toxic, [len(w) for w in words])
        n1 = np.bincount(at, weights=of, minlength=len(keys)).astype(np.int64)
        n = np.bincount(at, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n - n1), pa.array(n1)], ["key", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Counts all labelled training texts but those that calibrate, each different text once; at most CALIBRATION_ROWS calibrate.

    Rows whose id is null, whose label is null, or whose part by CRC-32 modulo 5 is 0 are never used. With no
    training text of one of the classes the model scores every document by the share of toxic ones among the labelled texts.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    part = F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(5))
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__toxic")).where("__id is not null and __toxic in (0, 1)")
    known = staged(known.groupBy("__id").agg(F.max("__toxic").alias("__toxic")).where(part != 0), "toxicity-labels")
    few = known.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(text_col, F.lit("")).alias("text")).where("__id is not null").where(part != 0)
    labelled = texts.join(F.broadcast(known) if few else known, "__id").withColumn("part", part)

    sampled = staged(known.where(part == CALIBRATION_PART).orderBy(F.xxhash64("__id"), "__id").limit(CALIBRATION_ROWS), "toxicity-calibration")
    counted = labelled.join(F.broadcast(sampled.select("__id")), "__id", "left_anti")
    chosen = counted.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n"), "__toxic").agg(F.min("__id").alias("__id")).select("__id")
    chosen = staged(chosen, "toxicity-texts")
    train = labelled.join(F.broadcast(chosen) if few else chosen, "__id", "left_semi").select("text", "__toxic")
    counts = train.mapInArrow(trimmed(_counted), "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = staged(counts, "toxicity-counts")
    total = counts.agg(F.sum("clean"), F.sum("toxic"), *[F.sum((F.col(c) == k).cast("long")) for c in ("clean", "toxic") for k in (1, 2)]).first()
    totals = np.array([total[0] or 0, total[1] or 0], float)
    if not totals.all():
        share = labelled.agg(F.avg("__toxic")).first()[0]
        p = min(max(share if share is not None else 0.0, 1e-6), 1 - 1e-6)
        return Model(0, np.empty(0, np.int64), np.empty(0, np.float32), 0.0, np.array([np.log(p / (1 - p)), 0, 0, 0]), np.zeros(3), np.ones(3))
    ones, twos = np.array([total[2], total[4]], float), np.array([total[3], total[5]], float)
    discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)

    weight = F.greatest(F.col("clean") * F.lit(float(totals.min() / totals[0])), F.col("toxic") * F.lit(float(totals.min() / totals[1])))
    own = counts.withColumn("weight", weight).where(F.col("weight") >= RARE[0])
    over = [F.greatest(F.col(c) - F.lit(float(d)), F.lit(0.0)) for c, d in zip(("clean", "toxic"), discount)]
    taken = own.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.when(F.col("weight") >= rare, x)), F.lit(0.0)) for rare in RARE for x in over]).first()
    rests = np.maximum(totals - np.array(taken[1:]).reshape(-1, 2), 1e-9)
    others = [float(np.log((r[1] / totals[1]) / (r[0] / totals[0]))) for r in rests]

    def ratio(k: int) -> Column:
        """Log ratio of an expression with own counts in the model of RARE[k]; both classes share the lower order."""
        shared = (F.col("clean") + F.col("toxic")) / F.lit(float(totals.sum()))
        clean, toxic = ((x + F.lit(float(r)) * shared) / F.lit(float(t)) for x, r, t in zip(over, rests[k], totals))
        return F.when(F.col("weight") >= RARE[k], F.log(toxic / clean)).otherwise(F.lit(others[k]))

    own = own.select("key", "weight", *[ratio(k).cast("float").alias(f"r{k}") for k in range(len(RARE))])
    rest = None
    if taken[0] > HEAVY:
        own = staged(own, "toxicity-own")
        edge = own.orderBy(F.desc("weight"), "key").limit(HEAVY + 1).agg(F.min(F.struct("weight", -F.col("key")))).first()[0]
        heavy = F.struct("weight", -F.col("key")) > F.struct(F.lit(edge[0]), F.lit(edge[1]))
        rest, own = own.where(~heavy), own.where(heavy)
    table = own.toArrow().sort_by("key")
    keys = np.asarray(table["key"])
    models = [Model(rare, keys, np.asarray(table[f"r{k}"]), others[k], np.zeros(4), np.zeros(3), np.ones(3), None if rest is None else rest.select("key", (F.col(f"r{k}") - F.lit(others[k])).alias("more"))) for k, rare in enumerate(RARE)]
    sample = texts.join(F.broadcast(sampled), "__id").select(F.col("__id").alias("id"), "text", F.col("__toxic").alias("toxic"))
    measured = [_measured(sample, m).withColumn("k", F.lit(k)) for k, m in enumerate(models)] if rest is not None else []
    if rest is None:
        lights = [m.light() for m in models]

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict = {}
            for batch in batches:
                words = [expressions(t, cache) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([float(len(w)) for w in words]), *[pa.array([m.sums(w) for w in words], pa.float64()) for m in lights]], ["id", "toxic", "n", *[f"s{k}" for k in range(len(models))]])

        seen = sample.mapInArrow(at_once, "id long, toxic int, n double, " + ", ".join(f"s{k} double" for k in range(len(models)))).toPandas().sort_values(["id", "n"])
    else:
        long = reduce(DataFrame.unionByName, measured).toPandas()  # at most CALIBRATION_ROWS documents, and their repeated rows
        seen = long.pivot_table(index=["id", "toxic", "n", "text"], columns="k", values="sum").rename(columns=lambda k: f"s{k}").reset_index().sort_values(["id", "n"])
    y, n = seen["toxic"].to_numpy(float), seen["n"].to_numpy(float)
    return min((_calibrated(m, seen[f"s{i}"].to_numpy(float), n, y) for i, m in enumerate(models)), key=lambda x: (x[0], x[1].rare))[1]


def _calibrated(model: Model, sums: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """Logistic weights by Newton's method, and the loss on the other half when each half fits the other."""
    x = features(sums, n) if len(y) else np.zeros((0, 3))
    centre, scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(y) else (np.zeros(3), np.ones(3))
    x = np.column_stack([np.ones(len(y)), (x - centre) / scale])

    def newton(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w, prior = np.zeros(4), np.array([0.05, RIDGE, RIDGE, RIDGE])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(prior), a.T @ (b - p) - prior * w)
            w = w + np.clip(step, -2, 2)
        return w

    loss, half = 0.0, np.arange(len(y)) % 2 == 0
    for fits, tests in ((half, ~half), (~half, half)):
        p = np.clip(1 / (1 + np.exp(-np.clip(x[tests] @ newton(x[fits], y[fits]), -30, 30))), 1e-9, 1 - 1e-9)
        loss -= float((y[tests] * np.log(p) + (1 - y[tests]) * np.log(1 - p)).sum())
    return loss, replace(model, weights=newton(x, y), centre=centre, scale=scale)


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with n, the different words of the column ``text``, and sum, their log ratios.

    Texts meet the expressions that are not heavy by a join, each different text once.
    """
    names, light, wanted = rows.columns, model.light(), model.rest is not None
    at = names.index("text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            words = [expressions(t, cache) for t in batch.column(at).to_pylist()]
            more = [pa.array([light.missed(w) for w in words], pa.list_(pa.int64()))] if wanted else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(len(w)) for w in words], pa.float64()), pa.array([light.sums(w) for w in words], pa.float64()), *more], [*names, "n", "sum", *["missed"][: len(more)]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n double, sum double"
    if not wanted:
        return rows.mapInArrow(trimmed(first), schema)
    found = staged(rows.mapInArrow(trimmed(first), schema + ", missed array<long>").withColumn("content", F.unhex(F.md5(F.coalesce("text", F.lit(""))))), "toxicity-missed")
    each = found.groupBy("content").agg(F.first("missed").alias("missed"))
    more = each.select("content", F.explode("missed").alias("key")).join(model.rest, "key").groupBy("content").agg(F.sum(F.col("more").cast("double")).alias("more"))
    return found.join(more, "content", "left").select(*names, "n", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"))


def _score(model: Model, n: Column, total: Column) -> Column:
    x = [total / F.greatest(n, F.lit(1.0)), total / F.sqrt(F.greatest(n, F.lit(1.0))), 1 / F.sqrt(F.greatest(n, F.lit(1.0)))]
    logit = F.lit(float(model.weights[0]))
    for value, w, centre, scale in zip(x, model.weights[1:], model.centre, model.scale):
        logit = logit + F.lit(float(w)) * (value - F.lit(float(centre))) / F.lit(float(scale))
    return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, length, log_ratio for each row of ``docs``.

    Only the text decides the score; a null text counts as empty, and an empty text gets the score of a text
    without words. A null id is never held out (its CRC-32 is not taken). Texts of any length are read whole. Repeated
    rows get equal rows, an empty table an empty result; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    rows = _measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model).withColumn("score", _score(model, F.col("n"), F.col("sum")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("n").cast("long").alias("length"), F.col("sum").alias("log_ratio"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not predict to be toxic; a null text counts as empty."""
    arrow_batches(docs.sparkSession)
    if model.rest is not None:
        texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
        name = fresh_name("toxic_text", docs.columns)
        toxic = _measured(texts, model).where(_score(model, F.col("n"), F.col("sum")) >= 0.5).select(F.col("text").alias(name))
        return docs.join(toxic, F.coalesce(F.col(text_col), F.lit("")) == F.col(name), "left_anti")
    at, schema, light = docs.columns.index(text_col), docs.schema, model.light()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            words = [expressions(t, cache) for t in batch.column(at).to_pylist()]
            p = light.scores(np.array([light.sums(w) for w in words], float), np.array([len(w) for w in words], float))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(trimmed(clean), schema)
