"""Exact deduplication that a huge group of copies cannot slow down.

Equal texts are collapsed three times, and each time the whole text is part of the grouping key, so a digest
only routes rows: within each task (Spark's partial aggregation), then for each (digest, salt), then for each
digest over the salts' winners. What travels for a group is at most one row per task and salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SALTS, by_hot_key, staged

#: Characters that do not count when texts are compared.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Ids are turned round (largest long minus id) below this many digits, lengths stand above them.
ID_DIGITS = 20
MOST = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _rank(id_: Column, length: Column) -> Column:
    """A number that is larger for longer texts, then for smaller ids; a null id comes after all others."""
    turned = F.coalesce(F.lit(MOST).cast("decimal(20,0)") - id_.cast("decimal(19,0)"), F.lit(-1).cast("decimal(20,0)")) + F.lit(1)
    return (length.cast("decimal(11,0)") * F.lit(str(10**ID_DIGITS)).cast("decimal(21,0)") + turned).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    turned = (rank % F.lit(str(10**ID_DIGITS)).cast("decimal(21,0)")).cast("decimal(20,0)")
    return F.when(turned > 0, (F.lit(MOST).cast("decimal(20,0)") - (turned - F.lit(1))).cast("long"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the one with the most code
    points in the original stays, then the smallest id. A null text counts as empty, and all empty texts are one
    group. A null id never wins against another id; a group of null ids only has a null keep_id and kept is true.
    Rows repeated with id and text each get a row, with the same verdict. An empty table gives an empty result.
    Other columns are not read. ``digest`` routes texts (SHA-256); if two different texts share one, the rows of
    such digests are matched by their whole texts.
    """
    digest = digest or (lambda text: F.sha2(text, 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    rows = rows.select("doc_id", F.char_length("raw").alias("length"), normalised(F.col("raw")).alias("content"))
    keyed = rows.select("doc_id", "content", digest(F.col("content")).alias("digest"), _rank(F.col("doc_id"), F.col("length")).alias("rank"), F.pmod(F.xxhash64("doc_id", "length"), F.lit(salts)).alias("salt"))

    salted = keyed.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("members"))
    whole = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("members").alias("group_size"))
    classes = staged(whole.select("digest", F.sha2("content", 256).alias("text_sha256"), _id_of(F.col("rank")).alias("keep_id"), "group_size"), "exact-classes")

    out = ["doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"]
    collided = classes.groupBy("digest").count().where("count > 1")
    if collided.limit(1).count():
        clashing = whole.select("digest", "content", F.sha2("content", 256).alias("text_sha256"), _id_of(F.col("rank")).alias("keep_id"), "group_size")
        return keyed.select("doc_id", "digest", "content").join(clashing, ["digest", "content"]).select(*out)
    return by_hot_key(keyed.select("doc_id", "digest"), classes, "digest", "group_size", F.col("doc_id")).select(*out)
