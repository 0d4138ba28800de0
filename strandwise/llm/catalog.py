"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, piece_sampling, secrets, simhash, token_counts, toxicity, warc
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .media import decoded_media, stored_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, dropped, and the SHA-256 of the text that is left."""
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__lines").cast("long").alias("lines"), F.col("__dropped").cast("long").alias("dropped"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.secret_spans(docs, secrets.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "network")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ids=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.revised_rollup(_table(spark, sf_dir, "documents"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pieces, CRC-32 of the ids, and the SHA-256 of the text that they spell."""
    found = piece_sampling.decode(piece_sampling.sample_encode(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoded_media(stored_texts(_table(spark, sf_dir, "documents")))
    size = F.octet_length("codes").cast("long")
    return found.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("codes", 256).alias("payload_sha256"), F.crc32(F.expr("substring(codes, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


OP8_SQL = r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as content
  from documents
), ranked as (
  select doc_id,
         first_value(doc_id) over (partition by content order by n desc, doc_id) as keep_id,
         count(*) over (partition by content) as group_size,
         sha256(content) as text_sha256
  from rows
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
"""


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup, "op2_secret_scan": op2_secret_scan, "op3_simhash": op3_simhash, "op4_packing": op4_packing, "op5_token_counts": op5_token_counts,
        "op6_piece_sampling": op6_piece_sampling, "op7_media": op7_media, "op8_exact_dedup": op8_exact_dedup, "op9_warc": op9_warc, "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict:
    return {"op8_exact_dedup": OP8_SQL}
