"""A corpus pipeline of five stages; each works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import near_copies, packing, secrets, toxicity
from strandwise.llm.line_dedup import line_dedup
from strandwise.llm.store import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under 0.5; rows of one id and text share the score."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates, and their new lengths; every document stays.

    Pairs of copies are left to the SimHash stage, which drops them whole.
    """
    return with_length(docs, line_dedup(docs, copies=False))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that SimHash or the similarity of shingles links; rows without an id stay."""
    return near_copies.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret, and their new lengths; every document stays."""
    return with_length(docs, secrets.redact(docs, secrets.fit(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs)


def with_length(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars, if there is one, is the length of the text as it is now."""
    length = F.char_length("text").cast("long")
    return changed.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", one_of_each), ("secrets", hide_secrets), ("packing", pack_sequences)]

#: Fingerprint components, the network and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
