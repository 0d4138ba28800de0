"""Token counts as rollups that deltas maintain.

The ledger is a table of signed sums. An attempt at a batch writes its sums in a folder of its own; a marker of the
batch's name, which can be created once only, tells which attempt counts. So a batch commits once however often and by
how many writers it is tried, and an attempt that fails or comes late is never read. Totals are sums over the marked
batches; compaction puts those of a moment into one, and later batches add to it.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import arrow_batches, new_path, staged

#: Versions of the tokenizer that the query counts by: file names of the tokenizers' folder.
VERSIONS = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens", "characters")
_WORDS = 200_000


@functools.cache
def counter(version: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of whole texts; loaded once where it runs, from the public tokenizers' folder."""
    import public_tokenizers as home

    if version.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=home.path(version))
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if version.endswith(".tiktoken"):
        import base64

        import regex
        import tiktoken

        with open(home.path(version), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=home.PATTERN, mergeable_ranks=ranks, special_tokens={})
        cut, known = regex.compile(home.PATTERN), {}

        def count(texts: list[str]) -> list[int]:
            out = []
            for text in texts:
                total = 0
                for part in cut.findall(text):
                    n = known.get(part)
                    if n is None:
                        n = len(coder.encode_ordinary(part))
                        if len(known) < _WORDS:
                            known[part] = n
                    total += n
                out.append(total)
            return out

        return count
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(home.path(version))
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, text_col: str = "text") -> DataFrame:
    """(source, lang, tokenizer, documents, tokens, characters): one row per row of ``docs`` and version; a null text is empty."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {v: counter(v) for v in versions}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for version, of in counters.items():
                totals: dict = {}
                tokens = of(texts)
                for source, lang, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tokens, texts):
                    kept = totals.setdefault((source, lang), [0, 0, 0])
                    kept[0] += 1
                    kept[1] += n
                    kept[2] += len(text)
                if totals:
                    columns = list(zip(*((s, la, version, *t) for (s, la), t in totals.items())))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], [*KEYS, *SUMS])

    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(count, "source string, lang string, tokenizer string, documents long, tokens long, characters long")


class Ledger:
    """Committed batches of signed sums in one folder. Many may read and commit at once."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "token-ledger")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Adds counted rows of ``inserts`` and takes away those of ``deletes``; a revision is both at once.

        True if this call committed the batch, false if it was committed before or meanwhile. Null sources and
        languages are groups of their own; repeated rows count each time; empty tables commit an empty batch.
        """
        if not batch or any(not (c.isalnum() or c in "-_") for c in batch):
            raise ValueError("a batch id is made of letters, digits, - and _")
        signed = [df.select(*KEYS, *[(F.col(c) * sign).alias(c) for c in SUMS]) for df, sign in ((inserts, 1), (deletes, -1)) if df is not None]
        if not signed:
            raise ValueError("a batch has inserts or deletes")
        if self._read(f"batches/{batch}"):
            return False
        rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        attempt = self._write(rows)
        if self._mark(f"batches/{batch}", {"data": attempt}):
            return True
        self._fs.delete(self._path(f"{self.path}/data/{attempt}"), True)
        return False

    def compact(self) -> bool:
        """Puts all batches of this moment into one table that readers take in their place; false if another writer was first."""
        number, before = self._snapshot()
        found = self.batches()
        attempt = self._write(self._rows(before, found))
        if self._mark(f"snapshots/{number + 1:08d}", {"data": attempt, "batches": found}):
            return True
        self._fs.delete(self._path(f"{self.path}/data/{attempt}"), True)
        return False

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [name for name in self._names("batches") if self._read(f"batches/{name}")]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens, characters) over all committed batches; groups that cancel out are gone."""
        return self._summed(self._rows(self._snapshot()[1], self.batches()))

    def _snapshot(self) -> tuple[int, dict]:
        """Number and content of the last snapshot that is whole."""
        for name in reversed(self._names("snapshots")):
            if found := self._read(f"snapshots/{name}"):
                return int(name), found
        return 0, {"data": None, "batches": []}

    def _rows(self, snapshot: dict, batches: list[str]) -> DataFrame:
        schema = ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{c} long" for c in SUMS)
        own = [self._read(f"batches/{b}")["data"] for b in batches if b not in set(snapshot["batches"])]
        paths = [f"{self.path}/data/{x}" for x in [snapshot["data"], *own] if x]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where(" or ".join(f"{c} <> 0" for c in SUMS))

    def _write(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        self._summed(rows).coalesce(1).write.parquet(f"{self.path}/data/{attempt}")  # sums: a row for each source, language and version
        return attempt

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where) if not s.getPath().getName().startswith((".", "_"))) if self._fs.exists(where) else []

    def _mark(self, name: str, content: dict) -> bool:
        """Creates a marker if there is none of its name; what decides is one call of the file system."""
        target, text = self._path(f"{self.path}/{name}"), json.dumps(content)
        self._fs.mkdirs(target.getParent())
        if self._fs.getScheme() == "file":  # a link appears whole or not at all
            place = Path(target.toUri().getPath())
            draft = place.parent / f".{uuid.uuid4().hex}"
            draft.write_text(text, encoding="utf-8")
            try:
                os.link(draft, place)
                return True
            except FileExistsError:
                return False
            finally:
                draft.unlink()
        try:
            out = self._fs.create(target, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, name: str) -> dict | None:
        """Content of a marker; none while it is not there or not yet whole."""
        where = self._path(f"{self.path}/{name}")
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None


def revised_rollup(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Totals of ``docs`` after three batches and a compaction; equal to a plain count.

    The first batch holds all rows, but those of one source (the smallest name) in an earlier edition, their texts in
    lower case. It is committed twice. The second batch revises that source: it takes the counts of the earlier
    edition away and adds those of the texts as they are. Null sources and languages are groups of their own; null
    texts are empty; an empty table has no totals.
    """
    ledger = Ledger(docs.sparkSession)
    again = docs.agg(F.min(F.col("source").cast("string"))).first()[0]
    of = F.coalesce(F.col("source").cast("string") == F.lit(again), F.lit(False)) if again is not None else F.lit(False)
    earlier = docs.withColumn("text", F.when(of, F.lower("text")).otherwise(F.col("text")))
    first = staged(counted(earlier, versions).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]), "token-counts")
    ledger.commit("all", inserts=first)
    ledger.commit("all", inserts=first)
    ledger.compact()
    ledger.commit("revised", inserts=counted(docs.where(of), versions), deletes=first.where(of))
    return ledger.totals()
