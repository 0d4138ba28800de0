"""Best-fit packing of token sequences by minimum bin slack.

Only the number of pieces of each length decides how bins are filled, so the plan works on a histogram of at most
``capacity`` rows. For each bin, subset sums of the lengths at hand are built as bits of one integer per length
(bounded multiplicities as powers of two); the fullest reachable sum is traced back and taken out, as often at once
as the counts allow. Pieces get their places by rank within their length, so no task holds a long group.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import KEPT, SALTS, arrow_batches, staged, trimmed

CAPACITY = 2048
#: Tokenizer files are given by name; public_tokenizers.path(name) is their place on any machine.
TOKENIZER = "word_bpe_49k.json"
END = 0
#: Words, and parts of words, that an encoder keeps; longer ones are encoded where they are met.
_WORDS, _LONG = 150_000, 200
#: Python cuts at these controls, the tokenizer does not.
_SEPARATORS = "[\x1c-\x1f]"
#: Words of these alone are cut and lowered here; other ones go through the whole tokenizer. No special token is one.
_PLAIN = "^[!-~\u00a1-\u017f]+$"
#: The pattern by which they are cut: no match holds white space or depends on what stands around it.
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Kept:
    """Ids of strings, flat, and where those of each string are; the first ``most`` that are not long are kept for good."""

    def __init__(self, most: int) -> None:
        self.most, self.strings = most, pa.array([], pa.string())
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def found(self, strings: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, lengths, k): string i has the ids flat[starts[k[i]]:][:lengths[k[i]]]. Strings differ."""
        k = pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(k < 0)
        if not len(missing):
            return self.flat, self.starts, self.lengths, k
        fresh = strings.take(pa.array(missing))
        room = self.most - len(self.strings)
        if room:  # those to be kept come first
            short = pc.less_equal(pc.binary_length(fresh), _LONG).to_numpy(zero_copy_only=False)
            order = np.argsort(~short, kind="stable")
            missing, fresh, room = missing[order], fresh.take(pa.array(order)), min(room, int(short.sum()))
        ids, n = encode(fresh)
        first, end = len(self.lengths), len(self.flat)
        flat, starts, lengths = np.append(self.flat, ids), np.append(self.starts, end + np.cumsum(n) - n), np.append(self.lengths, n)
        k[missing] = first + np.arange(len(fresh))
        if room:
            self.strings = pa.concat_arrays([self.strings, fresh[:room]])
            self.flat, self.starts, self.lengths = flat[: end + int(n[:room].sum())].copy(), starts[: first + room].copy(), lengths[: first + room].copy()
        return flat, starts, lengths, k


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the strings k one after another, and their counts."""
    n = lengths[k]
    return flat[np.repeat(starts[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class Encoder:
    """Token ids of whole texts; different words are encoded once for a batch, and kept while there is room.

    The tokenizer replaces white space by spaces, composes, lowers and then cuts into parts within which tokens form,
    so that words between white space, and parts of words, can be encoded alone. Words of Latin letters and ASCII
    marks are cut here by the tokenizer's own pattern and their parts encoded without its normaliser; all other words
    go through the whole tokenizer, as do whole texts where the tokenizer is of another kind.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", ())]
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", ())
        self.pattern = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and cuts[0]["pattern"].get("Regex") == _CUT and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]:
            self.pattern = regex.compile(f"{_CUT}|\n")
            self.parts = Tokenizer(self.whole.model)
            self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.pieces = _Kept(_WORDS), _Kept(_WORDS)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        e = self.parts.encode(" ".join(parts.to_pylist()), add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.bincount(np.fromiter(e.word_ids, np.int64, len(e.ids)), minlength=len(parts))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their counts: in order, plain ones by their parts, which are cut all at once."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
        cut = pa.array(self.pattern.findall("\n".join([*words.filter(plain).to_pylist(), ""]).lower()), pa.string())
        ends = np.flatnonzero(pc.equal(cut, "\n").to_numpy(zero_copy_only=False))
        flat = cut.filter(pc.not_equal(cut, "\n")).dictionary_encode()
        table = self.pieces.found(flat.dictionary, self._parts)
        ids, n = _gathered(*table[:3], table[3][flat.indices.to_numpy()])
        tokens = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends - np.arange(len(ends))])])
        if len(tokens) == len(words):
            return ids, tokens
        plain = plain.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~plain)
        whole = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(words.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        both = [*np.split(ids, np.cumsum(tokens)[:-1]), *whole] if len(tokens) else whole
        order = np.argsort(np.concatenate([np.flatnonzero(plain), odd]))
        return np.concatenate([both[i] for i in order]), np.array([len(both[i]) for i in order], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their counts; a null text has none."""
        texts = pc.fill_null(texts, "")
        if self.pattern is None:
            found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        parted = pc.match_substring_regex(texts, _SEPARATORS)
        odd = np.flatnonzero(np.asarray(parted.to_numpy(zero_copy_only=False), bool))
        cut = pc.utf8_split_whitespace(pc.if_else(parted, "", texts))
        words = cut.flatten().dictionary_encode()
        table = self.words.found(words.dictionary, self._words)
        ids, n = _gathered(*table[:3], table[3][words.indices.to_numpy()])
        run = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(run[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))])])
        if len(odd):
            split = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd.tolist():
                split[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids, counts


def encoder_of(tokenizer: str) -> Encoder:
    """One encoder for each worker process, so that later tasks find what earlier ones kept, until the worker does other work."""
    import public_tokenizers

    if tokenizer not in KEPT:
        KEPT[tokenizer] = Encoder(public_tokenizers.path(tokenizer))
    return KEPT[tokenizer]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, unless ``ids`` is false, the token ids, for each piece of each row.

    A document is its ids and the end id; a longer one is cut, a null or empty text gives the end id alone. Repeated
    rows give repeated pieces, an empty table none; very long texts are encoded whole, a batch of bounded bytes at a
    time. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            tokens, n = encoder.encode(batch.column(1))
            n = n + 1
            until = np.cumsum(n)
            flat = np.full(int(n.sum()), END, "<u4")
            own = np.ones(len(flat), bool)
            own[until - 1] = False
            flat[own] = tokens
            many = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, n[owner] - start)
            edges = np.concatenate([[0], np.cumsum(length)])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(trimmed(cut, keeps=True), schema)


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, largest first, whose sum comes closest to the capacity, the longest at hand among them."""
    first = max(counts)
    free = capacity - first
    items = []
    for length in sorted(counts, reverse=True):
        most = min(counts[length] - (length == first), free // length)
        step = 1
        while most > 0:
            take = min(step, most)
            items.append((length, take))
            most -= take
            step *= 2
    mask = (1 << (free + 1)) - 1
    reach, trail = 1, [1]
    for length, take in items:
        reach |= (reach << (length * take)) & mask
        trail.append(reach)
        if reach >> free & 1:
            break
    left = reach.bit_length() - 1
    chosen = [first]
    for k in range(len(trail) - 1, 0, -1):
        if not trail[k - 1] >> left & 1:
            length, take = items[k - 1]
            chosen += [length] * take
            left -= length * take
    return sorted(chosen, reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, times): bins in the order in which they are filled; every piece is in one of them."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        bin_ = fullest(counts, capacity)
        need = {k: bin_.count(k) for k in set(bin_)}
        times = min(counts[k] // n for k, n in need.items())
        for k, n in need.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((bin_, times))
    return out


def _slots(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length and bin pattern: the first rank, how many of the length a bin has, where the first of them lies."""
    rows, used, first = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            rows.append((length, used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return pd.DataFrame(rows, columns=["length", "rank0", "each", "bin0", "offset0"])


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset. ``cut`` is read three times: stage it first.

    No sequence exceeds the capacity and its pieces follow one another without gaps. Ties of length are dealt by
    a hash of id, piece and content, then by these. Full pieces are sequences by themselves and are not ranked; their
    numbers come from their place in the staged table. An empty table gives an empty result.
    """
    spark: SparkSession = cut.sparkSession
    dealt = cut.where(F.col("length") < capacity).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(2 * SALTS)))
    counts = dealt.groupBy("length", F.col("__salt").alias("salt")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "salt"])  # at most capacity * 2 * SALTS rows
    counts["base"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    bins = plan({int(k): int(v) for k, v in counts.groupby("length")["n"].sum().items()}, capacity)
    slots = _slots(bins)
    bases = spark.createDataFrame(counts[["length", "salt", "base"]].astype("int64"), "length long, salt long, base long").toDF("__length", "__salt2", "__base")
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("__place", rank).join(F.broadcast(bases), (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__salt2")))
    tables = {int(k): tuple(g.sort_values("rank0")[c].to_numpy(np.int64) for c in ("rank0", "each", "bin0", "offset0")) for k, g in slots.groupby("length")}
    names = [*cut.columns]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, own = np.asarray(batch.column("length")), np.asarray(batch.column("__rank"))
            sequence, offset = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                at = order[a:b]
                rank0, each, bin0, offset0 = tables[int(length[at[0]])]
                k = np.searchsorted(rank0, own[at], "right") - 1
                past = own[at] - rank0[k]
                sequence[at] = bin0[k] + past // each[k]
                offset[at] = offset0[k] + past % each[k] * length[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    placed = ranked.select(*names, (F.col("__base") + F.col("__place")).alias("__rank")).mapInArrow(trimmed(put), schema)
    whole = cut.where(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() + F.lit(sum(n for _, n in bins))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ids: bool = True) -> DataFrame:
    """Token pieces of all rows with their places in the fewest sequences that minimum bin slack finds.

    Nulls, empty and long texts, repeated rows and empty tables are as for ``pieces``, ties as for ``packed``.
    """
    return packed(staged(pieces(docs, id_col, text_col, capacity, tokenizer, ids), "pieces"), capacity)
