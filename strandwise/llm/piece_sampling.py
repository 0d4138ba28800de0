"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice of a chunk has a node for each place and an edge for each piece of the vocabulary that fits there;
characters that no piece covers go by their bytes. Filtering sums the weights of all paths to each node; sampling
walks back from the end and picks each edge by its share. Filtered chunks are kept, and the walks of all chunks of a
step go side by side in numpy. Draws come from a counter hash of the row key, so a row always gives the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_batches

MODEL = "piece_bpe_32k.model"
#: Weight of a piece: (its rank among the pieces + 2) to the power -ALPHA; bytes have a rank after all others.
ALPHA, SEED = 1.0, 11
SPACE = "▁"
#: Lattices that are kept, and characters of the longest one that is.
_KEPT, _LONG = 120_000, 64
#: Edges of spelled characters have labels from here, by code point.
SPELLED = 1 << 24
#: An odd multiplier and its inverse modulo 2**64, for hashes of pieces.
_UP = 0x9E3779B97F4A7C15
_DOWN = pow(_UP, -1, 1 << 64)
#: Bytes of texts that a step samples side by side; a longer text is a step by itself.
_STEP = 1 << 20
#: Bits of the tables that tell most strings that are no piece.
_SIEVE = 20


#: An edge of a filtered lattice: the state's cumulated share up to it, the state where it starts, the piece.
EDGE = np.dtype([("share", "f4"), ("origin", "i4"), ("label", "i4")])


@dataclass
class Filtered:
    """Filtered lattices of chunks as flat arrays: edges by state, a state's longest piece first; each chunk's last state."""

    end: dict[str, int] = field(default_factory=dict)
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    edges: np.ndarray = field(default_factory=lambda: np.empty(0, EDGE))

    def joined(self, other: Filtered) -> Filtered:
        if not other.end:
            return self
        base = len(self.first) - 1
        self.end.update((c, base + k) for c, k in other.end.items())
        more = other.edges.copy()
        more["origin"] += base
        return Filtered(self.end, np.append(self.first, len(self.edges) + other.first[1:]), np.append(self.edges, more))

    def walked(self, state: np.ndarray, draw: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling from the states of the live chunks: labels of the picked edges and their chunks, first pieces first."""
        now, draw, picked, owner, step = state[live], draw[live], [], [], 0
        while True:
            edge, until = self.first[now], self.first[now + 1]
            more = until > edge
            if not more.all():
                live, draw, edge, until = live[more], draw[more], edge[more], until[more]
            if not len(live):
                break
            u = (_mix(draw + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            found = self.edges[edge]
            late = np.flatnonzero(u >= found["share"])
            while len(late):
                edge[late] += 1
                late = late[edge[late] < until[late]]
                found[late] = self.edges[edge[late]]
                late = late[u[late] >= found["share"][late]]
            picked.append(found["label"].copy())
            owner.append(live)
            now = found["origin"]
            step += 1
        if not picked:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(picked[::-1]), np.concatenate(owner[::-1])


class Lattice:
    """Vocabulary of a model, and the filtered lattices of the chunks that were met first."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("the model has no piece for each byte, so decoding could lose text")
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int32)
        self.byte_weight = -alpha * float(np.log(n + 2))
        text: list[bytes] = [b""] * n
        for value, i in bytes_.items():
            text[i] = bytes([value])
        own = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        by_length: dict[int, list[tuple[int, int, float, np.ndarray]]] = {}
        for rank, i in enumerate(own):
            piece = model.id_to_piece(i).replace(SPACE, " ")
            text[i] = piece.encode()
            codes = _codes(piece)
            total, _ = _prefix(codes)
            by_length.setdefault(len(codes), []).append((int(total[-1]), i, -alpha * float(np.log(rank + 2)), codes))
            if any(a != " " and b == " " for a, b in zip(piece, piece[1:])) or "\n" in piece:
                raise ValueError("a piece goes on beyond a chunk")
        self.tables, self.sieves = {}, {}
        for span, rows in by_length.items():
            hashes, ids, weights, codes = zip(*sorted(rows, key=lambda r: r[:2]))
            if len(set(hashes)) < len(hashes):
                raise ValueError("two pieces share a hash")
            self.tables[span] = (np.array(hashes, np.uint64), np.array(ids, np.int64), np.array(weights), np.array(codes))
            self.sieves[span] = np.zeros(1 << _SIEVE, bool)
            self.sieves[span][self.tables[span][0] >> np.uint64(64 - _SIEVE)] = True
        self.spelled = np.frombuffer(b"".join(text), np.uint8)
        self.widths = np.fromiter(map(len, text), np.int64, n)
        self.places = np.cumsum(self.widths) - self.widths
        self.kept = Filtered()

    def learn(self, chunks: list[str]) -> Filtered:
        """Filters all chunks forward together: a step takes the states at one place of every chunk.

        State k of a chunk is the place after k characters; its edges are the pieces that end there, found by a
        rolling hash, and the bytes of the last character.
        """
        codes = _codes("".join(chunks))
        lengths = np.array([len(c) for c in chunks], np.int64)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = lengths[chunk] - place
        total, power = _prefix(codes)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        starts, spans, weights, labels = [np.arange(len(codes))], [np.ones(len(codes), np.int64)], [width * self.byte_weight], [SPELLED + codes.astype(np.int64)]
        for span, (hashes, ids, weight, pieces) in sorted(self.tables.items()):
            at = np.flatnonzero(left >= span)
            if not len(at):
                break
            own = (total[at + span] - total[at]) * power[at]
            maybe = np.flatnonzero(self.sieves[span][own >> np.uint64(64 - _SIEVE)])
            at, own = at[maybe], own[maybe]
            k = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            met = np.flatnonzero(hashes[k] == own)
            at, k = at[met], k[met]
            same = np.ones(len(at), bool)
            for j in range(span):
                same &= codes[at + j] == pieces[k, j]
            at, k = at[same], k[same]
            starts.append(at)
            spans.append(np.full(len(at), span))
            weights.append(weight[k])
            labels.append(ids[k])
        start, span, weight, label = (np.concatenate(x[::-1]) for x in (starts, spans, weights, labels))  # long pieces first: most take the larger share
        origin = start + chunk[start]
        state = origin + span
        order = np.argsort(state, kind="stable")  # merges one rising run for each length
        state, origin, weight, label, until = state[order], origin[order], weight[order], label[order], (place[start] + span)[order]
        sizes = np.bincount(state, minlength=len(log := np.zeros(len(codes) + len(chunks))))
        first = np.concatenate([[0], np.cumsum(sizes)])
        share, longest = np.empty(len(state)), int(lengths.max())
        turn = np.argsort(until.astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(until, minlength=longest + 1)[1:])])
        for a, b in zip(edges[:-1], edges[1:]):
            at = turn[a:b]
            score, own = log[origin[at]] + weight[at], state[at]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            n = np.diff(np.append(cut, b - a))
            top = np.maximum.reduceat(score, cut)
            part = np.exp(score - np.repeat(top, n))
            whole = np.add.reduceat(part, cut)
            log[own[cut]] = top + np.log(whole)
            share[at] = part / np.repeat(whole, n)
        for k in range(1, int(sizes.max())):
            at = first[:-1][sizes > k] + k
            share[at] += share[at - 1]
        share[first[1:][sizes > 0] - 1] = 1.0
        edges = np.empty(len(state), EDGE)
        edges["share"], edges["origin"], edges["label"] = share, origin, label
        return Filtered(dict(zip(chunks, (np.cumsum(lengths + 1) - 1).tolist())), first.astype(np.int32), edges)

    def sample(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and their counts.

        A text's draws depend on its key, its chunks' numbers and their steps alone.
        """
        words, counts = chunked(texts)
        words = words.dictionary_encode()
        different, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        kept = np.fromiter((self.kept.end.get(c, -1) for c in different), np.int64, len(different))
        missing = np.flatnonzero(kept < 0)
        fresh = [different[i] for i in missing.tolist()]
        now = self.learn(fresh) if fresh else Filtered()
        own = np.full(len(different), -1, np.int64)
        own[missing] = np.fromiter(now.end.values(), np.int64, len(fresh))
        if len(self.kept.end) + len(fresh) <= _KEPT and all(len(c) <= _LONG for c in fresh):
            kept[missing] = len(self.kept.first) - 1 + own[missing]
            self.kept, now = self.kept.joined(now), Filtered()
        state = kept[at]
        number = np.arange(len(state)) - np.repeat(np.cumsum(counts) - counts, counts)
        draw = _mix(np.repeat(keys.view(np.uint64), counts) ^ _mix(number.astype(np.uint64) + np.uint64(SEED << 40)))
        walks = [self.kept.walked(state, draw, np.flatnonzero(state >= 0))]
        if now.end:
            walks.append(now.walked(own[at], draw, np.flatnonzero(state < 0)))
        labels, owners = (np.concatenate(x) for x in zip(*walks))
        order = np.argsort(owners, kind="stable")
        labels, owners = labels[order], owners[order]
        spelled = np.flatnonzero(labels >= SPELLED)
        if len(spelled):
            codes = labels[spelled] - SPELLED
            n = np.ones(len(labels), np.int64)
            n[spelled] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            place = np.cumsum(n) - n
            flat = np.repeat(labels, n)
            for c in np.unique(codes):
                raw = self.byte_ids[np.frombuffer(chr(c).encode(), np.uint8)]
                places = place[spelled[codes == c]]
                for k, i in enumerate(raw):
                    flat[places + k] = i
            labels, owners = flat, np.repeat(owners, n)
        per = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(state)))])
        return labels.astype(np.int32), np.diff(per[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text that each run of ids spells; ids of controls spell nothing. Bytes that are no UTF-8 become marks."""
        n = self.widths[ids]
        raw = self.spelled[np.repeat(self.places[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        per = np.concatenate([[0], np.cumsum(n)])
        edges = per[np.concatenate([[0], np.cumsum(counts)])]
        data = pa.py_buffer(raw.tobytes())
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), data])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts one after another, and their counts: line feeds, and spaces with what follows until the next.

    No piece goes on beyond a chunk, so that the lattice of a text is that of its chunks, whatever their length.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    space, feed = data == 32, data == 10
    begins = feed.copy()
    begins[1:] |= feed[:-1] | space[1:] & ~space[:-1]
    own = offsets - offsets[0]
    begins[own[:-1][own[:-1] < own[1:]]] = True
    starts = np.flatnonzero(begins)
    edges = np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    return chunks, np.diff(np.searchsorted(starts, own))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed characters by falling powers, and the powers that move a difference of sums to its start."""
    with np.errstate(over="ignore"):
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(codes) - 1, 0), _DOWN, np.uint64)]))
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(codes) - 1, 0), _UP, np.uint64)]))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64)) * down[: len(codes)])]), up


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit counter hash: add, shift and multiply until all bits depend on all."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice_of(model: str, alpha: float = ALPHA) -> Lattice:
    """One lattice for each worker process, so that later tasks find what earlier ones kept."""
    import public_tokenizers

    if (model, alpha) not in _LATTICES:
        _LATTICES[model, alpha] = Lattice(public_tokenizers.path(model), alpha)
    return _LATTICES[model, alpha]


def sample_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """doc_id, ids for each row: a sampled segmentation whose draws are seeded by the id.

    Nothing is added in front and nothing normalised, so the pieces spell the text. A null text is empty and has no
    pieces; a null id seeds like 0. Repeated rows get equal pieces, an empty table an empty result. A very long text, or
    a long run without spaces, is one lattice like any other. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, alpha)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            for a, b in pairwise(np.flatnonzero(np.diff(sizes // _STEP, prepend=-1, append=-1)).tolist()):
                own = batch.slice(a, b - a)
                keys = pc.fill_null(own.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, counts = lattice.sample(own.column(1), keys)
                edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, pieces, ids_crc32, text: the text that each row's ids spell. Null ids spell null."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model)
        for batch in batches:
            column = batch.column(1)
            none = column.is_null()
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy().astype("<i4", copy=False)
            edges = np.concatenate([[0], np.cumsum(counts)])
            crc = [zlib.crc32(ids[a:b]) for a, b in pairwise(edges.tolist())]
            columns = [pa.array(counts), pa.array(crc, pa.int64()), lattice.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pc.if_else(none, pa.scalar(None, c.type), c) for c in columns]], ["doc_id", "pieces", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, pieces long, ids_crc32 long, text string")
