"""BigWig signals as a Spark data source, and a writer of one file for each range of places.

The driver reads a file's contigs and its index only; data blocks are dealt to tasks, which inflate them and give
runs (chrom, start, end, value). Written files have no zoom levels.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.select import regions

SCHEMA = "chrom string, start long, end long, value double"
#: Fixed values of the format: magic numbers of the file, the contig tree and the index.
FILE, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
#: Runs in a written block, children of an index node, blocks in a partition of a read, bytes of data in a written file.
ITEMS, FAN, BLOCKS, ROLL = 512, 256, 512, 64 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def contigs_and_blocks(file, meets=lambda *span: True) -> tuple[dict[int, tuple[str, int]], list[tuple[int, int]], bool]:
    """Contigs by number (name, length), (offset, size) of the data blocks, and whether they are compressed; ``file`` seeks and reads.

    Only index nodes and blocks whose span (first contig, first base, last contig, end) ``meets`` are followed.
    """
    file.seek(0)
    head = struct.unpack("<IHHQQQHHQQIQ", file.read(64))
    if head[0] != FILE:
        raise ValueError("no little-endian BigWig file")
    file.seek(head[3])
    magic, _, key, _, _, _ = struct.unpack("<IIIIQQ", file.read(32))
    if magic != TREE:
        raise ValueError("no contig tree")
    contigs, nodes = {}, [head[3] + 32]
    while nodes:
        file.seek(nodes.pop())
        leaf, _, n = struct.unpack("<BBH", file.read(4))
        for _ in range(n):
            raw = file.read(key + 8)
            if leaf:
                number, length = struct.unpack_from("<II", raw, key)
                contigs[number] = (raw[:key].rstrip(b"\0").decode(), length)
            else:
                nodes.append(struct.unpack_from("<Q", raw, key)[0])
    file.seek(head[5])
    if struct.unpack("<I", file.read(4))[0] != INDEX:
        raise ValueError("no index")
    blocks, nodes = [], [head[5] + 48]
    while nodes:
        file.seek(nodes.pop())
        leaf, _, n = struct.unpack("<BBH", file.read(4))
        for _ in range(n):
            *span, place, size = struct.unpack("<IIIIQQ", file.read(32)) if leaf else (*struct.unpack("<IIIIQ", file.read(24)), 0)
            if meets(*span):
                blocks.append((place, size)) if leaf else nodes.append(place)
    return contigs, sorted(blocks), head[10] > 0


def block_runs(raw: bytes) -> Iterator[tuple[int, int, int, float]]:
    """(contig number, start, end, value) of a block: runs, or values at places or in steps."""
    contig, first, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", raw)
    if kind == 1:
        for start, end, value in struct.iter_unpack("<IIf", raw[24:24 + 12 * n]):
            yield contig, start, end, value
    elif kind == 2:
        for start, value in struct.iter_unpack("<If", raw[24:24 + 8 * n]):
            yield contig, start, start + span, value
    elif kind == 3:
        for i, (value,) in enumerate(struct.iter_unpack("<f", raw[24:24 + 4 * n])):
            yield contig, first + i * step, first + i * step + span, value
    else:
        raise ValueError(f"block of unknown kind {kind}")


class BigWigSource(DataSource):
    """``spark.read.format("bigwig").load(path)``; several paths in the option ``paths``, one to a line.

    The option ``regions`` (contigs and intervals, as ``select.regions`` takes them) reads the blocks that meet them
    alone and cuts runs at their ends; ``limit`` cuts values at both signs. Values that are not finite are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return _Reader([p for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p], self.options.get("regions"), None if limit is None else float(limit))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], regions: str | None = None, limit: float | None = None) -> None:
        self.paths, self.regions, self.limit = paths, regions, limit

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            store, where = _store(path)
            chosen: dict[int, list[tuple[int, int]]] | None = None
            with store.open_input_file(where) as file:
                contigs, blocks, packed = contigs_and_blocks(file, lambda *span: self.regions is None)
                if self.regions is not None:
                    number, chosen = {v[0]: k for k, v in contigs.items()}, {}
                    for name, s, e in regions([self.regions], dict(contigs.values())):
                        chosen.setdefault(number[name], []).append((s, e))
                    contigs, blocks, packed = contigs_and_blocks(file, lambda a, s, b, e: any((a, s) < (k, y) and (k, x) < (b, e) for k, spans in chosen.items() for x, y in spans))
            names = {k: v[0] for k, v in contigs.items()}
            out += [InputPartition((path, names, blocks[i:i + BLOCKS], packed, chosen)) for i in range(0, len(blocks), BLOCKS)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, names, blocks, packed, chosen = partition.value
        store, where = _store(path)
        with store.open_input_file(where) as file:
            for offset, size in blocks:
                file.seek(offset)
                raw = file.read(size)
                for contig, start, end, value in block_runs(zlib.decompress(raw) if packed else raw):
                    if not math.isfinite(value):
                        continue
                    if self.limit is not None:
                        value = max(-self.limit, min(self.limit, value))
                    for a, b in ((start, end),) if chosen is None else chosen.get(contig, ()):
                        if max(a, start) < min(b, end):
                            yield names[contig], max(a, start), min(b, end), float(value)


def encoded(runs: list[tuple[str, int, int, float]], lengths: dict[str, int]) -> bytes:
    """A whole file of runs in contig and place order; every contig of ``lengths`` is listed."""
    names = sorted(lengths)
    number = {c: i for i, c in enumerate(names)}
    key = max(map(len, names), default=1)
    tree = struct.pack("<IIIIQQ", TREE, max(len(names), 1), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", number[c], lengths[c]) for c in names)
    at = 64 + 40 + len(tree)
    data, blocks, place, widest = [struct.pack("<Q", 0)], [], at + 8, 0
    i = 0
    while i < len(runs):
        part = runs[i:i + ITEMS]
        part = [r for r in part if r[0] == part[0][0]][: next((k for k, r in enumerate(part) if r[0] != part[0][0]), len(part))]
        i += len(part)
        raw = struct.pack("<IIIIIBBH", number[part[0][0]], part[0][1], part[-1][2], 0, 0, 1, 0, len(part)) + b"".join(struct.pack("<IIf", s, e, v) for _, s, e, v in part)
        body = zlib.compress(raw)
        blocks.append((number[part[0][0]], part[0][1], number[part[0][0]], part[-1][2], place, len(body)))
        data.append(body)
        place += len(body)
        widest = max(widest, len(raw))
    data[0] = struct.pack("<Q", len(blocks))
    bounds = (*blocks[0][:2], *blocks[-1][2:4]) if blocks else (0, 0, 0, 0)
    index = struct.pack("<IIQIIIIQII", INDEX, FAN, len(blocks), *bounds, place, 1, 0) + _nodes(blocks, place + 48)
    covered = sum(e - s for _, s, e, _ in runs)
    values = [v for *_, v in runs]
    summary = struct.pack("<Qdddd", covered, min(values, default=0.0), max(values, default=0.0), sum((e - s) * v for _, s, e, v in runs), sum((e - s) * v * v for _, s, e, v in runs))
    head = struct.pack("<IHHQQQHHQQIQ", FILE, 4, 0, 104, at, place, 0, 0, 0, 64, max(widest, 1), 0)
    return head + summary + tree + b"".join(data) + index


def _nodes(blocks: list[tuple], at: int) -> bytes:
    """Index nodes from the root down, level by level; ``at`` is where the root goes."""
    levels = [[blocks[i:i + FAN] for i in range(0, len(blocks), FAN)] or [[]]]
    while len(levels[0]) > 1:
        spans = [(*node[0][:2], *node[-1][2:4]) for node in levels[0]]
        levels.insert(0, [spans[i:i + FAN] for i in range(0, len(spans), FAN)])
    out, place = [], at
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        size = [4 + len(node) * (32 if leaf else 24) for node in level]
        below = place + sum(size)
        if leaf:
            out += [struct.pack("<BBH", 1, 0, len(n)) + b"".join(struct.pack("<IIIIQQ", *b) for b in n) for n in level]
        else:
            sizes = [4 + len(node) * (32 if depth + 1 == len(levels) - 1 else 24) for node in levels[depth + 1]]
            offsets = iter([below + sum(sizes[:k]) for k in range(len(sizes))])
            out += [struct.pack("<BBH", 0, 0, len(n)) + b"".join(struct.pack("<IIIIQ", *s, next(offsets)) for s in n) for n in level]
        place = below
    return b"".join(out)


def write_bigwig(track: DataFrame, lengths: dict[str, int], folder: str) -> DataFrame:
    """Writes runs as files of one range each under ``folder``; gives (path, runs). Zero runs are left out.

    A task keeps ROLL bytes at most before it writes a file, under a name of its own that it changes at the end.
    """
    most = ROLL // 32

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        held, done = [], []

        def put() -> None:
            final = f"{root}/part-{TaskContext.get().partitionId():05d}-{len(done):04d}.bw"
            name = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(name, compression=None) as out:
                out.write(encoded(held, lengths))
            store.move(name, final)
            done.append((final, len(held)))
            held.clear()

        for batch in batches:
            held += list(zip(batch["chrom"], batch["start"], batch["end"], batch["value"]))
            if len(held) >= most:
                put()
        if held:
            put()
        yield pd.DataFrame(done, columns=["path", "runs"])

    rows = track.where("value <> 0").select("chrom", "start", "end", F.col("value").cast("double").alias("value"))
    return rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").mapInPandas(written, "path string, runs long")
