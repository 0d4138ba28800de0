"""BAM files as a Spark data source, and the fragments of their read pairs. Nothing but zlib and struct is needed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, ref_end long, contig_length long"
#: Letters of CIGAR operations by number, and those that use up the reference.
CIGAR, ON_REFERENCE = "MIDNSHP=X", "MDN=X"
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 64, 256, 512, 1024, 2048


def inflated(read) -> Iterator[bytes]:
    """Data of each block of a blocked gzip stream; ``read(n)`` gives the next bytes."""
    while head := read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("no blocked gzip")
        extra = struct.unpack_from("<H", head, 10)[0]
        more = head[12:] + read(extra - 6)
        at, size = 0, None
        while at + 4 <= extra:
            tag, n = more[at:at + 2], struct.unpack_from("<H", more, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", more, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("block without size")
        body = read(size - 12 - extra)
        data = zlib.decompress(body[:-8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", body, len(body) - 8)[0]:
            raise ValueError("block checksum does not fit")
        yield data


class _Stream:
    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.rest = blocks, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.rest) < n:
            more = next(self.blocks, None)
            if more is None:
                break
            self.rest += more
        out = bytes(self.rest[:n])
        del self.rest[:n]
        return out


def alignments(read) -> Iterator[tuple]:
    """Rows of SCHEMA without the path."""
    s = _Stream(inflated(read))
    if s.take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    contigs: list[tuple[str | None, int | None]] = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", s.take(4))[0]))
    contigs.append((None, None))
    while size := s.take(4):
        raw = s.take(struct.unpack("<i", size)[0])
        ref, pos, name_n, mapq, _, ops, flag, _, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
        name = raw[32:32 + name_n - 1].decode()
        codes = struct.unpack_from(f"<{ops}I", raw, 32 + name_n)
        cigar = "".join(f"{c >> 4}{CIGAR[c & 15]}" for c in codes) or "*"
        end = pos + sum(c >> 4 for c in codes if CIGAR[c & 15] in ON_REFERENCE)
        yield name, flag, contigs[ref][0], pos, mapq, cigar, contigs[mate][0], mate_pos, tlen, end, contigs[ref][1]


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; several paths in the option ``paths``, one to a line. A file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options.get("paths", self.options.get("path", "")).split("\n"))


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = [p for p in paths if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (fs.LocalFileSystem(), partition.value)
        with store.open_input_stream(path, compression=None) as stream:
            for row in alignments(stream.read):
                yield (partition.value, *row)


def usable(reads: DataFrame, mapq: int = 0, proper: bool = True, duplicates: bool = False, failed: bool = False, clipped: bool = False, secondary: bool = False, supplementary: bool = False) -> DataFrame:
    """Reads of pairs that are both mapped, by flags, quality and clipping."""
    none = UNMAPPED | MATE_UNMAPPED | (0 if duplicates else DUPLICATE) | (0 if failed else FAILED) | (0 if secondary else SECONDARY) | (0 if supplementary else SUPPLEMENTARY)
    out = reads.where((F.col("flag").bitwiseAND(F.lit(none)) == 0) & (F.col("mapq") >= mapq))
    if proper:
        out = out.where(F.col("flag").bitwiseAND(F.lit(PROPER)) != 0)
    return out if clipped else out.where(~F.col("cigar").rlike("[SHP]"))


def pair_fragments(reads: DataFrame) -> DataFrame:
    """(path, chrom, s, e): from the forward read's start to the reverse read's end, for pairs that face each other on one contig."""
    strand = F.col("flag").bitwiseAND(F.lit(REVERSE)) != 0
    pairs = reads.groupBy("path", "name", "chrom").agg(
        F.min(F.when(~strand, F.col("pos"))).alias("s"), F.max(F.when(~strand, F.col("ref_end"))).alias("forward_end"), F.min(F.when(strand, F.col("pos"))).alias("reverse_start"), F.max(F.when(strand, F.col("ref_end"))).alias("e"),
    )
    return pairs.where("s <= reverse_start and e >= forward_end").select("path", "chrom", "s", "e")


def first_read_lengths(reads: DataFrame) -> DataFrame:
    """(path, chrom, s, e) by template length of the first read: the rule of length tables."""
    first = reads.where(F.col("flag").bitwiseAND(F.lit(FIRST)) != 0).where("tlen <> 0 and chrom = mate_chrom")
    start = F.least("pos", "mate_pos")
    return first.select("path", "chrom", start.alias("s"), (start + F.abs("tlen")).alias("e"))


def leftmost_fragments(reads: DataFrame) -> DataFrame:
    """(path, chrom, s, e) from reads with a positive template length: the rule of cross-correlation."""
    return reads.where("tlen > 0").select("path", "chrom", F.col("pos").alias("s"), (F.col("pos") + F.col("tlen")).alias("e"))
