"""WARC archives of pages: a writer of one gzip member per record, and a sequential reader.

The reader inflates incrementally, takes records by their content length, and verifies block and payload digests.
Archives are files in the shared folder; only their manifest goes through Spark.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SALTS, arrow_batches, new_path, shared_dir, staged

#: Payloads of so many bytes at least are stored once; smaller ones always.
LEAST_BYTES = 0
#: A new archive begins after so many compressed bytes.
ROLL_BYTES = 16 << 20
#: Tasks that read archives at most; a task reads one after another.
READERS = 10_000
#: Compressed bytes that the reader takes at a time.
READ_BYTES = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID(int=0)


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: datetime) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "about:blank") if c > " ") or "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(read) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each gzip member; ``read(n)`` gives the next compressed bytes. Raises ValueError on broken archives."""
    rest = b""
    while True:
        rest = rest or read(READ_BYTES)
        if not rest:
            return
        member, data, head, need = zlib.decompressobj(31), bytearray(), {}, None
        while not member.eof:
            if not rest:
                rest = read(READ_BYTES)
                if not rest:
                    raise ValueError("archive is cut short")
            data += member.decompress(rest)
            rest = member.unused_data if member.eof else b""
            if need is None and (end := data.find(b"\r\n\r\n")) >= 0:
                lines = bytes(data[:end]).decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC record")
                head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
                need = (end + 4, int(head["Content-Length"]))
        if need is None or len(data) != sum(need) + 4 or data[sum(need):] != b"\r\n\r\n":
            raise ValueError("length of a record does not fit its header")
        block = bytes(data[need[0]:sum(need)])
        if head.get("WARC-Block-Digest", "") != f"sha1:{digest(block)}":
            raise ValueError("block digest does not fit")
        yield head, block


def _page(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; the payload of a response is verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b":", 1)[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    told, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError("payload does not fit its digest")
    as_id = lambda name: int(head[name]) if head.get(name) else None
    return as_id("X-Page-ID"), size, told, kind, as_id("X-Refers-To-Page")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc)) -> DataFrame:
    """Writes every row as a record and returns the staged manifest (path, records, bytes) of complete archives.

    Of rows with equal payloads of at least ``least_bytes``, the one with the smallest id is a response and the others
    revisit it; repeated rows of that id in a task beyond the first are revisits too (they share a task, as rows are dealt by id and payload). A null payload is an empty one; a null id
    comes last. Groups are resolved by SHA-256 with salted partial minima, so that no copy's payload meets the others'.
    A task writes under a name of its own and renames at the end, so repeated attempts leave whole archives only.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    folder = new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256)))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    salted = rows.where("key is not null").groupBy("key", "salt").agg(F.min("page_id").alias("first"))
    least = salted.groupBy("key").agg(F.min("first").alias("first"))
    lookup = staged(salted.select("key", "salt").join(least, "key"), "warc-first")
    place = F.coalesce("page_id", F.lit(2**63 - 1))
    firsts = rows.select(place.alias("__place"), "key", "salt").join(lookup, ["key", "salt"]).select("__place", F.col("key").alias("__key"), "first").distinct()
    # The payloads move once: both sides are dealt by page, and tasks sort their own rows.
    marked = rows.withColumn("__page", place).join(firsts.hint("merge"), (F.col("__page") == F.col("__place")) & (F.col("key") == F.col("__key")), "left")
    ordered = marked.select("page_id", "url", "html", "first", F.col("key").isNotNull().alias("shared")).sortWithinPartitions("page_id", "html", "url")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        done, out, name, part, seen = [], None, "", 0, set()

        def close() -> None:
            nonlocal out
            size = out.tell()
            out.close()
            final = f"{root}/{task.partitionId():06d}-{part:04d}.warc.gz"
            if store.get_file_info(final).type != fs.FileType.NotFound:  # an earlier attempt of this task wrote the same records
                store.delete_file(final)
            store.move(name, final)
            done.append((final, count, size))
            out = None

        count = 0
        for batch in batches:
            for page, url, html, first, shared in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{root}/_{uuid.uuid4().hex}"
                    out, count = store.open_output_stream(name, compression=None), 0
                revisit = bool(shared) and (page != first or page in seen)
                if shared and page == first:
                    seen.add(page)
                out.write(record(page, url, html.encode("utf-8", "replace"), first if revisit else None, revisit, date))
                count += 1
                if out.tell() >= ROLL_BYTES:
                    close()
                    part += 1
        if out is not None:
            close()
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return staged(ordered.mapInArrow(written, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each record of the archives, in file order.

    An archive is read as a stream. Fewer records than the manifest tells, or any broken record, is an error.
    """
    spark = manifest.sparkSession
    files = manifest.count()
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    scheme = _scheme(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, where = fs.FileSystem.from_uri(scheme + path) if scheme else (fs.LocalFileSystem(), path)
                rows, met = [], 0
                with store.open_input_stream(where, compression=None) as stream:
                    for head, block in records(stream.read):
                        rows.append(_page(head, block))
                        met += 1
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if met != count:
                    raise ValueError(f"{path}: {met} records, {count} expected")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return manifest.select("path", "records").repartition(max(1, min(files, READERS))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _scheme(spark) -> str:
    """What stands before the paths of the shared folder: scheme and host, nothing for local paths."""
    found = shared_dir(spark)
    if "://" not in found:
        return ""
    scheme, rest = found.split("://", 1)
    return f"{scheme}://" if scheme == "file" else f"{scheme}://{rest.split('/', 1)[0]}"
