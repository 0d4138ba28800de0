"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

Media are RIFF WAVE bytes. Any bytes are codes of the 8-bit forms, and any whole blocks are codes of ADPCM, so texts are
stored losslessly in all three. The decoder gives back the codes as stored, and 16-bit PCM resampled to one rate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_batches, new_path

#: WAVE format tags.
PCM, A_LAW, MU_LAW, ADPCM = 1, 6, 7, 17
#: Bytes of a unit: what texts are filled up to, and a block of ADPCM, which holds SAMPLES samples.
UNIT, RATE, TARGET_RATE = 64, 8000, 16000
SAMPLES = 2 * (UNIT - 4) + 1
#: Formats among which the CRC-32 of the bytes deals texts.
FORMATS = (MU_LAW, A_LAW, ADPCM)
#: Fixed values of IMA ADPCM: changes of the step index for the low three bits of a code, and the steps.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
_STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
STEPS = len(_STEP)


def mu_law_table() -> np.ndarray:
    """16-bit PCM of each mu-law code: inverted bits, sign, three bits of exponent, four of mantissa, bias 33."""
    code = ~np.arange(256) & 0xFF
    value = ((((code & 0x0F) << 1) + 33) << (code >> 4 & 7)) - 33
    return (np.where(code & 0x80, -value, value) * 4).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit PCM of each A-law code: every other bit inverted, sign set for positive, three bits of exponent, four of mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, value = code >> 4 & 7, ((code & 0x0F) << 1) + 1
    value = np.where(exponent > 0, (value + 32) << np.maximum(exponent - 1, 0), value)
    return (np.where(code & 0x80, value, -value) * 8).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def wave(data: bytes, tag: int, rate: int = RATE, block: int = 1, samples: int = 1) -> bytes:
    """A mono WAVE file; ``block`` bytes hold ``samples`` samples."""
    bits = {PCM: 16, A_LAW: 8, MU_LAW: 8, ADPCM: 4}[tag]
    extra = b"" if tag == PCM else struct.pack("<H", 0) if tag != ADPCM else struct.pack("<HH", 2, samples)
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * block // samples, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Stored:
    """A WAVE file's format, rate, block size and codes."""

    tag: int
    rate: int
    block: int
    codes: bytes


def read_wave(media: bytes) -> Stored:
    """Reads chunks until the data; raises ValueError for what is no mono WAVE of a known format or is cut short."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at:at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("chunk is cut short")
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[1] != 1 or form[2] < 1 or (form[0] not in (PCM, *FORMATS)) or (form[0] == ADPCM and form[4] < 5):
                raise ValueError("no mono format that is known before the data")
            return Stored(form[0], form[2], form[4], media[at + 8:at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data")


def decoded_all(stored: list[Stored]) -> list[np.ndarray]:
    """PCM of each; the ADPCM blocks of all files with one block size are decoded side by side."""
    out: list[np.ndarray | None] = [None if s.tag == ADPCM else decoded(s.codes, s.tag) for s in stored]
    for block in {s.block for s in stored if s.tag == ADPCM}:
        at = [i for i, s in enumerate(stored) if s.tag == ADPCM and s.block == block]
        whole = [len(stored[i].codes) // block for i in at]
        pcm = adpcm_decoded(b"".join(stored[i].codes[: n * block] for i, n in zip(at, whole)), block)
        for i, part in zip(at, np.split(pcm, np.cumsum(whole)[:-1] * (2 * (block - 4) + 1))):
            out[i] = part
    return out


def decoded(codes: bytes, tag: int, block: int = 1) -> np.ndarray:
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(codes, np.uint8)]
    if tag == PCM:
        return np.frombuffer(codes, "<i2").astype(np.int16)
    if tag == ADPCM:
        return adpcm_decoded(codes, block)
    raise ValueError(f"format {tag} is not known")


def adpcm_decoded(codes: bytes, block: int) -> np.ndarray:
    """All whole blocks at once: a step of the loop decodes one sample of every block."""
    n = len(codes) // block
    raw = np.frombuffer(codes, np.uint8)[: n * block].reshape(n, block)
    if not n:
        return np.empty(0, np.int16)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.clip(raw[:, 2].astype(np.int64), 0, STEPS - 1)
    nibbles = np.empty((n, 2 * (block - 4)), np.int64)
    nibbles[:, ::2], nibbles[:, 1::2] = raw[:, 4:] & 15, raw[:, 4:] >> 4
    out = np.empty((n, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], _STEP[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, STEPS - 1)
        out[:, k + 1] = value
    return out.ravel()


def adpcm_encoded(pcm: np.ndarray, block: int = 256) -> bytes:
    """Blocks of 2 * (block - 4) + 1 samples, all at once; the last block is filled with its last sample."""
    per = 2 * (block - 4) + 1
    n = max(1, -(-len(pcm) // per))
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1] if len(pcm) else 0)]).astype(np.int64).reshape(n, per)
    value, index = x[:, 0].copy(), np.zeros(n, np.int64)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    codes = np.empty((n, per - 1), np.uint8)
    for k in range(per - 1):
        step, gap = _STEP[index], x[:, k + 1] - value
        left, code = np.abs(gap), np.zeros(n, np.int64)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = left >= part
            code |= np.where(on, bit, 0)
            left = left - np.where(on, part, 0)
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(gap < 0, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, STEPS - 1)
        codes[:, k] = code | np.where(gap < 0, 8, 0)
    out[:, 4:] = codes[:, ::2] | codes[:, 1::2] << 4
    return out.tobytes()


def resampled(pcm: np.ndarray, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation in integers (halves go up), the last sample held: the same on every machine."""
    if not len(pcm) or rate == target:
        return pcm.astype(np.int16)
    x = np.concatenate([pcm, pcm[-1:]]).astype(np.int64)
    at, part = np.divmod(np.arange(len(pcm) * target // rate, dtype=np.int64) * rate, target)
    return ((x[at] * (target - part) + x[at + 1] * part + target // 2) // target).astype(np.int16)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\0" * ((-len(raw)) % UNIT if raw else UNIT)


def stored_text(text: str | None, tag: int | None = None) -> bytes:
    """A text's filled-up bytes as a WAVE file of the format, or of the one that their CRC-32 picks."""
    raw = padded(text)
    tag = FORMATS[zlib.crc32(raw) % len(FORMATS)] if tag is None else tag
    return wave(raw, tag, RATE, UNIT, SAMPLES) if tag == ADPCM else wave(raw, tag)


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: int | None = None) -> DataFrame:
    """doc_id, n_bytes, media: each row's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as codes of a WAVE file.

    A null text is empty (64 zeros); a text of any length is one file. Equal texts give equal files, so repeated rows
    give equal rows; an empty table gives an empty result. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array([stored_text(t, tag) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, n_bytes long, media binary")


def feature(pcm: np.ndarray) -> str:
    """Samples, mean absolute amplitude in 1/1000, sign changes and the CRC-32 of PCM."""
    wide = pcm.astype(np.int64)
    loud = int(np.abs(wide).sum() * 1000 // max(len(pcm), 1))
    turns = int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())
    return f"{len(pcm)};{loud};{turns};{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def decoded_media(media: DataFrame, target_rate: int = TARGET_RATE) -> DataFrame:
    """``media`` (a binary column of that name) with codes, pcm (16-bit little-endian, resampled), and its feature.

    Null or broken media give nulls. Repeated rows give equal rows, an empty table an empty result. Extra columns are
    kept unless they have these names.
    """
    arrow_batches(media.sparkSession)
    keep = [c for c in media.columns if c not in ("codes", "pcm", "feature")]
    media = media.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index("media")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, stored = [], []
            for i, raw in enumerate(batch.column(at)):
                try:
                    stored.append(read_wave(raw.as_py() or b""))
                    good.append(i)
                except (ValueError, struct.error):
                    continue
            columns = [[None] * batch.num_rows for _ in range(3)]
            for i, own, pcm in zip(good, stored, decoded_all(stored)):
                pcm = resampled(pcm, own.rate, target_rate)
                columns[0][i], columns[1][i], columns[2][i] = own.codes, pcm.astype("<i2").tobytes(), feature(pcm)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.string()))]], [*keep, "codes", "pcm", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + ", codes binary, pcm binary, feature string"
    return media.mapInArrow(read, schema)


def store_pcm(decoded: DataFrame, path: str | None = None, target_rate: int = TARGET_RATE) -> DataFrame:
    """Writes decoded media as a Parquet table of resampled PCM in WAVE form (column ``wave``) and reads it from there.

    The other columns of ``decoded`` come along, without codes and media; null PCM stays null. The table goes to the
    shared folder unless a path is given.
    """
    path = path or new_path(decoded.sparkSession, "pcm")
    size = F.octet_length("pcm")
    digits = F.lpad(F.hex("__size"), 8, "0"), F.lpad(F.hex("__whole"), 8, "0")
    size4, whole4 = (F.unhex(F.concat(*[F.substring(d, k, 2) for k in (7, 5, 3, 1)])) for d in digits)
    head = wave(b"", PCM, target_rate, 2, 1)
    sized = decoded.withColumn("__size", size.cast("long")).withColumn("__whole", (size + len(head) - 8).cast("long"))
    made = F.concat(F.lit(head[:4]), whole4, F.lit(head[8:-4]), size4, F.col("pcm"))
    sized.withColumn("wave", made).drop("codes", "media", "pcm", "__size", "__whole").write.parquet(path)
    return decoded.sparkSession.read.parquet(path)
