r"""Telephony audio in media columns: G.711 mu-law and A-law, IMA ADPCM, in WAVE containers.

Companded samples are expanded by tables of 256 entries; ADPCM is decoded sample by sample in numpy, all
blocks of a group of files at once; PCM is resampled by linear interpolation. Media stay binary columns, and
nothing is shuffled. Files are worked on in groups of bounded bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats: WAVE format tags, index moves of IMA ADPCM.
FORMAT_PCM, FORMAT_ALAW, FORMAT_MULAW, FORMAT_IMA = 0x0001, 0x0006, 0x0007, 0x0011
CODECS = {"pcm": FORMAT_PCM, "alaw": FORMAT_ALAW, "mulaw": FORMAT_MULAW, "ima": FORMAT_IMA}
IMA_INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
IMA_STEPS = 89
RATE = 8000
PAYLOAD_UNIT = 64
#: Bytes of an ADPCM block: a header of 4 and two samples in each other byte.
IMA_BLOCK = 256
#: Files are decoded together until they have so many bytes.
GROUP_BYTES = 1 << 22


def mulaw_table() -> np.ndarray:
    """The 14-bit value, scaled to 16 bits, of each mu-law byte."""
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 13-bit value, scaled to 16 bits, of each A-law byte."""
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


# The step sizes of IMA ADPCM.
_IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
)
MULAW, ALAW = mulaw_table(), alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x samples, int16) of IMA ADPCM blocks (blocks x bytes, uint8), mono, low half of a byte first."""
    head = blocks[:, :2].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) + 0x8000 & 0xFFFF) - 0x8000
    index = np.minimum(blocks[:, 2].astype(np.int64), IMA_STEPS - 1)
    codes = np.stack([blocks[:, 4:] & 0x0F, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code = codes[:, k].astype(np.int64)
        step = _IMA_STEPS[index]
        move = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_INDEX_MOVE[code & 7], 0, IMA_STEPS - 1)
        out[:, k + 1] = value
    return out


def pack(payload: bytes, codec: str = "mulaw", rate: int = RATE, block: int = IMA_BLOCK) -> bytes:
    """A mono WAVE file around samples that are coded already."""
    tag = CODECS[codec]
    if tag == FORMAT_IMA:
        per_block = (block - 4) * 2 + 1
        shape = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per_block, block, 4, 2, per_block)
        n = len(payload) // block * per_block
    else:
        width = 2 if tag == FORMAT_PCM else 1
        shape = struct.pack("<HHIIHH", tag, 1, rate, rate * width, width, 8 * width) + (b"" if tag == FORMAT_PCM else b"\0\0")
        n = len(payload) // width
    fact = b"" if tag == FORMAT_PCM else struct.pack("<4sII", b"fact", 4, n)
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(shape)) + shape + fact + struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unpack(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a WAVE file; ValueError if it is none, lacks a part or has one cut short."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, shape, data = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        chunk = media[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(chunk) < max(size, 16):
                raise ValueError("the format is cut short")
            shape = chunk
        elif name == b"data":
            if len(chunk) < size:
                raise ValueError("data is cut short")
            data = chunk
        at += 8 + size + size % 2
    if shape is None or data is None:
        raise ValueError("no format or no data")
    tag, channels, rate, _, block = struct.unpack_from("<HHIIH", shape)
    if channels != 1:
        raise ValueError("one channel is supported")
    if not rate:
        raise ValueError("the rate is zero")
    return tag, rate, block, data


def ima_parts(block: int, data: bytes) -> list[np.ndarray]:
    """The blocks of ADPCM data (blocks x bytes): the whole ones and, if there is one, a last short one."""
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // block * block
    parts = [raw[:whole].reshape(-1, block)] if whole else []
    return parts + ([raw[whole:].reshape(1, -1)] if whole < len(raw) else [])


def expand(tag: int, block: int, data: bytes) -> np.ndarray:
    """PCM samples (int16) of coded data.

    A last ADPCM block that is short is decoded as far as it goes; of one without a whole header, and of a last
    PCM sample's first half, nothing can be told, and they raise ValueError.
    """
    if tag == FORMAT_MULAW:
        return MULAW[np.frombuffer(data, np.uint8)]
    if tag == FORMAT_ALAW:
        return ALAW[np.frombuffer(data, np.uint8)]
    if tag == FORMAT_PCM:
        if len(data) % 2:
            raise ValueError("the last sample is cut short")
        return np.frombuffer(data, "<i2")
    if tag == FORMAT_IMA and block > 4:
        if 0 < len(data) % block < 4:
            raise ValueError("the last block has no whole header")
        return np.concatenate([np.zeros(0, np.int16), *(decode_ima(p).ravel() for p in ima_parts(block, data))])
    raise ValueError(f"format {tag:#x} isn't supported")


def expand_all(files: list[tuple[int, int, bytes]]) -> list[np.ndarray | ValueError]:
    """expand() of each (tag, block, data); whole ADPCM blocks of one size are decoded together."""
    out: list[np.ndarray | ValueError] = [np.zeros(0, np.int16)] * len(files)
    together: dict[int, list[int]] = {}
    for k, (tag, block, data) in enumerate(files):
        if tag == FORMAT_IMA and block > 4 and data and len(data) % block == 0:
            together.setdefault(block, []).append(k)
            continue
        try:
            out[k] = expand(tag, block, data)
        except ValueError as e:
            out[k] = e
    for block, ks in together.items():
        pcm = decode_ima(np.concatenate([ima_parts(block, files[k][2])[0] for k in ks]))
        at = 0
        for k in ks:
            n = len(files[k][2]) // block
            out[k] = pcm[at : at + n].ravel()
            at += n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, so that it is exact everywhere."""
    if rate == to or not len(pcm):
        return pcm
    n = -(-len(pcm) * to // rate)
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (to - part) + wide[right] * part) // to).astype(np.int16)


def describe(pcm: np.ndarray, rate: int) -> str:
    """Length in ms, peak, root mean square (rounded down), zero crossings and CRC of the samples."""
    if not len(pcm):
        return "ms=0;peak=0;rms=0;crossings=0;crc=0"
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    rms = int(np.sqrt(int(wide @ wide) // len(wide)))
    return f"ms={len(wide) * 1000 // rate};peak={int(np.abs(wide).max())};rms={rms};crossings={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def _decoded(media: pa.Array, to: int) -> Iterator[tuple[bytes | None, bytes | None, np.ndarray | None, str | None]]:
    """(file, data, PCM at rate ``to``, error) of each file; nulls for a null file, an error for one that can't be read."""

    def group(files: list[bytes | None]) -> Iterator[tuple]:
        read: list[tuple | ValueError | None] = []
        for x in files:
            try:
                read.append(unpack(x) if x is not None else None)
            except ValueError as e:
                read.append(e)
        good = [r for r in read if isinstance(r, tuple)]
        samples = iter(expand_all([(tag, block, data) for tag, _, block, data in good]))
        for x, r in zip(files, read, strict=True):
            pcm = next(samples) if isinstance(r, tuple) else r
            if isinstance(pcm, np.ndarray):
                yield x, r[3], resample(pcm, r[1], to).astype("<i2"), None
            else:
                yield x, None, None, None if pcm is None else str(pcm)

    held, size = [], 0
    for x in media:
        held.append(x.as_buffer().to_pybytes() if x.is_valid else None)
        size += len(held[-1] or b"")
        if size >= GROUP_BYTES:
            yield from group(held)
            held, size = [], 0
    yield from group(held)


def decode_media(df: DataFrame, media: str = "media", to: int = 16000) -> DataFrame:
    """df with ``pcm`` (binary, 16-bit samples at rate ``to``), ``feature`` and ``error`` for its WAVE column.

    A null file has null results; one that can't be read has its reason in error. Columns of df so named are
    replaced; repeated rows get equal values; an empty table gives an empty result.
    """
    own = df.drop("pcm", "feature", "error")
    schema = T.StructType([*own.schema.fields, *(T.StructField(n, t()) for n, t in (("pcm", T.BinaryType), ("feature", T.StringType), ("error", T.StringType)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, None, error) if pcm is None else (pcm.tobytes(), describe(pcm, to), None) for _, _, pcm, error in _decoded(batch.column(media), to)]
            more = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "pcm", "feature", "error"])

    return own.mapInArrow(run, schema)


#: The codecs that texts are stored by, each a third of them by checksum.
TEXT_CODECS = ("mulaw", "alaw", "ima")


def store_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as the samples of a mu-law, A-law or ADPCM file.

    The coded samples are the text's UTF-8 bytes and zeros up to a positive multiple of PAYLOAD_UNIT, which is
    an ADPCM block; a null text counts as empty. The codec follows from the payload's checksum, so repeated
    rows and equal texts get equal files. A null id stays null; an empty table gives an empty result; other
    columns are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for x in batch.column("text").cast(pa.large_binary()).fill_null(b""):
                raw = x.as_buffer().to_pybytes()
                sizes.append(len(raw))
                payload = raw + bytes(max(PAYLOAD_UNIT, -(-len(raw) // PAYLOAD_UNIT) * PAYLOAD_UNIT) - len(raw))
                files.append(pack(payload, TEXT_CODECS[zlib.crc32(payload) % len(TEXT_CODECS)], block=PAYLOAD_UNIT))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def digest_media(stored: DataFrame, to: int = 16000) -> DataFrame:
    """Digests of stored files, from the bytes that are read back out of them, and of the PCM that decode_media() stores.

    A null file has null digests. One that can't be read has its own length and digest, no payload and no PCM,
    and its reason as the feature. Repeated rows get equal values, an empty table gives an empty result, and
    columns other than doc_id, n_bytes and media are passed over.
    """
    schema = (
        stored.select("doc_id").schema.add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long")
        .add("media_bytes", "long").add("media_sha256", "string").add("feature", "string").add("pcm_bytes", "long").add("pcm_sha256", "string")
    )
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def digest(media: bytes | None, data: bytes | None, pcm: np.ndarray | None, error: str | None) -> tuple:
        own = (None, None) if media is None else (len(media), sha256(media).hexdigest())
        if data is None or pcm is None:
            return (None, None, None, *own, error and f"error={error}", None, None)
        samples = pcm.tobytes()
        payload = (len(data), sha256(data).hexdigest(), zlib.crc32(data[-PAYLOAD_UNIT:]))
        return (*payload, *own, describe(pcm, to), len(samples), sha256(samples).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(*found) for found in _decoded(batch.column("media"), to)]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], names=schema.names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
