"""Telephony audio columns: G.711 and ADPCM payloads in WAV containers, kept as they are and decoded to PCM.

``store_payload`` writes bytes as 8-bit mu-law or A-law samples, or as blocks of 4-bit ADPCM
samples, into a WAV file: nothing is recoded, so the payload can be read back bit by bit.
``decode_media`` expands G.711 by lookup tables and decodes ADPCM with numpy across the blocks
of all rows of a batch at once; ``resample`` brings PCM to another rate, to be stored as a column.

Cases: null or empty payloads become one padding unit of zero bytes; rows that repeat give
repeated rows; bytes that no encoder would write (a step index out of range) are decoded as
the nearest valid ones; a table without rows gives no rows; further columns are kept or
dropped by name and never mixed up with those that are made.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

#: Bytes to which a payload is padded; also the length of an ADPCM block.
UNIT = 64
RATE, STORED_RATE = 8000, 16000
#: WAV format tags.
ALAW, MULAW, ADPCM = 6, 7, 17
CODECS = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
#: Samples of an ADPCM block: one in its header, two in each other byte.
BLOCK_SAMPLES = 1 + 2 * (UNIT - 4)

# Fixed values of the IMA ADPCM format: changes of the step index by the low three bits of a code.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _steps() -> np.ndarray:
    """The 89 step sizes: each about a tenth above the one before, from 7 to 32767."""
    # Fixed values of the IMA ADPCM format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
        190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
        18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


_STEP = _steps()


def _mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, three bits of exponent, four of mantissa, bias 33 at 14 bits."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted; a set sign bit means positive."""
    code = np.arange(256) ^ 0x55
    part, fraction = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, fraction + 8, fraction + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, UNIT) bytes -> (blocks, BLOCK_SAMPLES) 16-bit samples: all blocks go forward one sample at a time."""
    n = len(blocks)
    out = np.empty((BLOCK_SAMPLES, n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(_STEP) - 1)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK_SAMPLES - 1):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        step, low = _STEP[index], (code & 7).astype(np.int32)
        change = step >> 3
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            change += np.where(low & bit, step >> shift, 0)
        value += np.where(code & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += _INDEX[low]
        np.clip(index, 0, len(_STEP) - 1, out=index)
        out[k + 1] = value
    return out.T


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def codec_for(payload: bytes) -> int:
    """Which of the three codecs a payload without one of its own is given: by its checksum, so equal ones agree."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def wav(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono WAV file around the payload."""
    if codec == ADPCM:
        head = struct.pack("<HHIIHHHH", codec, 1, rate, rate * UNIT // BLOCK_SAMPLES, UNIT, 4, 2, BLOCK_SAMPLES)
        samples = len(payload) // UNIT * BLOCK_SAMPLES
    else:
        head, samples = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), len(payload)
    chunks = b"".join(k + struct.pack("<I", len(c)) + c + b"\0" * (len(c) & 1) for k, c in ((b"fmt ", head), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wav(media: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, payload) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(parts: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM of each (codec, payload); the ADPCM blocks of all parts are decoded together."""
    out: list[np.ndarray] = [EXPAND[c][np.frombuffer(p, np.uint8)] if c in EXPAND else np.zeros(0, np.int16) for c, p in parts]
    coded = [i for i, (c, _) in enumerate(parts) if c == ADPCM]
    if coded:
        blocks = np.frombuffer(b"".join(parts[i][1] for i in coded), np.uint8).reshape(-1, UNIT)
        pcm, at = decode_adpcm(blocks), 0
        for i in coded:
            n = len(parts[i][1]) // UNIT
            out[i] = pcm[at : at + n].ravel()
            at += n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers: the same samples on every machine. The last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(-(-len(pcm) * to // rate), dtype=np.int64) * rate
    left, part = at // to, at % to
    x = pcm.astype(np.int64)
    right = x[np.minimum(left + 1, len(x) - 1)]
    return ((x[left] * (to - part) + right * part + to // 2) // to).astype(np.int16)


def feature(codec: int, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square, sign changes and a checksum of the samples, all in whole numbers."""
    x = pcm.astype(np.int64)
    n = max(1, len(x))
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    peak = int(np.abs(x).max(initial=0))
    return f"{CODECS[codec]};n={len(x)};peak={peak};ms={int((x * x).sum()) // n};zc={changes};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def _rows(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in W.slices(batch, column):
        data, at = W.utf8(b.column(column))
        raw = data.tobytes()
        yield b, [raw[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def store_payload(rows: DataFrame, column: str = "text", key: str = "doc_id", codec: int | None = None, rate: int = STORED_RATE) -> DataFrame:
    """The key, n_bytes (of the payload before padding), media (the WAV file that holds it), codec, rate and pcm: what the file
    decodes to, as 16-bit little-endian samples at the stored rate."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw in _rows(batch, "payload"):
                full = [padded(x) for x in raw]
                media = [wav(x, codec or codec_for(x)) for x in full]
                codecs, pcm = _stored(media, rate)
                made = [pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary()), codecs, pa.array([rate] * len(raw), pa.int32()), pcm]
                yield pa.RecordBatch.from_arrays([b.column("id"), *made], names=[key, "n_bytes", "media", "codec", "rate", "pcm"])

    return rows.selectExpr(f"`{key}` AS id", f"`{column}` AS payload").mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary, codec string, rate int, pcm binary")


def _stored(media: list[bytes], rate: int) -> tuple[pa.Array, pa.Array]:
    """Codec, and PCM at the stored rate, of each file."""
    parts = [parse_wav(x) for x in media]
    pcm = [resample(x, r, rate).astype("<i2").tobytes() for x, (_, r, _) in zip(decode([(c, p) for c, _, p in parts]), parts, strict=True)]
    return pa.array([CODECS[c] for c, _, _ in parts], pa.string()), pa.array(pcm, pa.binary())


def decode_media(media: DataFrame, key: str = "doc_id", rate: int = STORED_RATE) -> DataFrame:
    """media(key, media) -> key, codec, rate, pcm: 16-bit little-endian samples at the stored rate."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw in _rows(batch, "media"):
                codecs, pcm = _stored(raw, rate)
                yield pa.RecordBatch.from_arrays([b.column("id"), codecs, pa.array([rate] * len(raw), pa.int32()), pcm], names=[key, "codec", "rate", "pcm"])

    return media.selectExpr(f"`{key}` AS id", "media").mapInArrow(run, f"`{key}` {kind}, codec string, rate int, pcm binary")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads what is stored back: sizes and hashes of payload and file, and a feature of the stored PCM."""
    kind = stored.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in DIGEST.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw in _rows(batch, "media"):
                out = []
                for x, samples in zip(raw, b.column("pcm"), strict=True):
                    codec, _, p = parse_wav(x)
                    pcm = np.frombuffer(samples.as_buffer(), "<i2")
                    out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), feature(codec, pcm)))
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *made], names=names)

    return stored.selectExpr(f"`{key}` AS id", "n_bytes", "media", "pcm").mapInArrow(run, f"`{key}` {kind}, {DIGEST}")
