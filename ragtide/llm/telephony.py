"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM blocks decoded with numpy across blocks, resampled PCM.

A payload is stored as a RIFF/WAVE file of 8-bit mu-law codes at 8 kHz, which keeps every byte; from the stored codes
come linear samples and PCM at twice the rate. A null payload counts as empty; an empty one is padded like any other,
so every row has media. Equal payloads give equal results; rows may repeat; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm._text import chunks, utf8

RATE, UNIT = 8000, 64
#: What a task handles at once: bytes of payload (or one payload) to be stored, rows to be read back.
CHUNK_BYTES, ROWS = 1 << 19, 256


def _mu_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, fine = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, fine + 8, (fine + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU_LAW, A_LAW = _mu_table(), _a_table()

_STEP = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
_code, _at = np.arange(16), np.arange(89)[:, None]
_size = (_STEP[:, None] >> 3) + np.where(_code & 4, _STEP[:, None], 0) + np.where(_code & 2, _STEP[:, None] >> 1, 0) + np.where(_code & 1, _STEP[:, None] >> 2, 0)
_MOVE = np.where(_code & 8, -_size, _size).astype(np.int32).ravel()
#: The next step's place in the tables, times 16.
_NEXT = (np.clip(_at + np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2), 0, 88) * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM of one channel. blocks: uint8 of shape (n, block bytes); gives int16 of shape (samples, n).

    A block's first sample and step stand in its 4 header bytes (a step beyond 88 counts as 88), then come two samples a
    byte, the low half first. All blocks advance together, a sample at a time."""
    data = np.ascontiguousarray(blocks.T)
    now = (data[0].astype(np.uint16) | data[1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
    step = np.minimum(data[2], 88).astype(np.int32) * 16
    out = np.empty((2 * (len(data) - 4) + 1, data.shape[1]), np.int16)
    out[0] = now
    at = 1
    for byte in data[4:]:
        for code in (byte & 15, byte >> 4):
            place = step + code
            now = np.clip(now + _MOVE[place], -32768, 32767)
            step = _NEXT[place]
            out[at] = now
            at += 1
    return out


#: A half-band low-pass: windowed sinc taps at the odd places, in 1/32768.
_TAPS = np.array([-340, 1410, -4370, 19684, 19684, -4370, 1410, -340], np.int32)


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """int16 at twice the rate: samples stay, and between two comes a weighted sum of eight; silence outside."""
    wide = np.zeros(len(pcm) + 7, np.int32)
    wide[3 : 3 + len(pcm)] = pcm
    mid = np.zeros(len(pcm), np.int32)
    for k, tap in enumerate(_TAPS.tolist()):
        mid += wide[k : k + len(pcm)] * tap
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((mid + 16384) >> 15, -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int, bits: int) -> bytes:
    """A one-channel WAVE file; tag 7: mu-law, 6: A-law, 1: PCM."""
    step = bits // 8
    form = struct.pack("<4sIHHIIHHH", b"fmt ", 18, tag, 1, rate, rate * step, step, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data) // step)
    body = b"WAVE" + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and sample bytes."""
    tag, rate, at = 0, 0, 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pad(payload: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return payload + b"\0" * (-len(payload) % UNIT if payload else UNIT)


def _crossings(samples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sign changes inside each stretch."""
    low = samples < 0
    turns = np.concatenate([[0], np.cumsum(low[1:] != low[:-1])])
    return turns[first[1:] - 1] - turns[first[:-1]]


def _features(parts: list[bytes]) -> list[str]:
    """Of mu-law payloads: peak, energy and sign changes of the samples; peak and energy as A-law and as ADPCM blocks."""
    codes = np.frombuffer(b"".join(parts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    out = []
    mu = MU_LAW[codes]
    mu_size, a_size = np.abs(MU_LAW.astype(np.int32))[codes], np.abs(A_LAW.astype(np.int32))[codes]
    turns = _crossings(mu, first)
    samples = decode_adpcm(codes.reshape(-1, UNIT)).astype(np.int32)
    block_first = first[:-1] // UNIT
    tops = np.maximum.reduceat(np.abs(samples).max(axis=0), block_first)
    power = np.add.reduceat(np.einsum("ij,ij->j", samples, samples, dtype=np.int64), block_first)
    top = [np.maximum.reduceat(x, first[:-1]) for x in (mu_size, a_size)]
    energy = [np.add.reduceat(x.astype(np.int64) ** 2, first[:-1]) for x in (mu_size, a_size)]
    for i in range(len(parts)):
        out.append(f"mu {top[0][i]} {energy[0][i]} {turns[i]};a {top[1][i]} {energy[1][i]};adpcm {tops[i]} {power[i]}")
    return out


def _store(texts: list[bytes]) -> pa.RecordBatch:
    media = [wav(pad(x), 7, RATE, 8) for x in texts]
    read = [read_wav(m)[2] for m in media]
    pcm = [wav(resample_double(MU_LAW[np.frombuffer(p, np.uint8)]).tobytes(), 1, 2 * RATE, 16) for p in read]
    return pa.RecordBatch.from_arrays(
        [pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary()), pa.array(_features(read))],
        ["n_bytes", "media", "pcm", "feature"],
    )


STORED = "n_bytes long, media binary, pcm binary, feature string"


def store_audio(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """id, n_bytes (unpadded), media (WAVE, mu-law at 8 kHz), pcm (WAVE, 16 bit at 16 kHz), feature."""

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks(texts, CHUNK_BYTES):
                rows = _store(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *rows.columns], ["id", *rows.schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), payload_col).mapInArrow(run, f"id {kind}, {STORED}")


def read_audio(stored: DataFrame) -> DataFrame:
    """Of rows of store_audio(): lengths, digests and checksums of the bytes read back from media and pcm."""

    def run(batches):
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            ids, n, media, pcm, feature = batch.columns
            media, pcm = media.to_pylist(), pcm.to_pylist()
            read = [read_wav(m)[2] for m in media]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, n,
                    pa.array([len(x) for x in read], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in read], pa.string()),
                    pa.array([zlib.crc32(x[-UNIT:]) for x in read], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                    feature,
                    pa.array([len(x) for x in pcm], pa.int64()),
                    pa.array([zlib.crc32(x) for x in pcm], pa.int64()),
                ],
                READ_NAMES,
            )

    kind = stored.schema["id"].dataType.simpleString()
    types = ["long", "long", "string", "long", "long", "string", "string", "long", "long"]
    return stored.mapInArrow(run, f"id {kind}, " + ", ".join(f"{a} {b}" for a, b in zip(READ_NAMES[1:], types)))


READ_NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_crc32"]
