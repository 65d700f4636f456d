"""Audio stored as WAV: written and read by the wave module, with spectral-peak pair fingerprints.

Payloads are 8-bit mono samples.  A short-time Fourier transform over Hann windows gives each frame's strongest local
peaks; each peak is paired with the peaks of the next frames, and a pair (frequency, frequency, frames between) is kept
with the time at which it begins.  Silence has no peaks, so its fingerprint is empty.

Null and empty texts give one padding unit.  Work is row-local, memory is bounded by one batch of payloads and one stretch of
frames; texts of any length are taken whole.  Repeated rows get equal values, an empty table gives none, other columns take no part.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrane.llm.common import as_bytes, two, written

UNIT, RATE, BATCH = 576, 8000, 1 << 24
WINDOW, HOP, PEAKS, AHEAD, STRETCH = 576, 288, 3, 3, 2048
_HANN = np.hanning(WINDOW).astype(np.float32)


def payload(text: bytes) -> bytes:
    """The bytes, followed by bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(-(-len(text) // UNIT), 1) * UNIT - len(text))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """(frame, frequency bin) of each frame's PEAKS strongest local maxima, by frame, then strength; ties: lower bin first."""
    x = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP] if x.size >= WINDOW else np.zeros((0, WINDOW), np.uint8)
    found = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(frames), STRETCH):
        power = np.rint(np.abs(np.fft.rfft((frames[at : at + STRETCH].astype(np.float64) - 128) * _HANN)) * 16).astype(np.int64)
        middle = power[:, 1:-1]
        strength = np.where((middle > power[:, :-2]) & (middle >= power[:, 2:]), middle, 0)
        best = np.argsort(-strength, axis=1, kind="stable")[:, :PEAKS]
        row = np.repeat(np.arange(len(best)), PEAKS)
        keep = strength[row, best.ravel()] > 0
        found.append(np.column_stack([row + at, best.ravel() + 1])[keep])
    return np.concatenate(found)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): code = first bin << 20 | second bin << 8 | frames between; in order of time."""
    p = peaks(samples)
    times, codes = [], []
    for step in range(1, PEAKS * (AHEAD + 1)):
        a, b = p[:-step], p[step:]
        gap = b[:, 0] - a[:, 0]
        ok = (gap >= 1) & (gap <= AHEAD)
        times.append(a[ok, 0])
        codes.append((a[ok, 1] << 20) | (b[ok, 1] << 8) | gap[ok])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def _mapped(df: DataFrame, of, schema: pa.Schema, spark_schema: str) -> DataFrame:
    """of(bytes) of each row's second column, between the row's id and its n_bytes.

    Batches end at BATCH bytes of what was read, so long texts don't add up.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, data, n in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows.append((doc, *of(data), n))
                held += len(data)
                if held >= BATCH:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return df.mapInArrow(run, spark_schema)


_ID, _SIZE = pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64())
_MEDIA = pa.schema([_ID, ("media", pa.binary()), _SIZE])
_ARRAYS = pa.schema([_ID, ("media", pa.binary()), ("times", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), _SIZE])
_DIGEST = pa.schema([_ID, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), _SIZE])


def _arrays(media: bytes) -> tuple:
    return media, *fingerprint(from_wav(media))


def _digests(media: bytes) -> tuple:
    back = from_wav(media)
    t, c = fingerprint(back)
    sha = hashlib.sha256(t.astype("<i8").tobytes() + c.astype("<i8").tobytes()).hexdigest()
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{c.size}:{sha}"


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, media (WAV), times, codes; with digest: the columns that op8 returns.

    The media column is a table in the shared folder; everything else is computed from its bytes as they are read back.
    """
    texts = two(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    stored = written(_mapped(texts, lambda text: (to_wav(payload(text)),), _MEDIA, "doc_id long, media binary, n_bytes long"), "media", "zstd")
    if not digest:
        return _mapped(stored, _arrays, _ARRAYS, "doc_id long, media binary, times array<long>, codes array<long>, n_bytes long").drop("n_bytes")
    found = _mapped(stored, _digests, _DIGEST, "doc_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_bytes long")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
