"""Media columns: payloads kept losslessly as WAV, read back by the wave module, and spectral-peak pair fingerprints.

A short-time Fourier transform (Hann window) gives magnitude frames; the strongest bin of each of a few bands is a peak
if it stands out in its frame; each peak is paired with peaks of the following frames, and a pair is stored as
hash = (frequency bin, other bin, frames between) with the time code of its first frame.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Payload unit, sample rate, window and hop of the transform.
UNIT, RATE, WINDOW, HOP = 576, 8000, 512, 288
#: Frequency bands (bin edges): one peak in each at most. Frames ahead that a peak is paired with.
BANDS = (2, 10, 20, 40, 80, 160, 257)
AHEAD = 3
#: A peak is this many times the mean magnitude of its frame at least.
PROMINENCE = 2.0
#: Frames that are transformed together.
BLOCK = 4096


def pad(data: bytes) -> bytes:
    """`data` with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks, in order of frame, then bin."""
    x = samples.astype(np.float32) - 128.0
    # silence up to a whole last frame, so that every sample lies in a frame
    x = np.concatenate([x, np.zeros(max(WINDOW - len(x), -(len(x) - WINDOW) % HOP), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    window = np.hanning(WINDOW).astype(np.float32)
    at, bins = [], []
    for lo in range(0, len(frames), BLOCK):
        magnitude = np.abs(np.fft.rfft(frames[lo : lo + BLOCK] * window, axis=1))
        floor = PROMINENCE * magnitude[:, BANDS[0] :].mean(axis=1)
        rows = np.arange(len(magnitude))
        best = np.stack([a + magnitude[:, a:b].argmax(axis=1) for a, b in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        stands = magnitude[rows[:, None], best] > floor[:, None]
        f, band = np.nonzero(stands)
        at.append(lo + f)
        bins.append(best[f, band])
    return np.concatenate(at), np.concatenate(bins)


def pair_fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time codes, hashes) of all peak pairs, in order of time, then hash."""
    at, bins = peaks(samples)
    n = len(at)
    stop = np.searchsorted(at, at + AHEAD, side="right")
    start = np.searchsorted(at, at, side="right")
    counts = stop - start
    first = np.repeat(np.arange(n), counts)
    other = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)
    hashes = (bins[first] << 13) | (bins[other] << 4) | (at[other] - at[first])
    order = np.lexsort((hashes, at[first]))
    return at[first][order].astype(np.int32), hashes[order].astype(np.int32)


def media_columns(docs: DataFrame, rid: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """(rid, n_bytes, media, times, hashes, and digests of what is read back) of every row's whole UTF-8 text.

    A null text is empty and has a payload of one unit. The fingerprint arrays are time-coded: times[i] is the frame of
    the pair hashes[i]; they are empty where no peak stands out. Repeated rows and null ids are kept, equal texts have
    equal values, and no rows give no rows. keep_media=False leaves out the WAV bytes, for callers that need only the
    digests and the fingerprints.
    """
    small_batches(docs.sparkSession)
    extra = [("times", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int32())), *([("media", pa.binary())] if keep_media else [])]
    names = ["rid", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pairs", "feature_sha256", *[k for k, _ in extra]]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[t for _, t in extra]]

    def row(text: str | None) -> tuple:
        data = (text or "").encode()
        media = to_wav(pad(data))
        payload = from_wav(media)
        times, hashes = pair_fingerprints(np.frombuffer(payload, np.uint8))
        feature = hashlib.sha256(times.astype("<i4").tobytes() + hashes.astype("<i4").tobytes()).hexdigest()
        digests = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(times), feature)
        return (*digests, times, hashes, *([media] if keep_media else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(row, batch.column(1).to_pylist()), strict=True)) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types[1:], strict=True)]], names)

    schema = "rid bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_pairs bigint, feature_sha256 string"
    schema += ", times array<int>, hashes array<int>" + (", media binary" if keep_media else "")
    return docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text")).mapInArrow(run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digests = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    feature = F.concat_ws(":", F.col("n_pairs").cast("string"), "feature_sha256").alias("feature")
    return media_columns(docs, keep_media=False).select(F.col("rid").alias("doc_id"), *digests, feature, "times", "hashes")
