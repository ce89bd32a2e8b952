"""Winnowed fingerprints of token arrays, and finding ids."""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens in a gram, grams in a window, and the fewest tokens that are fingerprinted.
GRAM, WINDOW, FLOOR = 10, 8, 50


def grams(tokens: Column, k: int = GRAM) -> Column:
    """A short hex digest of each run of k tokens."""
    return F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.substring(F.md5(F.array_join(F.slice(tokens, i, k), " ")), 1, 16))).otherwise(F.array().cast("array<string>"))


def winnow(hashes: Column, w: int = WINDOW) -> Column:
    """The sorted distinct minima of all windows of w grams; of all grams together where there are fewer."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(hashes, i, w)))
    return F.when(F.size(hashes) > 0, F.array_sort(F.array_distinct(windows))).otherwise(F.array().cast("array<string>"))


def text_minima(text: bytes | None, k: int = GRAM, w: int = WINDOW, floor: int = FLOOR) -> tuple[int, np.ndarray] | None:
    """The number of tokens and the winnowed fingerprints, as numbers; none if there are under `floor` tokens, k or more."""
    tokens = (text or b"").split()  # at [ \t-\r]
    if len(tokens) < floor:
        return None
    joined = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))  # of the token before, and the space after it
    hashes = np.frombuffer(b"".join(md5(joined[a : b - 1]).digest()[:8] for a, b in zip(ends, ends[k:])), ">u8").astype("u8")  # noqa: B905
    if len(hashes) > w:
        hashes = np.lib.stride_tricks.sliding_window_view(hashes, w).min(axis=1)
    else:
        hashes = hashes.min(keepdims=True)
    return len(tokens), np.unique(hashes)


def fingerprinted(rows: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """`kept` columns, n_tokens and fingerprints of the texts of FLOOR tokens and more: winnow(grams(tokens)), in one pass."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [text_minima(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(batch.num_columns - 1)]
                fit = [f for f in found if f]
                prints = np.concatenate([f[1] for f in fit]) if fit else np.zeros(0, "u8")
                hexed = pa.StringArray.from_buffers(len(prints), pa.py_buffer(np.arange(len(prints) + 1, dtype="i4") * 16), pa.py_buffer(hexlify(prints.astype(">u8").tobytes())))
                lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(len(f[1]) for f in fit)], pa.int32()), hexed)
                rest = batch.filter(pa.array([f is not None for f in found], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array([f[0] for f in fit], pa.int32()), lists], names=[*kept, "n_tokens", "fingerprints"])

    return rows.select(*kept, text).mapInArrow(run, f"{kinds}, n_tokens int, fingerprints array<string>")


def finding_id(*parts: Column) -> Column:
    """Twelve hex digits of a digest over the parts, each ended by a zero character; a null part counts as empty."""
    return F.substring(F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts]), 256), 1, 12)
