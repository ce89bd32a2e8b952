"""Best-fit packing of token sequences with a bounded number of open bins.

Texts become token ids where they are read; only the lengths travel on. Pieces are dealt to packing tasks by a hash of
their document, each task packs its own in the order of another hash: every piece goes to the open bin with the least
free space that still holds it. A bitset keyed by free space (bit f is set if an open bin has f tokens free) finds that
bin with one shift and one lowest-bit operation. If no open bin holds the piece, a new one opens; if all `open_bins` are
taken, the fullest closes first.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pattern that splits text before the merges of the vocabulary. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Token ids end with this one, once per document.
END = 0


@cache
def encoder(path: str):
    """text -> ids for a tokenizer file: rank files (.tiktoken) by tiktoken, others by tokenizers.

    The added tokens of the tokenizer file (for a rank file, of the .json beside it) have their own ids wherever they stand.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        added = {}
        if (beside := Path(path).with_suffix(".json")).exists():
            added = {t["content"]: t["id"] for t in json.loads(beside.read_text(encoding="utf-8"))["added_tokens"]}
        whole = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: whole.encode(text, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if it fits, else full ones behind a shorter first."""
    head = n % capacity if n > capacity else n
    cuts = ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]
    return cuts


class BestFit:
    """Online best-fit over at most `open_bins` bins of `capacity`."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.n_open = 0
        self.next_bin = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `length`, 1 to capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open == self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, at = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - length
        if left:  # a full bin closes at once
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.n_open += 1
        return at, self.capacity - free


def tokenize(docs: DataFrame, vocabulary: str, capacity: int, rid: str, text: str, with_ids: bool) -> DataFrame:
    """(rid, piece, start, length, ids_crc32, ids) of every row's pieces; a null text is empty and has the end token alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rids, rows = [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(encode(t or "") + [END], dtype="<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[start : start + length]
                    rids.append(r)
                    rows.append((piece, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64()), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]], pa.array(columns[4], pa.list_(pa.int32()))],
                ["rid", "piece", "start", "length", "ids_crc32", "ids"],
            )

    schema = "rid bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"
    return docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 1024, lookahead: int = 2000, tasks: int | None = None) -> DataFrame:
    """`pieces` (rid, piece, start, length, ...) with sequence_id and offset.

    Pieces arrive in hash order; among each `lookahead` that arrive together the longest goes first. Every row keeps a
    place; the offsets in a sequence are gapless from 0 and end at `capacity` or before. Repeated rows and ties are packed
    each by itself; no rows give no rows; further columns, whatever their names, are carried along. The order in a task depends on the rows alone, so a task that runs again packs alike, and
    sequence ids carry the task's number in their high bits. More tasks cost at most a few unfilled bins each.
    """
    spark = pieces.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    mark = next(f"task{'_' * i}" for i in range(len(names) + 1) if f"task{'_' * i}" not in names)
    plain = [F.col(f"`{c}`") for c in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*plain).schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for waiting in gathered(batches, lookahead):
            task = waiting.column(mark)[0].as_py()
            lengths = waiting.column("length").to_numpy()
            waiting = waiting.take(pa.array(np.argsort(-lengths, kind="stable")))
            placed = [bins.put(x) for x in waiting.column("length").to_pylist()]
            own = [waiting.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array([(task << 40) + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"])

    dealt = pieces.select(*plain, F.pmod(F.xxhash64(F.lit(11), "rid", "piece"), F.lit(n)).cast("int").alias(mark))
    # by hash, not by range: the sampling of a range exchange would tokenize everything once more
    ranged = dealt.repartition(n, mark).sortWithinPartitions(mark, F.xxhash64("rid", "piece"), "rid", "piece", "start", "length")
    return split_by_task(ranged, run, schema, mark)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of `rows` rows or a little more; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def split_by_task(dealt: DataFrame, run, schema: str, mark: str) -> DataFrame:
    """Run `run` once for each value of the column `mark`: a partition may hold several, in order."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                tasks = batch.column(mark).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if b > a:
                        yield int(tasks[a]), batch.slice(a, b - a)

        source = parts()
        ahead = next(source, None)
        while ahead is not None:
            task = ahead[0]

            def of_task() -> Iterator[pa.RecordBatch]:
                nonlocal ahead
                while ahead is not None and ahead[0] == task:  # noqa: B023
                    yield ahead[1]
                    ahead = next(source, None)

            yield from run(of_task())

    return dealt.mapInArrow(runs, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, open_bins: int = 1024, rid: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every row of `docs` with their places; with_ids adds the token ids themselves. Null and empty texts are a
    piece of the end token; long texts are tokenized whole; repeated rows have pieces of their own; no rows give no rows."""
    pieces = tokenize(docs, vocabulary, capacity, rid, text, with_ids)
    return pack(pieces if with_ids else pieces.drop("ids"), capacity, open_bins)


def fast_vocabulary() -> str:
    """The rank file of byte_bpe_50k: the same vocabulary and ids as its .json (see tests), several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest_columns(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("rid").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_columns(pack_documents(docs, fast_vocabulary()))
