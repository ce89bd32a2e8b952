"""A bigram language model in Elias-Fano tries, trained and applied over a cluster.

Work goes by blocks of documents, vocabulary shards and context shards, each of bounded size:

1. Each block sends its distinct words' hashes, with their counts in training texts, to vocabulary shards, which add them
   up over all blocks and answer each block with the totals.
2. Each block turns its tokens into (context, word, text) entries and sends them to the shard of the context. A context is
   the word before; a very frequent one is split by the hash of the next word, with its exact share of probability.
3. Each context shard builds its part of the trie: context hashes, monotone pointers to each context's successors, and the
   successors, all as Elias-Fano sequences in memory-mapped files, with quantised probabilities. It scores every entry by a
   successor search relative to its context and sends the sums per text back to the blocks.

Probabilities are interpolated absolute discounting, p(w|v) = (c(vw) - D) / c(v) + D n(v) / c(v) p(w), with n(v) the
number of distinct words seen after v and D from the counts of counts. p(w) is the discounted unigram estimate, whose
reserved mass is shared by all seen and as many unseen words; an unseen word takes one such share.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import cut, small_batches

BLOCK_BYTES, BLOCK_TEXTS = 10 << 20, 60_000
#: Distinct words of one vocabulary shard (in all blocks together), and tokens of one context shard, as a target.
WORDS_PER_SHARD, TOKENS_PER_SHARD = 1_000_000, 2_000_000
#: A context with more training tokens than this is split, into at most 2 ** FINE_BITS parts.
SPLIT_ABOVE, FINE_BITS = 250_000, 12
FINE = 1 << FINE_BITS
#: Word hashes have 60 bits; a successor is kept by the upper 32 of them.
HASH_BITS, WORD_BITS = 60, 32
END, START = 1, 2
#: Unigram log-probabilities are sent as multiples of this.
UNIGRAM_STEP = 0.05


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - HASH_BITS)


def in_training(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def zip_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; multi-byte items are stored by byte planes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str}:{len(a)};".encode().ljust(32)
        parts += [head, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unzip_arrays(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = raw[at : at + 32].split(b";")[0].decode().split(":")
        kind, n, at = np.dtype(kind), int(n), at + 32
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += size
    return out


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block id, document ids, texts) by runs of rows; the id is a hash of what is in it."""
    ids, texts, size = [], [], 0

    def block() -> tuple[int, list, list[bytes]]:
        digest = xxhash.xxh64(seed=5)
        for i, t in zip(ids, texts, strict=True):
            digest.update(b"%d,%d;" % (-1 if i is None else i, len(t)))
            digest.update(t)
        return digest.intdigest() >> 1, ids, texts

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append((t or "").encode())
            size += len(texts[-1])
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                yield block()
                ids, texts, size = [], [], 0
    if ids:
        yield block()


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct word hashes with END, each token's index into them, each text's number of tokens, END included)."""
    words = [t.lower().split() for t in texts]
    index: dict[bytes, int] = {}
    place = index.setdefault
    flat = np.fromiter((place(w, len(index)) for w in chain.from_iterable(words)), dtype=np.int64)
    hashes = np.fromiter(chain(map(word_hash, index), [END]), dtype=np.uint64, count=len(index) + 1)
    known, back = np.unique(hashes, return_inverse=True)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.full(int(lengths.sum()), len(index), dtype=np.int64)
    inside = np.ones(len(tokens), dtype=bool)
    inside[ends] = False
    tokens[inside] = flat
    return known, back[tokens], lengths


class Unigram:
    """Totals of the training tokens, and what follows from them."""

    def __init__(self, tokens: int, types: int, once: int, twice: int, fine_tokens: np.ndarray, fine_types: np.ndarray) -> None:
        self.tokens, self.types = tokens, types
        self.discount = once / (once + 2 * twice) if once else 0.5
        n = max(tokens, 1)
        self.share = (self.discount * max(types, 1) / n if tokens else 1.0) / (2 * (types + 1))
        #: probability of all words in each fine bucket of the word hash
        self.fine = np.maximum((fine_tokens - self.discount * fine_types) / n, 0) + fine_types * self.share + (types + 2) * self.share / FINE

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(np.where(counts > 0, (counts - self.discount) / max(self.tokens, 1), 0) + self.share)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


class Trie:
    """The two levels of one context shard in `folder`."""

    @staticmethod
    def build(folder: str, contexts: np.ndarray, starts: np.ndarray, words: np.ndarray, log_p: np.ndarray, log_backoff: np.ndarray) -> None:
        """contexts: sorted hashes; starts: index of each one's first successor, and the end; words: sorted in each context."""
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(starts))
        elias_fano.write(f"{folder}/contexts", contexts)
        elias_fano.write(f"{folder}/pointers", starts)
        elias_fano.write(f"{folder}/successors", (rank << np.uint64(WORD_BITS)) | words.astype(np.uint64))
        for name, values in (("p", log_p), ("backoff", log_backoff)):
            book = np.unique(np.quantile(values, np.linspace(0, 1, 256))) if len(values) else np.zeros(1)
            middle = (book[1:] + book[:-1]) / 2
            np.searchsorted(middle, values).astype(np.uint8).tofile(f"{folder}/{name}")
            book.tofile(f"{folder}/{name}.book")

    def __init__(self, folder: str) -> None:
        self.contexts, self.pointers, self.successors = (elias_fano.Sequence(f"{folder}/{x}") for x in ("contexts", "pointers", "successors"))
        self.p, self.backoff = ((self._map(f"{folder}/{x}"), np.fromfile(f"{folder}/{x}.book")) for x in ("p", "backoff"))

    @staticmethod
    def _map(path: str) -> np.ndarray:
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)

    def log10(self, contexts: np.ndarray, words: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 p(word | context); `unigram` has log10 p(word). A context that isn't there backs off wholly."""
        out = unigram.astype(np.float64).copy()
        at = self.contexts.successor(contexts)
        there = np.flatnonzero(at < self.contexts.n)
        there = there[self.contexts[at[there]] == contexts[there]]
        rank = at[there]
        codes, book = self.backoff
        out[there] += book[codes[rank]]
        start, stop = self.pointers[rank].astype(np.int64), self.pointers[rank + 1].astype(np.int64)
        key = (rank.astype(np.uint64) << np.uint64(WORD_BITS)) | words[there].astype(np.uint64)
        found = self.successors.successor(key, start, stop)
        hit = np.flatnonzero(found < stop)
        hit = hit[self.successors[found[hit]] == key[hit]]
        codes, book = self.p
        out[there[hit]] = book[codes[found[hit]]]
        return out


def _requests(texts: list[bytes], ids: list, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vocabulary shard, its hashes of this block in order, their counts in training texts)."""
    known, tokens, lengths = tokens_of(texts)
    train = np.repeat(np.fromiter(map(in_training, ids), dtype=bool, count=len(ids)), lengths)
    counts = np.bincount(tokens[train], minlength=len(known))
    shard = (known % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        own = order[edges[s] : edges[s + 1]]
        if len(own):
            yield s, known[own], counts[own]


def _vocabulary(table: pa.Table) -> pa.Table:
    """Totals over all blocks for one vocabulary shard: an answer for each block, and a row of statistics (block -1)."""
    parts = [unzip_arrays(x) for x in table.column("payload").to_pylist()]
    sizes = [len(h) for h, _ in parts]
    known, back = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    totals = np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(known)).astype(np.int64)
    answers = np.split(totals[back], np.cumsum(sizes)[:-1])
    seen = totals > 0
    fine = (known >> np.uint64(HASH_BITS - FINE_BITS)).astype(np.int64)[seen]
    stats = zip_arrays(
        np.array([totals.sum(), seen.sum(), (totals == 1).sum(), (totals == 2).sum()], dtype=np.int64),
        np.bincount(fine, weights=totals[seen], minlength=FINE).astype(np.int64),
        np.bincount(fine, minlength=FINE).astype(np.int64),
    )
    small = lambda a: a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a
    shard = table.column("shard")[0].as_py()
    n = len(parts)
    return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()), "payload": pa.array([*(zip_arrays(small(a)) for a in answers), stats], pa.binary())})


def _pack_block(ids: list, texts: list[bytes]) -> bytes:
    known, tokens, lengths = tokens_of(texts)
    return zip_arrays(known, tokens.astype(np.uint32), lengths.astype(np.uint32), np.array([-1 if i is None else i for i in ids], dtype=np.int64), np.array([i is None for i in ids], dtype=np.uint8))


def _entries(packed: bytes, counts: np.ndarray, shards: int, unigram: Unigram) -> Iterator[tuple[int, str, bytes]]:
    """(context shard, kind, payload): the block's entries by shard, and its texts' base columns (shard 0)."""
    known, tokens, lengths, ids, null = unzip_arrays(packed)
    tokens, lengths = tokens.astype(np.int64), lengths.astype(np.int64)
    n = len(lengths)
    text = np.repeat(np.arange(n), lengths)
    c = counts[tokens]
    train = np.array([in_training(None if z else i) for i, z in zip(ids.tolist(), null.tolist(), strict=True)], dtype=bool)
    yield 0, "texts", zip_arrays(ids, null, train, lengths, np.bincount(text, weights=c > 0, minlength=n).astype(np.int64), np.bincount(text, weights=unigram.base(c), minlength=n))
    end = int(np.searchsorted(known, END))
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = end  # END stands for START: both are once in a text
    total = counts[before]
    bits = np.minimum(np.ceil(np.log2(np.maximum(total / SPLIT_ABOVE, 1))), FINE_BITS).astype(np.int64)
    fine = (known[tokens] >> np.uint64(HASH_BITS - FINE_BITS)).astype(np.int64)
    part = fine >> (FINE_BITS - bits)
    context = known[before]
    split = bits > 0
    mixed = (context[split] ^ ((part[split] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    context[split] = (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - HASH_BITS)
    summed = np.concatenate([[0.0], np.cumsum(unigram.fine)])
    width = FINE >> bits
    share = np.where(split, summed[(part + 1) * width] - summed[part * width], 1.0).astype(np.float32)
    contexts, first, rank = np.unique(context, return_index=True, return_inverse=True)
    shard_of = (contexts % np.uint64(shards)).astype(np.int64)
    # one entry per (context, word, text), by shard, then context, word, text
    key = np.sort((((rank * len(known)) + tokens) << 16) | text)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    times = np.diff(np.append(np.flatnonzero(fresh), len(key)))
    key = key[fresh]
    text, pair = key & 0xFFFF, key >> 16
    order = np.argsort(shard_of[pair // len(known)], kind="stable")
    text, pair, times = text[order], pair[order], times[order]
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
    at = np.flatnonzero(fresh)
    texts_in = np.diff(np.append(at, len(pair)))
    trained = np.add.reduceat(times * train[text], at)
    pair = pair[fresh]
    rank, word = pair // len(known), pair % len(known)
    code = np.round(-unigram.log10(counts[word]) / UNIGRAM_STEP).clip(0, 255).astype(np.uint8)
    word = (known[word] >> np.uint64(HASH_BITS - WORD_BITS)).astype(np.uint32)
    shard = shard_of[rank]
    pair_edges = np.searchsorted(shard, np.arange(shards + 1))
    entry_edges = np.concatenate([[0], np.cumsum(texts_in)])[pair_edges]
    whole = np.where(split[first], total[first], 0)
    for s in range(shards):
        a, b = pair_edges[s], pair_edges[s + 1]
        if a == b:
            continue
        own = rank[a:b]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        r = own[at]
        e = slice(entry_edges[s], entry_edges[s + 1])
        yield s, "entries", zip_arrays(
            contexts[r], np.diff(np.append(at, b - a)).astype(np.uint32), whole[r].astype(np.uint64), share[first[r]],
            word[a:b], code[a:b], trained[a:b].astype(np.uint32), texts_in[a:b].astype(np.uint32),
            text[e].astype(np.uint16), np.minimum(times[e], 65535).astype(np.uint16), times[e][times[e] > 65535].astype(np.int64),
        )


def _score_shard(payloads: list[bytes]) -> list[bytes]:
    """Build the trie of one context shard from all blocks' entries, and give each block the sums of its texts."""
    parts = [unzip_arrays(p) for p in payloads]
    context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    word, code, trained = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    heads = np.concatenate([p[0] for p in parts])
    whole, share = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    at = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    total = np.add.reduceat(trained[order].astype(np.int64), at)
    c, w, u = c[at], w[at], -UNIGRAM_STEP * code[order][at].astype(np.float64)
    # the model: only what was seen in training
    seen = np.flatnonzero(total > 0)
    n1, n2 = int((total == 1).sum()), int((total == 2).sum())
    discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
    contexts, start = np.unique(c[seen], return_index=True)
    starts = np.append(start, len(seen))
    sums = np.add.reduceat(total[seen], start).astype(np.float64) if len(seen) else np.zeros(0)
    kinds, first = np.unique(heads, return_index=True)
    where = first[np.searchsorted(kinds, contexts)]
    part, all_ = share[where].astype(np.float64), whole[where].astype(np.float64)
    reach = np.where(all_ > 0, (sums + part) / (all_ + 1), 1.0)
    backoff = reach * discount * np.diff(starts) / np.maximum(sums, 1) / part
    spread = np.repeat(np.arange(len(contexts)), np.diff(starts))
    p = reach[spread] * (total[seen] - discount) / sums[spread] + backoff[spread] * 10.0 ** u[seen]
    # a split context of which nothing was seen in this part
    unseen = 1.0 * share[first] / (whole[first] + 1.0) / np.maximum(share[first], 1e-30)
    lost = np.where(whole[first] > 0, np.log10(unseen), 0.0)
    with tempfile.TemporaryDirectory() as folder:
        Trie.build(folder, contexts, starts, w[seen], np.log10(p), np.log10(backoff))
        trie = Trie(folder)
        scores = trie.log10(c, w, u)
        missing = ~np.isin(c, contexts)
        if missing.any():
            scores[missing] += lost[np.searchsorted(kinds, c[missing])]
        del trie
    of_pair = np.empty(len(order))
    of_pair[order] = scores[group]
    out, at = [], 0
    for part_ in parts:
        n = len(part_[4])
        texts, times = part_[8].astype(np.int64), part_[9].astype(np.float64)
        times[part_[9] == 65535] = part_[10] if len(part_[10]) == (part_[9] == 65535).sum() else 65535
        sums = np.bincount(texts, weights=np.repeat(of_pair[at : at + n], part_[7]) * times)
        some = np.flatnonzero(sums)
        out.append(zip_arrays(some.astype(np.uint16), sums[some]))
        at += n
    return out


def score_texts(docs: DataFrame, rid: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows of `docs` that in_training() takes, and score all of them.

    Returns (rid, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`, repeats
    included. Null texts count as empty and have the end token alone; a null rid is a training row. `docs` is read twice
    and must give the same rows in the same order both times, as files do; otherwise an error is raised.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards = max(4, -(-size // (40 * WORDS_PER_SHARD)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks_of(batches):
            got = list(_requests(texts, ids, word_shards))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(got), pa.int64()), pa.array([s for s, *_ in got], pa.int32()), pa.array([zip_arrays(h, c.astype(np.uint32)) for _, h, c in got], pa.binary())], ["block", "shard", "payload"])

    kinds = "block bigint, shard int, payload binary"
    answers = cut(rows.mapInArrow(ask, kinds).groupBy("shard").applyInArrow(_vocabulary, kinds))
    unigram = _totals(answers)
    shards = max(4, -(-(size // 6) // TOKENS_PER_SHARD))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_pack_block(ids, texts)], pa.binary())], ["block", "packed"])

    def send(texts: pa.Table, totals: pa.Table) -> pa.Table:
        if not texts.num_rows or not totals.num_rows:
            raise ValueError("the input gave other rows when it was read again")
        got: list[tuple[int, int, str, bytes]] = []
        answer = sorted(zip(totals.column("shard").to_pylist(), totals.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
        answer = list(dict(answer).values())  # blocks that are alike in all rows have the same answers
        packed = texts.column("packed")[0].as_py()
        known = unzip_arrays(packed)[0]
        counts = np.empty(len(known), dtype=np.int64)
        counts[np.argsort((known % np.uint64(word_shards)).astype(np.int64), kind="stable")] = np.concatenate([unzip_arrays(x)[0].astype(np.int64) for x in answer])
        block = texts.column("block")[0].as_py()
        for copy in range(texts.num_rows):
            got += [(s, block, copy, kind, data) for s, kind, data in _entries(packed, counts, shards, unigram)]
        shard, blocks, copies, kinds_, data = zip(*got, strict=True)
        return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array(blocks, pa.int64()), "copy": pa.array(copies, pa.int32()), "kind": pa.array(kinds_), "payload": pa.array(data, pa.binary())})

    def score(table: pa.Table) -> pa.Table:
        is_text = np.array(table.column("kind").to_pylist()) == "texts"
        payloads = table.column("payload").to_pylist()
        entries = [i for i in range(len(payloads)) if not is_text[i]]
        for i, data in zip(entries, _score_shard([payloads[i] for i in entries]) if entries else [], strict=True):
            payloads[i] = data
        return pa.table({"block": table.column("block"), "copy": table.column("copy"), "kind": table.column("kind"), "payload": pa.array(payloads, pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        scores = None
        for kind, data in sorted(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda x: x[0] != "texts"):
            arrays = unzip_arrays(data)
            if kind == "texts":
                ids, null, train, lengths, n_known, base = arrays
                scores = np.zeros(len(ids))
            else:
                scores[arrays[0].astype(np.int64)] += arrays[1]
        return pa.table(
            {
                "rid": pa.array(ids, pa.int64(), mask=null.astype(bool)),
                "held_out": pa.array(~train.astype(bool)),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(np.round(scores, 6)),
            }
        )

    packed = rows.mapInArrow(keep, "block bigint, packed binary")
    entries = packed.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(send, "shard int, block bigint, copy int, kind string, payload binary")
    sums = entries.groupBy("shard").applyInArrow(score, "block bigint, copy int, kind string, payload binary")
    out = sums.groupBy("block", "copy").applyInArrow(finish, "rid bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("rid", "held_out", "n_tokens", "n_known", F.lit(unigram.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _totals(answers: DataFrame) -> Unigram:
    """The statistics rows of all vocabulary shards added up; added by position on the executors, a few numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                flat = np.concatenate(unzip_arrays(data))
                sums = flat if sums is None else sums + flat
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.int64())], ["i", "x"])

    got = answers.where("block = -1").select("payload").mapInArrow(run, "i int, x bigint").groupBy("i").agg(F.sum("x").alias("x")).collect()  # 4 + 2 * FINE rows
    flat = np.zeros(4 + 2 * FINE, dtype=np.int64)
    for r in got:
        flat[r.i] = r.x
    return Unigram(*(int(x) for x in flat[:4]), flat[4 : 4 + FINE], flat[4 + FINE :])


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs).withColumnRenamed("rid", "doc_id")
