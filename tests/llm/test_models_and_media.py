import hashlib
import io
import math
import random
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeweave.llm import elias_fano, language_model, media, packing

from .conftest import SCHEMA, words


def test_elias_fano_round_trip_and_successor(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1000, 3), (1000, 1 << 20), (5000, 1 << 62)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        elias_fano.write(f"{tmp_path}/x", values)
        s = elias_fano.Sequence(f"{tmp_path}/x")
        assert (s[np.arange(n)] == values).all()
        ask = np.concatenate([values, rng.integers(0, top + 5, 200, dtype=np.uint64)])
        assert (s.successor(ask) == np.searchsorted(values, ask)).all()
        lo = rng.integers(0, n + 1, len(ask))
        hi = np.minimum(lo + rng.integers(0, 50, len(ask)), n)
        want = np.clip(np.searchsorted(values, ask), lo, hi)
        assert (s.successor(ask, lo, hi) == want).all()


def model_by_hand(texts, train):
    """Base columns and the same bigram formula with dictionaries."""
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if i in train for w in ws)
    n, v = sum(c.values()), len(c)
    pairs = lambda ws: list(zip(["<s>", *ws], ws, strict=False))
    b = Counter(p for i, ws in tokens.items() if i in train for p in pairs(ws))
    of, kinds = Counter(), Counter()
    for (x, _), k in b.items():
        of[x] += k
        kinds[x] += 1
    return tokens, pairs, c, n, v, b, of, kinds


@pytest.mark.parametrize("split", [250_000, 40])
def test_language_model_equals_brute_force(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(language_model, "SPLIT_ABOVE", split)
    monkeypatch.setattr(language_model, "BLOCK_TEXTS", 40)
    r = random.Random(6)
    vocab = words(9, 60).split()
    texts = {i: " ".join(r.choice(vocab[: r.choice((5, 60))]) for _ in range(r.randint(0, 60))) for i in range(200)}
    texts |= {200: None, 201: "", 202: "UNSEEN Zeta omega", 203: texts[0]}
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA).repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in language_model.op8_language_model(spark, str(tmp_path)).collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    tokens, pairs, c, n, v, b, of, kinds = model_by_hand(texts, train)
    assert len(got) == len(texts)
    counts = Counter(c.values())
    d1 = counts[1] / (counts[1] + 2 * counts[2]) if counts[1] else 0.5
    share = d1 * v / n / (2 * (v + 1))
    uni = lambda w: ((c[w] - d1) / n if c[w] else 0) + share
    for i, ws in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        if split > 1000:
            # discounts are per shard, so only near
            s = sum(math.log10(max(b[p] - 0.5, 0) / of[p[0]] + 0.5 * kinds[p[0]] / of[p[0]] * uni(p[1]) if of[p[0]] else uni(p[1])) for p in pairs(ws))
            assert x.score == pytest.approx(s, abs=0.35 * len(ws))
        assert x.score < 0
    assert got[203].score == pytest.approx(got[0].score, abs=1e-5)
    held = [i for i in got if i not in train]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held) - 0.1 * sum(len(tokens[i]) for i in held)


def test_split_contexts_share_their_probability(tmp_path):
    """Over all words after a context, split or not, probabilities of the trie sum to at most one, and nearly to it."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(50)).encode() for _ in range(60)]
    ids = list(range(60))
    known, _, _ = language_model.tokens_of(texts)
    parts = list(language_model._requests(texts, ids, 1))
    counts = parts[0][2]
    seen = counts > 0
    fine = (known >> np.uint64(48)).astype(int)[seen]
    model = language_model.Unigram(int(counts.sum()), int(seen.sum()), int((counts == 1).sum()), int((counts == 2).sum()), np.bincount(fine, counts[seen], language_model.FINE), np.bincount(fine, minlength=language_model.FINE))
    assert (10 ** model.log10(counts[seen])).sum() <= 1
    assert model.fine.sum() == pytest.approx(1, abs=1e-9)


def test_no_documents(spark, empty_folder):
    assert language_model.op8_language_model(spark, empty_folder).count() == 0
    assert packing.op6_packing(spark, empty_folder).count() == 0
    assert media.op10_media(spark, empty_folder).count() == 0


def test_odd_documents(spark, folder):
    rows = language_model.op8_language_model(spark, folder).collect()
    assert len(rows) == 13 and {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_fast_vocabulary_gives_the_same_ids():
    import public_tokenizers

    fast, plain = packing.encoder(packing.fast_vocabulary()), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", " ", "\n\n a", "don't 12 34", "é漢字🙂", "<|endoftext|>", "x" * 3000, "a b\t\tc", *(words(i, 50) for i in range(40))]:
        assert fast(t) == plain(t)


def test_pieces():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)]
    assert packing.pieces_of(8, 4) == [(0, 4), (4, 4)]
    assert packing.pieces_of(4, 4) == [(0, 4)] and packing.pieces_of(1, 4) == [(0, 1)]


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # exact fit, though bin 0 has room
    assert bins.put(8) == (2, 0)
    assert bins.put(9) == (3, 0)  # two are open: bin 2, the fullest, closes
    assert bins.put(2) == (0, 6) and bins.put(1) == (3, 9)
    rng = np.random.default_rng(2)
    bins, fill = packing.BestFit(100, 8), defaultdict(int)
    for x in rng.integers(1, 101, 3000):
        at, offset = bins.put(int(x))
        assert fill[at] == offset
        fill[at] += int(x)
        assert fill[at] <= 100 and bins.n_open <= 8


def test_packing_is_whole_and_tight(spark, folder):
    rows = packing.op6_packing(spark, folder).collect()
    encode = packing.encoder(packing.fast_vocabulary())
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    ids = encode(words(3, 30_000)) + [0]
    long = sorted(by_doc[7], key=lambda r: r.piece)
    assert [r.length for r in long[1:]] == [2048] * (len(long) - 1) and sum(r.length for r in long) == len(ids)
    for r in long:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert [(r.piece, r.length) for r in by_doc[4]] == [(r.piece, r.length) for r in by_doc[5]] == [(0, 1)]
    assert len(by_doc[3]) == 2
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 5


def test_media_round_trip(spark, folder, odd_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = media.op10_media(spark, folder).collect()
    assert len(rows) == 13
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and r.payload_bytes % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.to_wav(payload)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and media.from_wav(stored) == payload
    full = {r.rid: r for r in media.media_columns(odd_docs).collect()}
    assert len(full[7].times) == len(full[7].hashes) == full[7].n_pairs > 0
    with wave.open(io.BytesIO(bytes(full[0].media))) as w:
        assert (w.getsampwidth(), w.getnchannels()) == (1, 1)


def test_every_sample_lies_in_a_frame():
    rng = np.random.default_rng(3)
    for n in (576, 1152, 5760):
        x = rng.integers(0, 256, n, dtype=np.uint8)
        y = x.copy()
        y[-58:] = (255 * (np.arange(58) % 2)).astype(np.uint8)
        assert [a.tolist() for a in media.pair_fingerprints(x)] != [a.tolist() for a in media.pair_fingerprints(y)]


def peaks_by_hand(x):
    """The same by definition, frame by frame with a plain Fourier sum."""
    x = [int(v) - 128.0 for v in x]
    out, at = [], 0
    while True:
        frame = np.array((x[at * media.HOP :] + [0.0] * media.WINDOW)[: media.WINDOW]) * np.hanning(media.WINDOW)
        k = np.arange(media.WINDOW // 2 + 1)
        magnitude = np.abs(np.exp(-2j * np.pi * k[:, None] * np.arange(media.WINDOW) / media.WINDOW) @ frame)
        for lo, hi in zip(media.BANDS, media.BANDS[1:], strict=False):
            best = lo + int(np.argmax(magnitude[lo:hi]))
            if magnitude[best] > media.PROMINENCE * magnitude[media.BANDS[0] :].mean():
                out.append((at, best))
        if at * media.HOP + media.WINDOW >= len(x):
            return out
        at += 1


def test_pairs_equal_brute_force():
    for seed in range(3):
        data = media.pad(words(seed, 300).encode())
        found = peaks_by_hand(data)
        want = sorted((a, p << 13 | q << 4 | b - a) for a, p in found for b, q in found if a < b <= a + media.AHEAD)
        times, hashes = media.pair_fingerprints(np.frombuffer(data, np.uint8))
        assert list(zip(times.tolist(), hashes.tolist(), strict=True)) == want and want


def test_a_tone_gives_its_bin():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 / media.RATE * t)).astype(np.uint8)
    frames, bins = media.peaks(tone)
    assert Counter(bins.tolist()).most_common(1)[0][0] == 1000 * media.WINDOW // media.RATE
    times, hashes = media.pair_fingerprints(tone)
    assert (np.diff(times) >= 0).all() and len(set(hashes.tolist())) < len(hashes)


def test_added_tokens_have_the_ids_of_an_untouched_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.fast_vocabulary())
    for t in ["<|endoftext|>", "a<|endoftext|> b", " <|endoftext|><|endoftext|>\n", "<|endoftext", *(words(i, 50) + "<|endoftext|>" * (i % 3) + words(i + 1, 9) for i in range(9))]:
        assert fast(t) == plain.encode(t, add_special_tokens=False).ids
    assert fast("<|endoftext|>") == [50256]


def best_fit_by_hand(lengths, capacity, open_bins):
    """Sequences by definition: every piece to the open bin with the least room that holds it, lists searched one by one."""
    bins, closed, out = [], 0, []
    for x in lengths:
        fits = [b for b in bins if b[1] >= x]
        if fits:
            least = min(b[1] for b in fits)
            b = [b for b in fits if b[1] == least][-1]
            bins.remove(b)
        else:
            if len(bins) == open_bins:
                fullest = min(b[1] for b in bins)
                bins.remove([b for b in bins if b[1] == fullest][-1])
            b = [closed, capacity]
            closed += 1
        out.append((b[0], capacity - b[1]))
        b[1] -= x
        if b[1]:
            bins.append(b)
    return out


def test_packing_equals_a_naive_best_fit(spark):
    rng = np.random.default_rng(4)
    for open_bins in (1, 3, 50):
        lengths = rng.integers(1, 65, 700).tolist()
        bins = packing.BestFit(64, open_bins)
        assert [bins.put(x) for x in lengths] == best_fit_by_hand(lengths, 64, open_bins)
    rows = [(i % 40, i, 0, int(x), f"t{i}") for i, x in enumerate(rng.integers(1, 65, 300))]
    pieces = spark.createDataFrame(rows, "rid bigint, piece int, start bigint, length bigint, task string")
    got = packing.pack(pieces, 64, 8, lookahead=1, tasks=1).collect()
    assert got[0].__fields__ == [*pieces.columns, "sequence_id", "offset"] and {r.task for r in got} == {r[4] for r in rows}
    assert [(r.sequence_id, r.offset) for r in got] == best_fit_by_hand([r.length for r in got], 64, 8)
