"""Toxicity scores: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

The lexicon has two parts: a fixed list of insults, and words and word beginnings that the labelled training rows show to
be far more frequent in toxic texts. Features are densities and peaks of lexicon words, their distance to second-person
words, capitals, punctuation, and obfuscated spellings (digits and symbols in place of letters). The learnt lexicon, the
trees and the calibration are fitted by two folds, so that each fold's features come from the other fold's lexicon.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic, sigmoid
from .common import small_batches

#: Labelled rows that the model is fitted on, at most: those of the least hashes of their ids.
MAX_LABELLED = 8000
#: Their bytes at most, in the same order; a text that is taken is taken whole.
MAX_LABELLED_BYTES = 256 << 20
#: Insults, second-person words, and letters that symbols stand for.
INSULTS = frozenset("idiot idiots idiotic moron morons moronic stupid dumb loser losers trash scum pathetic worthless disgusting clown clowns fool fools jerk imbecile garbage filth vermin hate ugly crap".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"})
EDGES = ".,;:!?\"'()[]{}<>*_#&%$|/\\-–—…«»“”‘’¡¿~`^=+"
INNER = re.compile(r"[^\W\d_][*@$!#%0-9+]+[^\W\d_]")
SHORTEST, LONGEST = 3, 10
NEAR, SPAN = 6, 20
FEATURES = 22


@cache
def capitals() -> np.ndarray:
    """Which code points are capitals."""
    return np.array([chr(i).isupper() for i in range(0x110000)])


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


def entries(word: str) -> Iterator[str]:
    """What of a plain word can be in the learnt lexicon: its beginnings (with a mark) and itself."""
    if len(word) >= SHORTEST:
        yield word
        for k in range(SHORTEST, min(len(word), LONGEST) + 1):
            yield word[:k] + "*"


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Entries with their log-odds for toxic texts; by texts that hold them, only strong and repeated ones.

    A beginning of words is kept only if it stands for several words of toxic texts; else the word itself says it all.
    """
    seen, words = [Counter(), Counter()], set()
    for t, y in zip(texts, toxic, strict=True):
        own = {plain(w) for w in t.split()}
        words |= own if y else set()
        seen[int(y)].update({e for w in own for e in entries(w)})
    kinds = Counter(e for w in words for e in entries(w))
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    out = {}
    for e, c in seen[1].items():
        odds = math.log((c + 0.1) / (n1 + 0.2)) - math.log((seen[0][e] + 0.1 + 0.5) / (n0 + 0.7))
        if c >= 3 and odds > 2.5 and (not e.endswith("*") or kinds[e] >= 3):
            out[e] = round(odds * c / (c + 2), 3)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


class Words:
    """Per distinct word: lexicon strength, and flags. Kept while it has fewer than `most` words."""

    def __init__(self, lexicon: dict[str, float], most: int = 500_000) -> None:
        self.lexicon, self.most = lexicon, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, 6), dtype=np.float32)

    def strength(self, word: str) -> float:
        get = self.lexicon.get
        return max((get(e, 0.0) for e in entries(word)), default=0.0)

    def add(self, raw: str) -> int:
        word = plain(raw)
        strength, insult = self.strength(word), float(word in INSULTS)
        hidden = 0.0
        if word and (INNER.search(raw) or not word.isalpha()):
            read = raw.lower().translate(STANDS_FOR).strip(EDGES)
            if read != word:
                s, i = self.strength(read), float(read in INSULTS)
                hidden = float(max(s, 4 * i) > max(strength, 4 * insult))
                strength, insult = max(strength, s), max(insult, i)
        letters = sum(map(str.isalpha, raw))
        at = self.index[raw] = len(self.index)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = (strength, insult, word in SECOND_PERSON, hidden, bool(INNER.search(raw)), letters > 1 and raw.upper() == raw and raw.lower() != raw)
        return at

    def look(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.clear()
        get, add = self.index.get, self.add
        at = np.fromiter((i if (i := get(w)) is not None else add(w) for w in words), dtype=np.int64, count=len(words))
        return self.rows[at].astype(np.float64)


def features(text: str, words: Words) -> list[float]:
    """The dense features of one whole text; zeros for an empty one."""
    split = text.split()
    n = len(split)
    if not n:
        return [0.0] * FEATURES
    strength, insult, second, hidden, inner, shout = words.look(split).T
    hits = np.flatnonzero((strength > 2.5) | (insult > 0))
    strong = np.sort(strength[hits])[::-1]
    you = np.flatnonzero(second)
    gaps = np.diff(hits)
    crowd = (np.searchsorted(hits, hits + SPAN) - np.arange(len(hits))).max() if len(hits) else 0
    if len(you) and len(hits):
        after = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(after, len(you) - 1)]), np.abs(hits - you[np.maximum(after - 1, 0)]))
        near, nearest = float((gap <= NEAR).mean()), float(1 / (1 + gap.min()))
    else:
        near = nearest = 0.0
    chars = len(text)
    upper = int(capitals()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())
    count = text.count
    return [
        math.log1p(n), len(hits) / n, math.log1p(len(hits)), strength.sum() / n, strong[0] if len(strong) else 0.0, strong[:3].sum(), strong[:8].sum(),
        insult.sum() / n, math.log1p(insult.sum()), math.log1p(len({split[i] for i in hits})), crowd / SPAN, 1 / (1 + gaps.min()) if len(gaps) else 0.0,
        second.sum() / n, near, nearest, hidden.sum() / n, math.log1p(hidden.sum()), inner.sum() / n,
        upper / chars, shout.sum() / n, (count("!") + count("?")) / chars, (count(".") + count(",") + count(";") + count(":") + count("'") + count('"')) / chars,
    ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None
    calibration: Isotonic | None
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; among equally calibrated ones the raw order shows in the sixth decimal."""
        if self.trees is None:
            return np.full(len(x), self.rate)
        margin = self.trees.margin(x)
        return np.clip((1 - 2e-6) * self.calibration(margin) + 2e-6 * sigmoid(margin), 0, 1)


def fit(texts: list[str], toxic: np.ndarray) -> ToxicityModel:
    """Two folds: each fold's features use the other's lexicon, and the calibration its out-of-fold margins."""
    toxic = np.asarray(toxic, dtype=np.float64)
    rate = float(toxic.mean()) if len(toxic) else 0.0
    if len(toxic) < 20 or toxic.sum() < 6 or (1 - toxic).sum() < 6:
        return ToxicityModel({}, None, None, rate)
    fold = np.zeros(len(toxic), dtype=np.int64)
    for y in (0, 1):
        rows = np.flatnonzero(toxic == y)
        fold[rows] = np.arange(len(rows)) % 2
    x = np.zeros((len(toxic), FEATURES))
    for k in (0, 1):
        other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        words = Words(learn_lexicon([texts[i] for i in other], toxic[other]))
        x[own] = [features(texts[i], words) for i in own]
    margin = np.zeros(len(toxic))
    for k in (0, 1):
        margin[fold == k] = BoostedTrees().fit(x[fold != k], toxic[fold != k]).margin(x[fold == k])
    return ToxicityModel(learn_lexicon(texts, toxic), BoostedTrees().fit(x, toxic), Isotonic().fit(margin, toxic), rate)


def crc_rest(doc_id, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_bytes: int = MAX_LABELLED_BYTES) -> ToxicityModel:
    """Fit, in one executor task, on up to `most` labelled rows of up to `most_bytes` together, outside the held-out part
    (crc32 of the id mod 3 is 1). Rows without a label or an id are no labelled rows; a row labelled twice is toxic if one
    label says so; a repeated row counts once. Only the model comes to the driver."""
    small_batches(docs.sparkSession)
    usable = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers
    by_hash = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # of `most` rows
    within = texts.withColumn("upto", F.sum(F.octet_length("text")).over(by_hash)).where(F.col("upto") <= most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for batch in batches:
            rows |= zip(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True), batch.column("toxic").to_pylist(), strict=True)
        ordered = sorted(rows)
        model = fit([t for _, t in ordered], np.array([rows[k] > 0 for k in ordered]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    row = within.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else fit([], np.zeros(0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, rid: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, score, predicted) of every row, repeats included and null ids kept. Null and empty texts have the features of an
    empty text; long ones are read whole; equal texts have equal scores. No rows give no rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            score = model.score(np.array([features(t, words) for t in texts]).reshape(len(texts), FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["rid", "score", "predicted"])

    return docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text")).mapInArrow(run, "rid bigint, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    held_out = F.crc32(F.col("rid").cast("string").cast("binary")) % 3 == 1
    return score_toxicity(docs, model).select(F.col("rid").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")
