"""Quality rules as a short-circuit cascade (DataFrame operations only).

Each rule is a condition on the facts of a text that rejects it. A random sample gives each rule's selectivity (the share it
rejects) and its cost (the time of evaluating it alone over the sample, less that of an empty pass); the rules are then tried
in the order of rejections per cost, and a text that one rule rejects is not looked at by the later ones. The order changes
only the time: a text is kept if no rule rejects it, in whatever order.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let

#: The characters that count as symbols. A fixed value.
SYMBOLS = "#*$%&|<>"
#: Texts in the sample (about), and files that it is drawn from if there are more.
SAMPLE, SAMPLE_FILES = 400, 32


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than space and U+0009 to U+000D, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice. Windows are compared by their 64-bit hashes."""

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            near = lambda i, d: F.get(s, i + d)["h"]
            again = F.filter(s, lambda x, i: F.coalesce(x["h"] == near(i, -1), F.lit(False)) | F.coalesce(x["h"] == near(i, 1), F.lit(False)))
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            # a window covers the words up to the next one, three at most
            return let(at, lambda a: F.aggregate(F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.least(F.coalesce(y, x + 3) - x, F.lit(3))), F.lit(0), lambda n, x: n + x))

        return let(placed, positions)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, count)).cast("bigint")


@dataclass
class Facts:
    """What rules may ask of a text, as expressions over it and its words."""

    text: Column
    words: Column

    @cached_property
    def n_words(self) -> Column:
        return F.size(self.words).cast("bigint")

    @cached_property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("bigint")

    @cached_property
    def n_symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(f"[{SYMBOLS}]")).cast("bigint")

    @cached_property
    def n_upper(self) -> Column:
        return F.regexp_count(self.text, F.lit(r"\p{Lu}")).cast("bigint")

    @cached_property
    def n_lines(self) -> Column:
        return F.size(F.split(self.text, "\n")).cast("bigint")

    @cached_property
    def n_dup_lines(self) -> Column:
        """Lines that hold a word and equal an earlier line."""
        lines = F.filter(F.split(self.text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
        return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")

    @cached_property
    def n_repeat_words(self) -> Column:
        return n_repeat_words(self.words)


Rule = Callable[[Facts], Column]

#: name: (facts -> true if the rule rejects the text). A null never rejects.
RULES: dict[str, Rule] = {
    "few_words": lambda f: f.n_words < 50,
    "repeated_words": lambda f: 100 * f.n_repeat_words > 50 * f.n_words,
    "symbols": lambda f: 40 * f.n_symbols > f.word_chars,
    "shouting": lambda f: 3 * f.n_upper > f.word_chars,
    "repeated_lines": lambda f: 3 * f.n_dup_lines > f.n_lines,
    "word_length": lambda f: let(f.word_chars, lambda n: (n < 2 * f.n_words) | (n > 20 * f.n_words)),
}
#: The rules that the query's contract has.
BASE = ("few_words", "repeated_words")


def over(text: Column, body: Callable[[Facts], Column]) -> Column:
    """`body` of the facts of a text, null as empty; the words are made once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda w: body(Facts(t, w))))


def few_files(docs: DataFrame, most: int = SAMPLE_FILES, seed: int = 11) -> DataFrame:
    """The rows of `docs` in a random choice of its files, so that drawing a sample doesn't read a large table; all rows where
    there are few files or none."""
    files = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()})
    if len(files) <= most:
        return docs
    try:
        return docs.where(F.col("_metadata.file_name").isin(random.Random(seed).sample(files, most)))
    except AnalysisException:
        return docs


def measure(docs: DataFrame, text: str, rules: dict[str, Rule], rows: int = SAMPLE, tries: int = 2) -> dict[str, tuple[float, float]]:
    """(cost in seconds, share rejected) of each rule on a random sample of about `rows` texts."""
    some = few_files(docs.select(F.col(text).alias("t")))
    share = rows / max(rows, some.count())
    sample = some.sample(fraction=share, seed=11).cache()
    n = max(sample.count(), 1)

    def timed(condition: Column) -> tuple[float, int]:
        spent = []
        for _ in range(tries):
            began = time.perf_counter()
            rejected = sample.agg(F.count(F.when(condition, 1)).alias("n")).first().n
            spent.append(time.perf_counter() - began)
        return min(spent), rejected

    empty, _ = timed(over(F.col("t"), lambda f: f.words.isNull()))
    out = {}
    for name, rule in rules.items():
        spent, rejected = timed(over(F.col("t"), rule))
        out[name] = (max(spent - empty, 1e-4), rejected / n)
    sample.unpersist()
    return out


def order_rules(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per cost, the most first; names break ties."""
    return sorted(measured, key=lambda k: (-measured[k][1] / measured[k][0], k))


def cascade(facts: Facts, rules: dict[str, Rule], order: list[str]) -> Column:
    """The name of the first rule in `order` that rejects the text, or null. Later rules are not evaluated.

    A null or empty text has no words, symbols or lines to reject it by but what few_words says; the verdict rests on the
    text alone, so repeated rows have the same.
    """
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name](facts), F.lit(name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows whose text no rule rejects, with their columns as they were, whatever their names. A null text counts as
    empty; long texts are read whole; repeated rows stand or fall together; no rows give no rows."""
    rules = rules or RULES
    order = order_rules(measure(docs, text, rules))
    return docs.where(over(F.col(text), lambda f: cascade(f, rules, order)).isNull())


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts of the contract and the verdict of the cascade. All counts are returned here, so they are made once, and the
    rules that use them read them; the order is that of the whole cascade."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = order_rules(measure(docs, "text", RULES))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def row(f: Facts) -> Column:
        def verdict(c: Column) -> Column:
            known = Facts(f.text, f.words)
            for name in names:
                known.__dict__[name] = c[name]
            rejected = cascade(known, RULES, order)
            failed = RULES["few_words"](known) | RULES["repeated_words"](known)
            return F.struct(c.alias("c"), failed.alias("base_failed"), rejected.isNull().alias("kept"))

        return let(F.struct(*[getattr(f, name).alias(name) for name in names]), verdict)

    return docs.select("doc_id", over(F.col("text"), row).alias("r")).select("doc_id", *[f"r.c.{name}" for name in names], "r.base_failed", "r.kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY doc_id
), c AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 40 * n_symbols > word_chars OR 3 * n_upper > word_chars OR 3 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
