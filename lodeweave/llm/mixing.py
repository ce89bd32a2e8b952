"""Mixing sources to target weights by hierarchical budgets (DataFrame operations only).

Sources are leaves of a tree (domain, language, source). A budget of tokens goes down the tree by the nodes' weights. A
node can use no more than its documents' tokens times `max_epochs`; what it leaves is shared by its siblings by weight,
and only a parent whose children are all full leaves anything to its own siblings. A leaf's budget then buys whole epochs
of its documents and, of one more epoch in its own seeded order, the longest prefix of documents whose tokens fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, md5_key
from .quality_rules import words_of

#: The order of an epoch is split by its top bits, so that no task sorts a whole leaf.
ORDER_BITS, MOST_BUCKET_BITS = 60, 24
WIDE = "decimal(38,0)"


def weight_of(value: Column, weights: dict[str, int]) -> Column:
    """The given weight of a node's name, else 1."""
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(value == name, weight).otherwise(out)
    return out.cast("bigint")


def share(children: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """`children` (path, cap, weight) with the parents' budgets shared out: by weight, none over its cap.

    Children in the order of cap / weight fill up one after the other; the first that doesn't fill at its share ends it,
    and it and all later ones divide what is left by weight. Whole tokens; a rest of less than a token each is dropped.
    """
    path = [c for c in children.columns if c not in ("cap", "weight")]
    by_ratio = Window.partitionBy(*by).orderBy(F.col("cap") / F.col("weight"), *path)
    upto, alike = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    heavy = F.sum("weight").over(alike) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    full = F.col("cap").cast(WIDE) * F.col("heavy") <= F.col("left").cast(WIDE) * F.col("weight")
    placed = children.join(parents, by).withColumns({"left": left, "heavy": heavy}).withColumn("full", full)
    spare = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(alike), F.lit(0))
    hungry = F.sum(F.when(~F.col("full"), F.col("weight"))).over(alike)
    part = F.floor(spare.cast(WIDE) * F.col("weight") / hungry)
    return placed.withColumn("own", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("bigint")).select(*path, F.col("own").alias("budget"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], parts: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels, tokens, budget) of each leaf of (levels, tokens). The whole budget is parts[0] / parts[1] of all tokens."""
    usable = F.when(weight_of(F.col(levels[-1]), weights.get(levels[-1], {})) > 0, F.col("tokens") * max_epochs).otherwise(0)
    capped = leaves.withColumn("cap", usable)
    total = F.floor(F.sum("tokens").cast(WIDE) * parts[0] / parts[1]).cast("bigint")
    budgets = capped.agg(F.least(total, F.sum("cap")).alias("budget")).withColumn("root", F.lit(0))
    for i, level in enumerate(levels):
        path, above = levels[: i + 1], levels[:i] or ["root"]
        weight = weight_of(F.col(level), weights.get(level, {}))
        nodes = capped.withColumn("root", F.lit(0)).groupBy(*([] if i else ["root"]), *path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.select(*nodes.columns[:-1], F.when(weight > 0, F.col("cap")).otherwise(0).alias("cap"), F.greatest(weight, F.lit(1)).alias("weight"))
        budgets = share(nodes, budgets, above).select(*path, "budget")
    return leaves.join(budgets, levels)


def order_key(seed: int, epoch: Column, rid: Column) -> Column:
    return md5_key(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), rid.cast("string")))


def mix(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], parts: tuple[int, int], max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """(rid, levels, tokens, epoch): one row for each time that a document is taken; rows: (rid, levels, tokens).

    A null level counts as a node named by the empty string; levels may have any names but rid, tokens and epoch. Rows that
    repeat a rid in a leaf are one document with the sum of their tokens; a null rid is a rid. Documents without tokens
    cost nothing and come with every epoch of their leaf. A leaf or the whole table without tokens, and an empty table,
    give no rows. The leaf table has a row per leaf; documents meet it by a join that may be dealt out by leaf, whose
    large partitions can be split. A leaf's last epoch is cut by prefix sums over buckets of its order, about 65,000
    documents each, and documents are sorted only in the bucket where it ends.
    """
    own = [f"level_{i}" for i in range(len(levels))]
    own_weights = {o: weights[c] for o, c in zip(own, levels, strict=True) if c in weights}
    named = rows.select("rid", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(o) for o, c in zip(own, levels, strict=True)], F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    docs = cut(named.groupBy("rid", *own).agg(F.sum("tokens").alias("tokens")))
    bits = min(MOST_BUCKET_BITS, max(4, (docs.count() >> 16).bit_length()))
    leaves = cut(docs.groupBy(*own).agg(F.sum("tokens").alias("leaf_tokens")).where("leaf_tokens > 0"))
    budgets = leaf_budgets(leaves.withColumnRenamed("leaf_tokens", "tokens"), own, own_weights, parts, max_epochs).select(
        *own, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    budgets = cut(budgets)
    at = order_key(seed, F.col("epochs"), F.col("rid"))
    keyed = docs.join(budgets, own).withColumn("at", at).withColumn("bucket", F.shiftright("at", ORDER_BITS - bits).cast("int"))
    before = Window.partitionBy(*own).orderBy("bucket")
    buckets = keyed.groupBy(*own, "bucket").agg(F.sum("tokens").alias("bucket_tokens")).withColumn("upto", F.sum("bucket_tokens").over(before))
    met = keyed.join(buckets, [*own, "bucket"]).withColumn("lead", F.col("upto") - F.col("bucket_tokens"))
    inside = Window.partitionBy(*own, "bucket").orderBy("at", "rid").rowsBetween(Window.unboundedPreceding, 0)
    is_edge = (F.col("upto") > F.col("rest")) & (F.col("lead") <= F.col("rest"))
    one_more = lambda yes: F.col("epochs") + F.when(yes, 1).otherwise(0)
    plain = met.where(~is_edge).withColumn("taken", one_more(F.col("upto") <= F.col("rest")))
    edge = met.where(is_edge).withColumn("taken", one_more(F.col("lead") + F.sum("tokens").over(inside) <= F.col("rest")))
    taken = plain.unionByName(edge).where("taken > 0")
    return taken.select("rid", *[F.col(o).alias(c) for o, c in zip(own, levels, strict=True)], "tokens", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("epoch"))


#: The tree of the table `documents`: a domain derived from the source, language, source. Names not listed weigh 1.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"web": 3, "books": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def domain_of(source: Column) -> Column:
    return F.when(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1) < "8", "web").otherwise("books")


def leaf_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("rid"), domain_of(F.col("source")).alias("domain"), "lang", "source", F.size(words_of(F.coalesce("text", F.lit("")))).alias("tokens"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(leaf_rows(docs), LEVELS, WEIGHTS, (4, 5)).withColumnsRenamed({"rid": "doc_id", "tokens": "n_tokens"})


def _level_sql(name: str, path: list[str], above: list[str], parent: str, weight: str) -> str:
    by, on = ", ".join(above), ", ".join(above)
    return f"""
{name}_n AS (
  SELECT {", ".join(dict.fromkeys([*above, *path]))}, CAST(CASE WHEN {weight} > 0 THEN sum(cap) ELSE 0 END AS HUGEINT) AS cap, CAST(greatest({weight}, 1) AS HUGEINT) AS weight
  FROM leaves GROUP BY {", ".join(dict.fromkeys([*above, *path]))}
), {name}_p AS (
  SELECT n.*, p.budget,
         p.budget - coalesce(sum(cap) OVER o, 0) AS left_over, sum(weight) OVER (PARTITION BY {by}) - coalesce(sum(weight) OVER o, 0) AS heavy
  FROM {name}_n n JOIN {parent} p USING ({on})
  WINDOW o AS (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {", ".join(path)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name}_f AS (
  SELECT *, cap * heavy <= left_over * weight AS is_full FROM {name}_p
), {name} AS (
  SELECT {", ".join(path)}, CASE WHEN is_full THEN cap ELSE
         (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {by}), 0)) * weight // sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {by}) END AS budget
  FROM {name}_f
)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


ORACLE = (
    r"""
WITH d AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT 0 AS root, domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS cap FROM d GROUP BY ALL HAVING sum(n_tokens) > 0
), top AS (
  SELECT 0 AS root, CAST(least(CAST(sum(tokens) AS HUGEINT) * 4 // 5, sum(cap)) AS HUGEINT) AS budget FROM leaves
),"""
    + ",".join(
        _level_sql(n, LEVELS[: i + 1], LEVELS[:i] or ["root"], p, _case(LEVELS[i], WEIGHTS[LEVELS[i]]))
        for i, (n, p) in enumerate([("by_domain", "top"), ("by_lang", "by_domain"), ("by_source", "by_lang")])
    )
    + r""", e AS (
  SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM by_source JOIN leaves USING (domain, lang, source)
), k AS (
  SELECT d.*, epochs, rest, CAST('0x' || substr(md5('17:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place
  FROM d JOIN e USING (domain, lang, source)
), t AS (
  SELECT *, epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS taken FROM k
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, CAST(taken AS BIGINT))) AS INTEGER) AS epoch FROM t WHERE taken > 0
"""
)


def mix_documents(docs: DataFrame, parts: tuple[int, int], max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """The rows of a table like `documents` that mix() takes, with their columns, each as often as it is taken.

    Rows that repeat a doc_id in a leaf stand or fall together. Null ids and null levels are kept as values of their own.
    """
    taken = mix(leaf_rows(docs), LEVELS, WEIGHTS, parts, max_epochs, seed).select(F.col("rid").alias("_rid"), *[F.col(c).alias(f"_{c}") for c in LEVELS])
    level = {"domain": domain_of(docs["source"]), "lang": F.coalesce(docs["lang"], F.lit("")), "source": F.coalesce(docs["source"], F.lit(""))}
    same = docs["doc_id"].eqNullSafe(taken["_rid"])
    for c in LEVELS:
        same = same & (level[c] == taken[f"_{c}"])
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns])
