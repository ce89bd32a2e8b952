"""Sharding by sampled splitters (DataFrame operations only).

Records are ordered by (content key, record id). A size-weighted sample of that order gives quantile boundaries, records
are range-partitioned by them, ranges that turn out overfull are subdivided by further sample points, and exact prefix
sums over the ranges then place each record.

Copies stay together. Groups of equal content of over 1 / (n_shards * FINE) of all bytes, of which there can't be more
than n_shards * FINE, go to the emptiest shard first, the largest before the others, as long as they fit it; what room they
leave is filled in the order of the ranges, by whole groups. Only a group that fits no shard is split. So shards differ by
about the share of a group that is too small to be dealt out by itself. The splitters decide only how the work is spread;
the shards depend on the rows alone.
"""

from __future__ import annotations

import bisect
import heapq
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, md5_key

LOWEST = -(2**63)
#: Groups of over 1 / FINE of a shard are dealt out by themselves.
FINE = 256
Bound = tuple[int, int, int]


def longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def upto(n: int, at_or_below) -> Column:
    """How many of n sorted values are at or below a record's, by binary search; at_or_below(i) tells for value i."""
    if not n:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, by: F.when((at + by <= n) & at_or_below(at + by - 1), at + by).otherwise(at))


def range_of(place: list[Column], bounds: list[Bound]) -> Column:
    """Index of the range of a record's place: how many of the sorted bounds are at or below it."""
    parts = [longs([b[i] for b in bounds]) for i in range(3)] if bounds else []

    def below(i: Column) -> Column:
        a, b, c = (F.get(p, i) for p in parts)
        return (a < place[0]) | ((a == place[0]) & ((b < place[1]) | ((b == place[1]) & (c <= place[2]))))

    return upto(len(bounds), below)


def quantile_bounds(sample: list[Bound], n: int) -> list[Bound]:
    """n - 1 or fewer distinct boundaries that cut the sorted sample into equal parts."""
    return sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []


def subdivide(bounds: list[Bound], sizes: dict[int, int], sample: list[Bound], most: float) -> list[Bound]:
    """More boundaries, from the sample, inside each range that holds over `most` bytes."""
    out = set(bounds)
    for r, size in sizes.items():
        if size > most:
            lo = bisect.bisect_left(sample, bounds[r - 1]) if r else 0
            hi = bisect.bisect_left(sample, bounds[r]) if r < len(bounds) else len(sample)
            out.update(quantile_bounds(sample[lo:hi], math.ceil(size / most)))
    return sorted(out)


def deal_groups(groups: list[tuple[int, int]], n_shards: int, room: int) -> tuple[dict[int, int], list[int]]:
    """({key: shard}, bytes in each shard) for groups (bytes, key): each to the emptiest shard, if it stays within `room`."""
    emptiest, where, loads = [(0, s) for s in range(n_shards)], {}, [0] * n_shards
    for size, key in sorted(groups, key=lambda g: (-g[0], g[1])):
        load, shard = emptiest[0]
        if load + size <= room:
            heapq.heapreplace(emptiest, (load + size, shard))
            where[key], loads[shard] = shard, load + size
    return where, loads


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def shard_by_size(df: DataFrame, n_shards: int, size: Column, content: Column, rid: Column, carry: dict[str, Column] | None = None, *, range_bytes: int = 16 << 20, max_ranges: int = 16_384, sample_per_range: int = 16) -> DataFrame:
    """Put every row of `df` into one of `n_shards` shards of nearly equal sizes, in which equal contents stay together.

    size: positive bytes of a record; content: text whose equal values stay together; rid: an integral record id that
    breaks ties (null counts as the lowest). carry: further columns to return. Returns the carried columns, `size`,
    `shard` and `slot` (gapless from 0 in each shard). Rows that repeat, in any number, keep a place each; an empty table
    gives no rows. The sample holds about max_ranges * sample_per_range rows at most, at any size of the input; broadcast
    are tables of a row per range and shard, and of n_shards * FINE groups at most.
    """
    spark = df.sparkSession
    carry = carry or {}
    names = [f"c_{k}" for k in carry]
    taken = df.select(*[c.alias(f"c_{k}") for k, c in carry.items()], size.cast("bigint").alias("size"), md5_key(content).alias("key"), F.coalesce(rid.cast("bigint"), F.lit(LOWEST)).alias("rid"))
    rows = cut(taken.withColumn("nonce", F.xxhash64(F.monotonically_increasing_id())))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    # groups that are dealt out by themselves, and those that may be split: n_shards * FINE together at most
    large = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes").cast("decimal(38,0)") * (n_shards * FINE) > total)
    groups = [(r.bytes, r.key) for r in large.collect()]
    where, loads = deal_groups(groups, n_shards, total // n_shards)
    fate = [(key, where.get(key)) for _, key in groups]
    rows = rows.join(small_table(spark, fate, "key bigint, dealt int").withColumn("is_large", F.lit(True)), "key", "left")
    split = F.col("is_large") & F.col("dealt").isNull()
    rows = rows.withColumns({"b": F.when(split, F.col("rid")).otherwise(LOWEST), "c": F.when(split, F.col("nonce")).otherwise(LOWEST), "weight": F.when(F.col("dealt").isNull(), F.col("size")).otherwise(0)}).withColumn("split", F.coalesce(split, F.lit(False)))
    place = [F.col("key"), F.col("b"), F.col("c")]

    n_ranges = int(min(max_ranges, max(4 * n_shards, total / range_bytes))) if count else 1
    rate = n_ranges * sample_per_range / max(total, 1)
    draw = F.shiftrightunsigned(F.xxhash64("nonce", "rid", F.lit(7)), 11) / F.lit(float(1 << 53))
    sample = sorted((r.key, r.b, r.c) for r in rows.where(draw < F.col("size") * rate).select("key", "b", "c").collect())
    bounds = quantile_bounds(sample, n_ranges)
    ranged = lambda: rows.withColumn("range", range_of(place, bounds))
    measure = lambda: {r.range: (r.size, r.weight) for r in ranged().groupBy("range").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).collect()}
    stats = measure()
    finer = subdivide(bounds, {r: s for r, (s, _) in stats.items()}, sample, 2 * total / n_ranges)
    if finer != bounds:
        bounds = finer
        stats = measure()
    weights = [stats.get(r, (0, 0))[1] for r in range(len(bounds) + 1)]
    before = list(zip(range(len(weights)), accumulate(weights, initial=0), strict=False))
    # what each shard has left for the others, and where in their order it ends
    ends = list(accumulate(total * (s + 1) // n_shards - total * s // n_shards - loads[s] for s in range(n_shards)))[:-1]
    inside = Window.partitionBy("range").orderBy("key", "b", "c")
    at = F.col("before") + F.coalesce(F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.when(F.col("split"), F.col("at")).otherwise(F.min("at").over(Window.partitionBy("range", "key")))  # groups go whole
    filled = upto(len(ends), lambda i: F.get(longs(ends), i) <= F.col("first"))
    placed = cut(
        ranged().join(small_table(spark, before, "range int, before bigint"), "range").withColumn("at", at).withColumn("first", first)
        .select(*names, "size", "key", "rid", "c", "range", F.coalesce("dealt", filled).alias("shard"))
    )
    counts = sorted((r.shard, r.range, r.n) for r in placed.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    slots, done = [], dict.fromkeys(range(n_shards), 0)
    for shard, range_, n in counts:
        slots.append((shard, range_, done[shard]))
        done[shard] += n
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "rid", "c", *names))
    numbered = placed.withColumn("nth", nth).join(small_table(spark, slots, "shard int, range int, done bigint"), ["shard", "range"])
    return numbered.select(*[F.col(f"c_{k}").alias(k) for k in carry], "size", "shard", (F.col("done") + F.col("nth") - 1).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    out = shard_by_size(docs, 24, F.octet_length(text) + 8, text, F.col("doc_id"), {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The shards don't depend on the sampled splitters, so plain prefix sums give the same rows. The checksum goes over the
#: text's bytes by half bytes, low one first.
ORACLE = r"""
WITH RECURSIVE fixed AS (
  SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
          3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS crc
), d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT doc_id, t, strlen(t) + 8 AS size, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS key FROM d
), tot AS (
  SELECT CAST(sum(size) AS BIGINT) AS total FROM k
), g AS MATERIALIZED (
  SELECT key, CAST(bytes AS BIGINT) AS bytes, total, row_number() OVER (ORDER BY bytes DESC, key) AS i
  FROM (SELECT key, sum(size) AS bytes FROM k GROUP BY key), tot WHERE bytes * 24 * 256 > total
), deal(i, loads, key, dealt) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(24), lambda s: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER)
  UNION ALL
  SELECT g.i, CASE WHEN list_min(loads) + bytes <= total // 24
                   THEN list_transform(loads, lambda x, s: CASE WHEN s = list_position(loads, list_min(loads)) THEN x + bytes ELSE x END) ELSE loads END,
         g.key, CASE WHEN list_min(loads) + bytes <= total // 24 THEN CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) END
  FROM deal JOIN g ON g.i = deal.i + 1
), loads AS (
  SELECT loads FROM deal ORDER BY i DESC LIMIT 1
), ends AS (
  SELECT s, sum(total * (s + 1) // 24 - total * s // 24 - loads[s + 1]) OVER (ORDER BY s) AS stop FROM (SELECT unnest(range(23)) AS s), loads, tot
), j AS (
  SELECT k.*, dealt, g.key IS NOT NULL AND dealt IS NULL AS split FROM k LEFT JOIN g ON g.key = k.key LEFT JOIN deal ON deal.key = k.key
), p AS (
  SELECT *, coalesce(sum(CASE WHEN dealt IS NULL THEN size ELSE 0 END) OVER (ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM j
), f AS (
  SELECT *, CASE WHEN split THEN prior ELSE min(prior) OVER (PARTITION BY key) END AS placed FROM p
), s AS (
  SELECT *, coalesce(dealt, (SELECT CAST(count(*) AS INTEGER) FROM ends WHERE stop <= placed)) AS shard FROM f
), h AS (
  SELECT *, hex(encode(t)) AS x, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot FROM s
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       xor(CAST(4294967295 AS BIGINT), list_reduce(
         list_transform(range(1, length(x) + 1), lambda i: CAST(instr('0123456789ABCDEF', x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS BIGINT)),
         lambda c, v: xor(c >> 4, CAST(fixed.crc[(xor(c, v) & 15) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT))) AS text_crc32,
       'bytes' AS law, shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM h, fixed
"""
