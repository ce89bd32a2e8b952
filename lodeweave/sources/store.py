"""Stored facts, graph snapshots and score history, as Parquet on any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import extract
from .discover import tree_key

#: Raised whenever facts of the same content would come out differently.
FACTS_VERSION = 2
TABLES = ("files", "symbols", "imports", "edges", "roots", "shapes", "packages", "declared", "scripts", "surface", "pragmas", "coverage", "diagnostics", "texts")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def facts(spark: SparkSession, tree: DataFrame, folder: str) -> DataFrame:
    """Facts of all files of `tree`: those known by content are read, only the others are extracted, and then stored.

    The store is partitioned by version and extension, so that a reader prunes what it can't use.
    """
    path = f"{folder}/facts"
    wanted = tree.select("path", "content_hash", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext")).where(F.col("ext").isin(*extract.LANGUAGES))
    known = spark.read.parquet(path).where(F.col("version") == FACTS_VERSION) if exists(spark, path) else None
    missing = wanted if known is None else wanted.join(known.select("content_hash", "ext"), ["content_hash", "ext"], "left_anti")
    fresh = cut(extract.facts_of(tree.join(missing.select("path"), "path", "left_semi")))
    stored = fresh.select("path", "content_hash", "language", "facts", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.lit(FACTS_VERSION).alias("version"))
    one = stored.dropDuplicates(["content_hash", "ext"]).drop("path")
    one.write.mode("append").partitionBy("version", "ext").parquet(path)
    if known is None:
        return fresh
    old = wanted.join(known.drop("version"), ["content_hash", "ext"]).select("path", "content_hash", "language", "facts")
    return old.unionByName(fresh).dropDuplicates(["path"])


def save(graph, tree: DataFrame, folder: str, surfaces: DataFrame | None = None) -> str:
    """Store a graph under the key of its tree, with the tree's listing and surfaces for the next run; the key."""
    key = tree_key(tree)
    for name in TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/snapshots/{key}/{name}")
    if surfaces is not None:
        surfaces.write.mode("overwrite").parquet(f"{folder}/snapshots/{key}/surfaces")
    listing = tree.select("path", "content_hash", *[F.col(c) for c in ("length", "modified") if c in tree.columns])
    if "modified" in tree.columns:
        cut(listing.withColumn("taken", F.current_timestamp())).write.mode("overwrite").parquet(f"{folder}/listing")
    return key


def load(spark: SparkSession, tree: DataFrame, folder: str):
    """The stored graph of exactly this tree, or None."""
    from ..plans.check import Graph

    base = f"{folder}/snapshots/{tree_key(tree)}"
    return Graph(*[spark.read.parquet(f"{base}/{name}") for name in TABLES]) if exists(spark, f"{base}/{TABLES[-1]}/_SUCCESS") else None


def _last(spark: SparkSession, folder: str) -> str | None:
    """The folder of the snapshot that was stored last and wholly."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshots")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s for s in (fs.listStatus(top) if fs.exists(top) else []) if exists(spark, f"{s.getPath().toString()}/{TABLES[-1]}/_SUCCESS")]
    return max(done, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString() if done else None


def latest(spark: SparkSession, folder: str):
    """The graph that was stored last, of whatever tree, or None."""
    from ..plans.check import Graph

    base = _last(spark, folder)
    return Graph(*[spark.read.parquet(f"{base}/{name}") for name in TABLES]) if base else None


def last_surfaces(spark: SparkSession, folder: str) -> DataFrame | None:
    base = _last(spark, folder)
    return spark.read.parquet(f"{base}/surfaces") if base and exists(spark, f"{base}/surfaces") else None


def last_listing(spark: SparkSession, folder: str) -> DataFrame | None:
    """(path, content_hash, length, modified, taken) of the tree that was stored last, or None."""
    return spark.read.parquet(f"{folder}/listing") if exists(spark, f"{folder}/listing") else None


def prune(spark: SparkSession, folder: str, most_bytes: int = 256 << 20) -> list[str]:
    """Delete the snapshots that were used longest ago until the rest fit; their names."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshots")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    entries = sorted(((s.getModificationTime(), s.getPath()) for s in fs.listStatus(top)), key=lambda e: -e[0])
    gone, held = [], 0
    for _, path in entries:
        held += fs.getContentSummary(path).getLength()
        if held > most_bytes:
            fs.delete(path, True)
            gone.append(path.getName())
    return gone


def trend(spark: SparkSession, score: DataFrame, folder: str) -> DataFrame:
    """(score, grade, previous): today's score with the last stored one, then stored itself."""
    path = f"{folder}/health"
    none = score.withColumn("previous", F.lit(None).cast("double"))
    if exists(spark, path):
        last = spark.read.parquet(path).agg(F.max_by("score", "at").alias("previous"))
        none = cut(score.join(F.broadcast(last), F.lit(True)))  # one row
    score.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    return none
