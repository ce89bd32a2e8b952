"""Incremental refresh: edges are replaced by owner, in batch or for each batch of a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A patch is tried only if at most a twentieth of the files changed.
MOST_CHANGED = 20


def replace_owned(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """`edges` without those that a changed owner holds, with the `fresh` ones of these owners."""
    return edges.join(changed.select("owner").distinct(), "owner", "left_anti").select(*edges.columns).unionByName(fresh.select(*edges.columns))


def can_patch(before: DataFrame, after: DataFrame) -> bool:
    """Whether a patch gives what a full run would: same files, few changes, same surfaces of the changed.

    Both: (path, content_hash, surface, is_manifest).
    """
    b = before.select("path", F.col("content_hash").alias("was"), F.col("surface").alias("s0"), F.col("is_manifest").alias("m0"))
    met = b.join(after, "path", "full")
    changed = ~F.col("was").eqNullSafe(F.col("content_hash"))
    row = met.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("was").isNull() | F.col("content_hash").isNull()).alias("other"),
        F.count_if(changed).alias("changed"),
        F.count_if(changed & (F.coalesce("m0", F.lit(False)) | ~F.col("s0").eqNullSafe(F.col("surface")))).alias("surface"),
    ).first()
    return not row.other and not row.surface and row.changed * MOST_CHANGED <= row.n


def watch(spark: SparkSession, changes: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream over a folder of change files; `apply` gets each batch of (owner, edge...) rows, to merge by owner."""
    stream = spark.readStream.schema(schema).parquet(changes)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
