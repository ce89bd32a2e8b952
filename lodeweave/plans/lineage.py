"""Cutting lineage in iterative plans, in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
from math import ceil

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the folder named by spark.checkpoint.dir; only a local master may do without that setting."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodeweave-"))
    return df.checkpoint()


#: Rows of a part of a table that is dealt by key, at most, as long as no key has more.
ROWS_A_PART = 250_000


def parts_for(df: DataFrame, rows: int) -> int:
    """In how many parts a table of so many rows is dealt: all cores if they get some thousand rows each, more for large ones.

    Two at least: a single part would not count as dealt by a key.
    """
    return max(2, min(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / 5000)), ceil(rows / ROWS_A_PART))


#: How dealt tables are planned: ahead, and joined as they lie also where the keys of the join are more than those dealt by.
PLANNED = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def dealt(df: DataFrame, parts: int = 0, *keys: str) -> DataFrame:
    """cut() with the rows dealt by `keys` over `parts` parts: joins and groups by these keys of tables dealt alike move no row.

    Adaptive plans forget how rows are dealt, so this one is planned ahead. It should hold no other exchange than
    repartition() with a number, as nothing fits the parts of others to their size. Without parts, rows stay as they lie.
    """
    conf = df.sparkSession.conf
    was = {k: conf.get(k) for k in PLANNED}
    try:
        for k, v in PLANNED.items():
            conf.set(k, v)
        return cut(df.repartition(parts, *keys) if parts else df)
    finally:
        for k, v in was.items():
            conf.set(k, v)
