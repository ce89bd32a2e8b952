"""Coverage lines and the interval join that gives each function its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def accumulate(lines: DataFrame) -> DataFrame:
    """(path, line, hits) with the hits of repeated lines added up."""
    return lines.groupBy("path", "line").agg(F.sum("hits").alias("hits"))


def function_coverage(spans: DataFrame, lines: DataFrame, width: int = 256) -> DataFrame:
    """(id, instrumented, covered, coverage) of spans (id, path, first, last); coverage is null without lines.

    Both sides meet on (path, block of `width` lines), so that a long file doesn't make all pairs; a span lies in each
    block that it touches, a line in one.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.greatest("first", "last") / width))).alias("block")
    cells = spans.select("id", "path", "first", "last", blocks)
    met = cells.join(lines.withColumn("block", F.floor(F.col("line") / width)), ["path", "block"]).where("line between first and last")
    counted = met.groupBy("id").agg(F.count("*").alias("instrumented"), F.count_if(F.col("hits") > 0).alias("covered"))
    out = spans.select("id").join(counted, "id", "left")
    return out.select("id", F.coalesce("instrumented", F.lit(0)).alias("instrumented"), F.coalesce("covered", F.lit(0)).alias("covered"), (F.col("covered") / F.col("instrumented")).alias("coverage"))


def rebase(lines: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Lines with the first matching (prefix, replacement) applied to their path."""
    path = F.col("path")
    for prefix, put in reversed(prefixes):
        path = F.when(F.col("path").startswith(prefix), F.concat(F.lit(put), F.substring("path", len(prefix) + 1, 1 << 30))).otherwise(path)
    return lines.withColumn("path", path)


def rebase_by_package(lines: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of unknown paths put under a package's directory, where exactly one package then has such a file."""
    known = lines.join(files.select("path"), "path", "left_semi")
    other = lines.join(files.select("path"), "path", "left_anti")
    # an equi-join on the directories above each file
    above = files.select(F.col("path").alias("real"), F.explode(ancestors(F.col("path"))).alias("dir")).join(packages.select("dir").distinct(), "dir")
    dirs = above.select("real", F.when(F.col("dir") == "", F.col("real")).otherwise(F.expr("substring(real, length(dir) + 2)")).alias("path"))
    one = dirs.groupBy("path").agg(F.min("real").alias("real"), F.count_distinct("real").alias("n")).where("n = 1")
    return known.unionByName(other.join(one, "path").select(F.col("real").alias("path"), "line", "hits"))
