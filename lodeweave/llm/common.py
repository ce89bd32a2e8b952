"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a Java character class: space and U+0009 to U+000D.
SPACE_CLASS = r"[ \t-\r]"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. Where none is configured, a local master (tests) gets a temporary one; a cluster an
    error, as its executors share no local folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodeweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`: the optimizer can't inline a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to the Python workers, by rows and by bytes. The values are the same for
    every operator, so it doesn't matter which one sets them last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def md5_key(value: Column) -> Column:
    """The first 60 bits of md5 as a non-negative long; other SQL engines can compute the same."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")
