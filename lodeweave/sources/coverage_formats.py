"""Coverage reports as (path, line, hits): lcov, Cobertura, JaCoCo, Go cover profiles.

Each takes rows with the whole `content` of one report. Text formats go line by line in the JVM; XML goes through the
`from_xml` reader there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Roots that a JVM source path may have. Fixed values.
JVM_ROOTS = ("", "src/main/java/", "src/main/kotlin/")



def parse_lcov(reports: DataFrame) -> DataFrame:
    """SF opens a file, DA:line,hits counts, end_of_record closes; all else is ignored."""
    rows = reports.select(F.explode(F.split("content", r"(?m)^end_of_record\s*$")).alias("part"))
    path = F.trim(F.regexp_extract("part", r"(?m)^SF:(.*)$", 1))
    hits = F.regexp_extract_all("part", F.lit(r"(?m)^DA:(\d+,\d+)"), 1)
    out = rows.select(path.alias("path"), F.explode(hits).alias("da")).where("path <> ''")
    return out.select("path", F.split("da", ",")[0].cast("int").alias("line"), F.split("da", ",")[1].cast("bigint").alias("hits"))


def parse_go(reports: DataFrame) -> DataFrame:
    """path:sl.sc,el.ec statements count: every line of a block gets the count; the mode line is skipped."""
    pattern = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    rows = reports.select(F.explode(F.split("content", r"\r?\n")).alias("text")).where(F.col("text").rlike(pattern))
    part = lambda i: F.regexp_extract("text", pattern, i)
    first, last = part(2).cast("int"), part(3).cast("int")
    return rows.select(part(1).alias("path"), F.explode(F.sequence(first, F.greatest(first, last))).alias("line"), part(4).cast("bigint").alias("hits"))


def _without_doctype(content):
    return F.regexp_replace(content, r"(?is)<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "")


def parse_cobertura(reports: DataFrame) -> DataFrame:
    """Lines of every class, under its file name and under the name below each source root."""
    schema = "sources struct<source:array<string>>, packages struct<package:array<struct<classes:struct<`class`:array<struct<_filename:string,lines:struct<line:array<struct<_number:int,_hits:bigint>>>>>>>>>"
    rows = reports.select(F.from_xml(_without_doctype(F.col("content")), schema).alias("x"))
    classes = rows.select(F.col("x.sources.source").alias("roots"), F.explode("x.packages.package").alias("p")).select("roots", F.explode("p.classes.class").alias("c"))
    name = F.col("c._filename")
    joined = F.transform(F.coalesce("roots", F.array().cast("array<string>")), lambda r: F.concat(F.regexp_replace(F.regexp_replace(r, r"^\./?|^\.$", ""), "/$", ""), F.lit("/"), name))
    paths = F.array_distinct(F.concat(F.array(name), F.transform(joined, lambda p: F.regexp_replace(p, "^/", ""))))
    lines = classes.select(F.explode(paths).alias("path"), F.col("c.lines.line").alias("lines")).select("path", F.explode("lines").alias("l"))
    return lines.select("path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"))


def parse_jacoco(reports: DataFrame, module: str = "") -> DataFrame:
    """Covered instructions of each line, under each source root that the file may have."""
    schema = "package array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>>>, `group` array<struct<package:array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>>>>>"
    rows = reports.select(F.from_xml(_without_doctype(F.col("content")), schema).alias("x"))
    empty = F.array().cast("array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>>>")
    packages = rows.select(F.explode(F.concat(F.coalesce("x.package", empty), F.coalesce(F.flatten(F.transform("x.group", lambda g: g["package"])), empty))).alias("p"))
    files = packages.select(F.concat_ws("/", F.nullif(F.col("p._name"), F.lit("")), F.lit("")).alias("dir"), F.explode("p.sourcefile").alias("s"))
    roots = F.explode(F.array(*[F.lit(module + r) for r in JVM_ROOTS])).alias("root")
    lines = files.select(roots, "dir", F.col("s._name").alias("name"), F.col("s.line").alias("lines")).select(F.concat("root", "dir", "name").alias("path"), F.explode("lines").alias("l"))
    return lines.select("path", F.col("l._nr").alias("line"), F.col("l._ci").alias("hits"))


def latest(reports: DataFrame, max_age_days: int = 7) -> DataFrame:
    """Reports (path, modified, content) that are young enough, each content once."""
    young = reports.where(F.col("modified") >= F.current_timestamp() - F.expr(f"interval {max_age_days} days"))
    return young.withColumn("nth", F.row_number().over(Window.partitionBy(F.md5("content")).orderBy("path"))).where("nth = 1").drop("nth")
