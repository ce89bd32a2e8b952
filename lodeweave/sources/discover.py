"""Files of a source tree: from a folder that Spark can list, or from a git tree."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import glob_to_regex

IGNORE_FILES = (".gitignore", ".ignore")
SNAPSHOT_RAW = "path string, length bigint, modified timestamp, content binary"


def ignore_pattern(line: str, folder: str) -> tuple[str, bool] | None:
    """(regex on paths, whether it takes back) of one line of an ignore file in `folder`; None for a blank or a comment."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.lstrip("!")
    only_dir, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    base = "".join("\\" + c if c in r"\.^$+()[]{}|*?" else c for c in folder + "/" if folder)
    body = glob_to_regex(line)[1:-1]
    return f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", back


def _ignored(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    """Whether the last rule that matches a path ignores it."""
    return next((not back for regex, back in reversed(rules) if regex.search(path)), False)


def _hidden(path: str) -> bool:
    return any(part.startswith(".") for part in path.split("/"))


def _keep(paths: list[str], texts: dict[str, str]) -> list[str]:
    """Paths that are neither hidden nor ignored; texts: the contents of the ignore files by path."""
    order = sorted(texts, key=lambda p: (p.count("/"), p))
    rules = [(re.compile(r[0]), r[1]) for p in order for line in texts[p].splitlines() if (r := ignore_pattern(line, p.rpartition("/")[0]))]
    return [p for p in paths if not _hidden(p) and not _ignored(p, rules)]


def _listing(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """The root's address and the paths of all files below it, listed on the driver."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/")
    if base.startswith("file:"):
        folder = "/" + base[5:].lstrip("/")
        return "file://" + folder, [os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if "/.git" not in d]
    out, files = [], fs.listFiles(top, True)
    while files.hasNext():
        out.append(files.next().getPath().toString()[len(base) + 1 :])
    return base, out


def _read(spark: SparkSession, address: str) -> bytes:
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def discover(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder that no ignore file excludes, hashed; hidden ones are left out.

    Names are listed and filtered on the driver, contents are read by the executors. Spark's reader passes over names
    that begin with an underscore; those few are read one by one.
    """
    base, paths = _listing(spark, root)
    texts = {p: _read(spark, f"{base}/{p}").decode("utf-8", "replace") for p in paths if p.rpartition("/")[2] in IGNORE_FILES}
    kept = _keep(paths, texts)
    odd = [p for p in kept if p.rpartition("/")[2].startswith("_")]
    rows = spark.createDataFrame([(p, None, None, _read(spark, f"{base}/{p}")) for p in odd], SNAPSHOT_RAW)
    plain = [f"{base}/{p}" for p in kept if not p.rpartition("/")[2].startswith("_")]
    if plain:
        full = F.regexp_replace("path", r"^[a-z]+:/*", "/")
        short = F.expr(f"substring(full, {len('/' + base.split(':', 1)[-1].strip('/')) + 2})")
        raw = spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in plain])
        rows = rows.unionByName(raw.withColumn("full", full).select(short.alias("path"), "length", F.col("modificationTime").alias("modified"), "content"))
    return rows.select("path", F.sha2("content", 256).alias("content_hash"), "length", "modified", "content")


def discover_with_stat(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """discover(), with the hashes of files whose time and length are as in the listing stored in `folder` taken from there:
    their contents are read only by who asks for them."""
    from .store import last_listing

    files, listing = discover(spark, root), last_listing(spark, folder)
    if listing is None:
        return files
    known = unchanged(files.select("path", "length", "modified"), listing)
    return files.join(known, "path", "left").withColumn("content_hash", F.when(F.col("known_hash").isNotNull(), F.col("known_hash")).otherwise(F.col("content_hash"))).drop("known_hash")


def git(repository: str, *arguments: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repository, *arguments], input=data, capture_output=True, check=True).stdout


def merge_base(repository: str, a: str, b: str = "HEAD") -> str:
    return git(repository, "merge-base", a, b).decode().strip()


def write_tree(repository: str) -> str:
    """The id of the tree that is staged."""
    return git(repository, "write-tree").decode().strip()


def _blobs(repository: str, ids: list[str]) -> list[bytes]:
    """Contents of the blobs, in order, by one call."""
    out, at, found = git(repository, "cat-file", "--batch", data="".join(f"{o}\n" for o in ids).encode()) if ids else b"", 0, []
    for _ in ids:
        end = out.index(b"\n", at)
        size = int(out[at:end].split()[2])
        found.append(out[end + 1 : end + 1 + size])
        at = end + 2 + size
    return found


def discover_git(spark: SparkSession, repository: str, treeish: str, prefix: str = "") -> DataFrame:
    """The files of a commit or tree, below `prefix`, as discover() gives them.

    Names and ignore files are read on the driver; blobs by the executors, which must see the repository under its path."""
    listing = git(repository, "ls-tree", "-r", "-z", treeish, *([prefix] if prefix else [])).decode()
    entries = {e.split("\t", 1)[1][len(prefix) :].lstrip("/"): e.split()[2] for e in listing.split("\0") if e and e.split()[1] == "blob"}
    rules = [p for p in entries if p.rpartition("/")[2] in IGNORE_FILES]
    texts = dict(zip(rules, (b.decode("utf-8", "replace") for b in _blobs(repository, [entries[p] for p in rules])), strict=True))
    kept = _keep(list(entries), texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = _blobs(repository, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], ["path", "length", "content"])

    rows = spark.createDataFrame([(p, entries[p]) for p in kept], "path string, blob string").mapInArrow(run, "path string, length bigint, content binary")
    return rows.select("path", F.sha2("content", 256).alias("content_hash"), "length", F.lit(None).cast("timestamp").alias("modified"), "content")


def discover_source(spark: SparkSession, source: str, stored: str | None = None) -> DataFrame:
    """The files of any source: `git:REPOSITORY@TREEISH`, `staged:REPOSITORY`, or a folder on any store."""
    kind, _, rest = source.partition(":")
    if kind == "git":
        repository, _, treeish = rest.rpartition("@")
        return discover_git(spark, repository, treeish)
    if kind == "staged":
        return discover_git(spark, rest, write_tree(rest))
    return discover(spark, source) if stored is None else discover_with_stat(spark, source, stored)


def named(files: DataFrame, names: list[str]) -> DataFrame:
    return files.where(F.regexp_extract("path", r"([^/]*)$", 1).isin(*names))


def unchanged(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Paths whose time and length are those of a snapshot taken later than the file's time: their hash is known."""
    known = snapshot.select("path", "length", "modified", F.col("content_hash").alias("known_hash"), "taken")
    return files.join(known, ["path", "length", "modified"]).where("modified < taken").select("path", "known_hash")


def missing_facts(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose facts are not cached, by content and extractor version (language, version, content_hash)."""
    return files.join(cached.select("language", "version", "content_hash"), ["language", "version", "content_hash"], "left_anti")


def tree_key(files: DataFrame) -> str:
    """A digest of a whole tree, to name its snapshot by: added up from the files, so no task sees them all."""
    parts = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", "content_hash"), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    row = files.agg(*[p.alias(f"k{i}") for i, p in enumerate(parts)], F.count("*").alias("n")).first()
    return f"{row.n:x}-" + reduce(lambda a, k: a + f"{int(k or 0):x}.", row[:4], "").strip(".")
