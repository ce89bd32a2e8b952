"""Navigation: search, description, neighbours, paths, impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROOT_KINDS
from .graph import colors, reach, reverse, shortest_paths, simple_paths, widest_paths

LIMIT, PATHS = 50, 10


@dataclass(frozen=True)
class Selector:
    """What a text names: a file, a symbol in a file, a dependency, a package, or roots of a kind."""

    kind: str
    path: str | None = None
    name: str | None = None


def parse_selector(text: str) -> Selector:
    for prefix, kind in (("dep:", "dependency"), ("pkg:", "package"), ("roots:", "roots")):
        if text.startswith(prefix):
            name = text[len(prefix) :]
            if not name or (kind == "roots" and name not in ROOT_KINDS):
                raise ValueError(f"{text!r} names no {kind}")
            return Selector(kind, name=name)
    path, mark, name = text.partition("#")
    if not path or (mark and not name):
        raise ValueError(f"{text!r} is not a selector")
    return Selector("symbol", path, name) if mark else Selector("file", path)


def resolve(selector: Selector, files: DataFrame, symbols: DataFrame) -> list[str]:
    """Node ids that a file or symbol selector means: none, one, or several if it is ambiguous."""
    if selector.kind == "file":
        return [r.path for r in files.where(F.col("path") == selector.path).select("path").collect()]
    label = F.concat_ws(".", "member_of", "name")
    rows = symbols.where((F.col("path") == selector.path) & ((F.col("name") == selector.name) | (label == selector.name)))
    return sorted(r.sym for r in rows.select("sym").collect())


def match_rank(text: Column, wanted: str) -> Column:
    """0 equal, 1 prefix, 2 inside, null otherwise; case counts."""
    return F.when(text == wanted, 0).when(text.startswith(wanted), 1).when(F.contains(text, F.lit(wanted)), 2)


def find(rows: DataFrame, wanted: str, labels: list[str], key: str, limit: int = LIMIT) -> DataFrame:
    """(key, rank, n_matches): the best rank over `labels`, ordered by rank and key; n_matches counts before the limit."""
    rank = F.least(*[match_rank(F.col(c), wanted) for c in labels], F.lit(9))
    hits = rows.select(key, rank.alias("rank")).where("rank < 9").groupBy(key).agg(F.min("rank").alias("rank"))
    total = hits.agg(F.count("*").alias("n_matches"))
    return hits.orderBy("rank", key).limit(limit).join(F.broadcast(total), F.lit(True)).select(key, "rank", "n_matches")  # one row


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_n, in_n): stated edges from and to each node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_n"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_n"))
    return nodes.select("node").distinct().join(out, "node", "left").join(in_, "node", "left").select("node", F.coalesce("out_n", F.lit(0)).alias("out_n"), F.coalesce("in_n", F.lit(0)).alias("in_n"))


def nearest_roots(edges: DataFrame, roots: DataFrame, node: str, most: int = 10) -> DataFrame:
    """(node, kind, depth): roots that reach a node, the nearest first."""
    spark = edges.sparkSession
    back = reach(reverse(edges), spark.createDataFrame([(node,)], "node string"))
    return back.join(roots.select("node", "kind").distinct(), "node").orderBy("depth", "node", "kind").limit(most)


def uses(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth) of what the seeds use; the seeds themselves left out."""
    return reach(edges, seeds, depth).where("depth > 0")


def used_by(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    return uses(reverse(edges), seeds, depth)


def trace(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(node, depth, path) of the shortest path between two nodes; no row if there is none."""
    return shortest_paths(edges, start).where(F.col("node") == end)


def trace_all(edges: DataFrame, start: str, end: str, most: int = PATHS) -> DataFrame:
    """(path, complete): simple paths up to two nodes longer than the shortest, by length and names, `most` of them; complete
    is false if the search for them hit its bound."""
    return simple_paths(edges, start, end).orderBy(F.size("path"), "path").limit(most)


def liveness_trace(edges: DataFrame, roots: DataFrame, node: str) -> tuple[str | None, DataFrame]:
    """The kind of root that keeps a node alive (production, else test, else tooling) and its depths towards the node."""
    for kind in ROOT_KINDS:
        depths = reach(edges, roots.where(F.col("kind") == kind).select("node"))
        if not (hit := depths.where(F.col("node") == node)).isEmpty():
            return kind, hit
    return None, edges.select(F.col("src").alias("node"), F.lit(0).alias("depth")).limit(0)


def impact(edges: DataFrame, seeds: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth, is_root): all that depends on the seeds, and whether it is a root."""
    mark = roots.select("node").distinct().withColumn("is_root", F.lit(True))
    return reach(reverse(edges), seeds).join(mark, "node", "left").select("node", "depth", F.coalesce("is_root", F.lit(False)).alias("is_root"))


def impact_if_deleted(nodes: DataFrame, edges: DataFrame, roots: DataFrame, deleted: DataFrame) -> DataFrame:
    """(node, before, after): nodes whose colour changes when the deleted ones and all edges at them go."""
    gone = deleted.select(F.col("node").alias("gone")).distinct()
    left = edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    kept = roots.join(gone, F.col("node") == F.col("gone"), "left_anti")
    rest = nodes.join(gone, F.col("node") == F.col("gone"), "left_anti")
    was = colors(nodes, widest_paths(edges, roots)).select("node", F.col("color").alias("before"))
    now = colors(rest, widest_paths(left, kept)).select("node", F.col("color").alias("after"))
    return was.join(now, "node").where("before <> after")


def freed_dependencies(imports: DataFrame, declared: DataFrame, deleted: DataFrame) -> DataFrame:
    """(name): declared dependencies that only deleted files import."""
    before = imports.select("name").distinct()
    after = imports.join(deleted.select("path"), "path", "left_anti").select("name").distinct()
    return before.exceptAll(after).join(declared.select("name").distinct(), "name", "left_semi")
