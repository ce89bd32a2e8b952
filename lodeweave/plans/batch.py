"""Navigation requests in batches: JSON lines in, one JSON envelope out for each, over one assembled graph."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import functions as F

from ..functions.paths import basename
from ..operators import analyses, coverage, navigate
from .check import Graph, Result

VERBS = ("find", "describe", "uses", "used-by", "trace", "impact", "explain")


def nav_edges(g: Graph, kinds: str = "all"):
    """Stated edges that navigation follows: imports, references, or all; wildcards never."""
    rows = g.edges.where("dst is not null and ekind <> 'wildcard'")
    if kinds == "imports":
        rows = rows.where("ekind = 'imports-file'")
    elif kinds == "references":
        rows = rows.where("ekind = 'references'")
    return rows.select("src", "dst", "confidence")


def answer(result: Result, request: dict) -> dict:
    """The envelope of one request: rows, how many were left out, and an error in place of a failure."""
    g, verb, limit = result.graph, request.get("verb"), int(request.get("limit", navigate.LIMIT))
    spark = g.files.sparkSession
    if verb not in VERBS:
        return {"request": request, "error": f"unknown verb {verb!r}", "rows": []}
    try:
        if verb == "explain":
            rows = [r.asDict() for r in result.findings.where(F.col("id") == request["id"]).collect()]
            return {"request": request, "rows": rows, "elided": 0, **({} if rows else {"error": "not found"})}
        if verb == "find":
            named = g.symbols.select(F.col("sym").alias("node"), "name", F.concat_ws(".", "member_of", "name").alias("label"), "kind", "language")
            files = g.files.select(F.col("path").alias("node"), basename(F.col("path")).alias("name"), F.col("path").alias("label"), F.lit("file").alias("kind"), "language")
            rows = named.unionByName(files)
            for key in ("kind", "language"):
                rows = rows.where(F.col(key) == request[key]) if request.get(key) else rows
            if request.get("color"):
                rows = rows.join(result.colors.where(F.col("color") == request["color"]).select("node"), "node", "left_semi")
            got = navigate.find(rows, request["text"], ["name", "label"], "node", limit).collect()
            every = navigate.find(rows, request["text"], ["name", "label"], "node", 1 << 30).select("node").join(rows, "node")
            counts = {key: {r[0] or "": r[1] for r in every.groupBy(key).count().collect()} for key in ("kind", "language")}  # a row for each kind and language
            return {"request": request, "rows": [{"node": r.node, "rank": r.rank} for r in got], "elided": (got[0].n_matches if got else 0) - len(got), "counts": counts}
        ids = [navigate.resolve(navigate.parse_selector(s), g.files, g.symbols) for s in request["selectors"]]
        if not all(ids):
            return {"request": request, "error": "not found", "rows": []}
        if any(len(i) > 1 for i in ids):
            return {"request": request, "error": "ambiguous", "rows": [{"node": n} for i in ids for n in i]}
        edges = nav_edges(g, request.get("edges", "all"))
        seeds = spark.createDataFrame([(i[0],) for i in ids], "node string")
        if verb == "trace":
            if len(ids) == 1:
                kind, hit = navigate.liveness_trace(edges, g.roots, ids[0][0])
                return {"request": request, "kind": kind, "rows": [r.asDict() for r in hit.collect()], "elided": 0}
            paths = navigate.trace_all(edges, ids[0][0], ids[1][0]) if request.get("all") else navigate.trace(edges, ids[0][0], ids[1][0])
            got = [r.path for r in paths.select("path").collect()]
            weakest = {tuple(p): _weakest(edges, p) for p in got}
            return {"request": request, "rows": [{"path": p, "weakest": weakest[tuple(p)]} for p in got], "elided": 0}
        if verb == "describe":
            rows = navigate.degrees(seeds, edges).join(result.colors, "node").collect()
            node = ids[0][0]
            roots = [r.asDict() for r in navigate.nearest_roots(edges, g.roots, node).collect()]
            path = node.split("#")[0]
            found = [r.asDict() for r in result.findings.where(F.col("path") == path).collect()]
            return {"request": request, "rows": [r.asDict() for r in rows], "roots": roots, "findings": found, "metrics": metrics(g, node), "elided": 0}
        if verb == "impact" and request.get("if_deleted"):
            table = navigate.impact_if_deleted(g.nodes(), g.all_edges(), g.roots, seeds)
        elif verb == "impact":
            table = navigate.impact(edges, seeds, g.roots)
        else:
            table = (navigate.uses if verb == "uses" else navigate.used_by)(edges, seeds, request.get("depth", 1))
        more = {}
        if verb == "impact" and request.get("if_deleted"):
            gone = g.symbols.select(F.col("sym").alias("node"), "path").join(seeds, "node").select("path").union(seeds.select("node")).distinct()
            used = g.imports.where("resolution = 'dependency'").select(F.col("target").alias("name"), "path")
            whole = gone.join(g.files.select("path"), "path", "left_semi").join(seeds, F.col("path") == F.col("node"), "left_semi")
            more["freed"] = sorted(r.name for r in navigate.freed_dependencies(used, g.declared, whole).collect())
            touched = table.join(g.symbols.select(F.col("sym").alias("node"), "package"), "node").groupBy("package").count().orderBy("package").collect()
            more["packages"] = {r.package: r["count"] for r in touched}
        total = table.count()
        order = ["depth", "node"] if "depth" in table.columns else ["node"]
        return {"request": request, "rows": [r.asDict() for r in table.orderBy(*order).limit(limit).collect()], "elided": max(0, total - limit), **more}
    except (KeyError, ValueError) as error:
        return {"request": request, "error": str(error), "rows": []}


def metrics(g: Graph, node: str) -> list[dict]:
    """Shapes of a symbol or of a file: complexity, lines, tokens, whether it only builds a value; crap only if measured."""
    path, _, rest = node.partition("#")
    own = g.shapes.where(F.col("path") == path)
    if rest:
        own = own.where((F.col("name") == rest.rpartition("@")[0]) & (F.col("first") == int(rest.rpartition("@")[2])))
    spans = own.select(F.concat("path", F.lit("#"), "name", F.lit("@"), F.col("first").cast("string")).alias("id"), "path", "first", "last")
    measured = coverage.function_coverage(spans, g.coverage).where("coverage is not null")
    rows = own.withColumn("id", F.concat("path", F.lit("#"), "name", F.lit("@"), F.col("first").cast("string"))).join(measured.select("id", "coverage"), "id", "left")
    score = F.when(F.col("coverage").isNotNull(), analyses.crap_score(F.col("cyclomatic"), F.col("coverage")))
    return [r.asDict() for r in rows.select("name", "first", "cyclomatic", "loc", F.size("tokens").alias("tokens"), "construction", "coverage", score.alias("crap")).orderBy("first").collect()]


def _weakest(edges, path: list[str]) -> int | None:
    """The least confidence of the steps of one path."""
    pairs = list(zip(path, path[1:], strict=False))
    if not pairs:
        return None
    steps = edges.sparkSession.createDataFrame(pairs, "src string, dst string")
    best = edges.join(F.broadcast(steps), ["src", "dst"]).groupBy("src", "dst").agg(F.max("confidence").alias("c"))  # a path's steps
    return best.agg(F.min("c")).first()[0]


def answer_lines(result: Result, lines: Iterable[str]) -> Iterator[str]:
    """One JSON line for each line that isn't blank; a line that can't be read gives an error of its own."""
    for line in lines:
        if line.strip():
            try:
                request = json.loads(line)
            except ValueError as error:
                yield json.dumps({"request": line.strip(), "error": str(error), "rows": []})
                continue
            yield json.dumps(answer(result, request))
