"""Command line: `python -m lodeweave.cli check|health|find|uses|used-by|trace|impact|baseline|doctor|init|plugin ROOT ...`.

Exit codes: check 0 clean, 1 findings at or over --fail-on (any with --strict) or a budget that is exceeded, 2 it could not
run; others 0, 1 nothing found, 2 an error. ROOT may be a folder, git:REPOSITORY@TREEISH or staged:REPOSITORY.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import health, navigate
from .operators.report import display_order
from .plans import batch, plugins
from .plans.check import analyse, assemble_graph, check, check_diff, check_staged, verdict
from .plans.lineage import cut
from .sources import config, discover, manifests, sinks, store

RANK = {"none": None, "info": 0, "warning": 1, "error": 2}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodeweave")
    sub = out.add_subparsers(dest="verb", required=True)
    for verb in ("check", "health", "find", "describe", "uses", "used-by", "trace", "impact", "baseline", "doctor", "query", "explain", "init", "plugin"):
        p = sub.add_parser(verb)
        p.add_argument("root")
        p.add_argument("arguments", nargs="*")
        p.add_argument("--format", choices=sorted(sinks.FORMATS), default="human")
        p.add_argument("--only", action="append", default=[])
        p.add_argument("--skip", action="append", default=[])
        p.add_argument("--fail-on", choices=sorted(RANK), default="none")
        p.add_argument("--diff")
        p.add_argument("--staged", action="store_true")
        p.add_argument("--strict", action="store_true")
        p.add_argument("--store")
        p.add_argument("--depth", type=int)
        p.add_argument("--baseline", default=".lodeweave-baseline.json")
        p.add_argument("--config", default="lodeweave.toml")
    return out


def settings_of(a: argparse.Namespace) -> config.Settings:
    path = Path(a.root) / a.config
    file = config.parse(path.read_text()) if path.exists() else config.Settings()
    return config.merge(file, config.Settings(skip=a.skip, only=a.only, fail_on=RANK[a.fail_on]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.verb == "init":
        path = Path(a.root) / a.config
        if path.exists():
            print(f"{path} exists", file=sys.stderr)
            return 2
        path.write_text(config.TEMPLATE)
        return 0
    spark = spark or SparkSession.builder.appName("lodeweave").config("spark.ui.enabled", "false").getOrCreate()
    settings = settings_of(a)
    say = lambda *x: print(*x, file=out)
    for problem in settings.problems:
        print("config:", problem, file=sys.stderr)
    baseline = Path(a.root) / a.baseline
    try:
        if a.verb == "check" and (a.diff or a.staged):
            delta = check_staged(spark, a.root, settings) if a.staged else check_diff(spark, a.root, a.diff, settings=settings)
            delta = cut(delta)
            for r in delta.orderBy("delta", "id").collect():
                say(r.delta, r.origin, r.category, r.id)
            new = delta.where("delta = 'new'").select("category", "severity", F.lit("").alias("path"))
            return int(verdict(new, delta, settings, a.strict).first().verdict == "fail")
        if a.verb in ("check", "health", "baseline", "query", "explain"):
            if a.verb == "baseline" and a.arguments[:1] != ["update"] and baseline.exists():
                raise ValueError(f"{baseline} exists: use baseline ROOT update")
            result = check(spark, a.root, settings, stored=a.store)
            if a.verb in ("query", "explain"):
                lines = sys.stdin if a.verb == "query" else [json.dumps({"verb": "explain", "id": a.arguments[0]})]
                answers = list(batch.answer_lines(result, lines))
                for line in answers:
                    say(line)
                return int(any("error" in json.loads(x) for x in answers))
            rows = [r.asDict() for r in display_order(result.findings).collect()]
            score = health.score(result.health).first().asDict()
            if a.verb == "health":
                say(json.dumps(score | {"packages": [r.asDict() for r in result.packages.orderBy("package").collect()]}))
                return 0
            if a.verb == "baseline":
                baseline.write_text(json.dumps(sorted(r["id"] for r in rows)))
                return 0
            known = set(json.loads(baseline.read_text())) if baseline.exists() else set()
            left = result.findings.join(spark.createDataFrame([(i,) for i in known], "id string"), "id", "left_anti")
            rows = [r for r in rows if r["id"] not in known]
            say(sinks.json_report(rows, score) if a.format == "json" else sinks.FORMATS[a.format](rows))
            return int(verdict(left, None, settings, a.strict).first().verdict == "fail")
        if a.verb == "plugin":
            tree = discover.discover_source(spark, a.root)
            rows = manifests.parse(tree).where("kind = 'dependency'").select("package", "name")
            on = {p.id for p in plugins.active(plugins.BUILTIN, tree.select("path"), rows)}
            for p in plugins.BUILTIN:
                say(p.id, "active" if p.id in on else "idle")
            return 0
        graph = assemble_graph(spark, discover.discover(spark, a.root), settings)
        if a.verb == "doctor":
            say(json.dumps({"files": graph.files.groupBy("language").count().toPandas().to_dict("records"), "symbols": graph.symbols.groupBy("language", "kind").count().toPandas().to_dict("records"), "plugins": [p.id for p in plugins.active(plugins.BUILTIN, graph.files.select("path"), graph.declared)], "stored": None if not a.store else store.latest(spark, a.store) is not None, "problems": [r.asDict() for r in graph.diagnostics.collect()]}))
            return 0
        if a.verb == "find":
            rows = navigate.find(graph.symbols.withColumn("label", F.concat_ws(".", "member_of", "name")), a.arguments[0], ["label", "name"], "sym").collect()
            for r in rows:
                say(r.sym)
            return int(not rows)
        nodes = [navigate.resolve(navigate.parse_selector(x), graph.files, graph.symbols) for x in a.arguments]
        if not nodes or not all(nodes):
            return 1
        edges = graph.edges.where("dst is not null and ekind <> 'wildcard'").select("src", "dst", "confidence")
        seeds = spark.createDataFrame([(n,) for n in nodes[0]], "node string")
        if a.verb == "trace":
            rows = navigate.trace(edges, nodes[0][0], nodes[1][0]).collect()
            for r in rows:
                say(" > ".join(r.path))
            return int(not rows)
        if a.verb == "describe":
            _, colors, _ = analyse(graph, settings)
            rows = navigate.degrees(seeds, edges).join(colors, "node").collect()
        elif a.verb == "impact":
            rows = navigate.impact(edges, seeds, graph.roots).orderBy("depth", "node").collect()
        else:
            rows = (navigate.uses if a.verb == "uses" else navigate.used_by)(edges, seeds, a.depth).orderBy("depth", "node").collect()
        for r in rows:
            say(json.dumps(r.asDict()))
        return int(not rows)
    except (OSError, ValueError, IndexError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
