import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import graph, local_graph, navigate

EDGE = "src string, dst string, confidence int"


def random_graph(seed, n=14, m=26):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.randrange(3)) for _ in range(m)]
    roots = [(r.choice(graph.ROOT_KINDS), f"n{r.randrange(n)}", r.randrange(3)) for _ in range(4)]
    return edges, roots


@pytest.fixture(params=["one task", "distributed"])
def path(request, monkeypatch):
    if request.param == "distributed":
        monkeypatch.setattr(local_graph, "MOST_EDGES", -1)
    return request.param


def nine_searches(edges, roots, nodes):
    """The literal definition: a breadth-first search per kind and tier, then the first colour, then the strongest tier."""
    out = {}
    reach = {}
    for kind, tier in product(graph.ROOT_KINDS, (2, 1, 0)):
        seen = {n for k, n, c in roots if k == kind and c >= tier}
        while True:
            more = {d for s, d, c in edges if s in seen and c >= tier} - seen
            if not more:
                break
            seen |= more
        reach[kind, tier] = seen
    for n in nodes:
        for kind in graph.ROOT_KINDS:
            if n in reach[kind, 0]:
                out[n] = (graph.COLORS[kind], max(t for t in (0, 1, 2) if n in reach[kind, t]))
                break
        else:
            out[n] = ("unreachable", 2)
    return out, {k: reach[k, 0] for k in graph.ROOT_KINDS}


@pytest.mark.parametrize("seed", range(2))
def test_colors_equal_nine_searches(spark, path, seed):
    edges, roots = random_graph(seed)
    nodes = [f"n{i}" for i in range(14)]
    df = spark.createDataFrame(edges, EDGE)
    got = graph.colors(spark.createDataFrame([(n,) for n in nodes], "node string"), graph.widest_paths(df, spark.createDataFrame(roots, "kind string, node string, confidence int"))).collect()
    want, member = nine_searches(edges, roots, nodes)
    assert {r.node: (r.color, r.confidence) for r in got} == want
    assert all(r[f"in_{k}"] == (r.node in member[k]) for r in got for k in graph.ROOT_KINDS)


def test_weakest_link_and_precedence(spark, path):
    df = spark.createDataFrame([("a", "b", 2), ("b", "c", 0), ("t", "c", 2)], EDGE)
    roots = spark.createDataFrame([("production", "a", 2), ("test", "t", 2)], "kind string, node string, confidence int")
    nodes = spark.createDataFrame([("c",), ("x",)], "node string")
    got = {r.node: (r.color, r.confidence) for r in graph.colors(nodes, graph.widest_paths(df, roots)).collect()}
    assert got == {"c": ("production", 0), "x": ("unreachable", 2)}


def test_depths_components_and_cycles(spark, path):
    edges, _ = random_graph(5, m=20)
    df = spark.createDataFrame(edges, EDGE)
    after = {}
    for s, d, _ in edges:
        after.setdefault(s, set()).add(d)
    want, frontier, depth = {"n1": 0}, {"n1"}, 0
    while frontier:
        depth += 1
        frontier = {d for s in frontier for d in after.get(s, ())} - want.keys()
        want |= dict.fromkeys(frontier, depth)
    got = {r.node: r.depth for r in graph.reach(df, spark.createDataFrame([("n1",)], "node string")).collect()}
    assert got == want
    closure = {(r.src, r.dst) for r in graph.closure(df).collect()}
    strong = {}
    for r in graph.strong_components(df).collect():
        strong.setdefault(r.component, set()).add(r.node)
    names = {n for e in edges for n in e[:2]}
    expect = {frozenset({x} | {y for y in names if (x, y) in closure and (y, x) in closure}) for x in names}
    assert {frozenset(v) for v in strong.values()} == {e for e in expect if len(e) > 1}
    assert all(k == min(v) for k, v in strong.items())
    parts = {}
    for r in graph.components(df).collect():
        parts.setdefault(r.component, set()).add(r.node)
    assert {n for v in parts.values() for n in v} == names and all(k == min(v) for k, v in parts.items())
    assert not any({s, d} & a and {s, d} - a for a in parts.values() for s, d, _ in edges)


def test_paths(spark):
    edges = [("a", "b", 2), ("b", "d", 2), ("a", "c", 2), ("c", "d", 1), ("d", "a", 2), ("c", "e", 2), ("e", "b", 0)]
    df = spark.createDataFrame(edges, EDGE)
    assert navigate.trace(df, "a", "d").first().path == ["a", "b", "d"]
    assert [r.path for r in navigate.trace_all(df, "a", "d").collect()] == [["a", "b", "d"], ["a", "c", "d"], ["a", "c", "e", "b", "d"]]
    assert navigate.trace(df, "b", "zz").count() == 0 and graph.simple_paths(df, "zz", "a").count() == 0


def test_navigation(spark):
    df = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("r", "a", 2)], EDGE)
    seed = spark.createDataFrame([("b",)], "node string")
    roots = spark.createDataFrame([("production", "r", 2)], "kind string, node string, confidence int")
    assert {(r.node, r.depth) for r in navigate.used_by(df, seed).collect()} == {("a", 1), ("r", 2)}
    assert {(r.node, r.is_root) for r in navigate.impact(df, seed, roots).collect()} == {("b", False), ("a", False), ("r", True)}
    nodes = spark.createDataFrame([(x,) for x in "abcr"], "node string")
    flips = {(r.node, r.before, r.after) for r in navigate.impact_if_deleted(nodes, df, roots, seed).collect()}
    assert flips == {("c", "production", "unreachable")}
    kind, hit = navigate.liveness_trace(df, roots, "c")
    assert kind == "production" and hit.first().depth == 3
    assert navigate.nearest_roots(df, roots, "c").first().node == "r"
    assert navigate.parse_selector("a/b.ts#C.d") == navigate.Selector("symbol", "a/b.ts", "C.d")
    assert navigate.parse_selector("dep:x").kind == "dependency"
    for bad in ("", "roots:none", "a#"):
        with pytest.raises(ValueError):
            navigate.parse_selector(bad)
    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "xab"), (4, "q")], "k int, n string")
    assert [(r.k, r.rank, r.n_matches) for r in navigate.find(rows, "ab", ["n"], "k", 2).collect()] == [(1, 0, 3), (2, 1, 3)]
    assert F is not None


@pytest.fixture
def plans(monkeypatch):
    """The plans of all checkpoints, as they are written."""
    from pyspark.sql.classic.dataframe import DataFrame

    out, write = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a: (out.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a))[1])
    return out


def test_a_long_ring_takes_few_rounds(spark, plans):
    ring = spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % 150:03}", 2) for i in range(150)] + [("n000", "z", 2), ("y", "n000", 2)], EDGE)
    got = graph.strong_components(ring, most_edges=-1).collect()
    assert len(got) == 150 and {r.component for r in got} == {"n000"}
    assert len(plans) < 20


def test_rounds_move_what_improves_and_broadcast_nothing(spark, plans):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 2) for i in range(12)], EDGE)
    got = graph.reach(edges, spark.createDataFrame([("n0",)], "node string"), most_edges=-1)
    assert {(r.node, r.depth) for r in got.collect()} == {(f"n{i}", i) for i in range(13)}
    rounds = [p for p in plans if "LeftAnti" in p]
    assert rounds and not any("Broadcast" in p or "ENSURE_REQUIREMENTS" in p for p in rounds)


def test_all_paths_are_those_of_its_sql(spark, tmp_path):
    """The SQL counts paths of at most six nodes; here the shortest has five, and two nodes more would be seven."""
    from lodeweave.plans import catalogue

    strong = [(0, 1), (1, 2), (2, 3), (3, 9), (2, 6), (6, 3), (2, 4), (4, 5), (5, 3)]
    lines = [p for p in strong for _ in range(10)] + [(b, a) for a, b in strong]
    tables = {
        "lineitem": ([(i, s) for i, (s, _) in enumerate(lines)], "l_orderkey long, l_suppkey long"), "orders": ([(i, c) for i, (_, c) in enumerate(lines)], "o_orderkey long, o_custkey long"),
        "customer": ([(i, i) for i in range(10)], "c_custkey long, c_nationkey int"), "supplier": ([(i, i) for i in range(10)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.path for r in catalogue.QUERIES["trace_all_paths"](spark, str(tmp_path)).collect()}
    assert got == {"n:0 > n:1 > n:2 > n:3 > n:9", "n:0 > n:1 > n:2 > n:6 > n:3 > n:9"}


def test_shortest_cycles_up_to_a_length_broadcast_nothing(spark, plans):
    from lodeweave.operators import analyses

    edges = spark.createDataFrame([(f"n{i:02}", f"n{(i + 1) % 13:02}") for i in range(13)] + [("x", "y"), ("y", "x")], "src string, dst string")
    groups = spark.createDataFrame([("n00",), ("x",)], "anchor string")
    members = spark.createDataFrame([(f"n{i:02}", "n00") for i in range(13)] + [("x", "x"), ("y", "x")], "node string, component string")
    assert {r.anchor: len(r.cycle) for r in analyses.shortest_cycles(edges, groups, members).collect()} == {"n00": 14, "x": 3}
    assert {r.anchor: len(r.cycle) for r in analyses.shortest_cycles(edges, groups, members, longest=12).collect()} == {"x": 3}
    assert not any("Broadcast" in p for p in plans)


def test_colours_of_many_nodes_are_dealt_by_their_number(spark, monkeypatch):
    from lodeweave.plans import lineage

    monkeypatch.setattr(lineage, "ROWS_A_PART", 10)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(100)], "node string")
    widest = spark.createDataFrame([("test", "n7", 1)], "kind string, node string, confidence int")
    plan = graph.colors(nodes, widest)._jdf.queryExecution().executedPlan().toString()
    assert "node" in plan and ", 10), REPARTITION_BY_NUM" in plan and "Broadcast" not in plan
