"""Graph operators on edge tables (src, dst, confidence), as checkpointed frontier loops of DataFrames.

A graph that one task can hold (by a count of its edges) is worked on by the kernels of local_graph. Beyond that, every
loop is semi-naive: a round joins only what changed with the edges, keeps what is new or better, and stops when
nothing is. Rounds end in a checkpoint, so that the plan of a round doesn't hold those before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, dealt, parts_for
from ..schema import COLORS, ROOT_KINDS
from . import local_graph as local


#: Steps along the edges that a round of a loop takes before its checkpoint: in the first rounds, which may reach much, and later.
HOPS, LATER_HOPS, FIRST_ROUNDS = 3, 6, 3
#: Shortcuts that any graph may have, however few edges it began with.
SHORTCUTS = 100_000


def _spread(edges: DataFrame, start: DataFrame, keys: list[str], along: Column, worse, best, steps: int | None = None, parts: int = 0) -> DataFrame:
    """(keys, value): the least fixpoint of `value` over the edges, `best` of all that arrive at a key.

    start: (keys, value), one of the keys being `node`; along: the value at the end of an edge, of `value` and the edge's
    columns; worse(a, b): a doesn't improve on b. Edges are dealt by their source once and the state by node, so that a
    step moves the values that it sends and nothing else; a round takes some steps and writes the state with what
    improved. At most `steps` steps are taken in all. No join is broadcast: each would pass through the driver. With `parts`,
    the edges are dealt already, over so many.
    """
    if not parts:
        parts = parts_for(edges, edges.count())
        edges = dealt(edges, parts, "src")
    state = dealt(start.select(*keys, "value", F.lit(True).alias("last")), parts, "node")
    taken = rounds = 0
    while (steps is None or taken < steps) and not (now := state.where("last").select(*keys, "value")).isEmpty():
        hops = []
        n = HOPS if rounds < FIRST_ROUNDS else LATER_HOPS
        n = n if steps is None else min(n, steps - taken)
        known = state.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("value").alias("old")).hint("shuffle_hash")
        old = [F.col(k) == F.col(f"k_{k}") for k in keys]
        for hop in range(n):
            step = edges.join(now.hint("shuffle_hash"), now.node == edges.src).select(*[k for k in keys if k != "node"], F.col("dst").alias("node"), along.alias("value"))
            now = step.repartition(parts, "node").groupBy(*keys).agg(best("value").alias("value"))
            now = now.join(known, [*old, worse(F.col("value"), F.col("old"))], "left_anti").select(*keys, "value")
            hops.append(now.withColumn("hop", F.lit(hop)))
        # the best of the round; of equals the earliest, whose own steps have been taken. What was known is of no step.
        both = reduce(DataFrame.union, hops, state.select(*keys, "value", F.lit(-1).alias("hop"))).repartition(parts, "node")
        both = both.groupBy(*keys, "value").agg(F.min("hop").alias("hop")).groupBy(*keys).agg(best("value").alias("value"), (F.min_by if best is F.min else F.max_by)("hop", "value").alias("hop"))
        state = dealt(both.select(*keys, "value", (F.col("hop") == n - 1).alias("last")))
        taken += n
        rounds += 1
    return state.select(*keys, "value")


def widest_paths(edges: DataFrame, seeds: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(kind, node, confidence): the best bottleneck confidence over all paths from a kind's seeds.

    seeds: (kind, node, confidence). One loop serves all kinds and all confidence tiers: a node is reached at tier t from
    a kind exactly if its value is t or more. Values only rise in a three-step order, so a node changes three times at
    most per kind. A graph of at most `most_edges` edges (local_graph.MOST_EDGES if not given) is worked on in one task.
    """
    edges = cut(edges.select("src", "dst", "confidence"))
    parts = parts_for(edges, edges.count())
    edges = dealt(edges.repartition(parts, "src").groupBy("src", "dst").agg(F.max("confidence").alias("via")))
    best = cut(seeds.groupBy("kind", "node").agg(F.max("confidence").cast("int").alias("confidence")))
    if local.is_small(edges, best, most=most_edges):
        return cut(local.in_one_task(edges, best, local.widest, "kind string,node string,confidence int"))
    start = best.withColumnRenamed("confidence", "value")
    out = _spread(edges, start, ["kind", "node"], F.least("value", "via"), lambda a, b: a <= b, F.max, parts=parts)
    return cut(out.withColumnRenamed("value", "confidence"))


def colors(nodes: DataFrame, widest: DataFrame) -> DataFrame:
    """(node, color, confidence, in_production, in_test, in_tooling): the first kind in precedence that reaches a node.

    Nodes that no root reaches are unreachable, with certain confidence.
    """
    of = {k: F.max(F.when(F.col("kind") == k, F.col("confidence"))).alias(k) for k in ROOT_KINDS}
    parts = parts_for(nodes, nodes.count())
    wide = nodes.select("node").repartition(parts, "node").distinct().join(widest.repartition(parts, "node").hint("merge"), "node", "left").groupBy("node").agg(*of.values())
    color = reduce(lambda c, k: c.when(F.col(k).isNotNull(), COLORS[k]), ROOT_KINDS, F.when(F.lit(False), ""))
    return wide.select("node", color.otherwise("unreachable").alias("color"), F.coalesce(*ROOT_KINDS, F.lit(2)).cast("int").alias("confidence"), *[F.col(k).isNotNull().alias(f"in_{k}") for k in ROOT_KINDS])


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, most_edges: int | None = None) -> DataFrame:
    """(node, depth): least number of steps from any seed (depth 0) along src -> dst."""
    edges = cut(edges.select("src", "dst").distinct())
    if local.is_small(edges, start := cut(seeds.select("node").distinct()), most=most_edges):
        return cut(local.in_one_task(edges, start, local.depths(max_depth), "node string,depth int"))
    out = _spread(edges, start.withColumn("value", F.lit(0)), ["node"], F.col("value") + 1, lambda a, b: a >= b, F.min, max_depth)
    return cut(out.withColumnRenamed("value", "depth"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst): all pairs joined by one or more steps, by doubling. For small graphs: the result may be quadratic."""
    paths = cut(edges.select("src", "dst").distinct())
    n = paths.count()
    for _ in range(max_rounds):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        paths = cut(paths.union(longer).distinct())
        if (m := paths.count()) == n:
            break
        n = m
    return paths


def shortest_paths(edges: DataFrame, seed: str) -> DataFrame:
    """(node, depth, path): a shortest path from one seed to each node it reaches, the least by names among the shortest."""
    edges = cut(edges.select("src", "dst").distinct())
    spark = edges.sparkSession
    seen = cut(spark.createDataFrame([(seed, 0, [seed])], "node string, depth int, path array<string>"))
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min(F.struct("path", "depth")).alias("best")).select("node", "best.depth", "best.path"))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, start: str, end: str, slack: int = 2, most: int | None = 20_000, longest: int | None = None) -> DataFrame:
    """(path, complete): paths without repeated nodes from start to end, up to `slack` nodes longer than the shortest.

    Of at most `longest` nodes, if given. A node that can no longer reach the end in time is not expanded. `most` bounds the
    expansions of the whole search, as its safety valve; where it is reached, the first by names are expanded, so that a cut
    result is the same each time, and `complete` is false on every row. With most=None there is no bound.
    """
    edges = cut(edges.select("src", "dst").distinct().where("src <> dst"))
    spark = edges.sparkSession
    to_end = cut(reach(reverse(edges), spark.createDataFrame([(end,)], "node string")))
    first = to_end.where(F.col("node") == start).first()
    found = spark.createDataFrame([], "path array<string>")
    limit, left, complete = first.depth + slack if first else -1, most, True
    if longest is not None:
        limit = min(limit, longest - 1)
    frontier = spark.createDataFrame([([start],)], "path array<string>")
    for depth in range(limit + 1):
        last = F.element_at("path", -1)
        found = found.union(frontier.where(last == end))
        if depth == limit:
            break
        step = frontier.where(last != end).withColumn("src", last).join(edges, "src").where(~F.array_contains("path", F.col("dst")))
        step = step.join(to_end, step.dst == to_end.node).where(F.col("depth") + depth + 1 <= limit)
        frontier = cut(step.select(F.concat("path", F.array("dst")).alias("path")))
        if left is not None:
            n = frontier.count()
            if n > left:
                complete, frontier = False, cut(frontier.orderBy("path").limit(left))
            left -= min(n, left)
    return found.withColumn("complete", F.lit(complete))


def components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(node, component): least node name of each connected component of the undirected graph.

    Beyond one task's graphs, each round hooks every node's neighbours to the least node around it and then halves the
    paths to the roots, so the number of rounds grows with the logarithm of the graph's width, not with the width.
    """
    edges = cut(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType.simpleString()
    if local.is_small(edges, most=most_edges) and kind == "string":
        return cut(local.in_one_task(edges, edges.limit(0), local.least_in_component, "node string,component string"))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    links, before = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()), None
    while (now := links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != before and now[0]:
        before = now
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m"))
        around = around.select("u", F.least("u", "m").alias("m"))
        hooked = links.select(F.col("v").alias("at"), "u").join(around.withColumnRenamed("u", "at"), "at").select("u", F.col("m").alias("v"))
        hooked = hooked.union(around.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        lower = hooked.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(hooked.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct())
    return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _trimmed(edges: DataFrame, n: int, enough: int) -> tuple[DataFrame, int]:
    """Edges between nodes that have edges both in and out, and their number: until `enough` are left, or few more would go."""
    parts = parts_for(edges, n)
    left = dealt(edges, parts, "dst")
    while n > enough:
        for _ in range(2):
            entered = left.select(F.col("dst").alias("node")).distinct()
            left = left.repartition(parts, "src").join(entered.hint("shuffle_hash"), F.col("src") == F.col("node"), "left_semi")
            leaves = left.select(F.col("src").alias("node")).distinct()
            left = left.repartition(parts, "dst").join(leaves.hint("shuffle_hash"), F.col("dst") == F.col("node"), "left_semi")
        left, before = dealt(left), n
        n = left.count()
        if before - n < before / 5:
            break
    return left, n


def _shortcuts(edges: DataFrame, n: int, most: int) -> DataFrame:
    """The edges with ways of two, four and so on steps along them, while there are at most `most`: what reaches what stays."""
    while True:
        fan = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("a")).join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("b")).hint("shuffle_hash"), "node")
        if n + (fan.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) > most:
            return edges
        after = edges.select(F.col("src").alias("dst"), F.col("dst").alias("end")).hint("shuffle_hash")
        edges, before = cut(edges.union(edges.join(after, "dst").select("src", "end").where("src <> end")).distinct()), n
        n = edges.count()
        if n == before:
            return edges


def strong_components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(node, component): nodes on a cycle of two or more, with the least node name of their strong component.

    Nodes without an edge in or out are trimmed. The least label is then sent both forward and backward, along shortcuts
    where the trimmed graph leaves room for them; where both that arrive are one, it is the component. What is left, edges
    between nodes with other labels left out, goes around again, in one task as soon as it is small enough.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    most = (local.MOST_EDGES if most_edges is None else most_edges) if left.schema["src"].dataType.simpleString() == "string" else -1
    parts: list[DataFrame] = []
    n = room = left.count()
    while n:
        if n > most:
            left, n = _trimmed(left, n, max(most, 0))
        if n <= most:
            parts.append(cut(local.in_one_task(left, left.limit(0), local.strong, "node string,component string")))
            break
        near = _shortcuts(left, n, max(room, SHORTCUTS))
        at = lambda way, name: F.struct(F.lit(way).alias("way"), F.col(name).alias("name"))
        ways = near.select(at(0, "src").alias("src"), at(0, "dst").alias("dst")).union(near.select(at(1, "dst"), at(1, "src")))
        nodes = left.select(F.col("src").alias("name")).union(left.select("dst")).distinct()
        start = nodes.select(at(0, "name").alias("node"), F.col("name").alias("value")).union(nodes.select(at(1, "name"), "name"))
        label = _spread(cut(ways), cut(start), ["node"], F.col("value"), lambda a, b: a >= b, F.min)
        from_, to = (F.max(F.when(F.col("node.way") == way, F.col("value"))) for way in (0, 1))
        label = cut(label.groupBy(F.col("node.name").alias("node")).agg(from_.alias("a"), to.alias("b")))
        parts.append(label.where("a = b").select("node", F.col("a").alias("component")))
        rest = label.where("a <> b")
        inside = left.join(rest.toDF("src", "a", "b").hint("shuffle_hash"), "src").join(rest.toDF("dst", "c", "d").hint("shuffle_hash"), "dst")
        left = cut(inside.where("a = c and b = d").select("src", "dst"))
        n = left.count()
    if not parts:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    out = cut(reduce(DataFrame.unionByName, parts))
    sized = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(sized.hint("shuffle_hash"), "component", "left_semi").select("node", "component")


def weakest(path_edges: DataFrame, by: list[str], confidence: Column) -> DataFrame:
    """The least confidence on each path."""
    return path_edges.groupBy(*by).agg(F.min(confidence).alias("confidence"))
