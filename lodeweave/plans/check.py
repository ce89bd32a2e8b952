"""A whole run over a source tree: files to facts, facts to a graph, the graph to findings and health."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fingerprints import finding_id, grams, winnow
from ..functions.paths import ancestors, dirname, extension, origin, role
from ..operators import analyses, assemble, coverage, graph, health, report
from ..schema import CERTAIN, POSSIBLE, PROBABLE, PUBLIC, SEVERITY
from ..sources import coverage_formats, discover, extract, manifests
from ..sources.config import Settings
from ..streaming.incremental import can_patch, replace_owned
from . import plugins
from .lineage import cut

#: Directories of tests directly below a package, and by language what belongs to the standard library. Fixed values.
TEST_DIRS = ["test", "tests", "__tests__", "spec", "androidTest", "Tests"]
LIBRARIES = {"rust": ["std.", "core.", "alloc."], "java": ["java.", "javax.", "jdk."], "kotlin": ["kotlin.", "java.", "javax.", "kotlinx."], "swift": ["Foundation", "UIKit", "SwiftUI", "Swift", "Combine", "XCTest", "Dispatch"]}
#: Script modules of the runtime. Fixed values.
STDLIB = "assert buffer child_process cluster console crypto dgram dns events fs http http2 https module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split()


def none():
    return F.lit(None).cast("string")


#: Visibility rungs by language, from the narrowest: the scope of each. Fixed values.
LADDERS = {"js": (0, 3, 4), "go": (1, 3, 4), "java": (0, 1, 4, 4), "kotlin": (0, 3, 4, 4), "rust": (2, 2, 3, 4), "swift": (0, 0, 3, 4, 4)}


def ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, s) for k, scopes in LADDERS.items() for i, s in enumerate(scopes)], "language string, idx int, scope int")


@dataclass
class Graph:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    edges: DataFrame
    roots: DataFrame
    shapes: DataFrame
    packages: DataFrame
    declared: DataFrame
    scripts: DataFrame
    surface: DataFrame
    pragmas: DataFrame
    coverage: DataFrame
    diagnostics: DataFrame
    texts: DataFrame
    plugin_findings: DataFrame | None = None

    def nodes(self) -> DataFrame:
        return self.files.select(F.col("path").alias("node")).union(self.symbols.select("sym"))

    def all_edges(self) -> DataFrame:
        """Stated and implicit edges, as (src, dst, confidence)."""
        stated = self.edges.where("dst is not null").select("src", "dst", "confidence")
        implicit = assemble.implicit_edges(self.symbols, self.edges)
        return stated.union(implicit).union(assemble.invoked_programs(self.edges, self.roots, self.symbols))


def join_path(folder, name):
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def assemble_graph(spark: SparkSession, tree: DataFrame, settings: Settings | None = None, facts: DataFrame | None = None, known_plugins: list[plugins.Plugin] | None = None, before: Graph | None = None, changed: DataFrame | None = None) -> Graph:
    """The graph of a discovered tree (path, content_hash, content, perhaps modified); facts: those of its files, where they
    are known already. before, changed: a graph of the same files, and the (owner) paths whose contents are others now; the
    imports and edges of all other files are taken from it."""
    settings = settings or Settings()
    tree = cut(tree.select("path", "content_hash", "content", *[c for c in ("modified",) if c in tree.columns]))
    facts = cut(extract.facts_of(tree) if facts is None else facts)
    rows = cut(manifests.parse(tree))
    packages = rows.where("kind <> 'diagnostic'").groupBy("package").agg(
        F.min("manifest").alias("manifest"), F.min(F.when(F.col("kind") == "name", F.col("name"))).alias("name"), F.bool_or(F.col("kind") == "surface").alias("declares_surface")
    )
    plain = tree.select("path", "content_hash", origin(F.col("path"), F.col("content").cast("string")).alias("origin"), role(F.col("path"), extract.TEST_PATHS, extract.TOOLING_PATHS).alias("role"), extension(F.col("path")).alias("ext"))
    plain = plain.where(~F.regexp_extract("path", r"([^/]*)$", 1).isin(*manifests.PARSERS))
    known = facts.select("path", "language", F.col("facts.unit").alias("unit"))
    owned = assemble.longest_prefix(plain.join(known, "path", "left"), "path", packages.select(F.col("package").alias("dir"), F.col("package").alias("owner")), "")
    owned = owned.select("path", "content_hash", "language", "origin", "role", F.col("owner").alias("package"), F.coalesce("unit", dirname(F.col("path"))).alias("unit"))
    # targets of a manifest name the unit of all that lies below their folder
    places = rows.where("kind = 'target'").select(F.explode(F.array(*[join_path(F.col("package"), F.concat(F.lit(d), "name")) for d in ("Sources/", "Tests/", "Plugins/")])).alias("dir"), F.col("name").alias("owner"))
    over = assemble.longest_prefix(owned, "path", places)
    over = over.withColumn("unit", F.coalesce("owner", "unit")).drop("owner")
    gates = facts.select("path", F.explode("facts.gates").alias("g")).select("path", F.concat(F.lit("mod:"), "g.module").alias("specifier"), F.col("g.gated").alias("from_test"))
    gated = assemble.resolve_rust(gates.select("path", "specifier").distinct(), over).where("target is not null").join(gates, ["path", "specifier"]).join(over.select("path", "role"), "path")
    gated = gated.select("target", (F.col("from_test") | (F.col("role") == "test")).alias("from_test"))
    files = cut(assemble.demote_test_gated(assemble.promote_test_roles(over, TEST_DIRS), gated))

    d = facts.select("path", "language", F.explode("facts.declarations").alias("d")).select("path", "language", "d.*")
    label = F.concat_ws(".", "member_of", "name")
    symbols = cut(d.withColumn("sym", F.concat("path", F.lit("#"), label, F.lit("@"), F.col("first").cast("string"))).join(files.select("path", "package", "unit", "role", "origin"), "path"))

    sites = facts.select("path", F.explode("facts.imports").alias("i")).select("path", "i.*").join(files.select("path", "language", "package", "origin", "role"), "path")
    only = lambda df: df if changed is None else df.join(changed.select(F.col("owner").alias("path")), "path", "left_semi")
    sites = only(sites)
    declared = rows.where("kind = 'dependency'").select("package", "manifest", "name", F.col("value").alias("version_req"), "scope", "ordinal")
    declared = cut(assemble.inherit_versions(declared, rows.where("kind = 'pool'").select("name", F.col("value").alias("version_req"))))
    entries = rows.where("kind = 'entry'").groupBy("package").agg(F.min_by("name", "ordinal").alias("entry"))
    workspace = packages.where("name is not null and package <> ''").join(entries, "package", "left").select("name", F.col("package").alias("dir"), F.coalesce("entry", F.lit("index.js")).alias("entry"))
    script = assemble.resolve_script_imports(sites.where("language in ('js', 'html', 'css')").drop("resolution"), files, workspace, declared, STDLIB)
    other = sites.where("language not in ('js', 'html', 'css')")
    by_unit = assemble.resolve_by_unit(other, files)
    go = assemble.resolve_by_prefix(other.where("language = 'go'").select("specifier").distinct(), rows.where("kind = 'name' and manifest like '%go.mod'").select(F.col("name").alias("module"), F.col("package").alias("target"))).withColumnRenamed("target", "go_dir")
    met = by_unit.join(go, "specifier", "left")
    met = assemble.resolve_rust(met.withColumnRenamed("target", "by_unit"), files).withColumn("target", F.coalesce(F.when(F.col("language") == "rust", F.col("target")), "by_unit"))
    library = F.when(F.col("language") == "go", ~F.substring_index("specifier", "/", 1).contains("."))
    for language, prefixes in LIBRARIES.items():
        library = library.when(F.col("language") == language, assemble.is_stdlib(F.col("specifier"), [p for p in prefixes if p.endswith(".")], [p.rstrip(".") for p in prefixes]))
    # crates are declared with either sign between words
    needs = declared.groupBy("package", F.regexp_replace("name", "_", "-").alias("wanted")).agg(F.min("name").alias("declared"))
    crate = F.regexp_replace(F.split("specifier", r"[.:]")[0], "_", "-")
    met = met.withColumn("wanted", F.when(F.col("language") == "rust", crate).otherwise(F.regexp_replace("specifier", "_", "-"))).join(needs, ["package", "wanted"], "left")
    resolution = F.when(F.col("target").isNotNull(), "file").when(F.col("go_dir").isNotNull(), "workspace-member").when(F.coalesce(library, F.lit(False)), "stdlib").when(F.col("declared").isNotNull(), "dependency").otherwise("unresolved")
    compiled = met.withColumn("resolution", resolution).withColumn("target", F.coalesce("target", F.when(F.col("resolution") == "dependency", F.col("declared"))))
    imports = script.unionByName(compiled.select(*script.columns))
    if before is not None:
        imports = before.imports.join(changed.select(F.col("owner").alias("path")), "path", "left_anti").select(*imports.columns).unionByName(imports)
    imports = cut(imports)

    reexports = imports.where("reexport and resolution in ('file', 'workspace-member')")
    tops = symbols.where("member_of is null and exported").select(F.col("path").alias("file"), "name", "sym")
    pending = reexports.select(F.col("path").alias("file"), F.when(F.col("name") != "*", F.col("alias")).alias("name"), F.col("target").alias("source"), F.when(F.col("name") != "*", F.col("name")).alias("source_name"))
    names = cut(assemble.reexport_fixpoint(tops, pending))

    refs = facts.select("path", F.explode("facts.references").alias("r")).select("path", "r.*").join(files.select("path", "language", "package", "unit"), "path")
    refs = cut(only(refs).distinct().withColumn("ref", F.monotonically_increasing_id()))
    bound = imports.where("resolution in ('file', 'workspace-member') and alias is not null").select(F.col("path").alias("at"), F.col("alias").alias("known_as"), F.col("name").alias("imported"), F.col("target").alias("file"))
    by_import = refs.join(bound, (F.col("path") == F.col("at")) & (F.col("name") == F.col("known_as"))).join(names.withColumnRenamed("name", "n"), ["file"]).where("imported = n or imported = 'default' or imported = '*'").select("ref", F.col("sym").alias("target"))
    # a module bound under a name brings the modules bound in it, one hop on
    linked = assemble.link_bindings(bound.where("imported = '*'").select(F.col("at").alias("file"), F.col("known_as").alias("name"), F.col("file").alias("target")).distinct())
    far = linked.where("name like '%.%'").select(F.col("file").alias("at"), F.col("name").alias("known_as"), F.lit("*").alias("imported"), F.col("target").alias("file"))
    by_qualifier = refs.join(bound.unionByName(far), (F.col("path") == F.col("at")) & (F.col("qualifier") == F.col("known_as"))).join(names.withColumnRenamed("name", "n"), ["file"]).where(F.col("name") == F.col("n")).select("ref", F.col("sym").alias("target"))
    own = symbols.select(F.col("path").alias("p"), F.col("name").alias("n"), "sym", "member_of", F.col("unit").alias("u"), F.col("language").alias("lang"))
    bare = refs.where("qualifier is null")
    same_file = bare.join(own.where("member_of is null"), (F.col("path") == F.col("p")) & (F.col("name") == F.col("n"))).select("ref", F.col("sym").alias("target"))
    # of twins in a file, one whose lines hold the use goes before the others
    twins = symbols.where("member_of is null").join(symbols.where("member_of is null").groupBy("path", "name").agg(F.count("*").alias("alike")).where("alike > 1"), ["path", "name"]).select("path", "name", "sym", "first", "last")
    within = assemble.within_owner(bare.select(F.col("ref").alias("site"), "path", "name", "line"), twins).select(F.col("site").alias("ref"), F.col("sym").alias("target"))
    chained = chained_uses(facts, refs, symbols)
    same_unit = bare.where("language in ('go', 'java', 'kotlin', 'swift')").join(own.where("member_of is null"), (F.col("unit") == F.col("u")) & (F.col("language") == F.col("lang")) & (F.col("name") == F.col("n"))).select("ref", F.col("sym").alias("target"))
    rungs = F.broadcast(ladder(spark).select("language", F.col("idx").alias("visibility"), "scope"))  # a few rows per language
    members = symbols.where("member_of is not null").join(rungs, ["language", "visibility"], "left").select("sym", "name", "language", "path", "unit", "package", F.coalesce("scope", F.lit(PUBLIC)).alias("scope"))
    units = files.where("unit <> ''").select("unit").distinct().select("unit", F.explode(F.concat(F.array("unit"), ancestors(F.col("unit")))).alias("u")).where("u <> ''").select(F.col("u").alias("unit")).distinct()
    ancestry = assemble.unit_ancestry(units.select("unit", F.nullif(dirname(F.col("unit")), F.lit("")).alias("parent")))
    duck = cut(assemble.duck_typed(refs.where("qualifier is not null").select("ref", "name", "language", "path", "unit", "package"), members, ancestry))
    ranked = assemble.ranked_resolution([("qualifier", by_qualifier), ("chain", chained), ("owner", within), ("same-file", same_file), ("import", by_import), ("unit", same_unit), ("duck", duck.select("ref", "target"))])
    sure = duck.select("ref", "target", F.col("confidence").alias("duck"))
    resolved = ranked.join(sure, ["ref", "target"], "left").join(refs, "ref")
    # a use counts for the innermost declaration around it, or else for the file
    around = refs.join(symbols.select(F.col("path").alias("p"), F.col("sym").alias("holder"), "first", "last"), (F.col("path") == F.col("p")) & F.col("line").between(F.col("first"), F.col("last")) & (F.col("last") > F.col("first")))
    holder = around.groupBy("ref").agg(F.min_by("holder", F.struct(F.col("last") - F.col("first"), "holder")).alias("holder"))
    uses = resolved.join(holder, "ref", "left").select(F.lit("references").alias("ekind"), F.coalesce("holder", "path").alias("src"), F.col("target").alias("dst"), F.col("kind").alias("ref_kind"), F.when(F.col("tier") == "duck", F.coalesce("duck", F.lit(POSSIBLE))).otherwise(CERTAIN).alias("confidence"), F.col("path").alias("owner"), "line")
    to_file = imports.where("target is not null and resolution in ('file', 'workspace-member')").select(F.lit("imports-file").alias("ekind"), F.col("path").alias("src"), F.col("target").alias("dst"), none().alias("ref_kind"), F.lit(CERTAIN).alias("confidence"), F.col("path").alias("owner"), "line").dropDuplicates(["src", "dst"])
    dynamics = facts.select("path", F.explode("facts.dynamics").alias("x")).select("path", assemble.normalize_path(F.concat(dirname(F.col("path")), F.lit("/"), "x.dir")).alias("dir"))
    maybe = assemble.dynamic_targets(dynamics, files)
    dynamic = maybe.select(F.lit("imports-file").alias("ekind"), "src", "dst", none(), "confidence", F.col("src").alias("owner"), F.lit(None).cast("int"))
    opened = maybe.select(F.lit("wildcard").alias("ekind"), F.col("dst").alias("src"), none().alias("dst"), none().alias("rk"), F.lit(POSSIBLE).alias("c"), F.col("dst").alias("owner"), F.lit(None).cast("int").alias("line"))
    stated_edges = uses.union(to_file).union(dynamic).union(opened)
    adapters = files.select(F.col("path").alias("owner"), F.concat(F.lit("adapter:"), "language").alias("source"))
    edges = stated_edges.join(adapters, "owner", "left").select(*stated_edges.columns, "source")
    edges = cut(edges if before is None else patched_edges(before, symbols, edges, changed))

    targets = rows.where("kind = 'entry'").select(join_path(F.col("package"), F.col("name")).alias("wanted"), F.col("scope").alias("key"))
    candidates = targets.select("wanted", F.posexplode(assemble.script_candidates(F.lit(""), F.concat(F.lit("/"), "wanted"))).alias("at", "path")).join(files.select("path"), "path")
    entry_files = candidates.groupBy("wanted").agg(F.min_by("path", "at").alias("node")).select(F.lit("production").alias("kind"), "node", F.lit(CERTAIN).alias("confidence"))
    # whole-module re-exports of an entry file make what they name part of the surface
    whole = reexports.where("name = '*'").select(F.col("path").alias("src"), F.col("target").alias("dst"), F.lit(CERTAIN).alias("confidence"))
    shown = assemble.library_surface(entry_files.select(F.col("node").alias("file"), "confidence"), whole)
    entry_files = shown.select(F.lit("production").alias("kind"), F.col("file").alias("node"), "confidence")
    public = entry_files.join(names, F.col("node") == F.col("file")).select("kind", F.col("sym").alias("node"), F.lit(CERTAIN).alias("confidence"))
    invoked = rows.where("kind = 'script'").select("package", F.explode(F.regexp_extract_all("value", F.lit(r"[\w./-]+\.[cm]?[jt]sx?"), 0)).alias("word")).select(join_path(F.col("package"), assemble.normalize_path(F.col("word"))).alias("path"))
    launched = invoked.join(files.select("path"), "path", "left_semi").select(F.lit("production").alias("kind"), F.col("path").alias("node"), F.lit(PROBABLE).alias("confidence"))
    stated = facts.select("path", F.explode("facts.roots").alias("r")).select("path", "r.*").withColumnRenamed("name", "n")
    in_source = stated.where("n is null").select("kind", F.col("path").alias("node"), "confidence").union(
        stated.where("n is not null").join(symbols.select(F.col("path").alias("p"), F.col("name").alias("m"), "sym"), (F.col("path") == F.col("p")) & (F.col("n") == F.col("m"))).select("kind", F.col("sym").alias("node"), "confidence")
    )
    main_files = in_source.where("node like '%#%'").select("kind", F.split("node", "#")[0].alias("node"), "confidence")
    external = assemble.externally_invoked(symbols, settings.externally_invoked)
    roles = files.select(F.col("path").alias("node"), "role").union(symbols.select("sym", "role"))
    roots = assemble.cap_roots(entry_files.union(public).union(launched).union(in_source).union(main_files).union(external), roles).union(assemble.role_roots(files))
    tested = symbols.where("role = 'test' and member_of is null").select(F.lit("test").alias("kind"), F.col("sym").alias("node"), F.lit(PROBABLE).alias("confidence"))
    roots = roots.union(tested).distinct()

    commands = rows.where("kind = 'script'").select("package", F.explode(F.split("value", r"[^\w@./-]+")).alias("name")).distinct()
    scripts = commands.join(declared.select("package", "name").distinct(), ["package", "name"], "left_semi")
    surface = rows.where("kind = 'surface'").select(F.col("package").alias("provider"), F.explode(assemble.script_candidates(F.lit(""), F.concat(F.lit("/"), join_path(F.col("package"), F.col("name"))))).alias("target"))
    shapes = facts.select("path", "language", F.explode("facts.shapes").alias("s")).select("path", "language", "s.*")
    pragmas = facts.select("path", F.explode("facts.pragmas").alias("p")).select("path", "p.*")
    pragmas = pragmas.select(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "category").alias("pragma"), "path", "line", F.col("line").alias("last_line"), "category", "subject", "scope")
    problems = facts.select("path", F.explode("facts.diagnostics").alias("message")).union(rows.where("kind = 'diagnostic'").select("manifest", "name"))
    g = Graph(files, symbols, imports, edges, roots, cut(shapes), packages, declared, scripts, surface, cut(pragmas), read_coverage(tree, files, max_age=settings.max_age_seconds), problems, facts.select("path", F.explode("facts.texts").alias("t")).select("path", "t.*"))
    return with_plugins(g, tree, plugins.BUILTIN if known_plugins is None else known_plugins)


def patched_edges(before: Graph, symbols: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges of a graph with those of changed owners replaced by fresh ones; edges of others that end at a symbol of a
    changed file follow it to its new line. Wildcards are stated by those who open them and are all made anew."""
    label = F.concat_ws(".", "member_of", "name")

    def nth(rows: DataFrame, name: str) -> DataFrame:
        own = rows.join(changed.select(F.col("owner").alias("path")), "path", "left_semi")
        return own.select("path", label.alias("label"), F.row_number().over(Window.partitionBy("path", label).orderBy("first")).alias("nth"), F.col("sym").alias(name))

    moved = nth(before.symbols, "was").join(nth(symbols, "now"), ["path", "label", "nth"]).select("was", "now")
    old = before.edges.where("ekind <> 'wildcard' and not coalesce(source, '') like 'plugin:%'").join(moved, F.col("dst") == F.col("was"), "left").withColumn("dst", F.coalesce("now", "dst")).drop("was", "now")
    return replace_owned(old, changed, fresh.join(changed, "owner", "left_semi")).union(fresh.where("ekind = 'wildcard'")).distinct()


def chained_uses(facts: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, target): members at the end of chains `a.b.c`, by the type that `a` is known to hold where it is used (its last
    mention before), or by the type around `this` and `self`."""
    known = facts.select("path", F.explode("facts.types").alias("t")).select("path", "t.*")
    fields = known.where("owner is not null").select(F.col("owner").alias("type"), F.col("name").alias("member"), F.col("type").alias("yields"))
    generics = facts.select(F.explode("facts.generics").alias("g")).select("g.*")
    uses = refs.where("qualifier is not null and qualifier <> '?'").select("ref", "path", "language", "name", "line", F.split("qualifier", r"\.").alias("steps")).withColumn("head", F.col("steps")[0])
    held = known.where("owner is null").select("path", F.col("name").alias("head"), F.col("type").alias("holds"), F.col("line").alias("from"))
    by_name = uses.join(held, ["path", "head"]).where(F.col("from") <= F.col("line")).groupBy("ref").agg(F.max_by("holds", F.struct("from", "holds")).alias("type"))
    types = symbols.where("member_of is null and last > first").select("path", F.col("name").alias("around"), "first", "last", "kind").where("kind not in ('function', 'constant', 'variable', 'module')")
    by_self = uses.where("head in ('this', 'self')").join(types, "path").where("line between first and last").groupBy("ref").agg(F.min_by("around", F.struct(F.col("last") - F.col("first"), "around")).alias("type"))
    start = by_name.union(by_self).groupBy("ref").agg(F.min("type").alias("type")).join(uses.select("ref", F.slice("steps", 2, F.size("steps")).alias("steps")), "ref")
    ends = assemble.chained_members(start, fields, generics).where("type is not null").withColumn("member_of", F.regexp_replace("type", "<.*$", ""))
    members = symbols.where("member_of is not null").select("member_of", "name", "language", F.col("sym").alias("target"))
    return ends.join(uses.select("ref", "name", "language"), "ref").join(members, ["member_of", "name", "language"]).select("ref", "target")


def with_plugins(g: Graph, tree: DataFrame, known: list[plugins.Plugin]) -> Graph:
    """The graph with what the active plugins contribute."""
    on = plugins.active(known, g.files.select("path").union(g.packages.where("manifest is not null").select("manifest")), g.declared)
    g.symbols = cut(plugins.mark_members(on, g.symbols)) if any(p.members for p in on) else g.symbols
    if any(p.roots for p in on):
        g.roots = g.roots.union(plugins.contribute_roots(on, g, tree)[0])
    g.roots = cut(g.roots.distinct())
    for p in on:
        if p.edges:
            more = p.edges(g, plugins.view(p, tree)).select(F.lit("references-file").alias("ekind"), "src", "dst", none().alias("ref_kind"), "confidence", F.col("src").alias("owner"), F.lit(None).cast("int").alias("line"), F.lit(f"plugin:{p.id}").alias("source"))
            g.edges = cut(g.edges.unionByName(more))
        if p.generated:
            made = p.generated(g, plugins.view(p, tree)).withColumn("made", F.lit(True))
            g.files = cut(g.files.join(made, "path", "left").withColumn("origin", F.when(F.col("made"), "generated").otherwise(F.col("origin"))).drop("made"))
        if p.annotate:
            marks = p.annotate(g, plugins.view(p, tree)).groupBy("path", F.col("name").alias("n")).agg(F.collect_set("marker").alias("more"))  # a symbol's marks
            g.symbols = cut(g.symbols.join(marks.withColumnRenamed("path", "at"), (F.col("path") == F.col("at")) & (F.col("name") == F.col("n")), "left").withColumn("markers", F.array_union(F.coalesce("markers", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).drop("at", "n", "more"))
        if p.coverage:
            lines = p.coverage(g, plugins.view(p, tree)).select("path", "line", F.col("hits").cast("bigint").alias("hits"))
            g.coverage = cut(coverage.accumulate(g.coverage.select("path", "line", "hits").unionByName(lines.join(g.files.select("path"), "path", "left_semi"))))
    g.plugin_findings = plugins.contribute_findings(on, g, tree)
    return g


def read_coverage(tree: DataFrame, files: DataFrame, prefixes: list[tuple[str, str]] | None = None, max_age: int | None = None) -> DataFrame:
    """Lines of all coverage reports in the tree, with paths brought to those of its files: by the given prefixes, or below the
    one package that has such a file."""
    if max_age is not None and "modified" in tree.columns:  # reports that are too old say nothing of this tree
        tree = tree.where(F.col("modified").isNull() | (F.unix_timestamp("modified") >= F.unix_timestamp() - max_age))
    text = tree.select("path", F.col("content").cast("string").alias("content"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = coverage_formats.parse_lcov(text.where(name.rlike(r"lcov.*\.info$|\.lcov$|^lcov\.info$")))
    lines = lines.union(coverage_formats.parse_go(text.where(name.rlike(r"\.(?:coverprofile|cov\.out)$|^coverage\.out$"))))
    lines = lines.union(coverage_formats.parse_cobertura(text.where(name.rlike(r"cobertura.*\.xml$|^coverage\.xml$"))))
    lines = lines.union(coverage_formats.parse_jacoco(text.where(name.rlike(r"^jacoco.*\.xml$"))))
    lines = coverage.rebase(lines.withColumn("path", F.regexp_replace("path", r"^\./", "")), prefixes or [])
    placed = coverage.rebase_by_package(lines, files.select(F.col("package").alias("dir")).where("dir <> ''").distinct(), files)
    return cut(coverage.accumulate(placed.join(files.select("path"), "path", "left_semi")))


def _finding(rows: DataFrame, category: str, subject_kind, path, symbol=None, line=None, confidence=None, package=None, message=None, extra=None) -> DataFrame:
    symbol = none() if symbol is None else symbol
    return rows.select(
        finding_id(F.lit(category), subject_kind, path, symbol, none() if extra is None else extra).alias("id"),
        F.lit(category).alias("category"),
        subject_kind.alias("subject_kind"),
        F.lit(SEVERITY.get(category, 0)).alias("severity"),
        (F.lit(CERTAIN) if confidence is None else confidence).cast("int").alias("confidence"),
        path.alias("path"),
        (F.lit(1) if line is None else line).cast("int").alias("line"),
        symbol.alias("symbol"),
        (none() if package is None else package).alias("package"),
        (none() if message is None else message).alias("message"),
    )


def analyse(g: Graph, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, colours, clone groups) of a graph."""
    settings = settings or Settings()
    c, lit = F.col, F.lit
    colors = cut(graph.colors(g.nodes(), graph.widest_paths(g.all_edges(), g.roots)))
    label = F.concat_ws(".", "member_of", "name")
    by_sym = g.symbols.select("sym", "path", "first", "kind", label.alias("label"))
    out = []

    served = analyses.served_only(g.edges, g.roots)
    dead = cut(analyses.unused_files(g.files, colors, g.symbols))
    rolled = cut(analyses.directory_rollup(g.files.join(dead.withColumn("eligible", lit(True)), "path", "left")).where("dir <> ''"))
    covered = dead.join(rolled, c("path").startswith(F.concat("dir", lit("/"))), "left_semi")
    out.append(_finding(dead.join(covered, "path", "left_anti"), "unused", lit("file"), c("path")))
    out.append(_finding(rolled, "unused", lit("directory"), c("dir"), message=F.concat(c("n_files").cast("string"), lit(" files"))))
    out.append(_finding(analyses.unused_symbols(g.symbols, colors, g.files, served).join(by_sym, "sym"), "unused", c("kind"), c("path"), c("label"), c("first")))

    # a member of the workspace is used by its package name
    uses = g.imports.where("resolution in ('dependency', 'workspace-member')").select("package", F.when(c("resolution") == "dependency", c("target")).otherwise(assemble.package_part(c("specifier"))).alias("name"), "role", "origin", lit(CERTAIN).alias("confidence"), "language")
    usage = cut(analyses.dependency_usage(g.declared, uses, g.scripts))
    manifest = g.packages.select("package", "manifest")
    for verdict in ("unused", "test-only"):
        out.append(_finding(usage.where(c("verdict") == verdict).join(manifest, "package"), verdict, lit("dependency"), c("manifest"), c("name"), confidence=c("confidence"), package=c("package")))
    names = g.packages.where("name is not null").select("package", "name")
    lacking = analyses.undeclared(uses.where("language = 'js'"), g.declared.select("package", "name").union(names))
    out.append(_finding(lacking.join(manifest, "package"), "undeclared", lit("dependency"), c("manifest"), c("name"), confidence=c("confidence"), package=c("package")))
    skew = analyses.version_skew(g.declared)
    first = g.declared.groupBy("name").agg(F.min("manifest").alias("manifest"))
    out.append(_finding(skew.join(first, "name"), "version-skew", lit("dependency"), c("manifest"), c("name"), message=c("evidence")))

    same = analyses.duplicate_groups(g.files.where(c("content_hash") != lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")), "content_hash", "path")
    out.append(_finding(same, "duplicate", lit("file"), c("anchor"), message=F.concat(c("n_copies").cast("string"), lit(" copies"))))
    fit = g.shapes.join(g.files.where("role <> 'test' and origin = 'authored'").select("path"), "path", "left_semi").where(F.size("tokens") >= settings.duplicate_tokens)
    rid = F.concat("path", lit("#"), "name", lit("@"), c("first").cast("string"))
    shaped = fit.select(rid.alias("rid"), "language", "path", "name", "first", F.concat_ws("#", "path", "name").alias("label"), winnow(grams(c("tokens"))).alias("fingerprints"))
    shaped = cut(analyses.disambiguate(shaped, "label", "first").withColumn("name", F.expr("substring(label, length(path) + 2)")))
    clones = cut(analyses.clone_groups(analyses.clone_pairs(shaped)))
    anchors = clones.select(c("anchor").alias("rid")).distinct().join(shaped, "rid")
    out.append(_finding(anchors, "duplicate", lit("function"), c("path"), c("name"), c("first")))

    between = g.edges.where("ekind = 'imports-file'").select("src", "dst", "confidence")
    packs = g.files.select("path", "package")
    hazard = between.join(g.files.where("language in ('js', 'java', 'kotlin') and origin = 'authored'").select(c("path").alias("src")), "src", "left_semi")
    parts = cut(graph.strong_components(hazard))
    spread = parts.join(packs, parts.node == packs.path).where("package <> ''").groupBy("component").agg(F.count_distinct("package").alias("n")).where("n >= 2")
    inner = parts.join(spread, "component", "left_anti")
    loops = hazard.join(inner.select(c("node").alias("src")), "src", "left_semi").join(inner.select(c("node").alias("dst")), "dst", "left_semi")
    loops = cut(loops)
    rounds = cut(analyses.cycles(loops, parts=inner))
    shown = rounds.join(analyses.shortest_cycles(loops, rounds, inner), "anchor", "left")
    out.append(_finding(shown, "cyclic", lit("file"), c("anchor"), confidence=c("confidence"), message=F.array_join("cycle", " > ")))
    cross = between.join(packs.select(c("path").alias("src"), c("package").alias("a")), "src").join(packs.select(c("path").alias("dst"), c("package").alias("b")), "dst").where("a <> b and a <> '' and b <> ''")
    rings = analyses.cycles(cut(cross.groupBy(c("a").alias("src"), c("b").alias("dst")).agg(F.max("confidence").alias("confidence"))), small=True)
    out.append(_finding(rings.join(g.packages.select(c("package").alias("anchor"), "manifest"), "anchor"), "cyclic", lit("package"), c("manifest"), confidence=c("confidence"), package=c("anchor")))
    reach_in = cross.select(c("a").alias("consumer"), c("b").alias("provider"), c("dst").alias("target"), "confidence")
    deep = analyses.deep_imports(reach_in, g.surface)
    out.append(_finding(deep.join(g.packages.select(c("package").alias("consumer"), "manifest"), "consumer").join(g.packages.select(c("package").alias("provider"), c("name").alias("of")), "provider"), "deep-import", lit("package"), c("manifest"), c("of"), confidence=c("confidence"), package=c("consumer")))

    spans = g.shapes.join(g.files.where("role <> 'test' and origin = 'authored'").select("path"), "path", "left_semi").select(rid.alias("id"), "path", "first", "last", "name", "cyclomatic")
    blind = cut(analyses.abstained(g.roots, g.coverage))
    judged = coverage.function_coverage(spans.select("id", "path", "first", "last"), g.coverage)
    risky = analyses.crap(spans.join(judged.select("id", "coverage"), "id").select("id", c("cyclomatic").alias("complexity"), "coverage"), settings.crap_threshold)
    risky = risky.join(spans.select("id", "path", "name", "first"), "id").join(F.broadcast(blind.where("category = 'crap'")), lit(True), "left_anti")  # one row at most
    out.append(_finding(risky, "crap", lit("function"), c("path"), c("name"), c("first"), message=F.round("score", 1).cast("string")))
    claimed = g.files.where("language is not null and origin = 'authored'")
    bare_files = analyses.untested(claimed.where("role = 'production'").select(c("path").alias("node"), lit(False).alias("values_only")), colors).withColumnRenamed("node", "path")
    callable_ = g.symbols.where("kind in ('function', 'method', 'class')").select("path").distinct()
    bare_files = cut(bare_files.join(callable_, "path", "left_semi").join(F.broadcast(blind.where("category = 'untested'")), lit(True), "left_anti"))  # one row at most
    out.append(_finding(bare_files, "untested", lit("file"), c("path")))
    bare = analyses.untested(g.symbols.where("kind in ('function', 'method') and role = 'production'").select(c("sym").alias("node"), lit(False).alias("values_only")), colors).withColumnRenamed("node", "sym")
    bare = bare.join(by_sym, "sym").join(bare_files, "path", "left_anti").join(F.broadcast(blind.where("category = 'untested'")), lit(True), "left_anti")
    out.append(_finding(bare, "untested", c("kind"), c("path"), c("label"), c("first")))
    lonely_files = analyses.test_only(claimed.select(c("path").alias("node"), "role"), colors).withColumnRenamed("node", "path")
    out.append(_finding(lonely_files, "test-only", lit("file"), c("path")))
    lonely = analyses.test_only(g.symbols.select(c("sym").alias("node"), "role"), colors).withColumnRenamed("node", "sym").join(by_sym, "sym").join(lonely_files, "path", "left_anti")
    out.append(_finding(lonely, "test-only", c("kind"), c("path"), c("label"), c("first")))
    out.append(_finding(analyses.unresolved(g.imports.withColumn("confidence", lit(CERTAIN))).distinct(), "unresolved", lit("import"), c("path"), c("specifier")))

    # visibility: what is exported has the package rung, and the public one only on a package's surface
    open_ = graph.reach(g.edges.where("ref_kind is null and dst is not null").select("src", "dst"), g.roots.where("node like '%#%'").select("node")).select(c("node").alias("sym")).withColumn("public", lit(True))
    rung = F.when(c("language") == "js", F.when(c("public"), 2).when(c("exported"), 1).otherwise(0)).otherwise(c("visibility")).cast("int")
    ranked = cut(g.symbols.where(c("language").isin("js", "go", "java", "kotlin")).join(open_, "sym", "left").withColumn("visibility", rung))
    around = g.nodes().join(g.symbols.select(c("sym").alias("node"), c("path").alias("p")), "node", "left").select(c("node").alias("src"), F.coalesce("p", "node").alias("path")).join(g.files.select("path", "unit", "package"), "path")
    around = around.select("src", c("path").alias("at_path"), c("unit").alias("at_unit"), c("package").alias("at_package"))
    needs = assemble.required_scope(c("path") == c("at_path"), c("language").isin("go", "java") & (c("unit") == c("at_unit")), c("package") == c("at_package"))
    stated = g.edges.where("ekind = 'references'").join(around, "src").join(ranked.select(c("sym").alias("dst"), "path", "unit", "package", "language"), "dst")
    used = stated.where("src <> dst").select(c("dst").alias("sym"), needs.alias("scope"), "confidence")
    exempt = g.roots.select(c("node").alias("sym")).union(colors.where("color = 'unreachable'").select("node")).distinct()
    judgeable = ranked.where("kind <> 'constructor' and not implicitly_invoked and origin = 'authored' and role = 'production'").withColumn("nested_scope", lit(False)).join(exempt, "sym", "left_anti")
    narrow = analyses.internal_only(judgeable, used, ladder(g.files.sparkSession))
    out.append(_finding(narrow.join(by_sym, "sym"), "internal-only", c("kind"), c("path"), c("label"), c("first"), confidence=c("confidence")))
    held = g.symbols.select(c("sym").alias("decl"), c("first").alias("signature_start"), c("signature_last").alias("signature_end"), c("language").alias("l1"))
    named = g.edges.where("ref_kind = 'type-use'").select(c("src").alias("decl"), c("dst").alias("type"), "confidence", "line").join(held, "decl").join(g.symbols.select(c("sym").alias("type"), c("language").alias("l2")), "type")
    owner = g.symbols.where("member_of is null").select("path", c("name").alias("member_of"), c("sym").alias("owner"))
    chain = ranked.join(owner, ["path", "member_of"], "left").select("sym", "owner", "exported", "visibility")
    leaks = analyses.private_type_leak(named.withColumn("same_language", c("l1") == c("l2")), analyses.effective_surface(chain))
    shown = leaks.join(by_sym, leaks.decl == by_sym.sym).join(by_sym.select(c("sym").alias("leaked"), c("label").alias("type_label")), "leaked")
    out.append(_finding(shown, "private-type-leak", c("kind"), c("path"), c("label"), c("first"), message=c("type_label"), extra=c("type_label")))

    findings = out[0]
    for rows in out[1:]:
        findings = findings.unionByName(rows)
    # of findings with one id the first by line, package and message stays
    best = F.min(F.struct("line", "package", "message", *[x for x in findings.columns if x not in ("id", "line", "package", "message")])).alias("b")
    return cut(findings.groupBy("id").agg(best).select("id", *[f"b.{x}" for x in findings.columns[1:]])), colors, clones


def suppressed(g: Graph, findings: DataFrame) -> DataFrame:
    """Findings that no pragma covers, with stale pragmas added."""
    declared = g.symbols.select("sym", "path", "first", "last")
    bound = cut(report.bind_pragmas(g.pragmas, declared))
    hit = cut(report.suppress(findings.select("id", "path", "line", "category", c_subject().alias("subject")), g.pragmas, bound))
    from ..schema import CATEGORIES

    stale = report.stale_pragmas(g.pragmas, bound, hit, [x for x in CATEGORIES if x != "stale"]).join(g.pragmas.select("pragma", "path", "line"), "pragma")
    named = g.pragmas.select("pragma", F.col("category").alias("name"))
    hints = named.join(report.nearest_category(named), "name").select("pragma", "hint")
    stale = stale.join(hints, "pragma", "left").withColumn("reason", F.when(F.col("hint").isNotNull() & (F.col("reason") == "unknown"), F.concat("reason", F.lit(", perhaps "), "hint")).otherwise(F.col("reason")))
    extra = _finding(stale, "stale", F.lit("suppression"), F.col("path"), line=F.col("line"), message=F.col("reason"), extra=F.col("pragma"))
    return findings.join(hit.select("id").distinct(), "id", "left_anti").unionByName(extra)


def c_subject():
    return F.coalesce("symbol", "path")


#: Kinds of symbols that count as code. Fixed values.
CODE = ["function", "method", "class", "constant", "variable", "type", "enum", "interface", "struct", "trait", "object", "property"]


def tallies(findings: DataFrame, symbols: DataFrame, files: DataFrame, declared: DataFrame, shapes: DataFrame, colors: DataFrame) -> DataFrame:
    """(package, axis, part, whole) of each health axis: findings over what they could be of, by package.

    findings: (category, subject_kind, package); symbols: (node, package, exported); files (package) that a language claims;
    declared, shapes: (package); colors: (node, color).
    """
    cat = lambda category, kinds=None: findings.where(F.col("category") == category).where(F.col("subject_kind").isin(*kinds) if kinds else F.lit(True)).select("package")
    production = symbols.join(colors.where("color = 'production'").select("node"), "node", "left_semi")
    pairs = {
        "unused-symbols": (cat("unused", CODE), symbols),
        "unused-files": (cat("unused", ["file"]), files),
        "unused-dependencies": (cat("unused", ["dependency"]).unionByName(cat("test-only", ["dependency"])), declared),
        "test-only": (cat("test-only", [*CODE, "file"]), symbols),
        "cycles": (cat("cyclic"), files),
        "internal-only": (cat("internal-only"), symbols.where("exported")),
        "untested": (cat("untested", CODE), production),
        "duplication": (cat("duplicate", ["function"]), shapes),
        "crap": (cat("crap"), shapes),
    }
    rows = None
    for axis, (part, whole) in pairs.items():
        one = part.select("package", F.lit(1).alias("part"), F.lit(0).alias("whole")).union(whole.select("package", F.lit(0), F.lit(1))).withColumn("axis", F.lit(axis))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("package", "axis").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))


def tallies_of(g: Graph, findings: DataFrame, colors: DataFrame) -> DataFrame:
    owners = g.files.select("path", F.col("package").alias("own")).union(g.packages.where("manifest is not null").select("manifest", "package"))
    placed = findings.drop("package").join(owners, "path", "left").select("category", "subject_kind", F.coalesce("own", F.lit("")).alias("package"))
    symbols = g.symbols.select(F.col("sym").alias("node"), "package", "exported")
    shapes = g.shapes.join(g.files.select("path", "package"), "path").select("package")
    return cut(tallies(placed, symbols, g.files.where("language is not null").select("package"), g.declared.select("package"), shapes, colors))


def health_of(spark: SparkSession, tally: DataFrame) -> DataFrame:
    """(axis, ratio, penalty) of the whole tree; an axis without anything to judge has ratio 0."""
    axes = spark.createDataFrame([(a,) for a in health.AXES], "axis string")
    whole = tally.groupBy("axis").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
    return health.penalties(axes.join(whole, "axis", "left").fillna(0, ["part", "whole"]))


def health_by_package(g: Graph, tally: DataFrame) -> DataFrame:
    """(package, score, grade, to_next) where two packages or more own claimed files; no rows otherwise."""
    owning = g.files.where("language is not null").select("package").distinct()
    several = F.broadcast(owning.agg((F.count("*") > 1).alias("several")).where("several"))  # one row at most
    by = tally.join(owning, "package", "left_semi").join(several, F.lit(True), "left_semi")
    scored = health.score(health.penalties(by, ["package"]), ["package"])
    return scored.withColumn("to_next", health.to_next_grade(F.col("score")))


@dataclass
class Result:
    graph: Graph
    findings: DataFrame
    colors: DataFrame
    health: DataFrame
    packages: DataFrame | None = None
    sources: DataFrame | None = None


def stored_graph(spark: SparkSession, tree: DataFrame, settings: Settings, folder: str, known_plugins: list[plugins.Plugin] | None = None) -> Graph:
    """The graph of a tree: its stored snapshot; or the one stored last, patched, where a patch gives what a full run would;
    or assembled from stored facts. Then stored."""
    from ..sources import store

    if (g := store.load(spark, tree, folder)) is not None:
        return g
    tree = cut(tree)
    facts = cut(store.facts(spark, tree, folder))
    now = cut(surfaces(tree, facts))
    last, was = store.latest(spark, folder), store.last_surfaces(spark, folder)
    if last is not None and was is not None and can_patch(was, now):
        changed = cut(was.select(F.col("path").alias("owner"), F.col("content_hash").alias("h")).join(now.select(F.col("path").alias("owner"), "content_hash"), "owner").where("h <> content_hash").select("owner"))
        g = assemble_graph(spark, tree, settings, facts, known_plugins, last, changed)
    else:
        g = assemble_graph(spark, tree, settings, facts, known_plugins)
    store.save(g, tree, folder, now)
    return g


def surfaces(tree: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, content_hash, surface, is_manifest) of all files: what a patch must leave as it is."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return tree.select("path", "content_hash", name.isin(*manifests.PARSERS).alias("is_manifest")).join(assemble.surface_signature(facts), "path", "left").select("path", "content_hash", "surface", "is_manifest")


def provenance_of(g: Graph, findings: DataFrame) -> DataFrame:
    """(id, sources): the adapter of each finding's file, and who contributed an edge at its symbol or file."""
    label = F.concat_ws(".", "member_of", "name")
    at = g.symbols.select("path", label.alias("symbol"), F.col("first").alias("line"), F.col("sym").alias("node"))
    placed = findings.join(at, ["path", "symbol", "line"], "left").select("id", "path", F.coalesce("node", "path").alias("node"))
    claims = g.files.where("language is not null").select("path", F.concat(F.lit("adapter:"), "language").alias("source"))
    return report.provenance(placed, g.edges.where("source is not null"), claims)


def check(spark: SparkSession, root: str, settings: Settings | None = None, tree: DataFrame | None = None, stored: str | None = None, known_plugins: list[plugins.Plugin] | None = None) -> Result:
    """All findings of the tree that `root` names (see discover_source; or of a given one), after pragmas and filters, and its health axes.

    stored: a folder of facts and snapshots, which unchanged files and trees are taken from."""
    settings = settings or Settings()
    tree = discover.discover_source(spark, root, stored) if tree is None else tree
    g = stored_graph(spark, tree, settings, stored, known_plugins) if stored else assemble_graph(spark, tree, settings, known_plugins=known_plugins)
    found, colors, _ = analyse(g, settings)
    kept = cut(report.report_filter(suppressed(g, found), settings.only or None, settings.skip or None, settings.min_confidence).where("fate = 'shown'").drop("fate"))
    tally = tallies_of(g, found, colors)
    return Result(g, kept, colors, health_of(spark, tally), health_by_package(g, tally), provenance_of(g, kept))


def verdict(findings: DataFrame, deltas: DataFrame | None, settings: Settings, strict: bool = False) -> DataFrame:
    """(worst, failed_budgets, verdict) of findings, with the settings' budgets: `category` bounds new less fixed findings,
    `category-per-subject` what one file has. strict: any finding fails. deltas: (category, delta), none without a base."""
    spark = findings.sparkSession
    rules = [(k, k.removesuffix("-per-subject"), "per-subject" if k.endswith("-per-subject") else "net", most) for k, most in settings.budgets.items()]
    table = spark.createDataFrame(rules, "rule string, category string, kind string, most int")
    if deltas is None:
        table, deltas = table.where("kind = 'per-subject'"), spark.createDataFrame([], "category string, delta string")
    sure = F.lit(False).alias("advisory")
    totals = findings.select("category", F.col("path").alias("subject"), sure)
    budget = report.budgets(deltas.select("category", "delta", sure), totals, table)
    least = 0 if strict else 1 << 20 if settings.fail_on is None else settings.fail_on
    return report.gate(findings.select("severity", sure), budget, least)


def check_diff(spark: SparkSession, repository: str, before: str, after: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """(id, delta, origin) between a commit and the working tree (or another tree)."""
    tree = discover.discover(spark, repository) if after is None else after
    base = discover.discover_git(spark, repository, discover.merge_base(repository, before))
    a, b = check(spark, repository, settings, tree), check(spark, repository, settings, base)
    touched = report.touched_paths(base, tree)
    both = b.findings.select("id", "category", "severity").union(a.findings.select("id", "category", "severity")).distinct()
    return report.diff(b.findings.select("id", "path"), a.findings.select("id", "path"), touched).join(both, "id")


def check_staged(spark: SparkSession, repository: str, settings: Settings | None = None) -> DataFrame:
    """check_diff() between the last commit and what is staged, whatever lies in the working tree."""
    return check_diff(spark, repository, "HEAD", discover.discover_source(spark, f"staged:{repository}"), settings)


def envelope(result: Result, limit: int | None = None) -> str:
    """The JSON report: findings in display order, the score, and counts."""
    rows = report.display_order(result.findings)
    rows = (rows.limit(limit) if limit else rows).collect()
    score = health.score(result.health).first()
    return json.dumps({"schema": "1", "findings": [r.asDict() for r in rows], "health": {"score": score.score, "grade": score.grade, "axes": [r.asDict() for r in result.health.collect()]}}, indent=1)


