"""Plugins: functions from a graph and its files' contents to roots, edges, marks and findings, and the built-in ones.

A plugin is active if a file matches one of its globs or a package declares one of its dependencies. Contributions name a
path and perhaps a symbol in it; what can't be resolved is dropped and counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, glob_to_regex
from ..operators.assemble import plugin_targets
from ..operators.report import cap_per_rule
from ..schema import CERTAIN, PROBABLE

CONTRIBUTION = "plugin string, path string, name string, kind string, confidence int"


@dataclass(frozen=True)
class Plugin:
    """roots: (graph, files with content) -> (path, name, confidence); edges: -> (src, dst, confidence); members: trait names
    with the methods that machinery calls; annotate: -> (path, name, marker); coverage: -> (path, line, hits); findings: ->
    rows with rule and id. reads: globs of the files whose contents it may see, all if there are none."""

    id: str
    globs: tuple[str, ...] = ()
    dependencies: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    roots: Callable | None = None
    edges: Callable | None = None
    generated: Callable | None = None
    members: dict[str, tuple[str, ...]] = field(default_factory=dict)
    findings: Callable | None = None
    annotate: Callable | None = None
    coverage: Callable | None = None
    reads: tuple[str, ...] = ()


#: Contents that a plugin sees: of one file, and of all together, the smallest first.
MOST_FILE_BYTES, MOST_VIEW_BYTES = 1 << 20, 64 << 20


def view(plugin: Plugin, contents: DataFrame, most_file: int = MOST_FILE_BYTES, most: int = MOST_VIEW_BYTES) -> DataFrame:
    """The files whose contents a plugin may read, within its budgets; a plugin without `reads` sees all of them.

    Sizes are added up by classes of two powers, so that no task sorts all files; of the class that the budget ends in, none
    is shown."""
    if not plugin.reads:
        return contents
    size = F.octet_length("content")
    some = contents.where(F.col("path").rlike("|".join(map(glob_to_regex, plugin.reads))) & (size <= most_file)).withColumn("class", F.ceil(F.log2(size + 1)).cast("int"))
    held = some.groupBy("class").agg(F.sum(size).alias("bytes")).orderBy("class").collect()  # 21 rows at most
    upto, last = 0, -1
    for row in held:
        upto += row.bytes
        if upto > most:
            break
        last = row["class"]
    return some.where(F.col("class") <= last).drop("class")


def active(plugins: list[Plugin], files: DataFrame, declared: DataFrame) -> list[Plugin]:
    """The plugins whose globs or dependencies are met, and those that active ones need."""
    on = {p.id for p in plugins if (p.globs and not files.where(F.col("path").rlike("|".join(map(glob_to_regex, p.globs)))).isEmpty()) or (p.dependencies and not declared.where(F.col("name").isin(*p.dependencies)).isEmpty())}
    by_id = {p.id: p for p in plugins}
    while more := {n for i in on for n in by_id[i].needs if n in by_id} - on:
        on |= more
    return [p for p in plugins if p.id in on]


def contribute_roots(plugins: list[Plugin], graph, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, node, confidence) of all plugins' production roots, and (plugin, stated, resolved) counts."""
    spark = contents.sparkSession
    rows = spark.createDataFrame([], CONTRIBUTION)
    for p in plugins:
        if p.roots:
            rows = rows.unionByName(p.roots(graph, view(p, contents)).select(F.lit(p.id).alias("plugin"), "path", "name", F.lit("production").alias("kind"), F.col("confidence").cast("int").alias("confidence")))
    hit = plugin_targets(rows, graph.files, graph.symbols)
    stated = rows.groupBy("plugin").agg(F.count("*").alias("stated"))
    counts = stated.join(hit.groupBy("plugin").agg(F.count("*").alias("resolved")), "plugin", "left").select("plugin", "stated", F.coalesce("resolved", F.lit(0)).alias("resolved"))
    return hit.select("kind", "node", "confidence").distinct(), counts


def mark_members(plugins: list[Plugin], symbols: DataFrame) -> DataFrame:
    """`symbols` with implicitly_invoked set for methods that a trait's machinery calls."""
    hit = F.col("implicitly_invoked")
    for p in plugins:
        for trait, methods in p.members.items():
            hit = hit | ((F.col("implements") == trait) & F.col("name").isin(*methods))
    return symbols.withColumn("implicitly_invoked", F.coalesce(hit, F.lit(False)))


def contribute_findings(plugins: list[Plugin], graph, contents: DataFrame, gated: set[str] = frozenset()) -> DataFrame | None:
    """Findings of all plugins, 500 of each rule at most; advisory unless the rule is gated."""
    out = None
    for p in plugins:
        if p.findings:
            rows = p.findings(graph, view(p, contents)).withColumn("rule", F.concat(F.lit(f"plugin:{p.id}/"), "rule"))
            out = rows if out is None else out.unionByName(rows)
    return None if out is None else cap_per_rule(out).withColumn("advisory", ~F.col("rule").isin(*gated) if gated else F.lit(True))


def _text(contents: DataFrame, glob: str) -> DataFrame:
    return contents.where(F.col("path").rlike(glob_to_regex(glob))).select("path", F.col("content").cast("string").alias("text"))


def _exports(graph, rlike: str, confidence: int) -> DataFrame:
    files = graph.files.where(F.col("path").rlike(rlike)).select("path")
    named = graph.symbols.where("exported and member_of is null").join(files, "path", "left_semi").select("path", "name", F.lit(confidence).alias("confidence"))
    return files.select("path", F.lit(None).cast("string").alias("name"), F.lit(confidence).alias("confidence")).union(named)


#: Convention files of the page framework. A fixed value.
PAGES = r"(?:^|/)(?:src/)?(?:pages/.*\.[jt]sx?|app/(?:.*/)?(?:page|layout|route|loading|error|not-found|template|default|sitemap|robots|opengraph-image)\.[jt]sx?|middleware\.[jt]s|instrumentation\.[jt]s|next\.config\.[cm]?[jt]s)$"
SERVERS = r"(?:^|/)(?:server|app|index|main)\.[cm]?[jt]s$"


def _classes_in(contents: DataFrame, glob: str, pattern: str, graph, confidence: int = CERTAIN) -> DataFrame:
    """Names that a pattern finds in resources, on the declarations of that name."""
    names = _text(contents, glob).select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name"))
    plain = names.select(F.regexp_replace("name", r"^.*\.", "").alias("name")).distinct()
    return graph.symbols.join(plain, "name").select("path", "name", F.lit(confidence).alias("confidence"))


def _templates(graph, contents: DataFrame) -> DataFrame:
    return graph.files.where(F.col("path").rlike(r"(?:^|/)templates/.*\.html$")).select("path", F.lit(None).cast("string").alias("name"), F.lit(CERTAIN).alias("confidence"))


def _template_links(graph, contents: DataFrame) -> DataFrame:
    """(src, dst, confidence): `@{/...}` links of templates to files below a resource root."""
    links = _text(contents, "**/templates/**/*.html").select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"@\{/([^}?(]+)"), 1)).alias("link"))
    below = graph.files.select(F.col("path").alias("dst"), F.regexp_extract("path", r"(?:^|/)(?:static|public|resources|META-INF/resources)/(.+)$", 1).alias("link"))
    return links.join(below, "link").select("src", "dst", F.lit(PROBABLE).alias("confidence"))


def _attribute_functions(graph, contents: DataFrame) -> DataFrame:
    """Functions that serialization attributes name, in the file that states them."""
    rows = _text(contents, "**/*.rs").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"#\[serde\([^\]]*(?:default|with|serialize_with|deserialize_with|skip_serializing_if)\s*=\s*\"([\w:]+)\""), 1)).alias("name"))
    return rows.select("path", F.regexp_replace("name", r"^.*::", "").alias("name"), F.lit(CERTAIN).alias("confidence"))


def _generated_styles(graph, contents: DataFrame) -> DataFrame:
    """Output files of a style compiler, by the source and output folders that a build file states."""
    pom = _text(contents, "**/pom.xml").where("text like '%libsass%'").select(F.regexp_replace(F.regexp_extract("text", r"<outputPath>(?:\$\{[^}]*\}/)?([^<]+)</outputPath>", 1), "^/|/$", "").alias("out")).where("out <> ''").distinct()
    # an equi-join on every folder name chain above a file
    dirs = graph.files.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).where("dir <> ''")
    ends = dirs.select("path", "dir", F.split("dir", "/").alias("p")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", -n, n), "/"))).alias("out"))
    return ends.join(pom, "out").select("path").distinct()


BUILTIN = [
    Plugin("nextjs", dependencies=("next",), roots=lambda g, c: _exports(g, PAGES, CERTAIN)),
    Plugin("express", dependencies=("express",), roots=lambda g, c: _exports(g, SERVERS, PROBABLE)),
    Plugin("info-plist", globs=("**/Info.plist",), roots=lambda g, c: _classes_in(c, "**/Info.plist", r"<key>(?:NSPrincipalClass|UISceneDelegateClassName|NSExtensionPrincipalClass)</key>\s*<string>(?:\$\([A-Z_]+\)\.)?([\w.]+)</string>", g)),
    Plugin("uikit", globs=("**/*.storyboard", "**/*.xib"), roots=lambda g, c: _classes_in(c, "**/*.{storyboard,xib}", r"(?:customClass|selector|property)=\"(\w+)", g, PROBABLE)),
    Plugin("libsass", globs=("**/pom.xml",), generated=_generated_styles),
    Plugin("serde", dependencies=("serde",), roots=_attribute_functions, members={"Serialize": ("serialize",), "Deserialize": ("deserialize",), "Serializer": ("serialize_str", "serialize_i64"), "Visitor": ("expecting", "visit_str", "visit_map", "visit_seq", "visit_i64", "visit_u64", "visit_bool", "visit_none", "visit_some", "visit_unit")}),
    Plugin("thymeleaf", globs=("**/templates/**/*.html",), roots=_templates, edges=_template_links),
    Plugin("rkyv", dependencies=("rkyv",), members={"Archive": ("resolve",), "SerializeWith": ("serialize_with",), "DeserializeWith": ("deserialize_with",), "ArchiveWith": ("resolve_with",)}),
    Plugin("wasmtime", dependencies=("wasmtime",), members={"Host": (), "WasiView": ("ctx", "table"), "ResourceLimiter": ("memory_growing", "table_growing")}),
]
