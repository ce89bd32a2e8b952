"""Assembly: joins and fixpoints that turn extracted facts into the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..plans.lineage import cut
from ..schema import CERTAIN, FILE, MODULE, PACKAGE, POSSIBLE, PROBABLE, PUBLIC, UNIT


def longest_prefix(rows: DataFrame, path: str, dirs: DataFrame, default: str | None = None) -> DataFrame:
    """`rows` with `owner`: of (dir, owner) the one whose directory is the nearest above `path`.

    Paths are exploded to their ancestors, so that it is an equi-join, not a range join.
    """
    paths = rows.select(path).distinct()
    above = paths.select(path, F.explode(ancestors(F.col(path))).alias("dir"))
    best = above.join(dirs, "dir").groupBy(path).agg(F.max_by("owner", F.struct(F.length("dir"), "owner")).alias("owner"))
    return rows.join(best, path, "left").withColumn("owner", F.coalesce("owner", F.lit(default)))


def inherit_versions(declared: DataFrame, pool: DataFrame) -> DataFrame:
    """Declared dependencies with versions from the workspace pool (name, version_req) where they have none."""
    shared = pool.groupBy("name").agg(F.min("version_req").alias("pooled"))
    return declared.join(shared, "name", "left").withColumn("version_req", F.coalesce("version_req", "pooled")).drop("pooled")


def promote_test_roles(files: DataFrame, test_dirs: list[str]) -> DataFrame:
    """Production files whose first directory under their package is a test directory get role test."""
    inner = F.when(F.col("package") == "", F.col("path")).otherwise(F.expr("substring(path, length(package) + 2)"))
    first = F.when(F.instr(inner, "/") > 0, F.split(inner, "/")[0])
    return files.withColumn("role", F.when((F.col("role") == "production") & first.isin(*test_dirs), "test").otherwise(F.col("role")))


def demote_test_gated(files: DataFrame, gates: DataFrame) -> DataFrame:
    """Production files that modules pull in only under test gates get role test. gates: (target, from_test)."""
    only = gates.groupBy("target").agg(F.bool_and("from_test").alias("only")).where("only").select(F.col("target").alias("path"), F.lit(True).alias("gated"))
    return files.join(only, "path", "left").withColumn("role", F.when(F.col("gated") & (F.col("role") == "production"), "test").otherwise(F.col("role"))).drop("gated")


def role_roots(files: DataFrame) -> DataFrame:
    """Every test or tooling file is a probable root of its kind."""
    return files.where("role in ('test', 'tooling')").select(F.col("role").alias("kind"), F.col("path").alias("node"), F.lit(PROBABLE).alias("confidence"))


def cap_roots(roots: DataFrame, roles: DataFrame) -> DataFrame:
    """Production roots in test or tooling files take the file's kind. roles: (node, role)."""
    kind = F.when((F.col("kind") == "production") & F.col("role").isin("test", "tooling"), F.col("role")).otherwise(F.col("kind"))
    return roots.join(roles, "node", "left").select(kind.alias("kind"), "node", "confidence")


# imports

#: Endings that a relative script import may leave out, in order, and index files after them. Fixed values.
SCRIPT_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts")


def normalize_path(path: Column) -> Column:
    """`.` and `..` segments applied; going above the root gives null."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda out, s: F.when((s == "..") & (F.size(out) > 0), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))))
    return F.when(~F.array_contains(done, ".."), F.array_join(done, "/"))


def script_candidates(importer: Column, specifier: Column) -> Column:
    """Paths that a relative or rooted specifier may mean, in order of precedence."""
    base = normalize_path(F.when(specifier.startswith("/"), specifier).otherwise(F.concat(dirname(importer), F.lit("/"), specifier)))
    return F.array(base, *[F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS], *[F.concat(base, F.lit("/index" + e)) for e in SCRIPT_ENDINGS])


def package_part(specifier: Column) -> Column:
    """The package name of a bare specifier: its first segment, or two if it is scoped."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def resolve_script_imports(imports: DataFrame, files: DataFrame, workspace: DataFrame, declared: DataFrame, stdlib: list[str]) -> DataFrame:
    """`imports` (path, package, specifier, ...) with (resolution, target).

    Relative: the first candidate that is a file, else missing. `#x`: unresolved. A workspace name: the member's entry or
    subpath, if there; `node:`: stdlib; a declared dependency; a listed stdlib module; else a dependency by name.
    workspace: (name, dir, entry); declared: (package, name).
    """
    spec = F.col("specifier")
    relative = spec.startswith(".") | spec.startswith("/")
    sites = imports.select("path", "package", "specifier").distinct().withColumn("name", package_part(spec))
    paths = sites.where(relative).select("path", "specifier", F.posexplode(script_candidates(F.col("path"), spec)).alias("at", "candidate"))
    inner = sites.where(~relative).join(workspace, "name")
    subpath = F.concat("dir", F.lit("/"), F.expr("substring(specifier, length(name) + 2)"))
    whole = F.when(F.col("specifier") == F.col("name"), F.array(F.concat("dir", F.lit("/"), "entry"))).otherwise(script_candidates(F.lit(""), F.concat(F.lit("/"), subpath)))
    members = inner.select("path", "specifier", F.posexplode(whole).alias("at", "candidate"))
    files_ = files.select(F.col("path").alias("candidate"))
    hit = paths.withColumn("member", F.lit(False)).union(members.withColumn("member", F.lit(True))).join(files_, "candidate")
    found = hit.groupBy("path", "specifier").agg(F.min_by("candidate", "at").alias("file"), F.bool_or("member").alias("member"))
    known = declared.select("package", "name").distinct().withColumn("declared", F.lit(True))
    rows = sites.join(found, ["path", "specifier"], "left").join(known, ["package", "name"], "left")
    resolution = (
        F.when(spec.startswith("#"), "unresolved")
        .when(F.col("member"), "workspace-member")
        .when(F.col("file").isNotNull(), "file")
        .when(relative, "missing")
        .when(spec.startswith("node:"), "stdlib")
        .when(F.col("declared"), "dependency")
        .when(F.col("name").isin(*stdlib), "stdlib")
        .otherwise("dependency")
    )
    target = F.when(resolution.isin("file", "workspace-member"), F.col("file")).when(resolution == "dependency", F.col("name"))
    return imports.join(rows.select("path", "specifier", resolution.alias("resolution"), target.alias("target")), ["path", "specifier"])


def resolve_by_prefix(imports: DataFrame, modules: DataFrame, separator: str = "/") -> DataFrame:
    """`imports` with `target`: of modules (module, target) the one whose name is the longest prefix by segments."""
    parts = F.split("specifier", F.lit("\\" + separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    met = imports.select("specifier").distinct().select("specifier", F.explode(prefixes).alias("module")).join(modules, "module")
    best = met.groupBy("specifier").agg(F.max_by("target", F.struct(F.length("module"), "target")).alias("target"))
    return imports.join(best, "specifier", "left")


def resolve_by_unit(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`imports` with `target`: the first file by path of the unit that is named, the importer's own package first."""
    named = imports.join(files.where("unit is not null").select(F.col("unit").alias("specifier"), F.col("path").alias("file"), F.col("package").alias("of")), "specifier")
    best = named.groupBy("path", "specifier").agg(F.min(F.struct((F.col("of") != F.col("package")).alias("foreign"), "file")).alias("b"))
    return imports.join(best.select("path", "specifier", F.col("b.file").alias("target")), ["path", "specifier"], "left")


def resolve_rust(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`imports` (path, specifier, ...) with `target`: `mod:x` means x.rs or x/mod.rs beside the file or below its own name;
    crate, self and super paths mean the file of the longest prefix of segments below the crate's src, the module or the one
    above it. files: (path, package)."""
    own = F.regexp_replace("path", r"(?:/?(?:mod|lib|main))?\.rs$", "")
    sites = imports.select("path", "specifier").distinct().join(files.select("path", "package"), "path").withColumn("module", own)
    root = F.when(F.col("package") == "", F.lit("src")).otherwise(F.concat("package", F.lit("/src")))
    parts = F.split(F.regexp_replace("specifier", "::", "."), r"\.")
    tail = F.slice(parts, 2, F.size(parts))
    start = F.when(F.col("specifier").startswith("mod:"), F.col("module")).when(parts[0] == "crate", root).when(parts[0] == "self", F.col("module")).when(parts[0] == "super", dirname(F.col("module")))
    steps = F.when(F.col("specifier").startswith("mod:"), F.array(F.substring("specifier", 5, 1 << 20))).otherwise(tail)
    placed = sites.withColumns({"start": start, "steps": steps}).where("start is not null")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("steps"), F.lit(1))), lambda n: F.array_join(F.filter(F.concat(F.array("start"), F.slice("steps", 1, n)), lambda x: x != ""), "/"))
    tried = placed.select("path", "specifier", F.posexplode(prefixes).alias("n", "base")).select("path", "specifier", "n", F.explode(F.array(F.concat("base", F.lit(".rs")), F.concat("base", F.lit("/mod.rs")))).alias("candidate"))
    best = tried.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("path", "specifier").agg(F.max_by("candidate", F.struct("n", "candidate")).alias("target"))
    return imports.join(best, ["path", "specifier"], "left")


# names


def ranked_resolution(tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(ref, target, tier): the candidates of each reference's first tier that has any. Tiers: (ref, target), in order."""
    union = None
    for i, (name, candidates) in enumerate(tiers):
        rows = candidates.select("ref", "target", F.lit(i).alias("rank"), F.lit(name).alias("tier"))
        union = rows if union is None else union.union(rows)
    best = union.groupBy("ref").agg(F.min("rank").alias("first"))
    return union.join(best, "ref").where("rank = first").select("ref", "target", "tier").distinct()


def duck_typed(refs: DataFrame, members: DataFrame, ancestry: DataFrame | None = None) -> DataFrame:
    """(ref, target, confidence): members of a bare name in the same language that are visible from the site.

    refs: (ref, name, language, path, unit, package), a row for each ref; members: (sym, name, language, path, unit, package,
    scope). One candidate is probable; several are possible. ancestry: (unit, ancestor), for members that a module and all
    modules inside it see. Candidates are counted by site first, so the pairs, which are as many as the rows that come out,
    are not moved again.
    """
    m = members.select("sym", "name", "language", "scope", *[F.col(c).alias(f"m_{c}") for c in ("path", "unit", "package")]).hint("shuffle_hash")
    above = None if ancestry is None else ancestry.select(F.col("unit").alias("site_unit"), F.col("ancestor").alias("holder_unit"), F.lit(True).alias("inside")).distinct()

    def visible(sites: DataFrame) -> DataFrame:
        met, inside = sites.join(m, ["name", "language"]), F.lit(False)
        if above is not None:
            met = met.join(above, (F.col("unit") == F.col("site_unit")) & (F.col("m_unit") == F.col("holder_unit")), "left")
            inside = (F.col("scope") == MODULE) & F.coalesce("inside", F.lit(False))
        seen = scope_contains(F.col("scope"), F.col("m_path") == F.col("path"), F.col("m_unit") == F.col("unit"), F.col("m_package") == F.col("package"))
        return met.where(seen | inside)

    at = ["name", "language", "path", "unit", "package"]
    counted = visible(refs.select(*at).distinct()).groupBy(*at).agg(F.count("*").alias("many")).toDF(*[f"c_{c}" for c in at], "many")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in at]
    told = refs.join(counted.hint("shuffle_hash"), same).select("ref", *at, "many")
    return visible(told).select("ref", F.col("sym").alias("target"), F.when(F.col("many") == 1, PROBABLE).otherwise(POSSIBLE).alias("confidence"))


def scope_contains(scope: Column, same_file: Column, same_unit: Column, same_package: Column) -> Column:
    """Whether a declaration of this scope can be seen from a site; modules count as units here."""
    false = F.lit(False)
    return (
        F.when(scope == FILE, F.coalesce(same_file, false))
        .when(scope < PACKAGE, F.coalesce(same_file | same_unit, false))
        .when(scope == PACKAGE, F.coalesce(same_package, false))
        .otherwise(scope >= PUBLIC)
    )


def required_scope(same_file: Column, same_unit: Column, same_package: Column) -> Column:
    """The narrowest scope that covers a use."""
    return F.when(same_file, FILE).when(F.coalesce(same_unit, F.lit(False)), UNIT).when(same_package, PACKAGE).otherwise(PUBLIC)


def unit_ancestry(units: DataFrame) -> DataFrame:
    """(unit, ancestor): each unit with itself and all units above it. units: (unit, parent).

    The ways up are doubled each round, so the rounds grow with the logarithm of the depth.
    """
    seen = cut(units.select("unit", F.col("unit").alias("ancestor")).distinct())
    jump = cut(units.where("parent is not null").select("unit", F.col("parent").alias("above")).distinct())
    n = seen.count()
    while True:
        # those less than 2^k steps up, and the same above each unit 2^k steps up; broadcasts would pass through the driver
        lower = seen.select(F.col("unit").alias("above"), "ancestor")
        beyond = jump.join(lower.hint("merge"), "above", "left").select("unit", F.coalesce("ancestor", "above").alias("ancestor"))
        seen, before = cut(seen.union(beyond).distinct()), n
        n = seen.count()
        if n == before:
            return seen
        higher = jump.select(F.col("unit").alias("above"), F.col("above").alias("top"))
        jump = cut(jump.join(higher.hint("merge"), "above").select("unit", F.col("top").alias("above")).distinct())


def within_owner(sites: DataFrame, twins: DataFrame) -> DataFrame:
    """(site, sym): of twin declarations of a name in a file, the innermost whose lines hold the site."""
    met = sites.join(twins, ["path", "name"]).where("line between first and last")
    return met.groupBy("site").agg(F.min_by("sym", F.struct(F.col("last") - F.col("first"), "sym")).alias("sym"))


def link_bindings(bindings: DataFrame) -> DataFrame:
    """Module bindings (file, name, target) with those of their targets, one hop on: `a.b` for b bound in a's target.

    A name that the file binds itself stays as it is."""
    hop = bindings.alias("x").join(bindings.alias("y"), F.col("x.target") == F.col("y.file")).select(F.col("x.file").alias("file"), F.concat("x.name", F.lit("."), "y.name").alias("name"), F.col("y.target").alias("target"))
    fresh = hop.join(bindings.select("file", "name"), ["file", "name"], "left_anti").groupBy("file", "name").agg(F.min("target").alias("target"))
    return bindings.select("file", "name", "target").union(fresh)


def reexport_fixpoint(names: DataFrame, pending: DataFrame) -> DataFrame:
    """(file, name, sym): names with all that re-exports add, to a least fixpoint.

    pending: (file, name, source, source_name); a null source_name takes every name of the source (name is then null).
    A name that exists wins over a re-exported one; of several that arrive together the least symbol is taken.
    """
    known = cut(names.select("file", "name", "sym"))
    named, globs = pending.where("source_name is not null"), pending.where("source_name is null")
    frontier = known
    while not frontier.isEmpty():
        f = frontier.select(F.col("file").alias("source"), F.col("name").alias("source_name"), "sym")
        by_name = named.join(f, ["source", "source_name"]).select("file", "name", "sym")
        by_glob = globs.select("file", "source").join(f, "source").select("file", F.col("source_name").alias("name"), "sym")
        step = by_name.union(by_glob).groupBy("file", "name").agg(F.min("sym").alias("sym"))
        frontier = cut(step.join(known.select("file", "name"), ["file", "name"], "left_anti"))
        known = known.unionByName(frontier)
    return known


def library_surface(entries: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, confidence): files that whole-module re-exports make part of a package's surface.

    entries: (file, confidence); reexports: (src, dst, confidence). A file found again takes the better confidence but
    isn't followed again, so what it re-exports keeps the confidence of the round in which it was found.
    """
    seen = cut(entries.groupBy("file").agg(F.max("confidence").alias("confidence")))
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(reexports, frontier.file == reexports.src).select(F.col("dst").alias("file"), F.least(frontier.confidence, reexports.confidence).alias("new"))
        step = step.groupBy("file").agg(F.max("new").alias("new"))
        both = cut(seen.join(step, "file", "full").select("file", F.col("confidence").alias("old"), F.greatest("confidence", "new").alias("confidence")))
        frontier = both.where("old is null").drop("old")
        seen = both.drop("old")
    return seen


def surface_closure(surface: DataFrame, members: DataFrame) -> DataFrame:
    """(sym): surface symbols with their members, as long as a member is exported and its rung carries on.

    members: (owner, member, joins)."""
    from .graph import reach

    edges = members.where("joins").select(F.col("owner").alias("src"), F.col("member").alias("dst"))
    return reach(edges, surface.select(F.col("sym").alias("node"))).select(F.col("node").alias("sym"))


# implicit edges


def implicit_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, confidence) that liveness needs besides the stated edges.

    Module load: a symbol needs its file. Containment: a member needs its owner (same file and name, no member itself).
    Machinery: an owner may invoke its implicitly invoked members (probable). Implementation: for an implement or extend
    edge T to S, a member of S may call the member of T of that name in the edge's file (probable). Wildcard: a file may
    use all that it declares (possible). Invocation: running a program needs it and its production roots.
    """
    load = symbols.select(F.col("sym").alias("src"), F.col("path").alias("dst"), F.lit(CERTAIN).alias("confidence"))
    members = symbols.where("member_of is not null")
    owners = symbols.where("member_of is null").select("path", F.col("name").alias("member_of"), F.col("sym").alias("owner"))
    owned = members.join(owners, ["path", "member_of"])
    contain = owned.select(F.col("sym").alias("src"), F.col("owner").alias("dst"), F.lit(CERTAIN))
    machinery = owned.where("implicitly_invoked").select(F.col("owner").alias("src"), F.col("sym").alias("dst"), F.lit(PROBABLE))
    kin = edges.where("ref_kind in ('implement', 'extend')").select(F.col("src").alias("t"), F.col("dst").alias("s"), F.col("owner").alias("file"))
    of = owned.select("owner", "name", "sym", "path")
    dispatch = (
        kin.join(of.select(F.col("owner").alias("s"), "name", F.col("sym").alias("src")), "s")
        .join(of.select(F.col("owner").alias("t"), "name", F.col("sym").alias("dst"), F.col("path").alias("file")), ["t", "name", "file"])
        .select("src", "dst", F.lit(PROBABLE))
    )
    wild = edges.where("ekind = 'wildcard'").select(F.col("src").alias("path")).distinct().join(symbols.select("path", "sym"), "path").select(F.col("path").alias("src"), F.col("sym").alias("dst"), F.lit(POSSIBLE))
    return load.union(contain).union(machinery).union(dispatch).union(wild).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def invoked_programs(edges: DataFrame, roots: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, confidence): invoking a file reaches it and each production root symbol that it declares."""
    calls = edges.where("ekind = 'invokes-file'").select("src", F.col("dst").alias("path"), "confidence")
    entry = roots.where("kind = 'production'").select(F.col("node").alias("sym"), F.col("confidence").alias("rooted")).join(symbols.select("sym", "path"), "sym")
    inner = calls.join(entry, "path").select("src", F.col("sym").alias("dst"), F.least("confidence", "rooted").alias("confidence"))
    return calls.select("src", F.col("path").alias("dst"), "confidence").union(inner)


def dynamic_targets(dynamics: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, confidence): a dynamic import narrowed to a directory may mean any file below it (an equi-join on ancestors)."""
    below = files.select(F.col("path").alias("dst"), F.explode(ancestors(F.col("path"))).alias("dir"))
    return dynamics.select(F.col("path").alias("src"), "dir").join(below, "dir").where("src <> dst").select("src", "dst", F.lit(POSSIBLE).alias("confidence"))


def plugin_targets(contributions: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(plugin, node, kind, confidence): a contribution's path, and its name in it (bare, then Owner.name); misses go."""
    qualified = F.concat_ws(".", "member_of", "name")
    named = contributions.where("name is not null").withColumnRenamed("name", "wanted").join(symbols.select("path", "sym", "name", qualified.alias("qualified")), "path").where("wanted = name or wanted = qualified")
    first = named.withColumn("rank", F.when(F.col("wanted") == F.col("name"), 0).otherwise(1))
    best = first.withColumn("least", F.min("rank").over(Window.partitionBy("plugin", "path", "wanted"))).where("rank = least")
    whole = contributions.where("name is null").join(files.select("path"), "path", "left_semi")
    return best.select("plugin", F.col("sym").alias("node"), "kind", "confidence").union(whole.select("plugin", F.col("path").alias("node"), "kind", "confidence"))


def externally_invoked(symbols: DataFrame, rules: list[tuple[list[str], str]]) -> DataFrame:
    """(kind, node, confidence): symbols with a marker of a rule, in files that its glob names, are production roots."""
    from ..functions.paths import glob_to_regex

    hit = F.lit(False)
    for markers, glob in rules:
        hit = hit | (F.arrays_overlap("markers", F.array(*map(F.lit, markers))) & F.col("path").rlike(glob_to_regex(glob)))
    return symbols.where(hit).select(F.lit("production").alias("kind"), F.col("sym").alias("node"), F.lit(CERTAIN).alias("confidence"))


def region_covers(outer_scope: Column, outer_path: Column, outer_unit: Column, outer_package: Column, scope: Column, path: Column, unit: Column, package: Column) -> Column:
    """Whether everything that sees an inner declaration's region also lies in the outer one's region."""
    wide = outer_scope >= PUBLIC
    in_package = (outer_scope >= PACKAGE) & (scope <= PACKAGE) & outer_package.eqNullSafe(package)
    in_unit = (outer_scope >= UNIT) & (scope < PACKAGE) & outer_unit.eqNullSafe(unit)
    in_file = (scope == FILE) & outer_path.eqNullSafe(path)
    return wide | in_package | in_unit | in_file


#: One argument of a generic type, with arguments of its own two levels down.
ARGUMENT = r"[^,<>\s]+(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?"


def substitute(text: Column, params: Column, arguments: Column) -> Column:
    """A type expression with each parameter replaced by its argument; those without an argument stay."""
    pairs = F.arrays_zip(params.alias("p"), arguments.alias("a"))
    return F.aggregate(pairs, text, lambda out, x: F.when(x["a"].isNull() | x["p"].isNull(), out).otherwise(F.regexp_replace(out, F.concat(F.lit(r"\b"), x["p"], F.lit(r"\b")), x["a"])))


def chained_members(chains: DataFrame, fields: DataFrame, generics: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(ref, type): the type at the end of member chains `a.b.c`, by member-type facts; null where a step isn't known.

    chains: (ref, type, steps array); fields: (type, member, yields); generics: (type, params). Steps are taken one a round,
    by a join of all chains that still have one; what a member of a generic type yields has its parameters replaced by the
    arguments that the chain has come with.
    """
    now = chains.select("ref", "type", "steps")
    bare = fields.groupBy("type", "member").agg(F.min("yields").alias("yields")).withColumnsRenamed({"type": "of", "member": "m"})
    params = (generics if generics is not None else fields.select("type", F.array().cast("array<string>").alias("params")).limit(0)).groupBy("type").agg(F.min("params").alias("params")).withColumnRenamed("type", "g")
    for _ in range(most):
        if now.where("type is not null and size(steps) > 0").isEmpty():
            break
        left, base = F.size("steps") > 0, F.regexp_replace("type", "<.*$", "")
        step = now.withColumn("base", base).withColumn("member", F.when(left, F.get("steps", F.lit(0))))
        met = step.join(bare, (F.col("base") == F.col("of")) & (F.col("member") == F.col("m")), "left").join(params, F.col("base") == F.col("g"), "left")
        arguments = F.regexp_extract_all(F.regexp_extract("type", "<(.*)>$", 1), F.lit(ARGUMENT), 0)
        after = F.when(F.col("params").isNull(), F.col("yields")).otherwise(substitute(F.col("yields"), F.col("params"), arguments))
        now = cut(met.select("ref", F.when(left, after).otherwise(F.col("type")).alias("type"), F.when(left, F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0)))).otherwise(F.col("steps")).alias("steps")))
    return now.select("ref", F.when(F.size("steps") == 0, F.col("type")).alias("type"))


def surface_signature(facts: DataFrame) -> DataFrame:
    """(path, surface): a digest of what other files depend on, without lines, so that a shift leaves it as it is."""
    shown = F.transform("facts.declarations", lambda d: F.struct(d["name"], d["kind"], d["exported"], d["member_of"], d["visibility"], d["implements"], d["markers"]))
    held = F.transform(F.filter("facts.types", lambda t: t["owner"].isNotNull()), lambda t: F.struct(t["owner"], t["name"], t["type"]))
    gates = F.transform("facts.gates", lambda g: F.struct(g["module"], g["gated"]))
    brought = F.transform("facts.imports", lambda i: F.struct(i["specifier"], i["name"], i["alias"], i["reexport"]))
    return facts.select("path", F.sha2(F.to_json(F.struct(F.array_sort(shown).alias("d"), F.array_sort(brought).alias("i"), F.array_sort(held).alias("t"), F.array_sort(gates).alias("g"), F.col("facts.roots").alias("r"), F.col("facts.unit").alias("u"))), 256).alias("surface"))


def is_stdlib(specifier: Column, prefixes: list[str], names: list[str]) -> Column:
    """Whether a specifier belongs to the standard library: by a prefix of whole segments, or as a listed name."""
    hit = specifier.isin(*names)
    for p in prefixes:
        hit = hit | (specifier == p) | specifier.startswith(p if p.endswith((".", ":", "/")) else p + ".")
    return hit
