import pytest
from pyspark.sql import functions as F

from lodeweave.functions.paths import ancestors, glob_to_regex, origin
from lodeweave.functions.pragmas import parse as parse_pragmas
from lodeweave.operators import analyses, assemble, coverage, health, report
from lodeweave.sources import config, coverage_formats, discover, manifests
from lodeweave.streaming import incremental


def test_crap_by_hand(spark):
    df = spark.createDataFrame([("a", 6, 0.0), ("b", 6, 1.0), ("c", 6, None), ("d", 5, 0.0)], "id string, complexity int, coverage double")
    assert {r.id: r.score for r in analyses.crap(df).collect()} == {"a": 42.0, "c": 42.0}
    assert [r.category for r in analyses.abstained(spark.createDataFrame([("test", "n", 1)], "kind string, node string, confidence int"), spark.createDataFrame([], "path string, line int, hits bigint")).collect()] == ["crap"]


def test_rollup(spark):
    files = [("one/a", True), ("two/a", True), ("two/b", True), ("mixed/a", True), ("mixed/b", None), ("deep/x/a", True), ("deep/x/b", True), ("deep/y", True)]
    got = {(r.dir, r.n_files) for r in analyses.directory_rollup(spark.createDataFrame(files, "path string, eligible boolean")).collect()}
    assert got == {("two", 2), ("deep", 3)}


def test_skew_ignores_null_versions(spark):
    df = spark.createDataFrame([("a", None), ("a", "1"), ("b", "1"), ("b", "2")], "name string, version_req string")
    assert [(r.name, r.evidence) for r in analyses.version_skew(df).collect()] == [("b", "1,2")]


def test_common_fingerprints_make_no_clones(spark):
    rows = [(i, "x", [1, 100 + i]) for i in range(21)] + [(50, "x", [7, 8, 9]), (51, "x", [7, 8, 9]), (52, "y", [7, 8, 9])]
    pairs = analyses.clone_pairs(spark.createDataFrame(rows, "rid int, language string, fingerprints array<bigint>"))
    assert [(r.a, r.b) for r in pairs.collect()] == [(50, 51)]


def test_package_cycles_take_over_file_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("b", "a", 1)], "src string, dst string, confidence int")
    row = analyses.cycles(edges).first()
    assert (row.anchor, row.size, row.confidence) == ("a", 2, 1)
    assert analyses.cycles(edges, small=True).first() == row
    groups = spark.createDataFrame([("a",)], "component string")
    members = spark.createDataFrame([("a", "P", True), ("a", "Q", True)], "component string, package string, is_real boolean")
    assert analyses.file_cycles_only(groups, members).count() == 0


def test_dependency_usage(spark):
    declared = spark.createDataFrame([("p", "m", "dead", "prod", 0), ("p", "m", "opt", "optional", 1), ("p", "m", "t", "prod", 2), ("p", "m", "dev", "dev", 3), ("p", "m", "peer", "peer", 4), ("p", "m", "tool", "prod", 5)], "package string, manifest string, name string, scope string, ordinal int")
    imports = spark.createDataFrame([("p", "t", "test"), ("p", "dev", "test")], "package string, name string, role string")
    scripts = spark.createDataFrame([("p", "tool")], "package string, name string")
    got = {r.name: (r.verdict, r.confidence) for r in analyses.dependency_usage(declared, imports, scripts).collect()}
    assert got == {"dead": ("unused", 2), "opt": ("unused", 0), "t": ("test-only", 2)}


def test_visibility(spark):
    symbols = spark.createDataFrame([("a", "l", 2, False), ("b", "l", 2, True), ("c", "l", 2, False)], "sym string, language string, visibility int, nested_scope boolean")
    sites = spark.createDataFrame([("a", 1, 2), ("a", 4, 0), ("b", 0, 2)], "sym string, scope int, confidence int")
    ladder = spark.createDataFrame([("l", 0, 1), ("l", 1, 3), ("l", 2, 4)], "language string, idx int, scope int")
    got = {r.sym: (r.tightest, r.confidence) for r in analyses.internal_only(symbols, sites, ladder).collect()}
    assert got == {"a": (0, 0), "b": (1, 2)}


def test_longest_prefix_and_resolution(spark):
    dirs = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, owner string")
    rows = spark.createDataFrame([("a/x",), ("a/b/c/y",), ("ab/z",)], "path string")
    assert {r.path: r.owner for r in assemble.longest_prefix(rows, "path", dirs, "?").collect()} == {"a/x": "A", "a/b/c/y": "B", "ab/z": "?"}
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.js",), ("src/both.ts",), ("src/both.js",), ("pkg/core/main.ts",), ("pkg/core/util.ts",)], "path string")
    specs = ["./a", "./lib", "./both", "./gone", "../up", "#x", "node:fs", "fs", "@o/core", "@o/core/util", "lodash/get", "@s/p/q"]
    imports = spark.createDataFrame([("src/m.ts", "p", s) for s in specs], "path string, package string, specifier string")
    workspace = spark.createDataFrame([("@o/core", "pkg/core", "main.ts")], "name string, dir string, entry string")
    declared = spark.createDataFrame([("p", "lodash")], "package string, name string")
    got = {r.specifier: (r.resolution, r.target) for r in assemble.resolve_script_imports(imports, files, workspace, declared, ["fs"]).collect()}
    assert got == {
        "./a": ("file", "src/a.ts"), "./lib": ("file", "src/lib/index.js"), "./both": ("file", "src/both.ts"), "./gone": ("missing", None), "../up": ("missing", None), "#x": ("unresolved", None),
        "node:fs": ("stdlib", None), "fs": ("stdlib", None), "@o/core": ("workspace-member", "pkg/core/main.ts"), "@o/core/util": ("workspace-member", "pkg/core/util.ts"), "lodash/get": ("dependency", "lodash"), "@s/p/q": ("dependency", "@s/p"),
    }
    go = assemble.resolve_by_prefix(spark.createDataFrame([("x/y/z",), ("x/yy",)], "specifier string"), spark.createDataFrame([("x", "r"), ("x/y", "s")], "module string, target string"))
    assert {r.specifier: r.target for r in go.collect()} == {"x/y/z": "s", "x/yy": "r"}
    unit = assemble.resolve_by_unit(spark.createDataFrame([("m", "P", "u")], "path string, package string, specifier string"), spark.createDataFrame([("a", "Q", "u"), ("b", "P", "u")], "path string, package string, unit string"))
    assert unit.first().target == "b"


def test_roles_and_roots(spark):
    files = spark.createDataFrame([("p/test/a", "p", "production"), ("p/src/a", "p", "production"), ("test/b", "", "production")], "path string, package string, role string")
    assert [r.role for r in assemble.promote_test_roles(files, ["test"]).orderBy("path").collect()] == ["production", "test", "test"]
    gates = spark.createDataFrame([("p/src/a", True)], "target string, from_test boolean")
    assert "test" in [r.role for r in assemble.demote_test_gated(files, gates).where("path = 'p/src/a'").collect()]


def test_library_surface_does_not_requeue(spark):
    entries = spark.createDataFrame([("e", 2)], "file string, confidence int")
    edges = spark.createDataFrame([("e", "a", 0), ("e", "b", 2), ("b", "a", 2), ("a", "z", 2)], "src string, dst string, confidence int")
    assert {r.file: r.confidence for r in assemble.library_surface(entries, edges).collect()} == {"e": 2, "a": 2, "b": 2, "z": 0}


def test_coverage_interval_join(spark):
    lines = spark.createDataFrame([("f", i, i % 2) for i in range(1, 1001)] + [("f", 1, 3)], "path string, line int, hits bigint")
    spans = spark.createDataFrame([("x", "f", 250, 270), ("y", "f", 5, 4), ("z", "g", 1, 9)], "id string, path string, first int, last int")
    got = {r.id: (r.instrumented, r.covered, r.coverage) for r in coverage.function_coverage(spans, coverage.accumulate(lines)).collect()}
    assert got == {"x": (21, 10, 10 / 21), "y": (0, 0, None), "z": (0, 0, None)}
    moved = coverage.rebase(lines.limit(1), [("f", "g")])
    assert moved.first().path == "g"
    by_package = coverage.rebase_by_package(spark.createDataFrame([("src/a", 1, 1), ("src/b", 1, 1)], "path string, line int, hits bigint"), spark.createDataFrame([("p",), ("q",)], "dir string"), spark.createDataFrame([("p/src/a",), ("p/src/b",), ("q/src/b",)], "path string"))
    assert [r.path for r in by_package.collect()] == ["p/src/a"]


def test_coverage_formats(spark):
    one = lambda text: spark.createDataFrame([(text,)], "content string")
    assert {tuple(r) for r in coverage_formats.parse_lcov(one("SF:a.js\nFN:1,x\nDA:1,2\nDA:3,0,abc\nend_of_record\nSF:b.js\nDA:9,1\nend_of_record\n")).collect()} == {("a.js", 1, 2), ("a.js", 3, 0), ("b.js", 9, 1)}
    assert {tuple(r) for r in coverage_formats.parse_go(one("mode: set\na/b.go:3.2,5.4 2 1\nbroken\n")).collect()} == {("a/b.go", n, 1) for n in (3, 4, 5)}
    xml = '<?xml version="1.0"?>\n<!DOCTYPE coverage SYSTEM "http://x/y.dtd">\n<coverage><sources><source>./src</source></sources><packages><package><classes><class filename="a.py"><lines><line number="2" hits="3"/></lines></class></classes></package></packages></coverage>'
    assert {tuple(r) for r in coverage_formats.parse_cobertura(one(xml)).collect()} == {("a.py", 2, 3), ("src/a.py", 2, 3)}
    xml = '<!DOCTYPE report PUBLIC "-//J//D" "report.dtd"><report name="x"><package name="p/q"><sourcefile name="A.java"><line nr="4" mi="0" ci="7"/></sourcefile></package></report>'
    assert ("src/main/java/p/q/A.java", 4, 7) in {tuple(r) for r in coverage_formats.parse_jacoco(one(xml)).collect()}


def test_health(spark):
    rows = spark.createDataFrame([("unused-files", 1, 8), ("cycles", 9, 10), ("unknown", 1, 1), ("crap", 0, 0)], "axis string, part bigint, whole bigint")
    got = {r.axis: r.penalty for r in health.penalties(rows).collect()}
    assert got == {"unused-files": 5.0, "cycles": 5.0, "crap": 0.0}
    row = health.score(health.penalties(rows)).first()
    assert (row.score, row.grade) == (90.0, "A")


def test_report(spark):
    before = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, path string")
    after = spark.createDataFrame([("2", "b"), ("3", "a"), ("4", "c")], "id string, path string")
    touched = report.touched_paths(spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content_hash string"), spark.createDataFrame([("a", "z"), ("b", "y")], "path string, content_hash string"))
    assert {tuple(r) for r in report.diff(before, after, touched).collect()} == {("1", "fixed", "introduced"), ("3", "new", "introduced"), ("4", "new", "derived")}
    assert {tuple(r) for r in report.against_baseline(after, before).collect()} == {("2", "acknowledged"), ("3", "kept"), ("4", "kept"), ("1", "stale")}
    rules = spark.createDataFrame([("equal", "c", "net", 1), ("over", "c", "net", 0)], "rule string, category string, kind string, most int")
    deltas = spark.createDataFrame([("c", "new", False), ("c", "new", False), ("c", "fixed", False), ("c", "new", True)], "category string, delta string, advisory boolean")
    totals = spark.createDataFrame([("c", "s", False)], "category string, subject string, advisory boolean")
    assert {(r.rule, r.measured, r.verdict) for r in report.budgets(deltas, totals, rules).collect()} == {("equal", 1, "pass"), ("over", 1, "fail")}


def test_pragmas(spark):
    lines = spark.createDataFrame([("// weave:allow unused:foo because",), ("/* weave:allow-file crap */",), ("// xweave:allow unused",), ("// weave:allow",)], "t string")
    got = [(r.scope, r.category, r.subject, r.reason) for r in parse_pragmas(lines, "t").collect()]
    assert got == [("next", "unused", "foo", "because"), ("file", "crap", None, None)]
    pragmas = spark.createDataFrame([(1, "f", 3, 3, "unused", None, "next"), (2, "f", 8, 8, "nonsense", None, "next"), (3, "g", 1, 1, "stale", None, "file")], "pragma int, path string, line int, last_line int, category string, subject string, scope string")
    symbols = spark.createDataFrame([("s", "f", 4, 6), ("t", "f", 9, 9)], "sym string, path string, first int, last int")
    bound = report.bind_pragmas(pragmas, symbols)
    findings = spark.createDataFrame([("x", "f", 5, "unused", "q"), ("y", "f", 7, "unused", "q")], "id string, path string, line int, category string, subject string")
    hit = report.suppress(findings, pragmas, bound)
    assert [(r.id, r.pragma) for r in hit.collect()] == [("x", 1)]
    assert {tuple(r) for r in report.stale_pragmas(pragmas, bound, hit, ["unused"]).collect()} == {(2, "unknown"), (3, "meta")}


def test_paths_and_globs(spark):
    df = spark.createDataFrame([("a/b/c.ts",), ("x",)], "path string").select(ancestors(F.col("path")).alias("a"))
    assert [r.a for r in df.collect()] == [["a/b", "a", ""], [""]]
    import re

    assert re.match(glob_to_regex("**/*.{ts,js}"), "a/b.ts") and re.match(glob_to_regex("src/*"), "src/a") and not re.match(glob_to_regex("src/*"), "src/a/b")
    rows = spark.createDataFrame([("vendor/a.js", ""), ("a.js", "// Code generated by x. DO NOT EDIT."), ("a.js", "x = 'code generated'")], "path string, content string")
    assert [r.o for r in rows.select(origin(F.col("path"), F.col("content")).alias("o")).collect()] == ["vendored", "generated", "authored"]


@pytest.mark.parametrize("line, path, hit", [("*.log", "a/b.log", True), ("/build", "build/x", True), ("/build", "a/build/x", False), ("dist/", "a/dist/x", True), ("dist/", "dist", False), ("a/*.txt", "a/b.txt", True), ("a/*.txt", "a/c/b.txt", False)])
def test_ignore_lines(line, path, hit):
    import re

    regex, back = discover.ignore_pattern(line, "")
    assert bool(re.search(regex, path)) is hit and not back
    assert discover.ignore_pattern("# x", "") is None and discover.ignore_pattern("!a", "")[1]


def test_manifests():
    kinds = lambda rows, kind: [(r[1], r[2], r[3]) for r in rows if r[0] == kind]
    rows = list(manifests.package_json('{"name":"a","main":"./x.js","dependencies":{"b":"^1"},"peerDependencies":{"c":"2"},"exports":{".":{"import":"./y.js"}},"workspaces":["p/*"],"scripts":{"s":"node z.js"}}'))
    assert kinds(rows, "dependency") == [("b", "^1", "prod"), ("c", "2", "peer")] and kinds(rows, "surface")[0][0] == "y.js" and kinds(rows, "entry")[0][0] == "x.js"
    assert ("serde", "1", "prod") in kinds(manifests.cargo_toml('[package]\nname="x"\n[dependencies]\nserde={version="1"}\n[dev-dependencies]\nq="2"'), "dependency")
    assert kinds(manifests.go_mod("module m/x\nrequire (\n\ta/b v1.2.3\n\tc/d v0.1.0 // indirect\n)\nrequire e/f v2.0.0\n"), "dependency") == [("a/b", "v1.2.3", "prod"), ("c/d", "v0.1.0", "optional"), ("e/f", "v2.0.0", "prod")]
    pom = '<project xmlns="http://m"><artifactId>z</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>'
    assert kinds(manifests.pom_xml(pom), "dependency") == [("g:a", "1", "dev")]
    assert kinds(manifests.gradle('dependencies { implementation("g:a:1.0")\n testImplementation "h:b" }'), "dependency") == [("g:a", "1.0", "prod"), ("h:b", None, "dev")]
    assert kinds(manifests.package_swift('let package = Package(name: "p", dependencies: [.package(url: "https://x/y.git", from: "1.0.0")], targets: [.target(name: "t")])'), "dependency") == [("y", "1.0.0", "prod")]


def test_config():
    s = config.parse('[analysis]\nskip=["crap","bogus"]\nmin-confidence="probable"\n[analysis.duplicate]\nmin-tokens=5\n[delta]\nunused=3\nbad="x"\n[odd]\n')
    assert (s.skip, s.min_confidence, s.duplicate_tokens, s.budgets) == (["crap"], 1, 50, {"unused": 3}) and len(s.problems) == 3
    assert config.parse("not toml [").problems and config.seconds("7d") == 604800
    assert config.merge(s, config.Settings(skip=["cyclic"], min_confidence=2)).skip == ["crap", "cyclic"]


def test_chains_regions_and_surfaces(spark):
    chains = spark.createDataFrame([(1, "A", ["b", "c"]), (2, "A", ["x"]), (3, "A", []), (4, None, ["b"])], "ref int, type string, steps array<string>")
    fields = spark.createDataFrame([("A", "b", "B<T>"), ("B", "c", "C")], "type string, member string, yields string")
    assert {r.ref: r.type for r in assemble.chained_members(chains, fields).collect()} == {1: "C", 2: None, 3: "A", 4: None}
    rows = [(4, "p", "u", "k", 3, "q", "v", "l"), (3, "p", "u", "k", 3, "q", "v", "k"), (0, "p", "u", "k", 3, "p", "u", "k"), (0, "p", "u", "k", 0, "p", "u", "k"), (1, "p", "u", "k", 0, "q", "u", "k")]
    df = spark.createDataFrame(rows, "a int, b string, c string, d string, e int, f string, g string, h string")
    assert [r.x for r in df.select(assemble.region_covers(*[F.col(x) for x in "abcdefgh"]).alias("x")).collect()] == [True, True, False, True, True]
    from lodeweave.sources import extract

    files = lambda text: extract.facts_of(spark.createDataFrame([("a.ts", "h", bytearray(text))], "path string, content_hash string, content binary"))
    one, moved, changed = (assemble.surface_signature(files(t)).first().surface for t in (b"export const a = 1;", b"\n// x\nexport const a = 1;", b"export const a = 1; export const b = 2;"))
    assert one == moved != changed
    names = spark.createDataFrame([("java.util",), ("javax.x",), ("javac",), ("kotlin",)], "s string")
    assert [r.x for r in names.select(assemble.is_stdlib(F.col("s"), ["java", "javax."], ["kotlin"]).alias("x")).collect()] == [True, True, False, True]


def test_incremental(spark):
    edges = spark.createDataFrame([("a", "b", "f"), ("c", "d", "g")], "src string, dst string, owner string")
    fresh = spark.createDataFrame([("a", "z", "f")], "src string, dst string, owner string")
    out = incremental.replace_owned(edges, spark.createDataFrame([("f",)], "owner string"), fresh)
    assert {tuple(r) for r in out.collect()} == {("c", "d", "g"), ("a", "z", "f")}
    schema = "path string, content_hash string, surface string, is_manifest boolean"
    old = [(f"f{i}", "h", "s", False) for i in range(40)]
    new = [("f0", "x", "s", False), *old[1:]]
    assert incremental.can_patch(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert not incremental.can_patch(spark.createDataFrame(old, schema), spark.createDataFrame([("f0", "x", "t", False), *old[1:]], schema))
    assert not incremental.can_patch(spark.createDataFrame(old, schema), spark.createDataFrame(new[:-1], schema))


def test_stream_of_changes(spark, tmp_path):
    seen = []
    schema = "owner string, src string, dst string"
    spark.createDataFrame([("f", "a", "b")], schema).write.parquet(f"{tmp_path}/in")
    q = incremental.watch(spark, f"{tmp_path}/in", schema, lambda df, n: seen.extend(tuple(r) for r in df.collect()), f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert seen == [("f", "a", "b")]
