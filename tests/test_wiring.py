"""Operators that whole runs use, each on a few rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import analyses, assemble, coverage, health
from lodeweave.plans import plugins
from lodeweave.plans.check import read_coverage, verdict
from lodeweave.sources import config, extract


def test_type_arguments_take_the_place_of_parameters(spark):
    chains = spark.createDataFrame([(1, "Box<Foo>", ["value", "name"]), (2, "Pair<A,Box<Foo>>", ["right", "value"]), (3, "Box<Foo>", ["none"]), (4, "Foo", []), (5, "Plain", ["value"])], "ref int, type string, steps array<string>")
    fields = spark.createDataFrame([("Box", "value", "T"), ("Foo", "name", "Text"), ("Pair", "right", "R"), ("Plain", "value", "Box<Foo>")], "type string, member string, yields string")
    generics = spark.createDataFrame([("Box", ["T"]), ("Pair", ["L", "R"])], "type string, params array<string>")
    got = {r.ref: r.type for r in assemble.chained_members(chains, fields, generics).collect()}
    assert got == {1: "Text", 2: "Foo", 3: None, 4: "Foo", 5: "Box<Foo>"}


def test_module_paths(spark):
    files = spark.createDataFrame([(p, "") for p in ("src/main.rs", "src/a.rs", "src/a/b.rs", "src/c/mod.rs")], "path string, package string")
    rows = [("src/main.rs", "mod:a"), ("src/main.rs", "mod:c"), ("src/a.rs", "mod:b"), ("src/main.rs", "crate.a.b"), ("src/a/b.rs", "super.x"), ("src/a.rs", "self.b"), ("src/main.rs", "serde.x"), ("src/main.rs", "mod:zz")]
    got = {(r.path, r.specifier): r.target for r in assemble.resolve_rust(spark.createDataFrame(rows, "path string, specifier string"), files).collect()}
    assert [got[r] for r in rows] == ["src/a.rs", "src/c/mod.rs", "src/a/b.rs", "src/a/b.rs", None, "src/a/b.rs", None, None]


def test_shortest_cycle_of_each_group(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "y"), ("y", "x")], "src string, dst string")
    groups = spark.createDataFrame([("a",), ("x",)], "anchor string")
    parts = spark.createDataFrame([(n, "a" if n < "d" else "x") for n in "abcxy"], "node string, component string")
    assert {r.anchor: r.cycle for r in analyses.shortest_cycles(edges, groups, parts).collect()} == {"a": ["a", "b", "a"], "x": ["x", "y", "x"]}
    assert analyses.shortest_cycles(edges, groups.limit(0), parts).count() == 0


def test_verdict_of_budgets_strictness_and_severity(spark):
    findings = spark.createDataFrame([("unused", 1, "a"), ("unused", 1, "a"), ("crap", 1, "b")], "category string, severity int, path string")
    deltas = spark.createDataFrame([("unused", "new"), ("unused", "new"), ("crap", "fixed")], "category string, delta string")
    of = lambda budgets=None, fail_on=None, strict=False, d=deltas: verdict(findings, d, config.Settings(budgets=budgets or {}, fail_on=fail_on), strict).first().verdict
    assert of() == "pass" and of(strict=True) == "fail" and of(fail_on=1) == "fail" and of(fail_on=2) == "pass"
    assert of({"unused": 2, "crap": 0}) == "pass" and of({"unused": 1}) == "fail" and of({"unused": 1}, d=None) == "pass"
    assert of({"unused-per-subject": 1}, d=None) == "fail" and of({"unused-per-subject": 2}) == "pass"


def test_points_to_the_next_grade(spark):
    rows = spark.createDataFrame([(95.0,), (89.5,), (64.0,), (10.0,)], "score double")
    assert [r.n for r in rows.select(health.to_next_grade(F.col("score")).alias("n")).collect()] == [None, 0.5, 1.0, 40.0]


def test_old_reports_are_left_out_and_paths_brought_home(spark):
    now = datetime.datetime.now()
    text = b"SF:lib/x.js\nDA:1,2\nend_of_record\nSF:y.js\nDA:1,1\nend_of_record\n"
    tree = spark.createDataFrame([("lcov.info", bytearray(text), now), ("old.lcov", bytearray(text.replace(b"DA:1,2", b"DA:9,9")), now - datetime.timedelta(days=30))], "path string, content binary, modified timestamp")
    files = spark.createDataFrame([("p/lib/x.js", "p"), ("a/y.js", "a"), ("b/y.js", "b")], "path string, package string")
    assert [tuple(r) for r in read_coverage(tree, files, max_age=86_400).collect()] == [("p/lib/x.js", 1, 2)]
    lines = spark.createDataFrame([("/build/p/lib/x.js", 3, 1)], "path string, line int, hits bigint")
    assert [r.path for r in coverage.rebase(lines, [("/build/", "")]).collect()] == ["p/lib/x.js"]


def test_a_plugin_sees_what_its_globs_and_budgets_allow(spark):
    rows = [("a.xml", b"x" * 10), ("b.xml", b"x" * 100), ("c.xml", b"x" * 5000), ("d.txt", b"x")]
    contents = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    see = lambda plugin, *most: sorted(r.path for r in plugins.view(plugin, contents, *most).collect())
    some = plugins.Plugin("p", reads=("**/*.xml",))
    assert see(some) == ["a.xml", "b.xml", "c.xml"] and see(some, 200) == ["a.xml", "b.xml"] and see(some, 9999, 50) == ["a.xml"]
    assert see(plugins.Plugin("q")) == ["a.xml", "b.xml", "c.xml", "d.txt"]


@pytest.mark.parametrize("body, builds", [("{ return new Foo(1); }", True), ("{ return Foo(a(b), c); }", True), ("{ Foo { x: 1 } }", True), ("{ return &Foo{x}; }", True), ("{ return a + Foo(1); }", False), ("{ let x = 1; return Foo(x); }", False), ("{ }", False), ("{ return foo(1); }", False)])
def test_bodies_that_only_build_a_value(body, builds):
    assert extract.is_construction(extract.tokenize(body, extract.Facts())) == builds


def test_types_texts_and_gates_of_sources():
    facts = lambda path, text: extract.extract(path, text.encode())
    js = facts("a.ts", "class Box<T> { value: T; get(): T { return this.value; } }\nfunction run(b: Box<Foo>) { b.get().go(); log('hi'); }")
    assert {(t["owner"], t["name"], t["type"]) for t in js.types} == {("Box", "value", "T"), ("Box", "get", "T"), (None, "b", "Box<Foo>")}
    assert js.generics == [{"type": "Box", "params": ["T"]}] and js.texts[0]["callee"] == "log" and ("go", "b.get") in {(r["name"], r["qualifier"]) for r in js.references}
    rust = facts("src/lib.rs", "#[cfg(test)]\nmod tests;\npub mod a;\nstruct S { f: Vec<C> }")
    assert [(g["module"], g["gated"]) for g in rust.gates] == [("tests", True), ("a", False)] and ("S", "f", "Vec<C>") in {(t["owner"], t["name"], t["type"]) for t in rust.types}
    java = facts("A.java", "package p; class A { private Foo foo; Foo get() { return foo; } void run() { Bar b = new Bar(); } }")
    assert {("A", "foo", "Foo"), ("A", "get", "Foo"), (None, "b", "Bar")} <= {(t["owner"], t["name"], t["type"]) for t in java.types}
    go = facts("a.go", "package m\ntype T struct {\n s Store\n}\nfunc f() {\n x := Store{}\n}")
    assert {(t["name"], t["type"]) for t in go.types} >= {("s", "Store"), ("x", "Store")}


def test_init_and_plugin_verbs(spark, tmp_path):
    import io

    from lodeweave import cli

    assert cli.main(["init", str(tmp_path)]) == 0 and cli.main(["init", str(tmp_path)]) == 2
    assert config.parse((tmp_path / "lodeweave.toml").read_text()).problems == []
    (tmp_path / "package.json").write_text('{"name":"x","dependencies":{"express":"4"}}')
    out = io.StringIO()
    assert cli.main(["plugin", str(tmp_path)], spark, out) == 0 and "express active" in out.getvalue() and "serde idle" in out.getvalue()


def test_members_of_a_module_are_seen_inside_it(spark):
    refs = spark.createDataFrame([(1, "go", "rust", "src/a/b/x.rs", "src/a/b", "p"), (2, "go", "rust", "src/c.rs", "src", "p")], "ref int, name string, language string, path string, unit string, package string")
    members = spark.createDataFrame([("m", "go", "rust", "src/a/y.rs", "src/a", "p", 2)], "sym string, name string, language string, path string, unit string, package string, scope int")
    units = spark.createDataFrame([("src/a/b", "src/a"), ("src/a", "src"), ("src", None)], "unit string, parent string")
    assert assemble.duck_typed(refs, members).count() == 0
    assert [(r.ref, r.target, r.confidence) for r in assemble.duck_typed(refs, members, assemble.unit_ancestry(units)).collect()] == [(1, "m", 1)]


def test_pairs_of_duck_typing_are_not_moved_again(spark):
    at = "name string, language string, path string, unit string, package string"
    refs = spark.createDataFrame([(1, "go", "js", "a.js", None, "p"), (2, "go", "js", "a.js", None, "p"), (3, "go", "js", "b.js", "u", "q"), (4, "no", "js", "b.js", "u", "q")], f"ref int, {at}")
    members = spark.createDataFrame([("m", "go", "js", "a.js", None, "p", 0), ("n", "go", "js", "c.js", "u", "p", 4), ("o", "go", "js", "d.js", "u", "q", 1)], f"sym string, {at}, scope int")
    out = assemble.duck_typed(refs, members)
    assert {tuple(r) for r in out.collect()} == {(1, "m", 0), (1, "n", 0), (2, "m", 0), (2, "n", 0), (3, "n", 0), (3, "o", 0)}
    assert {tuple(r) for r in assemble.duck_typed(refs.where("ref = 1"), members.where("sym = 'm'")).collect()} == {(1, "m", 1)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_ancestry_takes_few_rounds_and_goes_all_the_way_up(spark, monkeypatch):
    calls, write = [], assemble.cut
    monkeypatch.setattr(assemble, "cut", lambda df: (calls.append(1), write(df))[1])
    units = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(70)] + [("x", "y"), ("y", "x")], "unit string, parent string")
    got = {tuple(r) for r in assemble.unit_ancestry(units).collect()}
    want = {(f"u{i}", f"u{j}") for i in range(70) for j in range(i, 71)} | {(a, b) for a in "xy" for b in "xy"}
    assert got == want and len(calls) < 20


def test_texts_are_fingerprinted_in_one_pass_as_by_columns(spark):
    from lodeweave.functions import fingerprints as fp

    words = [f"w{i * i % 37}é" for i in range(90)]
    texts = [" ".join(words), "\t\n ".join(words[:57]) + " ", " ".join(words[:50]), " ".join(words[:49]), "", None, "a b c " * 60, "x " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = rows.select("id", F.filter(F.split("text", r"[ \t-\r]+"), lambda t: t != "").alias("t")).where(F.size("t") >= fp.FLOOR)
    want = {(r.id, r.n, tuple(r.f)) for r in tokens.select("id", F.size("t").alias("n"), fp.winnow(fp.grams(F.col("t"))).alias("f")).collect()}
    got = fp.fingerprinted(rows, "text", ["id"])
    assert len(want) == 5 and {(r.id, r.n_tokens, tuple(r.fingerprints)) for r in got.collect()} == want
