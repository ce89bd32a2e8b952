"""Golden projects: the exact set of findings of small source trees."""

import io
import json
import subprocess

import pytest

from lodeweave import cli
from lodeweave.plans.check import check, check_diff
from lodeweave.sources import config, discover, extract, sinks

BODY = "function {0}(items) {{ let sum = 0; for (const item of items) {{ if (item.price > 10 && item.count) {{ sum = sum + item.price * item.count; }} else {{ sum = sum + 1; }} }} if (sum > 100) {{ sum = sum - 10; }} const tax = sum * 2; return sum + tax; }}"
PROJECTS = {
    "cyclic": (
        {"package.json": '{"name":"x","main":"main.ts"}', "main.ts": "import {a} from './a'; export const run = a;", "a.ts": "import {b} from './b'; export const a = b;", "b.ts": "import {a} from './a'; export const b = 1; export const c = a;"},
        {("cyclic", "file", "a.ts", None), ("unused", "constant", "b.ts", "c")},
    ),
    "hygiene": (
        {"package.json": '{"name":"x","main":"src/index.ts","dependencies":{"chai":"1"},"devDependencies":{"vitest":"1"}}', "src/index.ts": "export function go() { return 1; }", "src/index.test.ts": "import chai from 'chai'; chai.expect(1);"},
        {("test-only", "dependency", "package.json", "chai"), ("unused", "dependency", "package.json", "vitest"), ("untested", "file", "src/index.ts", None)},
    ),
    "clones": (
        {"package.json": '{"name":"x","main":"main.ts"}', "main.ts": "import {f} from './f'; import {g} from './g'; export const run = [f, g];", "f.ts": "export " + BODY.format("f"), "g.ts": "// other\nexport " + BODY.format("g").replace("sum", "total")},
        {("duplicate", "function", "f.ts", "f")},
    ),
    "crap": (
        {"package.json": '{"name":"x","main":"risky.ts"}', "risky.ts": "export function classify(n) {\n if (n > 1) { return 1 }\n if (n > 2) { return 2 }\n if (n > 3) { return 3 }\n if (n > 4) { return 4 }\n if (n > 5) { return 5 }\n return n > 6 ? 6 : 7\n}\n", "lcov.info": "SF:risky.ts\nDA:2,0\nDA:3,0\nend_of_record\n"},
        {("crap", "function", "risky.ts", "classify")},
    ),
    "monorepo": (
        {
            "package.json": '{"name":"root","private":true,"workspaces":["packages/*"]}',
            "packages/a/package.json": '{"name":"@o/a","main":"index.js","dependencies":{"chalk":"^5","@o/b":"1"}}',
            "packages/b/package.json": '{"name":"@o/b","main":"index.js","dependencies":{"chalk":"^4","@o/a":"1"}}',
            "packages/a/index.js": "const chalk = require('chalk'); const b = require('@o/b'); const p = require('phantom'); module.exports = { chalk, b, p };",
            "packages/b/index.js": "const chalk = require('chalk'); const a = require('@o/a'); module.exports = { chalk, a };",
        },
        {("version-skew", "dependency", "packages/a/package.json", "chalk"), ("undeclared", "dependency", "packages/a/package.json", "phantom"), ("cyclic", "package", "packages/a/package.json", None)},
    ),
    "visibility": (
        {
            "package.json": '{"name":"x","main":"m.ts"}',
            "m.ts": "import {run} from './r'; export const m = run;",
            "r.ts": "export function helper(a) {\n  return a;\n}\ninterface Hidden { a: number }\nexport function run(x: Hidden) {\n  return helper(x);\n}\n",
        },
        {("internal-only", "function", "r.ts", "helper"), ("private-type-leak", "function", "r.ts", "run")},
    ),
    "chains": (
        {
            "package.json": '{"name":"x","main":"m.ts"}',
            "m.ts": "import {Box, Foo} from './t';\nexport function m(b: Box<Foo>) {\n  b.value.go();\n  return b.get().stop();\n}\n",
            "t.ts": "export class Box<T> {\n  value: T;\n  get(): T { return this.value; }\n}\nexport class Foo {\n  go(): void { run(1); }\n  stop(): void { run(2); }\n  idle(): void { run(3); }\n}\nclass Other {\n  go(): void { run(4); }\n}\nfunction run(n) { return n; }\n",
        },
        {("unused", "method", "t.ts", "Foo.idle"), ("unused", "class", "t.ts", "Other"), ("unused", "method", "t.ts", "Other.go"), ("private-type-leak", "function", "m.ts", "m")},
    ),
    "crate": (
        {
            "Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde_json = "1"\nrand = "0.8"\n',
            "src/main.rs": "mod a;\nmod used;\n#[cfg(test)]\nmod checks;\nuse crate::a::go;\nfn main() {\n    go();\n}\n",
            "src/a.rs": "use serde_json::Value;\nuse std::fmt::Debug;\nuse crate::used::help;\npub fn go() {\n    help();\n}\nfn lost() {\n    help();\n}\n",
            "src/used/mod.rs": "pub fn help() {\n}\n",
            "src/checks.rs": "use crate::a::go;\nfn test_go() {\n    go();\n}\n",
        },
        {("unused", "function", "src/a.rs", "lost"), ("unused", "dependency", "Cargo.toml", "rand"), ("untested", "file", "src/main.rs", None)},
    ),
    "suppressed": (
        {"package.json": '{"name":"x","main":"m.ts"}', "m.ts": "export const m = 1;\n// weave:allow unused kept for later\nfunction old() { return 1; }\n// weave:allow unused\nconst y = 2;\nexport const z = y;\n"},
        {("stale", "suppression", "m.ts", None)},
    ),
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.mark.parametrize("names", [("cyclic", "clones", "crap", "suppressed", "visibility"), ("hygiene",), ("monorepo",), ("chains",), ("crate",)])
def test_golden(spark, tmp_path, names):
    """Projects side by side are packages of their own; those whose findings would mix stand alone."""
    want = set()
    for name in names:
        files, found = PROJECTS[name]
        below = f"{name}/" if len(names) > 1 else ""
        write(tmp_path, {below + k: v.replace('"name":"x"', f'"name":"{name}"').replace("SF:", "SF:" + below) for k, v in files.items()})
        want |= {(c, k, below + p, s) for c, k, p, s in found}
    got = {(r.category, r.subject_kind, r.path, r.symbol) for r in check(spark, str(tmp_path)).findings.collect()}
    assert got == want


def test_diff_git_and_cli(spark, tmp_path):
    write(tmp_path, {"package.json": '{"name":"x","main":"m.ts"}', "m.ts": "export const m = 1;", ".gitignore": "out/\n", "out/x.ts": "const q = 1;"})
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "one")
    assert sorted(r.path for r in discover.discover(spark, str(tmp_path)).collect()) == sorted(r.path for r in discover.discover_git(spark, str(tmp_path), "HEAD").collect()) == ["m.ts", "package.json"]
    write(tmp_path, {"m.ts": "export const m = 1;\nfunction dead() { return 2; }"})
    rows = check_diff(spark, str(tmp_path), "HEAD").collect()
    assert [(r.delta, r.origin) for r in rows] == [("new", "introduced")]
    out = io.StringIO()
    assert cli.main(["check", str(tmp_path), "--format", "json", "--fail-on", "warning"], spark, out) == 1
    report = json.loads(out.getvalue())
    assert [f["symbol"] for f in report["findings"]] == ["dead"] and report["health"]["grade"] in "ABCDF"
    assert cli.main(["baseline", str(tmp_path)], spark, out) == 0 and cli.main(["check", str(tmp_path), "--fail-on", "info"], spark, out) == 0
    assert cli.main(["find", str(tmp_path), "dead"], spark, out) == 0 and cli.main(["uses", str(tmp_path), "nowhere.ts"], spark, out) == 1


def test_extraction_of_each_language():
    names = lambda path, text: {(d["name"], d["member_of"]) for d in extract.extract(path, text.encode()).declarations}
    assert names("a.go", 'package m\nimport ("fmt"; "x/y")\nfunc (s *T) Do() { fmt.Println() }\ntype T struct { }\nfunc main() { }') == {("Do", "T"), ("T", None), ("main", None)}
    assert names("a.rs", "use a::{C, D};\npub struct S { x: i32 }\nimpl Display for S { fn fmt(&self) { self.x } }\nfn main() { run!(); }") == {("S", None), ("fmt", "S"), ("main", None)}
    assert ("A", "A") in names("A.java", "package p; import java.util.List; public class A { public A() {} @Override public String toString() { return \"a\"; } }")
    assert names("a.kt", "package p\nclass A { fun go(): Int { return 1 } }\nfun main() { A().go() }") == {("A", None), ("go", "A"), ("main", None)}
    assert names("a.swift", "import Foundation\npublic struct A { func go() -> Int { return 1 } }") == {("A", None), ("go", "A")}
    assert names("a.scss", "@use 'b';\n$c: 1;\n@mixin m { }") == {("$c", None), ("m", None)}
    page = extract.extract("a.html", b'<script src="x.js"></script><a href="https://z">')
    assert [i["specifier"] for i in page.imports] == ["./x.js"] and page.roots
    assert extract.extract("a.json", b"{").diagnostics and extract.extract("a.txt", b"x") is None
    odd = extract.extract("a.ts", b"export function f( { { ` unclosed \xff")
    assert odd is not None


def test_sinks():
    rows = [{"id": "1", "category": "unused", "subject_kind": "file", "severity": 1, "confidence": 2, "path": "a", "line": 1, "symbol": None, "package": None, "message": None}]
    assert json.loads(sinks.sarif(rows))["runs"][0]["results"][0]["level"] == "warning"
    assert json.loads(sinks.json_report(rows))["findings"][0]["confidence"] == "certain"
    assert "a:1" in sinks.agent_text(rows) and "dead-code (1)" in sinks.human_text(rows) and sinks.human_text([]) == "nothing found"
    assert config.Settings().skip == []
