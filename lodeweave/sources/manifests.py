"""Package manifests: dependencies, entry files, workspace members and scripts, as rows."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "package string, manifest string, kind string, name string, value string, scope string, ordinal int"
Row = tuple[str, str, str | None, str | None]  # kind, name, value, scope


def _targets(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _targets(v)
    elif isinstance(value, list):
        for v in value:
            yield from _targets(v)


def package_json(text: str) -> Iterator[Row]:
    data = json.loads(text)
    if data.get("name"):
        yield "name", data["name"], None, "private" if data.get("private") else None
    for key, scope in (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, version in (data.get(key) or {}).items():
            yield "dependency", name, None if str(version).startswith(("workspace:", "file:", "link:")) else str(version), scope
    for key in ("main", "module", "browser", "types", "bin"):
        for target in _targets(data.get(key)):
            yield "entry", posixpath.normpath(target), None, key
    if "exports" in data:
        for target in _targets(data["exports"]):
            yield "surface", posixpath.normpath(target), None, None
    workspaces = data.get("workspaces") or []
    for glob in workspaces.get("packages", []) if isinstance(workspaces, dict) else workspaces:
        yield "member", glob, None, None
    for name, command in (data.get("scripts") or {}).items():
        yield "script", name, str(command), None


def cargo_toml(text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    package = data.get("package", {})
    if package.get("name"):
        yield "name", package["name"], None, "private" if package.get("publish") is False else None
    tables = [data, *data.get("target", {}).values()]
    for table in tables:
        for key, scope in (("dependencies", "prod"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for name, spec in table.get(key, {}).items():
                spec = spec if isinstance(spec, dict) else {"version": spec}
                yield "dependency", name, spec.get("version"), "optional" if spec.get("optional") else scope
    for name, spec in data.get("workspace", {}).get("dependencies", {}).items():
        yield "pool", name, spec.get("version") if isinstance(spec, dict) else spec, None
    for glob in data.get("workspace", {}).get("members", []):
        yield "member", glob, None, None
    if package:
        for path in ("src/lib.rs", "src/main.rs", "build.rs"):
            yield "entry", path, None, "convention"
    for key in ("lib", "bin", "test", "example", "bench"):
        for target in [data[key]] if key == "lib" and key in data else data.get(key, []) if key != "lib" else []:
            if target.get("path"):
                yield "entry", target["path"], None, key


def go_mod(text: str) -> Iterator[Row]:
    text = re.sub(r"//(?! indirect).*", "", text)
    if m := re.search(r"(?m)^module\s+(\S+)", text):
        yield "name", m[1].strip('"'), None, None
    for block in [*re.findall(r"(?ms)^require\s*\((.*?)^\)", text), *("\n" + x for x in re.findall(r"(?m)^require\s+([^(\s].*)$", text))]:
        for name, version, indirect in re.findall(r"(?m)^\s*([^\s/][^\s]*)\s+(v\S+)(\s*// indirect)?", block):
            yield "dependency", name, version, "optional" if indirect else "prod"


def go_work(text: str) -> Iterator[Row]:
    for block in [*re.findall(r"(?ms)^use\s*\((.*?)^\)", text), *re.findall(r"(?m)^use\s+([^(\s]+)\s*$", text)]:
        for path in block.split():
            yield "member", posixpath.normpath(path), None, None


def pom_xml(text: str) -> Iterator[Row]:
    root = ET.fromstring(re.sub(r"\sxmlns=\"[^\"]*\"", "", text, count=1))
    if (a := root.findtext("artifactId")) is not None:
        yield "name", a, None, None
    for d in root.findall("./dependencies/dependency"):
        name = f"{d.findtext('groupId', '')}:{d.findtext('artifactId', '')}"
        scope = {"test": "dev", "provided": "peer"}.get(d.findtext("scope", ""), "optional" if d.findtext("optional") == "true" else "prod")
        yield "dependency", name, d.findtext("version"), scope
    for d in root.findall("./dependencyManagement/dependencies/dependency"):
        yield "pool", f"{d.findtext('groupId', '')}:{d.findtext('artifactId', '')}", d.findtext("version"), None
    for m in root.findall("./modules/module"):
        yield "member", m.text or "", None, None


def gradle(text: str) -> Iterator[Row]:
    text = re.sub(r"/\*.*?\*/|//[^\n]*", "", text, flags=re.S)
    for scope, name, version in re.findall(r"""\b(\w*[iI]mplementation|api|compileOnly|runtimeOnly|testRuntimeOnly|kapt)\b[\s(]*["']([^:"']+:[^:"']+)(?::([^"']+))?["']""", text):
        yield "dependency", name, version or None, "dev" if scope.startswith("test") else "peer" if scope == "compileOnly" else "prod"
    for block in re.findall(r"\binclude\b[\s(]*((?:[\"'][^\"']+[\"'][,\s]*)+)", text):
        for member in re.findall(r"[\"']:?([^\"']+)[\"']", block):
            yield "member", member.replace(":", "/"), None, None


def package_swift(text: str) -> Iterator[Row]:
    if m := re.search(r"Package\s*\(\s*name:\s*\"([^\"]+)\"", text):
        yield "name", m[1], None, None
    for url, version in re.findall(r"\.package\s*\([^)]*?url:\s*\"([^\"]+)\"[^)]*?\"([^\"]+)\"", text):
        yield "dependency", re.sub(r"\.git$", "", url.rsplit("/", 1)[-1]), version, "prod"
    for kind, name in re.findall(r"\.(target|executableTarget|testTarget)\s*\(\s*name:\s*\"([^\"]+)\"", text):
        yield "target", name, None, kind


PARSERS: dict[str, Callable[[str], Iterator[Row]]] = {
    "package.json": package_json,
    "Cargo.toml": cargo_toml,
    "go.mod": go_mod,
    "go.work": go_work,
    "pom.xml": pom_xml,
    "build.gradle": gradle,
    "build.gradle.kts": gradle,
    "settings.gradle": gradle,
    "settings.gradle.kts": gradle,
    "Package.swift": package_swift,
}


def parse(files: DataFrame) -> DataFrame:
    """Rows of all manifests in `files` (path, content); one that can't be parsed gives a row of kind diagnostic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = PARSERS.get(posixpath.basename(path))
                if parser:
                    try:
                        rows = list(parser((content or b"").decode("utf-8", "replace")))
                    except (ValueError, ET.ParseError, AttributeError, TypeError) as error:
                        rows = [("diagnostic", str(error)[:200], None, None)]
                    out += [(posixpath.dirname(path), path, *row, i) for i, row in enumerate(rows)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:6]), pa.array(columns[6], pa.int32())], ["package", "manifest", "kind", "name", "value", "scope", "ordinal"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
