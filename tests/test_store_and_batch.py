import json

import pytest

from lodeweave.operators import health
from lodeweave.plans import batch
from lodeweave.plans.check import assemble_graph, check, stored_graph, surfaces
from lodeweave.sources import config, discover, extract, store
from lodeweave.streaming.incremental import can_patch


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in {
        "package.json": '{"name":"x","main":"m.ts"}',
        "m.ts": "import {a} from './a';\nexport function m() {\n  return a();\n}\n",
        "a.ts": "export function a() {\n  return 1;\n}\nfunction gone() {\n  return a();\n}\n",
    }.items():
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def result(spark, project):
    return check(spark, str(project))


def test_batch(result):
    lines = ['{"verb": "find", "text": "a"}', "nonsense", "", '{"verb": "used-by", "selectors": ["a.ts#a"], "edges": "references"}', '{"verb": "trace", "selectors": ["m.ts#m", "a.ts#a"]}', '{"verb": "uses", "selectors": ["zz"]}', '{"verb": "impact", "selectors": ["a.ts#a"], "if_deleted": true}', '{"verb": "describe", "selectors": ["a.ts#a"]}', '{"verb": "fly"}']
    found, bad, used, trace, missing, impact, described, unknown = (json.loads(x) for x in batch.answer_lines(result, lines))
    assert {r["node"].split("@")[0] for r in found["rows"]} == {"a.ts#a", "a.ts"} and found["elided"] == 0
    assert "error" in bad and missing["error"] == "not found" and "error" in unknown
    assert {r["node"].split("@")[0] for r in used["rows"]} == {"m.ts#m", "a.ts#gone"}
    assert trace["rows"][0]["weakest"] == 2 and len(trace["rows"][0]["path"]) == 2
    assert all(r["after"] == "unreachable" for r in impact["rows"])
    assert described["rows"][0]["color"] == "production" and described["roots"][0]["kind"] == "production"
    one = result.findings.first().id
    assert batch.answer(result, {"verb": "explain", "id": one})["rows"][0]["id"] == one


def test_stored_facts_and_snapshots(spark, project, result, tmp_path, monkeypatch):
    tree = discover.discover(spark, str(project))
    first = {r.path: r.facts for r in store.facts(spark, tree, str(tmp_path)).collect()}
    calls = spark.sparkContext.accumulator(0)
    real = extract.extract

    def counted(path, content):
        calls.add(1)
        return real(path, content)

    monkeypatch.setattr(extract, "extract", counted)
    (project / "b.ts").write_text("export const b = 1;")
    try:
        again = store.facts(spark, discover.discover(spark, str(project)), str(tmp_path)).collect()
    finally:
        (project / "b.ts").unlink()
    assert {r.path for r in again} == {*first, "b.ts"} and {r.path: r.facts for r in again if r.path != "b.ts"} == first
    assert store.load(spark, tree, str(tmp_path)) is None
    key = store.save(result.graph, tree, str(tmp_path))
    assert store.load(spark, tree, str(tmp_path)).symbols.count() == result.graph.symbols.count()
    assert store.prune(spark, str(tmp_path), 1 << 40) == [] and store.prune(spark, str(tmp_path), 0) == [key]
    score = health.score(result.health)
    assert store.trend(spark, score, str(tmp_path)).first().previous is None
    assert store.trend(spark, score, str(tmp_path)).first().previous == score.first().score


def test_a_patched_graph_is_that_of_a_full_run(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "store")
    root.mkdir()
    files = {"package.json": '{"name":"x","main":"m.ts"}', "m.ts": "import {a} from './a';\nexport function m() {\n  return a();\n}\n", "a.ts": "export function a() {\n  return b();\n}\nfunction b() {\n  return 1;\n}\n"}
    files |= {f"z{i}.ts": f"export const z{i} = {i};" for i in range(40)}
    for path, text in files.items():
        (root / path).write_text(text)
    settings = config.Settings()
    first = stored_graph(spark, discover.discover_with_stat(spark, str(root), folder), settings, folder)
    assert store.latest(spark, folder).symbols.count() == first.symbols.count()
    # lines move and a use goes, but nothing that others depend on
    (root / "a.ts").write_text("// moved\nexport function a() {\n  return 2;\n}\nfunction b() {\n  return 1;\n}\n")
    tree = discover.discover_with_stat(spark, str(root), folder)
    assert can_patch(store.last_surfaces(spark, folder), surfaces(tree, store.facts(spark, tree, folder)))
    patched = stored_graph(spark, tree, settings, folder)
    whole = assemble_graph(spark, discover.discover(spark, str(root)), settings)
    for name in ("edges", "imports", "symbols"):
        assert sorted(map(str, getattr(patched, name).collect())) == sorted(map(str, getattr(whole, name).select(*getattr(patched, name).columns).collect()))
    again = stored_graph(spark, discover.discover_with_stat(spark, str(root), folder), settings, folder)
    assert again.edges.count() == whole.edges.count()
