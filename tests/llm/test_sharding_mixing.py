import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import mixing, sharding

from .conftest import words


def test_shards_are_near_equal_and_slots_gapless(spark, folder):
    rows = sharding.op5_sharding(spark, folder).collect()
    assert len(rows) == 13
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r.size for r in own) <= total / 24 + most
    assert {r.doc_id: r.text_crc32 for r in rows}[8] == zlib.crc32(b"one two")
    assert {r.size for r in rows if r.doc_id == 5} == {8}


def test_a_hot_key_is_split_by_exact_bytes(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else words(i, 5)) for i in range(3000)], "id bigint, t string")
    out = sharding.shard_by_size(df, 10, F.octet_length("t") + 8, F.col("t"), F.col("id"), {"id": F.col("id")}, sample_per_range=8)
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * 60


def test_copies_stay_together_and_shards_near_equal(spark):
    rows = [(i, words(i % 700 if i < 2000 else i, 3 + i % 9)) for i in range(6000)] + [(9000 + i, "a hot text " * 3) for i in range(3000)] + [(None, "no id")] * 400
    df = spark.createDataFrame(rows, "id bigint, t string")
    out = sharding.shard_by_size(df, 12, F.octet_length("t") + 8, F.col("t"), F.col("id"), {"id": F.col("id"), "t": F.col("t")}, range_bytes=4096).collect()
    assert len(out) == len(rows)
    sizes, groups, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        groups[r.t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(sizes) == 12 and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 12
    assert {t for t, s in groups.items() if len(s) > 1} == {"a hot text " * 3}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_groups_are_dealt_to_the_emptiest_shard_that_holds_them():
    assert sharding.deal_groups([(5, 1), (4, 2), (3, 3), (2, 4)], 2, 7) == ({1: 0, 2: 1, 3: 1, 4: 0}, [7, 7])
    assert sharding.deal_groups([(8, 1), (7, 2)], 2, 7) == ({2: 0}, [7, 0])
    assert sharding.deal_groups([], 2, 0) == ({}, [0, 0])


def test_range_search_and_subdivision(spark):
    bounds = [(1, 5, 0), (1, 5, 3), (1, 9, 0), (4, 0, 0)]
    rows = [(0, 7, 0), (1, 4, 0), (1, 5, 0), (1, 5, 2), (1, 5, 3), (1, 8, 0), (1, 9, 0), (3, 0, 0), (4, 0, 0), (9, 9, 9)]
    df = spark.createDataFrame(rows, "k bigint, r bigint, c bigint").withColumn("x", sharding.range_of([F.col("k"), F.col("r"), F.col("c")], bounds))
    assert [tuple(r) for r in df.collect()] == [(*p, sum(b <= p for b in bounds)) for p in rows]
    finer = sharding.subdivide([(5, 0, 0)], {0: 10, 1: 100}, [(i, 0, 0) for i in range(10)], 30)
    assert finer[0] == (5, 0, 0) and len(finer) == 4


def test_no_rows(spark, empty_folder):
    assert sharding.op5_sharding(spark, empty_folder).count() == 0
    assert mixing.op4_mixing(spark, empty_folder).count() == 0


def budget_by_hand(budget, nodes):
    """Water filling of [(name, cap, weight)] in whole tokens."""
    out, left = {}, list(nodes)
    while left:
        spare, heavy = budget - sum(out.values()), sum(w for _, _, w in left)
        full = [n for n in left if n[1] * heavy <= spare * n[2]]
        if not full:
            return out | {n: spare * w // heavy for n, _, w in left}
        name, cap, _ = min(full, key=lambda n: n[1] / n[2])
        out[name] = cap
        left = [n for n in left if n[0] != name]
    return out


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "d string, s string, tokens bigint")
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(leaves, ["d", "s"], {"d": {"a": 1, "b": 1}}, (1, 2), 1).collect()}
    top = budget_by_hand(3010 // 2, [("a", 1010, 1), ("b", 2000, 1)])
    want = {("a", k): v for k, v in budget_by_hand(top["a"], [("x", 10, 1), ("y", 1000, 1)]).items()} | {("b", k): v for k, v in budget_by_hand(top["b"], [("x", 1000, 1), ("y", 1000, 1)]).items()}
    assert got == want and got["a", "x"] == 10 and got["a", "y"] == 742


@pytest.mark.parametrize("parts", [(1, 4), (1, 1), (3, 1)])
def test_mix_keeps_to_budgets(spark, parts):
    rows = spark.createDataFrame([(i, "en" if i % 3 else "de", f"s{i % 4}", 5 + i % 7) for i in range(400)], "rid bigint, lang string, source string, tokens bigint")
    out = mixing.mix(rows, ["lang", "source"], {"lang": {"en": 2}}, parts, max_epochs=2).collect()
    total = sum(r.tokens for r in rows.collect())
    spent = sum(r.tokens for r in out)
    assert spent <= min(total * parts[0] // parts[1], 2 * total) and spent >= min(total * parts[0] // parts[1], 2 * total) - 8 * 20
    seen = defaultdict(list)
    for r in out:
        seen[r.rid].append(r.epoch)
    assert all(sorted(e) == list(range(len(e))) for e in seen.values())


def test_mix_of_odd_rows(spark, odd_docs):
    wide = odd_docs.withColumn("_rid", F.lit("x")).withColumn("domain", F.lit(1))
    out = mixing.mix_documents(wide, (1, 1))
    assert out.columns == wide.columns
    assert 0 < out.count() <= 2 * 13


def test_levels_may_have_any_names(spark):
    names = ["at", "bucket", "upto", "epochs", "rest", "budget", "cap", "weight", "root"]
    plain = spark.createDataFrame([(i, f"a{i % 2}", f"b{i % 3}", 5 + i % 7) for i in range(200)], "rid bigint, x string, y string, tokens bigint")
    want = sorted(tuple(r) for r in mixing.mix(plain, ["x", "y"], {"x": {"a0": 3}}, (1, 2)).collect())
    for a, b in zip(names, names[1:], strict=False):
        out = mixing.mix(plain.withColumnsRenamed({"x": a, "y": b}), [a, b], {a: {"a0": 3}}, (1, 2))
        assert out.columns == ["rid", a, b, "tokens", "epoch"] and sorted(tuple(r) for r in out.collect()) == want
