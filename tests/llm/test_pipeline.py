import corpus_pipeline
from lodeweave.llm import packing, quality_rules, simhash

from .conftest import SCHEMA, words


def test_stages_and_run(spark, tmp_path):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    base = words(50, 120)
    rows = [(i, words(i, 90), "en", f"src{i % 3}", 9) for i in range(20)]
    rows += [(20, base, "en", "src0", 9), (21, base + " end", "en", "src1", 9), (22, "too short", "en", "src0", 9), (23, f'{words(70, 80)} token = "{secret}"', "de", "src2", 9), (24, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(24) if i != 22]
    one = stage["near_dedup"](spark, kept, "")
    assert sorted(r.doc_id for r in one.collect()) == [i for i in range(24) if i not in (21, 22)]
    clean = stage["secret_scan"](spark, one, "")
    assert clean.columns == docs.columns and secret not in "".join(r.text for r in clean.collect())
    mixed = stage["mixing"](spark, clean, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    rows_ = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows_} == {r.doc_id for r in mixed.collect()}
    encode = packing.encoder(packing.fast_vocabulary())
    by_doc = {r.doc_id: r for r in rows_}
    assert all(by_doc[r.doc_id].ids == encode(r.text) + [0] for r in mixed.collect())
    assert corpus_pipeline.ORACLE_SQL is None and quality_rules and simhash


def test_empty(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_near_dedup_links_by_fingerprints_and_by_similarity(spark):
    block, rows = words(80, 61).split(), []
    for g in range(3):  # long repeats and own ends: fingerprints are alike, sets of shingles are not
        own, ends = [f"{w}{g}" for w in block], [words(81 + 10 * g + k, 40) for k in range(2)]
        rows += [f"{' '.join(own * 40)} {ends[0]}", f"{' '.join(own * 40)} {ends[1]}", f"{' '.join([*own[:30], 'zz', *own[31:]] * 40)} {ends[1]}"]
    rows += [words(200 + i, 90) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in enumerate(rows)], SCHEMA)
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for t in rows]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for i in (0, 3, 6):
        assert (prints[i] ^ prints[i + 1]).bit_count() <= 2 and alike(i, i + 1) < 0.8
        # the third is tied to the first by the second only
        assert alike(i + 1, i + 2) >= 0.8 > alike(i, i + 2) and min((prints[i + 2] ^ prints[j]).bit_count() for j in (i, i + 1)) > 2
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 6, *range(9, 15)]
