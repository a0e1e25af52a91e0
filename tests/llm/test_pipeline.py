"""The pipeline's stages against brute force on a small fixture, each on what the one before kept."""

import corpus_pipeline
from lumenfield.llm import decontaminate, registry, simhash
from tests.llm.test_text_operators import brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if k == 0:
            bad = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id").collect()}
            assert bad & before.keys() and not bad & after.keys()
        if k == 1:
            want = {d: t for d, t, n in brute_lines(list(before.items()), 2) if not n or t or before[d].count("\n") + 1 > n}
            assert after == want
        if k == 2:
            assert set(after) == {d for d, _, root in simhash.brute_force(list(before.items())) if d == root}
        if k == 3:
            assert set(after) == {r[0] for r in decontaminate.brute_force(list(before.items()), bench) if not r[-1]}
        if k == 4:
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == set(before)
        docs = out
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == docs.count()


def test_registry():
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
