"""The pipeline stage by stage against plain Python on the stage's own input."""

import corpus_pipeline
from ablatrix.llm import decontamination, near_dedup, quality_rules
from ablatrix.session import stage


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, sf_dir), name)
        if name == "packing":
            tokens = {}
            for r in out.collect():
                tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
                assert tokens[r["doc_id"]] <= r["doc_tokens"]
            assert set(tokens) == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == docs.columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(before[k] == v for k, v in after.items()) and after
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
        elif name == "near_dedup":
            fps = {k: near_dedup.simhash(near_dedup.shingle_hashes(t, 3)) for k, t in before.items()}
            group = {k: k for k in fps}
            for _ in fps:
                new = {k: min(group[j] for j in fps if (fps[k] ^ fps[j]).bit_count() <= 3) for k in fps}
                if new == group:
                    break
                group = new
            kept = set(group.values())
        elif name == "decontamination":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            judged = decontamination.brute_force([*before.values()], items)
            kept = {k for k, (n, hit, _, _) in zip(before, judged) if not (hit and 20 * hit >= n)}
        else:
            kept = set(after)
        assert set(after) == kept
        docs = out


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        assert docs.count() == 0
