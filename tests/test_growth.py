"""Work that must not grow faster than the input: what is written, held by workers and gone through again."""

import glob

from pyspark.sql import functions as F

from ablatrix.operators import packing, tokens
from ablatrix.session import shared_dir

DOCS = [(1, [["a", "b", "a"], ["zz"]]), (2, []), (3, [[], ["q", "q", "a"]]), (4, [["x", None, "x", "b"]]), (5, [["b"] * 9])]


def test_rare_tokens_are_asked_for_in_bounded_slices(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_VALUES", 3)
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("q", 5), ("x", 6)], "token string, id int")
    docs = spark.createDataFrame(DOCS, "doc_id int, tokens array<array<string>>").coalesce(1)
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/numbered-*"))
    for most in (1, 2, 100):
        known = vocab.select(F.col("token").alias("v"), F.col("id").alias("found"))
        got = {r["doc_id"]: r["ids"] for r in tokens._look_up(docs, known, "tokens", "ids", 0, most).collect()}
        ids = {"a": 3, "b": 4, "q": 5, "x": 6}
        assert got == {k: [[ids.get(t, 0) for t in s] for s in v] for k, v in DOCS}
    # Texts cut into tokens are the largest table there is; they are not written.
    assert set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/numbered-*")) == before


def test_slices_hold_few_values_or_one_row(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([v for _, v in DOCS])], names=["tokens"])
    slices = list(tokens._slices([batch], 0, 5))
    assert [s.num_rows for s in slices] == [2, 1, 1, 1] and pa.Table.from_batches(slices).to_pydict() == {"tokens": [v for _, v in DOCS]}


def test_many_documents_meet_their_places_by_key(spark, monkeypatch):
    rows = [(i // 2, [(0, [i, i]), (1, [i])]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, drawn array<struct<seg:int,tokens:array<int>>>").coalesce(2)
    few = sorted(packing.number_segments(docs).collect())
    monkeypatch.setattr(packing, "PLACED_ROWS", 3)
    monkeypatch.setattr(packing, "PARTITION_TOKENS", 4)
    numbered = packing.number_segments(docs)
    assert sorted(numbered.collect()) == few and len(few) == 80
    # As many partitions as the documents have tokens for, whatever the session's number is.
    assert "REPARTITION_BY_NUM" in numbered._jdf.queryExecution().executedPlan().toString()
