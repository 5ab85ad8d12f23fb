"""Sentences: texts are split once, tokens judged once, at any white space."""

import pytest
from pyspark.sql import functions as F

from ablatrix.functions import text as tx
from ablatrix.operators import boundaries, corpus


def _times(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "One. Two"), (2, " ")], "doc_id int, text string")
    split = corpus.sentences_of(docs, splitter=lambda c: F.split(c, r"(?<=\.)THE GAP|(?<=\.) +"))
    rows = split.select("doc_id", F.posexplode("sentences"))
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "One."), (1, 1, "Two")]
    assert _times(rows, "THE GAP") == 1


def test_types_are_looked_at_once_per_distinct_token(spark):
    docs = spark.createDataFrame([("Dr. Wu met Dr. Ax. dr",), (None,), ("",)], "text string")
    counts = boundaries.type_counts(docs)
    assert sorted(map(tuple, counts.collect())) == [("ax", 1, 0), ("dr", 2, 1), ("met", 0, 1), ("wu", 0, 1)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


@pytest.mark.parametrize("space", list(tx.WHITESPACE))
def test_ends_of_pieces(spark, space):
    split = boundaries.split_trained(boundaries.Model(("dr",), (), ()))
    df = spark.createDataFrame([(f"He saw Dr.{space}Wu.{space}{space}She left!{space}Yes{space}",)], "text string")
    assert df.select(split(F.col("text"))).first()[0] == [f"He saw Dr.{space}Wu.", "She left!", "Yes"]


def test_space_is_every_white_space_and_nothing_else(spark):
    points = spark.range(1, 0x3100).filter("id < 55296").select("id", F.rlike(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), F.lit(f"^{tx.SPACE}")).alias("hit"))
    assert {r["id"] for r in points.filter("hit").collect()} == {ord(c) for c in tx.WHITESPACE}
