"""Kinds of JSON members, however a line is spelled, and what it takes to tell them."""

import json

import pytest
from pyspark.sql import functions as F

from ablatrix.sources import jsonl

# What stands in a line, the JSON kept of it, and its plain text.
MEMBERS = [
    ('"a b"', '"a b"', "a b"), ('"12"', '"12"', "12"), ("12", "12", "12"), ('"true"', '"true"', "true"), ("true", "true", "true"),
    ('"null"', '"null"', "null"), ("null", "null", None), ('"[1]"', '"[1]"', "[1]"), ("[1]", "[1]", "[1]"), ('["a","b c"]', '["a","b c"]', '["a","b c"]'),
    ('"[\\"a\\"]"', '"[\\"a\\"]"', '["a"]'), ('"{}"', '"{}"', "{}"), ("{}", "{}", "{}"), ('{"a":"12"}', '{"a":"12"}', '{"a":"12"}'), ('[{"a":1}]', '[{"a":1}]', '[{"a":1}]'),
    ('"[{"', '"[{"', "[{"), ("1.50", "1.5", "1.5"), ('"1.50"', '"1.50"', "1.50"), ("1.0E10", "1.0E10", "1.0E10"), ("-3", "-3", "-3"), ('""', '""', ""), ('" 7 "', '" 7 "', " 7 "),
    ('"\\u00e9\\/"', '"é/"', "é/"), ('"q\\"\\\\\\n"', '"q\\"\\\\\\n"', 'q"\\\n'), ('"x\\":\\"12"', '"x\\":\\"12"', 'x":"12'), ("[ ]", "[]", "[]"), ('["a" , 1.0]', '["a",1.0]', '["a",1.0]'),
]


@pytest.mark.parametrize(("comma", "colon"), [(",", ":"), (", ", ": "), (" ,\t", "\t: ")])
def test_members_of_lines(spark, comma, colon):
    """All members in one line, and each in a line with a number and a text that look alike."""
    def line(ms):
        return "{" + comma.join(f'"k{i}"{colon}{m[0]}' for i, m in enumerate(ms)) + "}"

    sets = [MEMBERS, *[[m, ("12", "12", "12"), ('"12"', '"12"', "12")] for m in MEMBERS]]
    df = spark.createDataFrame([(i, line(ms)) for i, ms in enumerate(sets)], "i int, value string")
    got = df.select("i", jsonl._entries(F.col("value")).alias("es")).orderBy("i").collect()
    for ms, row in zip(sets, got, strict=True):
        assert [tuple(e) for e in row["es"]] == [(f"k{i}", m[1], m[2]) for i, m in enumerate(ms)]


def test_last_of_equal_keys_and_broken_lines(spark):
    lines = {
        '{"a":1,"b":2,"a":"1"}': [("b", "2"), ("a", '"1"')], '{"a" : 1, "a" :"2"}': [("a", '"2"')], "{}": [], '{"a":1} ': [("a", "1")],
        '{"a":{"b":1,"b":2}}': None, '{"a":[{"b":1,"b":2}]}': None, '{"a":1} {"b":2}': None, '{"a":1},{"b":2}': None, "": None, "[1]": None, '{"a":1': None, "null": None,
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = [r["es"] for r in df.select("i", jsonl._entries(F.col("value")).alias("es")).orderBy("i").collect()]
    assert [es if es is None else [(e["key"], e["json"]) for e in es] for es in got] == list(lines.values())


def test_lines_are_parsed_once_and_json_is_written_once(spark):
    df = spark.createDataFrame([("{}", "x")], "value string, t string")
    members = df.select(jsonl._entries(F.col("value")).alias("es"))._jdf.queryExecution().analyzed().toString()
    # Once as texts and, only of lines that looks don't tell, once as variants.
    assert members.count("from_json(") == 2
    assert df.select(jsonl.json_of(F.col("t")).alias("j"))._jdf.queryExecution().analyzed().toString().count("to_json(") == 1


def test_json_of_values(spark):
    texts = ["a", "", 'q"\\\n\x01', "é\U0001F600", None]
    df = spark.createDataFrame([(i, t, [t, "b"] if i else None) for i, t in enumerate(texts)], "i int, t string, l array<string>")
    got = df.select(*[jsonl.json_of(F.col(c)) for c in df.columns]).collect()
    assert [tuple(map(json.loads, r)) for r in got] == [(i, t, [t, "b"] if i else None) for i, t in enumerate(texts)]
