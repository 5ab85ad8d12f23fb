"""Options of JSON lines: lists of strings alone, and others."""

from pyspark.sql import functions as F

from ablatrix.operators import corruption
from ablatrix.sources import jsonl


def test_option_lists(spark):
    lists = {
        '["a","b c"]': ["a", "b c"], '[]': [], '["\\"","\\\\","x\\\\\\"y",""]': ['"', "\\", 'x\\"y', ""],
        '["1",1.0E20,true,null,"t"]': ["1", "1e+20", "True", None, "t"], '[["a"],{"b":"c"}]': ['["a"]', '{"b":"c"}'],
    }
    df = spark.createDataFrame([(i, '{"options":' + o + "}") for i, o in enumerate(lists)], "i int, value string")
    assert [r["options"] for r in jsonl.parse_qa_lines(df).orderBy("i").collect()] == list(lists.values())


def test_options_turned(spark):
    df = spark.createDataFrame([(["abc", "ab cd.", "", None, "é_1", "a\n", "ab\r\n"],)], "o array<string>")
    assert df.select(corruption.scramble_options(F.col("o"))).first()[0] == ["cba", "ba dc.", "", "enoN", "1_é", "a\n", "ba\r\n"]
