"""JSON lines that a query writes only to read them back: little disk, no sorting of whole lines."""

import os

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from ablatrix.plans.catalog import CATALOG
from ablatrix.session import setting
from ablatrix.sources import jsonl

OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@pytest.fixture()
def tables(spark, tmp_path):
    """Documents of a few hundred words."""
    texts = [" ".join(f"w{(i * j) % 89} says \"{j}\"" for j in range(300)) for i in range(40)]
    rows = [(i, t, ("de", "en", "es")[i % 3], "src1", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/tables/documents.parquet")
    return f"{tmp_path}/tables"


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.fixture()
def written(monkeypatch):
    """The folders written as text meanwhile, and how many files a task could hold open."""
    seen = []
    text = DataFrameWriter.text

    def recorded(self, path, *a, **b):
        seen.append((path.removeprefix("file://"), self._spark.conf.get(OPEN_WRITERS, "0")))
        return text(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "text", recorded)
    return seen


@pytest.mark.parametrize("query", ["abilities_roundtrip", "jsonl_roundtrip"])
def test_lines_are_staged_in_little_space(spark, tables, written, query):
    rows = CATALOG[query](spark, tables)
    lines = rows.select(F.sum(F.octet_length("line"))).first()[0]
    (path, writers), = written
    kept = path.rsplit("/", 1)[0] if query == "abilities_roundtrip" else path  # its folders are moved after writing
    assert 0 < _bytes(kept) < lines / 2
    assert int(writers) >= 12 and spark.conf.get(OPEN_WRITERS, "0") == "0"


@pytest.mark.parametrize("codec", [None, "lz4", "gzip"])
def test_more_folders_than_open_files(spark, tmp_path, monkeypatch, codec):
    rows = [(f"a {i % 7}", jsonl.SPLITS[i % 3], '{"question":"q%d\\"","n":[1, 2.5],"question_type":null}' % i) for i in range(100)]
    df = jsonl.parse_qa_lines(spark.createDataFrame(rows, "ability string, split string, value string").coalesce(1))
    want = sorted((r["ability"], r["split"], r["line"]) for r in df.select("ability", "split", jsonl.qa_line(df).alias("line")).collect())
    for most in (2, 64):
        monkeypatch.setattr(jsonl, "OPEN_FILES", most)
        root = str(tmp_path / f"{most}")
        jsonl.write_abilities(df, root, codec)
        back = jsonl.read_abilities(spark, root)
        assert sorted((r["ability"], r["split"], r["line"]) for r in back.select("ability", "split", jsonl.qa_line(back).alias("line")).collect()) == want


def test_settings_hold_inside_only(spark):
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), setting(spark, name, "7"):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before
