"""Quality rules and decontamination against plain Python."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.llm import decontamination as dc, quality_rules as rules


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)
    )


def test_counts(docs):
    got = rules.document_features(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts")
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[1:6]) == counts(r["text"])
        assert sum(r["class_counts"]) == len(r["text"] or "")


def test_misleading_hashes_change_nothing(docs, monkeypatch):
    words = F.split("text", " ")
    df = docs.filter("length(text) > 100 and length(text) < 4000").select(words.alias("w"))
    keys = F.sort_array(F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(
        x, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(~((1 << 24) - 1)).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("k", keys).select(
        rules.places_by_hash(F.col("k")).alias("a"), rules.places_by_words(F.col("w")).alias("b"),
        rules.hash_misleads(F.col("w"), F.col("k")).alias("wrong"),
        rules.hash_misleads(F.col("w"), F.transform("k", lambda k: k.bitwiseAND((1 << 24) - 1))).alias("one_hash"),
    )
    for r in df.collect():
        assert r["a"] == r["b"] and not r["wrong"] and r["one_hash"]


def test_verdicts(docs, empty):
    got = rules.quality_rules(docs)
    assert got.count() == docs.count() and got.schema["kept"].dataType.simpleString() == "boolean"
    assert got.filter("kept is null or base_failed is null").count() == 0
    assert rules.quality_rules(empty).count() == 0


def test_references_are_distributions(spark, sf_dir):
    features = rules.document_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    references = rules.language_references(features)
    assert set(references) == {"de", "en", "es", "fr"}
    for r in references.values():
        assert sum(r["classes"]) == pytest.approx(1) and sum(r["words"]) == pytest.approx(1)


BENCHMARK = [  # hits, repeats, null and wordless items, an item without id
    ("7", "quick brown fox jumps over the lazy dog near the old river bank every single"), ("8", "wörds ß"), ("8", "wörds ß"),
    ("10", None), ("11", "..."), (None, "one two"), ("9", "w0 w1 w2 w3 w4 w5 w6 w0 w1 w2 w3 w4 w5 w6"), ("12", "B"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_hits(docs, spark, block_bytes):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    short = docs.filter("coalesce(length(text), 0) < 20000")
    rows = dc.find_hits(short, benchmark, block_bytes=block_bytes).collect()
    want = dc.brute_force([r["text"] for r in rows], BENCHMARK)
    for r, (n, hit, items, _) in zip(rows, want):
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, items)


def test_blocks_come_one_at_a_time(docs, spark, monkeypatch):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    events, blocks, write = [], dc.blocks, dc.stage
    monkeypatch.setattr(dc, "blocks", lambda *a: (events.append("read") or b for b in blocks(*a)))
    monkeypatch.setattr(dc, "stage", lambda df, name: events.append(name) or write(df, name))
    dc.find_hits(docs, benchmark, block_bytes=40)
    n = events.count("read")
    assert n > 2 and events == ["read", "read", "numbered", "hits", *["read", "hits"] * (n - 2)]


def test_windows_take_little_memory():
    text = " ".join(f"w{i}" for i in np.random.default_rng(1).integers(0, 5000, 200_000).tolist())
    tracemalloc.start()
    try:
        windows = dc.Windows([("1", text)], 13)
        assert tracemalloc.get_traced_memory()[0] < 20 * len(text)
    finally:
        tracemalloc.stop()
    assert len(windows.sizes) == 1


def test_equal_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(dc, "BASE", 0)
    items = [("1", "a b c"), ("2", "b c a b c"), ("3", "a b"), (None, "c c c c"), ("4", "a b c")]
    windows = dc.Windows(items, 3)
    for text in ("a b c a b", "c c c", "b a", "x a b x c a b c c c"):
        ids = np.array([windows.numbers.get(w, 0) for w in dc.folded_words(text)])
        hits = [*windows.hits(ids)]
        (_, n_hit, owners, _), = dc.brute_force([text], items, 3)
        assert len({i for b, s, _ in hits for i in range(b, b + s)}) == n_hit
        assert sorted(set().union(*[o for _, _, o in hits])) == owners


def test_decontaminate(docs, empty, spark):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    clean = dc.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert dc.find_hits(clean, benchmark).filter(dc.is_contaminated()).count() == 0
    cut = dc.decontaminate(docs, benchmark, remove="spans")
    assert cut.count() == docs.count() and cut.columns == docs.columns
    assert dc.decontaminate(empty, benchmark).count() == 0
    assert dc.decontaminate(docs, benchmark.limit(0)).count() == docs.count()


def test_spans_keep_the_rest():
    assert dc.without_spans("A, b-c (d) é f!", [(1, 3), (4, 5)]) == "A,  (d)  f!"
