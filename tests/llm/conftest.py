import pytest
from pyspark.sql import functions as F

from ablatrix.session import shared_dir


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, clashing extra columns."""
    shared_dir(spark)
    base = "the quick brown fox jumps over the lazy dog near the old river bank every single morning"
    texts = [
        None, "", "  \n\t", "one", "one two", base, base, base + " again", base.upper(), "Ünï cödé wörds ß 日本語 😀",
        "line\nline\nline\nother\n\n", " ".join(f"w{i % 7}" for i in range(300)), "word " * 20_000,
        "a" * 5000, "x\r\ny\x0bz\x0cq", "$$$ ### | | <b> &amp;", "<|endoftext|> marker",
    ]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(5, base, "en", "s2"), (None, base, "en", "s0"), (None, None, None, None), (7, base + " again", "xx", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({
        "score": F.lit("mine"), "kept": F.lit(1), "n_words": F.lit(7), "shard": F.lit("s"), "fp": F.lit(1.5),
        "words": F.lit("w"), "row": F.lit("r"), "hits": F.lit(0), "group": F.lit(0), "size": F.lit("L"),
    }).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(17)] + [(5, None, None), (None, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def empty(docs):
    return docs.limit(0)
