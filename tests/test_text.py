"""Text kernels and rewrites: hand-made rows, and brute force on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ablatrix.functions import text as tx
from ablatrix.operators import corruption as co

def _context(how):
    return lambda c: how.apply(c, c, F.array(c))[0]


def _question(how):
    return lambda c: how.apply(c, c, F.array(c))[1]


GOLDEN = [
    (tx.reverse_sentences, "A b. C d! E", "E C d! A b."),
    (tx.reverse_sentences, "", ""),
    (tx.reverse_sentences, "  One.\n\nTwo?  ", "Two? One."),
    (tx.reverse_words, "  a  b c ", "c b a"),
    (tx.reverse_words, " \t\n", ""),
    (tx.reverse_letters, "ab-cd, 12x", "ba-dc, x21"),
    (tx.reverse_letters, "\x01ab\x01 é_ß", "\x01ba\x01 ß_é"),
    (tx.mask_entities, "Bob saw 3rd 12, Al, 4.5kg", "[ENT1] saw 3rd [ENT2] Al, [ENT3]"),
    (tx.mask_entities, "Élan  É2 ǅx 7", "[ENT1] É2 ǅx [ENT2]"),
    (tx.blank_alphanumerics, "é1 Ab", "éX XX"),
    (_context(co.CAUSE), "It rained because of wind. Then sun.", "It rained  Then sun. Afterwards, a bird flew by."),
    (_context(co.CAUSE), "", ". Afterwards, a bird flew by."),
    (_context(co.CAUSE), "Late DUE TO\nfog. So what", "Late DUE TO\nfog. Afterwards, a bird flew by."),
    (_context(co.QUANTITATIVE), "Add 3.5 plus 2", " <NUM>  <NUM>"),
    (_context(co.QUANTITATIVE), "x2 3rd 12.5a 7", "x2 3rd <NUM>.5a <NUM>"),
    (_question(co.TEMPORAL), "Before noon, after 2 pm", "after noon, before 2 am"),
    (_question(co.TEMPORAL), "laſt first firsts", "laſt last firsts"),
    (_context(co.SPATIAL), "In front of it, Left.", "behind it, right."),
    (_context(co.DEDUCTIVE), "If all go. Then stop!", "stop! go."),
    (_context(co.COMPOSITION), "abc\n", "\ncba"),
    (_context(co.GENERIC), "a b", "b a"),
]


@pytest.mark.parametrize("kernel, given, expected", GOLDEN)
def test_golden(spark, kernel, given, expected):
    assert spark.createDataFrame([(given,)], "x string").select(kernel(F.col("x"))).first()[0] == expected


def test_null_options_and_null_option(spark):
    df = spark.createDataFrame([(["ab", None],), (None,)], "o array<string>")
    assert [r[0] for r in df.select(co.scramble_options(F.col("o"))).collect()] == [["ba", "enoN"], None]


def _random_texts(n=400, seed=5):
    rng = random.Random(seed)
    bits = [
        "Bob", "all", "ALL", "because", "so", "éall", "in front of", "before", "AM", "12", "3.5", "3rd", "x2", "_",
        ".", "!", "?", ",", " ", "  ", "\n", "\t", "\x1c", " ", " ", "\x01", "\x02", "²", "½", "Ⅷ", "‿",
        "字", "Straße", "İ", "ı", "more than", "due to", "-", "\\n", "😀", "é",
    ]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def _apply(spark, kernel, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(kernel(F.col("x"))).collect()]


def test_letters_twice_is_identity(spark):
    texts = _random_texts()
    assert _apply(spark, lambda c: tx.let(tx.reverse_letters(c), tx.reverse_letters), texts) == texts


def test_words_twice_normalises_space(spark):
    texts = _random_texts()
    got = _apply(spark, lambda c: tx.reverse_words(tx.reverse_words(c)), texts)
    assert got == [" ".join(t.split()) for t in texts]


def test_letters_against_character_walk(spark):
    def walk(t):
        out, run = [], []
        for ch in t + "\0":
            if ch.isalnum() or ch == "_":
                run.append(ch)
            else:
                out += run[::-1] + [ch]
                run = []
        return "".join(out)[:-1]

    texts = _random_texts(seed=6)
    assert _apply(spark, tx.reverse_letters, texts) == [walk(t) for t in texts]


def test_sentences_against_character_walk(spark):
    def walk(t):
        parts, current, gap = [], "", False
        for ch in t.strip():
            if ch.isspace() and (gap or current[-1:] in (".", "!", "?")) and current:
                gap = True
                continue
            if gap:
                parts.append(current)
                current, gap = "", False
            current += ch
        return " ".join(reversed(parts + [current]))

    texts = _random_texts(seed=7)
    assert _apply(spark, tx.reverse_sentences, texts) == [walk(t) for t in texts]


def test_whole_words_against_token_walk(spark):
    """Dropping words only at word boundaries, whatever script surrounds them."""
    words = {"all", "because"}

    def walk(t):
        pieces = re.findall(r"\w+|\W+", t)
        return "".join(x for x in pieces if x.lower() not in words)

    texts = _random_texts(seed=8)
    assert _apply(spark, lambda c: tx.drop_words(c, sorted(words)), texts) == [walk(t) for t in texts]


def test_blank(spark):
    texts = ["", " \n\x1c　", "\\n", "\\n ", "a"]
    assert _apply(spark, tx.is_blank, texts) == [True, True, True, False, False]


def test_user_rewrite_in_registry(spark):
    upper = co.Rewrite("upper", lambda c, q, o: (F.upper(c), q, o), ("context",))
    df = spark.createDataFrame(
        [("mine", "a b", "q", ["x"]), ("other", "a b", "c d", ["xy"]), ("", "a", "b", []), (None, "a", "b", [])],
        "question_type string, context string, question string, options array<string>",
    )
    rows = co.corrupt_corpus(df, {**co.REGISTRY, "mine": upper}).collect()
    assert sorted(map(tuple, rows)) == [("mine", "A B", "q", ["x"]), ("other", "b a", "d c", ["yx"])]


def test_dispatch_runs_without_python_or_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.lit("analogy").alias("question_type"), F.col("text").alias("context"), F.col("text").alias("question"),
        F.array("lang").alias("options"),
    )
    plan = co.corrupt_corpus(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
