"""License scans against edit distances of all stretches of words."""

import random
import string

import pytest
from pyspark.sql import functions as F

from ablatrix.llm import license_scan as ls


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def places(text, notice):
    """{(first word, word after the last): edits} of all stretches of words within the allowed edits."""
    words, most = ls.folded(text)[1].split(), ls.allowed(notice)
    out = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            stretch = " ".join(words[i:j])
            if len(stretch) > len(notice) + most:
                break
            if len(stretch) >= len(notice) - most and (n := distance(stretch, notice)) <= most:
                out[i, j] = n
    return out


def damaged(notice, edits, rng):
    signs = list(notice)
    for _ in range(edits):
        kind, at = rng.choice("ids"), rng.randrange(len(signs))
        if kind == "i":
            signs.insert(at, rng.choice(string.ascii_lowercase + " é-"))
        elif kind == "d":
            del signs[at]
        else:
            signs[at] = rng.choice(string.ascii_lowercase + "ß ")
    return "".join(signs)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    filler = "the mit licence of apache gnu general and public licenses by permission cc or free software rights ééé 日本".split()
    out = [None, "", " .,; ", "MIT License", "mit license mit license", "CC-BY CC BY-NC 4.0 cc by", "mit licence", "mitlicense",
           "permit licenses", "GNU  General\nPublic.License", "gnu general public licens gnu general public license"]
    for notice in ls.NOTICES | ls.PHRASES:
        for edits in (0, ls.allowed(notice), ls.allowed(notice) + 1):
            around = [" ".join(rng.choices(filler, k=3)) for _ in range(2)]
            out.append(f"{around[0]} {damaged(notice, edits, rng)}. {around[1]}")
    return out


def test_spans(texts):
    notices = sorted(ls.NOTICES | ls.PHRASES)
    scanner = ls.Scanner(notices)
    found_any = 0
    for text in texts:
        n, folded = ls.folded(text)
        spans, exact = scanner.scan(folded)
        words = folded.split()
        assert n == len(words)
        for i, notice in enumerate(notices):
            want, own = places(text, notice), [s for s in spans if s[2] == i]
            found_any += len(own)
            for b, e, _, edits in own:  # what is reported is true
                assert distance(" ".join(words[b:e]), notice) == edits <= ls.allowed(notice)
            for b, e in want:  # what is there is reported, itself or by a place it overlaps
                assert any(b < e2 and b2 < e for b2, e2, _, _ in own), (text, notice)
            if want:
                assert min(want.values()) == min(s[3] for s in own)
            size = len(notice.split())
            assert exact.get(i, []) == [j for j in range(n) if words[j:j + size] == notice.split()]
    assert found_any > 60


def test_report(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").repartition(3)
    for r in ls.report(df).collect():
        text = texts[r["doc_id"]]
        words = ls.folded(text)[1].split()
        base = [(j, label) for p, label in ls.PHRASES.items() for j in range(len(words)) if words[j:j + len(p.split())] == p.split()]
        scores = {}
        for notice, label in (ls.NOTICES | ls.PHRASES).items():
            if near := places(text, notice):
                scores[label] = max(scores.get(label, 0), 1 - min(near.values()) / (ls.allowed(notice) + 1))
        assert r["n_words"] == len(words) and r["n_base"] == len(base)
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert r["labels"] == ",".join(sorted(set(scores)))
        assert r["score"] == pytest.approx(max(scores.values(), default=0))


def test_odd_rows(docs, empty):
    got = ls.report(docs.withColumns({"spans": F.lit(1), "labels": F.lit("x"), "N_BASE": F.lit("y")}))
    assert got.count() == docs.count() and ls.report(empty).count() == 0
    assert {"n_words", "n_base", "spans", "labels", "kept", "shard"} <= set(got.columns)
    assert got.filter("labels is null or n_words is null or score < 0 or score > 1").count() == 0


def test_long_repetitions():
    """A text full of near notices is scanned in about the time its length takes."""
    scanner = ls.Scanner(sorted(ls.NOTICES | ls.PHRASES))
    spans, _ = scanner.scan(ls.folded("mit licence " * 5000)[1])
    assert len(spans) == 5000 and {s[3] for s in spans} == {1}
