"""Learned sentence boundaries against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ablatrix.operators import boundaries as bd, corpus


def core(t):
    return re.sub(r"(?:[^\w.]|_)+$", "", re.sub(r"^[\W_]+", "", t))


def kind(t):
    w = re.sub(r"\.+$", "", core(t)).lower()
    return "0" if re.fullmatch(r"[\d.,:-]*\d[\d.,:-]*", w) else w


def ratio(a, b, ab, n):
    def logs(k, m, p):
        return (k * math.log(max(p, 1e-300)) if k else 0) + ((m - k) * math.log(max(1 - p, 1e-300)) if m > k else 0)

    return 2 * (logs(ab, a, ab / a) + logs(b - ab, n - a, (b - ab) / (n - a)) - logs(ab, a, b / n) - logs(b - ab, n - a, b / n))


def trained(texts):
    toks = [(t or "").split() for t in texts]
    dots, plain = Counter(), Counter()
    for t in (t for ts in toks for t in ts if kind(t)):
        (dots if core(t).endswith(".") else plain)[kind(t)] += 1
    n, p = sum(dots.values()) + sum(plain.values()), sum(dots.values())
    names = set()
    for w, c in dots.items():
        letters = len(w.replace(".", ""))
        score = 2 * (c * (math.log(0.99) - math.log(p / n)) + plain[w] * (math.log(0.01) - math.log(1 - p / n)))
        if re.search(r"[^\W\d_]", w) and score * math.exp(-letters) * (len(w) - letters + 1) * letters ** -plain[w] >= 0.3:
            names.add(w)
    short = lambda w: w in names or bool(re.fullmatch(r"[^\W\d_]", w))
    both = Counter()
    for ts in toks:
        for a, b in zip(ts, ts[1:]):
            if a[-1] in ".!?" and kind(b):
                own = core(a).endswith(".") and (short(kind(a)) or kind(a) == "0")
                both[(kind(a) if own else None, kind(b))] += 1
    first = Counter()
    for (a, _), c in both.items():
        first[a] += c
    passed = {
        (a, b) for (a, b), c in both.items()
        if ratio(first[a], dots[b] + plain[b], c, n) > (30 if a is None else 7.88) and c * n > first[a] * (dots[b] + plain[b])
    }
    return names, {x for x in passed if x[0]}, {b for a, b in passed if a is None}


def split(text, model):
    names, together, starters = model
    out, last = [], None
    for token in re.findall(r"\S+|\s+", (text or "").strip()):
        if last and not token.isspace():
            a, b = kind(last), kind(token)
            short = a in names or bool(re.fullmatch(r"[^\W\d_]", a))
            first = re.sub(r"^[\W_]+", "", token)[:1]
            stop = True
            if last.endswith("."):
                stop = (b in starters and first.isupper()) if short else not first.islower() if a == "0" else True
                stop = stop and not ((short or a == "0") and (a, b) in together)
            if stop:
                out.append("")
        out = out or [""]
        out[-1] += token
        last = token if not token.isspace() and token[-1] in ".!?" else last if token.isspace() else None
    return [s.strip() for s in out if s.strip()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = "river stone Anna walked slowly because nobody asked when trains leave early towards northern hills again".split()
    def sentence():
        body = " ".join(rng.choices(words, k=rng.randint(4, 9)))
        return rng.choice([
            f"The {body}.", f"However, {body}!", f"Dr. Smith {body}.", f"The  {body} of approx. {rng.randint(2, 99)} miles?",
            f"She saw J. Doe {body}.", f"It was the 3. place {body}.", f"We like fruit, e.g. pears {body}.", f"The year was {rng.randint(1900, 1999)}. The {body}.",
        ])
    out = [rng.choice([" ", "\n", "  "]).join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(300)]
    return out + [None, "", "  \n", ".", "...", "a", "No end", "? foo! 'Bar' \"x.\" y.", "Dr. Smith", "e.g. e.g. e.g."]


def test_model_and_splits(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    model = bd.train(df)
    want = trained(texts)
    assert (set(model.abbreviations), set(model.collocations), set(model.starters)) == want
    assert {"dr", "approx", "e.g"} <= want[0] and "the" in want[2]
    got = df.select("doc_id", bd.split_trained(model)(F.col("text")).alias("s")).collect()
    for r in got:
        assert r["s"] == split(texts[r["doc_id"]], want), texts[r["doc_id"]]
    kept = corpus.sentences_of(df, splitter=bd.split_trained(model))
    assert kept.filter("doc_id >= 300").count() == 7
    joined = " ".join(x for r in got for x in r["s"])
    assert "Dr. Smith" in joined and not any(x.endswith(("Dr.", "approx.", "J.", "e.g.")) for r in got if r["doc_id"] < 300 for x in r["s"])


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert bd.train(df) == bd.Model()
    one = spark.createDataFrame([("All be. Can do! End",)], "text string")
    assert one.select(bd.split_trained(bd.Model())(F.col("text"))).first()[0] == ["All be.", "Can do!", "End"]
