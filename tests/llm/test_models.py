"""Scores: brute force where there is one, held-out accuracy otherwise."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ablatrix.llm import context_weighting as cw, quality_classifier as qc, toxicity as tox
from ablatrix.llm.catalog import CATALOG


def accuracy(spark, sf_dir, query, label):
    rows = CATALOG[query](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), rows


@pytest.mark.parametrize("query, label", [("op1_toxicity", "toxic"), ("op3_quality_classifier", "quality")])
def test_held_out(spark, query, label):
    good, rows = accuracy(spark, "/root/testdata/sf0.01", query, label)
    # Labels of the small tables are noisy; to always say the same is right in 75 to 87 of 100.
    assert good > 0.8 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_cases(docs, empty, labels):
    machine = tox.fit(docs, labels)
    got = tox.score(docs, machine)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert tox.score(empty, machine).count() == 0
    assert all(r["score"] < 1e-9 for r in tox.score(docs, tox.fit(docs, labels.limit(0))).collect())
    assert tox.drop_toxic(docs, labels).columns == docs.columns


def subsequence_kernel(a, b):
    """Sum over common three-sign subsequences within five signs, by trying all of both."""
    def bag(s):
        out = Counter()
        for x in range(len(s)):
            for j in range(2, 5):
                for i in range(1, j):
                    if x + j < len(s):
                        out[s[x], s[x + i], s[x + j]] += tox.DECAY ** (j - 2)
        return out

    p, q = bag(a), bag(b)
    return sum(v * q[k] for k, v in p.items()) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))


def test_kernel():
    words = ["idiot", "i d i o t", "idxiot", "kindly", "stupid", "stu-pid"]
    s = [tox.signs(w)[:40] for w in words]
    for a in s:
        for b in s:
            assert tox.kernel_vector(a) @ tox.kernel_vector(b) == pytest.approx(subsequence_kernel(a.tolist(), b.tolist()))
    near = tox.kernel_vector(s[0]) @ tox.kernel_vector(s[2])
    assert near > 3 * tox.kernel_vector(s[0]) @ tox.kernel_vector(s[3])


def test_texts_do_not_touch():
    weights = np.random.default_rng(2).normal(size=tox.SIGNS ** 3)
    known = np.zeros(tox.SIGNS ** 3)
    known[[n for s in ("some words", "other things here") for x, _ in tox.subsequences(tox.signs(s)) for n in x]] = 1
    weights *= known
    texts = ["some words", None, "", "other things here", "some"]
    assert tox.worst(texts, weights).tolist() == pytest.approx([tox.worst([t], weights)[0] for t in texts])


def test_quality_cases(docs, empty, labels):
    vectors, network = qc.fit(docs, labels)
    got = qc.score(docs, vectors, network)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert qc.score(empty, vectors, network).count() == 0
    v, n = qc.fit(docs, labels.limit(0))
    assert {r["score"] for r in qc.score(docs, v, n).collect()} == {0.5}
    assert qc.keep_good(docs, labels).columns == docs.columns


def test_context_sums(spark):
    texts = ["a b c a", "b b", None, "", "A_b c!"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    places, signs = qc.index_vectors()
    want, buckets = np.zeros((qc.BUCKETS, qc.DIMENSIONS)), qc.Buckets()
    for t in texts:
        ids = [buckets[x] for x in qc.TOKEN.findall(t or "")]
        for i, a in enumerate(ids):
            for j in range(max(0, i - qc.NEIGHBOURS), min(len(ids), i + qc.NEIGHBOURS + 1)):
                if j != i:
                    np.add.at(want[a], places[ids[j]], signs[ids[j]])
    assert (qc.context_sums(docs) == want).all()


def weighting(train, texts, depth):
    """Context-tree weighting by plain recursion over dictionaries."""
    counts = {}
    for t in train:
        t = cw.END * depth + t
        for i in range(depth, len(t)):
            for k in range(8):
                bits, bit = (1 << k) | (t[i] >> (8 - k)), t[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((t[i - d:i], bits), [0, 0])[bit] += 1
    children = {}
    for c, bits in counts:
        if c:
            children.setdefault((c[1:], bits), []).append((c, bits))

    def block(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = block(counts[node])
        below = sum(weighted[x] for x in children.get(node, []))
        weighted[node] = own if len(node[0]) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
    out = []
    for t in texts:
        t, total = cw.END * depth + t, 0.0
        for i in range(depth, len(t)):
            for k in range(8):
                bits, bit, p = (1 << k) | (t[i] >> (8 - k)), t[i] >> (7 - k) & 1, None
                for d in range(depth, -1, -1):
                    node = (t[i - d:i], bits)
                    if node in counts:
                        n = counts[node]
                        own = (n[bit] + 0.5) / (sum(n) + 1)
                        share = 1 if p is None or d == depth else math.exp(math.log(0.5) + block(n) - weighted[node])
                        p = own if p is None else share * own + (1 - share) * p
                total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_context_weighting(docs, empty):
    small = docs.filter("coalesce(length(text), 0) < 4000")
    rows = small.select("doc_id", "text").collect()
    norm = [cw.normalised(r["text"]) for r in rows]
    held = [zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    train = [t for t, h in zip(norm, held) if not h]
    words = Counter(w for t in train for w in t.split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    floor = n + 0.1 * (v + 1)
    want = Counter()
    for r, t, h, s in zip(rows, norm, held, weighting(train, norm, 3)):
        c = [words[w] for w in t.split()] + [len(train)]
        want[r["doc_id"], h, len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.1) / floor) for x in c), 3), round(s, 2)] += 1
    got = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3), round(r["score"], 2))
        for r in cw.score(small, depth=3, block_bytes=2000).collect()
    )
    assert got == want
    assert cw.score(empty).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 10.5, 1e6, 1e12])
    assert cw._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-8, rel=1e-12)


def test_toxicity_of_altered_insults(spark):
    """Words seen in labelled texts are found plain, dotted and with a letter put in; clean texts are left alone."""
    rng = random.Random(7)
    syllables = ["an", "er", "tion", "the", "ou", "ha", "ly", "re", "in", "st", "ble", "and"]
    insults = ["grobnik", "fuzzlewit", "snarvol", "plodkamp", "krumbub", "dwelzor"]

    def text(*said):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(60)]
        for w in said:
            words.insert(rng.randrange(10, 50), w)
        return " ".join(words[:30]) + ". " + " ".join(words[30:]) + "."

    docs = [(i, text(*rng.sample(insults, 2)) if i % 4 == 0 else text(), int(i % 4 == 0) if i % 50 else 1) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    machine = tox.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))

    def altered(w, how):
        at = rng.randrange(2, len(w) - 1)
        return {"plain": w, "dotted": ".".join(w), "put in": w[:at] + rng.choice("qxzhvj") + w[at:]}[how]

    def rate(texts):
        return (machine.probabilities(tox.values_of(texts, machine.weights)) >= 0.3).mean()

    found = {how: rate([text(altered(w, how)) for w in insults for _ in range(20)]) for how in ("plain", "dotted", "put in")}
    assert rate([text() for _ in range(200)]) <= 0.05
    assert found["plain"] >= 0.9 and found["dotted"] >= 0.9 and found["put in"] >= 0.6, found
