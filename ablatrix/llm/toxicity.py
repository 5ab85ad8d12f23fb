"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

Two strings are alike by the subsequences of three signs they share, near ones counting more: each
sign skipped multiplies a subsequence's weight by ``DECAY``. So letters put into an insult, or
blanks and dots between its letters, cost some similarity, not the match. Landmarks are words that
mark toxic texts among the labelled ones, and common words that don't. Sentences are placed by their
kernel values with the landmarks, whitened by the landmarks' own kernel matrix, and a linear machine
is fitted to labelled sentences there: of a toxic text its worst ones, of a clean one the
worst and another. As the kernel's subsequences number 28 ** 3, the fitted sum over landmarks collapses
exactly into one weight per subsequence, and a whole text is scored in a few array operations: its
score is that of its worst stretch of ``WINDOW`` signs, made a probability by a logistic curve.

Limits: the three signs lie within five places, so two letters put between every two of a word's hide
it; letters other than a-z and those in ``ACCENTS`` are breaks, so text in other scripts is as if empty.

Defined cases: a null text is empty; an empty text, or one without letters, scores as one whose
stretches weigh nothing; null labels and labels without document are left out of the fit; of
repeated labels each counts; without labels of both kinds every score is 0; an empty table gives no
rows. The sample: at most ``FIT_ROWS`` labelled documents, those of smallest key hash.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import fresh, opened, shipped, slices, whole
from .quality_classifier import labelled_sample

FIT_ROWS = 20_000
LANDMARKS = 256
#: Signs: a break between letters, the letters, and one between texts, which no landmark has and
#: which therefore weighs nothing.
SIGNS = 28
GAP = 27
DECAY = 0.75
#: Places of the second and third sign of a subsequence behind the first, and its weight.
STEPS = [(i, j, DECAY ** (j - 2)) for j in range(2, 5) for i in range(1, j)]
WINDOW = 14
ROUNDS = 4
#: Sentences a toxic text is represented by at most, and how bad they are beside the worst.
BAD_SENTENCES = 4
NEARLY = 0.6
#: Of clean sentences so many are less bad than a toxic text's that tells something.
CLEARLY = 0.9
#: Landmarks have at least this share of the best one's evidence.
EVIDENCE = 0.05
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LONG_WORD = re.compile(r"[^\W\d_]{4,}")
CHUNK = 1 << 20

#: Letters with accents count as their base letter, digits as the letter they resemble.
ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ013457@", "aaaaaaceeeeiiiinooooouuuuyyoieasta")
TO_SIGN = bytes(c - 96 if 97 <= c <= 122 else 0 for c in range(256))
#: Single letters with one or two other signs between them.
SPACED = re.compile(r"(?<!\w)(?:\w[\W_]{1,2}){3,}\w(?!\w)")


def signs(text: str | None) -> np.ndarray:
    """Letters as 1 to 26, every stretch of other characters as one 0, and one at either end.

    Words written letter by letter are added once more, put together.
    """
    if not text:
        return np.zeros(1, np.uint8)
    lowered = text.lower()
    spaced = SPACED.findall(lowered)
    if spaced:
        lowered += " ".join(["", *[re.sub(r"[\W_]", "", x) for x in spaced]])
    raw = lowered.translate(ACCENTS).encode("latin-1", "replace").translate(TO_SIGN)
    s = np.frombuffer(b"\0" + raw + b"\0", np.uint8)
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def subsequences(s: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Numbers of the subsequences that begin at each place, for each way to step, and their weight."""
    wide = s.astype(np.int32)
    for i, j, weight in STEPS:
        n = len(wide) - j
        if n > 0:
            yield (wide[:n] * SIGNS + wide[i:i + n]) * SIGNS + wide[j:j + n], weight


def kernel_vector(s: np.ndarray) -> np.ndarray:
    """All subsequences of a string with their weights, as a unit vector."""
    v = np.zeros(SIGNS ** 3)
    for numbers, weight in subsequences(s):
        np.add.at(v, numbers, weight)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def stretches(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights over the subsequences that begin in each stretch of ``WINDOW`` signs."""
    gains = np.zeros(len(s) + WINDOW)
    for numbers, weight in subsequences(s):
        gains[:len(numbers)] += weight * weights[numbers]
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    return sums[WINDOW:WINDOW + len(s)] - sums[:len(s)]


def worst(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The largest stretch of each text; texts are joined, so that arrays are long."""
    if not texts:
        return np.zeros(0)
    gap = np.full(WINDOW, GAP, np.uint8)  # stretches don't reach from one text into the next
    parts = [np.concatenate([signs(t), gap]) for t in texts]
    joined = np.concatenate(parts)
    values = np.where(joined == GAP, -np.inf, stretches(joined, weights))
    return np.maximum.reduceat(values, np.cumsum([0] + [len(p) for p in parts[:-1]]))


def split_sentences(text: str | None) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n+", text or "") if x.strip()]


def marking_words(sample: DataFrame, number: int) -> tuple[list[tuple[str, float]], list[str]]:
    """Words that mark toxic texts, with their evidence, and common words of clean ones.

    Documents with a word are counted by kind, map-side first; the best of them come to the driver.
    """
    words = sample.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole("text")), F.lit(r"\p{L}{3,32}"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(
        F.sum(F.when(F.col("label") > 0.5, 1).otherwise(0)).alias("toxic"), F.count("*").alias("all")
    )
    totals = sample.agg(F.sum(F.when(F.col("label") > 0.5, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).first()
    t, n = totals["t"] or 0, totals["n"]
    if not t or t == n:
        return [], []
    toxic, clean = F.col("toxic"), F.col("all") - F.col("toxic")
    ratio = F.log((toxic + 0.5) / (t + 1)) - F.log((clean + 0.5) / (n - t + 1))
    evidence = (toxic * ratio).alias("evidence")
    best = counts.filter(ratio > 1.5).select("word", evidence).orderBy(F.desc("evidence"), "word").limit(number).collect()
    best = [r for r in best if r["evidence"] >= EVIDENCE * best[0]["evidence"]]  # the rest may be words of a few copied texts
    common = counts.filter(ratio < 0.5).orderBy(F.desc("all"), "word").limit(number // 4).collect()
    return [(r["word"], r["evidence"]) for r in best], [r["word"] for r in common]


class Machine:
    def __init__(self, weights: np.ndarray, slope: float = 0.0, shift: float = -30.0):
        self.weights, self.slope, self.shift = weights, slope, shift

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -30, 30)))


def labelled_sentences(sample: DataFrame, weights: np.ndarray, names: re.Pattern[str]) -> tuple[list[str], np.ndarray]:
    """(sentence, label): of a toxic text the surroundings of its marking words, or without any its worst
    sentence and those nearly as bad; of a clean text its worst sentence and another."""
    box = sample.sparkSession.sparkContext.broadcast(weights)

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sentences = split_sentences(text)
                if not sentences:
                    continue
                if label > 0.5 and (marked := [x for x in map(names.search, sentences) if x][:BAD_SENTENCES]):
                    out += [beside(x) for x in marked]
                    labels += [label] * len(marked)
                    continue
                values = worst(sentences, box.value)
                order = np.argsort(-values, kind="stable")[:BAD_SENTENCES].tolist()
                if label > 0.5:
                    chosen = [i for i in order if values[i] >= NEARLY * values[order[0]] or i == order[0]]
                else:
                    chosen = sorted({order[0], len(sentences) // 2})
                out += [best_part(sentences[i], box.value) for i in chosen]
                labels += [label] * len(chosen)
            yield pa.RecordBatch.from_pydict({"s": pa.array(out, pa.string()), "label": pa.array(labels, pa.float64())})

    got = sample.select("text", "label").mapInArrow(pick, "s string, label double").orderBy(F.xxhash64("s"), "s", "label").limit(4 * FIT_ROWS).toArrow()
    return got["s"].to_pylist(), (got["label"].to_numpy() > 0.5).astype(float)


def beside(m: re.Match[str]) -> str:
    """A marking word and the words on either side."""
    before, after = m.string[:m.start()].split()[-1:], m.string[m.end():].split()[:1]
    return " ".join([*before, m[0], *after])


def best_part(sentence: str, weights: np.ndarray) -> str:
    """The words around the worst stretch of a long sentence."""
    words = sentence.split()
    if len(words) <= 12:
        return sentence
    parts = [" ".join(words[i:i + 12]) for i in range(0, len(words), 6)]
    return parts[int(np.argmax(worst(parts, weights)))]


def with_insertions(sentence: str, names: re.Pattern[str], draw: random.Random) -> str:
    """A letter or two put into the marking words; into some of the other words if there are none."""

    def insert(m: re.Match[str]) -> str:
        word = m[0]
        for _ in range(draw.choice((1, 1, 2))):
            at = draw.randrange(1, len(word))
            word = word[:at] + draw.choice(LETTERS) + word[at:]
        return word

    return names.sub(insert, sentence) if names.search(sentence) else LONG_WORD.sub(lambda m: insert(m) if draw.random() < 0.3 else m[0], sentence)


def kernel_values(sentences: list[str], weights: np.ndarray, landmarks: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Whitened kernel of each sentence's worst stretch with the landmarks; a stretch has few subsequences."""
    by_number = np.ascontiguousarray(landmarks.T) @ whiten
    out = np.zeros((len(sentences), whiten.shape[1]), np.float32)
    for row, sentence in enumerate(sentences):
        s = signs(sentence)
        at = int(np.argmax(stretches(s, weights)))
        found = [*subsequences(s[at:at + WINDOW + 4])]
        if not found:
            continue
        numbers, place = np.unique(np.concatenate([n for n, _ in found]), return_inverse=True)
        own = np.bincount(place, np.concatenate([np.full(len(n), w) for n, w in found]))
        out[row] = own @ by_number[numbers] / np.linalg.norm(own)
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, epochs: int = 30, penalty: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge loss by stochastic subgradients with averaging; the kinds weigh the same. Weights, and the shift,
    which the logistic curve replaces."""
    draw = np.random.default_rng(seed)
    sign = 2 * y - 1
    cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, mean, step = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    for epoch in range(epochs):
        for rows in np.array_split(draw.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            part = np.concatenate([x[rows], np.ones((len(rows), 1))], axis=1)
            hit = sign[rows] * (part @ w) < 1
            g = penalty * w - (cost[rows] * hit * sign[rows]) @ part / len(rows)
            w = w - g * 2.0 / np.sqrt(step)
            if epoch >= epochs // 2:
                mean += w
    mean *= np.linalg.norm(w) / max(1e-12, np.linalg.norm(mean))
    return mean[:-1], float(mean[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Machine:
    # Copies of one text would make all its words look like marks.
    sample = stage(labelled_sample(docs, labels, key, text, label, rows).dropDuplicates(["text", "label"]), "sample")
    marks, common = marking_words(sample, LANDMARKS)
    if not marks:
        return Machine(np.zeros(SIGNS ** 3))
    names = re.compile(rf"\b(?:{'|'.join(re.escape(m[0]) for m in marks)})\b", re.I)
    landmarks = np.array([kernel_vector(signs(w)) for w in [m[0] for m in marks] + common])
    own = landmarks @ landmarks.T
    values, vectors = np.linalg.eigh(own)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    # To begin with, what the marking words share with each other and not with common ones.
    evidence = np.array([m[1] for m in marks])
    weights = evidence @ landmarks[:len(marks)] / evidence.sum() - landmarks[len(marks):].sum(axis=0) / max(1, len(common))
    hard = np.zeros((0, whiten.shape[1]), np.float32)
    for turn in range(ROUNDS):
        sentences, y = labelled_sentences(sample, weights, names)
        if not len(y) or y.min() == y.max():
            break
        # A toxic text need not show it: what is no worse than clean texts' worst and holds no marking word teaches nothing.
        values = worst(sentences, weights)
        told = (y < 0.5) | (values > np.quantile(values[y < 0.5], CLEARLY)) | np.array([bool(names.search(s)) for s in sentences])
        if not y[told].any():
            told[:] = True
        sentences, y = [s for s, k in zip(sentences, told) if k], y[told]
        draw = random.Random(turn)
        altered = [with_insertions(s, names, draw) for s in sentences]
        y = np.concatenate([np.zeros(len(hard)), y, y])
        x = np.concatenate([hard, kernel_values([*sentences, *altered], weights, landmarks, whiten)])
        fitted, shift = fit_linear(x, y)
        weights = landmarks.T @ (whiten @ fitted)
        # Of clean sentences those on the wrong side of the margin stay for the next round; toxic ones are chosen anew.
        hard = x[(y < 0.5) & (x @ fitted + shift > -1)][:FIT_ROWS]
    box = docs.sparkSession.sparkContext.broadcast(weights)
    scored = sample.select("text", "label", F.xxhash64("text").alias("hash")).mapInArrow(_valuer(box), "label double, hash long, value double")
    # Repeated keys can make the sample longer; what is left out then is chance, whatever its kind.
    got = scored.orderBy("hash", "label").limit(2 * FIT_ROWS).toArrow()
    return calibrated(weights, got["value"].to_numpy(), (got["label"].to_numpy() > 0.5).astype(float))


def _valuer(box):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(values_of(batch.column(0).to_pylist(), box.value))
            yield pa.RecordBatch.from_pydict({"label": batch.column(1), "hash": batch.column(2), "value": values})

    return run


def values_of(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    out, part, size = [np.zeros(0)], [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK:
            out.append(worst(part, weights))
            part, size = [], 0
    if part:
        out.append(worst(part, weights))
    return np.concatenate(out)


def calibrated(weights: np.ndarray, values: np.ndarray, y: np.ndarray) -> Machine:
    """A logistic curve through the documents' values, by Newton steps with softened targets."""
    if not len(y) or y.min() == y.max():
        return Machine(weights)
    center, scale = values.mean(), values.std() + 1e-9
    z = np.stack([(values - center) / scale, np.ones(len(y))], axis=1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    ab = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        gradient = z.T @ (p - target) + 1e-3 * ab
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return Machine(weights, float(ab[0] / scale), float(ab[1] - ab[0] * center / scale))


def score(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic."""
    box = shipped(docs.sparkSession, machine)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(box)
        for batch in slices(batches):
            p = m.probabilities(values_of(batch.column(at).to_pylist(), m.weights))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents below this probability; columns are those of ``docs``."""
    into, = fresh(docs, "score")
    return score(docs, fit(docs, labels, key, text), text, into).filter(F.col(into) < threshold).select(*docs.columns)
