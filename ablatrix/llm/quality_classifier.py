"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector; a word's context vector is the sum of the index vectors
of its neighbours over the whole corpus. Words share a fixed number of buckets by hash, so the table
of vectors has the same size for any corpus: tasks sum what they read, and the sums are added by
bucket. A document is the mean vector of its tokens, that of its distinct ones, and its length,
variety and word length. A two-layer network is fitted to a bounded sample of labelled documents and its
probabilities are calibrated by a temperature on labelled documents it was not fitted to.

Defined cases: a null text is empty; an empty text has the zero vector and gets the score the
network gives that; null labels and keys without document are left out of the fit; of repeated
labels each counts; without labels of both kinds every score is 0.5; an empty table gives no rows.
The sample: at most ``FIT_ROWS`` labelled documents, those of smallest key hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, opened, shipped, slices

BUCKETS = 1 << 15
DIMENSIONS = 64
#: Places of an index vector that are not zero, and the neighbours on each side.
NONZERO = 2
NEIGHBOURS = 2
FIT_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
BATCH_TOKENS = 1 << 18
#: Tokens a task remembers the bucket of.
TABLE_SIZE = 150_000

TOKEN = re.compile(r"\w+|[^\w\s]+")
FEATURES = 2 * DIMENSIONS + 3


class Buckets(dict):
    """Buckets of tokens. Words in capitals share one: their letters say less than their case."""

    def __missing__(self, token: str) -> int:
        written = "\0" if len(token) > 1 and token.isupper() else token
        bucket = zlib.crc32(written.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) >= TABLE_SIZE:
            self.clear()
        self[token] = bucket
        return bucket


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector."""
    draw = np.random.default_rng(17)
    return draw.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens_of(texts: Iterable[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Buckets of all tokens in order, the tokens per text, and the texts' characters in tokens."""
    found = [TOKEN.findall(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    ids = np.fromiter((b for x in found for b in map(buckets.__getitem__, x)), np.int64, int(counts.sum()))
    return ids, counts, [sum(map(len, x)) for x in found]


def chunks(batch: pa.Array) -> Iterator[list[str | None]]:
    texts: list[str | None] = []
    size = 0
    for t in batch.to_pylist():
        texts.append(t)
        size += len(t or "")
        if size > BATCH_TOKENS * 4 or len(texts) >= 256:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vector of every bucket over all texts, ``BUCKETS`` x ``DIMENSIONS``."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        buckets = Buckets()
        sums = np.zeros(BUCKETS * DIMENSIONS)
        for batch in slices(batches):
            for texts in chunks(batch.column(0)):
                ids, counts, _ = tokens_of(texts, buckets)
                owner = np.repeat(np.arange(len(counts)), counts)
                for step in range(1, NEIGHBOURS + 1):
                    same = owner[step:] == owner[:-step]
                    left, right = ids[:-step][same], ids[step:][same]
                    at = np.concatenate([
                        left[:, None] * DIMENSIONS + places[right], right[:, None] * DIMENSIONS + places[left]
                    ])
                    weights = np.concatenate([signs[right], signs[left]])
                    sums += np.bincount(at.ravel(), weights.ravel(), len(sums))
        # Whole numbers: their sum doesn't depend on the order of tasks.
        rows = sums.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        for i in range(0, BUCKETS, 1024):
            part = rows[i:i + 1024]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([i], pa.int32()), "sums": pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary()),
                })

    def total(group: pa.Table) -> pa.Table:
        out = np.zeros(1024 * DIMENSIONS, np.int64)
        for raw in group["sums"]:
            out += np.frombuffer(zlib.decompress(raw.as_py()), "<i8")
        return pa.table({
            "part": group["part"].slice(0, 1), "sums": pa.array([zlib.compress(out.astype("<i8").tobytes(), 1)], pa.binary())
        })

    summed = docs.select(text).mapInArrow(add, "part int, sums binary").groupBy("part").applyInArrow(
        total, "part int, sums binary"
    )
    out = np.zeros((BUCKETS, DIMENSIONS))
    for r in summed.collect():  # the table of vectors, of fixed size
        out[r["part"]:r["part"] + 1024] = np.frombuffer(zlib.decompress(r["sums"]), "<i8").reshape(-1, DIMENSIONS)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors without their common direction."""
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    units = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    used = norms[:, 0] > 0
    if used.any():
        units[used] -= units[used].mean(axis=0)
    return units.astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Features of each text."""
    ids, counts, characters = tokens_of(texts, buckets)
    out = np.zeros((len(counts), FEATURES), np.float32)
    ends = np.cumsum(counts)
    for i, (begin, end) in enumerate(zip(ends - counts, ends)):
        if begin == end:
            continue
        kinds, times = np.unique(ids[begin:end], return_counts=True)
        own, n = vectors[kinds], end - begin
        out[i, :DIMENSIONS] = times.astype(np.float32) @ own / n
        out[i, DIMENSIONS:2 * DIMENSIONS] = own.mean(axis=0)
        out[i, -3:] = np.log1p(n), len(kinds) / n ** 0.8, characters[i] / n
    return out


class Network:
    """Standardised features, one hidden layer of rectifiers, a logit and a temperature."""

    def __init__(self):
        self.mean = np.zeros(FEATURES)
        self.scale = np.ones(FEATURES)
        self.w1, self.b1 = np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = np.zeros(HIDDEN), 0.0
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
        """Adam on four fifths, the temperature on the rest."""
        net, draw = cls(), np.random.default_rng(seed)
        if not len(y) or y.min() == y.max():
            return net
        x = x.astype(np.float64)
        order = draw.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5:]
        net.mean, net.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        net.w1 = draw.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN))
        net.w2 = draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
        params = [net.w1, net.b1, net.w2, np.array([net.b2])]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        z, t, step = np.clip((x - net.mean) / net.scale, -8, 8), y.astype(np.float64), 0
        for _ in range(EPOCHS):
            for rows in np.array_split(draw.permutation(used), max(1, len(used) // 128)):
                step += 1
                pre = z[rows] @ params[0] + params[1]
                act = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ params[2] + params[3][0], -30, 30)))
                d = (p - t[rows]) / len(rows)
                back = d[:, None] * params[2] * (pre > 0)
                grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), act.T @ d + 1e-4 * params[2], np.array([d.sum()])]
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= 2e-3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
        logits, truth = net.logits(x[held]), t[held]

        def loss(temperature: float) -> float:
            s = np.clip(logits / temperature, -30, 30)
            return float(np.mean(np.logaddexp(0, s) - truth * s)) if len(s) else 0.0

        net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return net


def add_features(docs: DataFrame, box, text: str, into: str) -> DataFrame:
    """Replace the text by its features."""
    at, others = docs.columns.index(text), [c for c in docs.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in slices(batches):
            x = np.concatenate([pooled(t, box.value, buckets) for t in chunks(batch.column(at))])
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(x), pa.list_(pa.float32()))], names=[*others, into])

    schema = docs.select(*others).withColumn(into, F.array().cast("array<float>")).schema
    return docs.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """``key, text, label`` of at most ``rows`` labels, those of smallest key hash."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("__key"), "label").limit(rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.join(F.broadcast(known), F.col("key") == F.col("__key")).select("key", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS):
    """(word vectors, network): vectors from all ``docs``, the network from the sample."""
    vectors = word_vectors(context_sums(docs, text))
    box = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = add_features(labelled_sample(docs, labels, key, text, label, rows), box, "text", "x")
    # A repeated key may bring more rows than labels.
    got = sample.orderBy(F.xxhash64("key"), "label", "x").limit(rows).select("label", "x").toArrow()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, FEATURES)
    return vectors, Network.fit(x, (got["label"].to_numpy() > 0.5).astype(np.int64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality."""
    box = shipped(docs.sparkSession, (vectors, network))
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = opened(box)
        buckets = Buckets()
        for batch in slices(batches):
            p = np.concatenate([net.probabilities(pooled(t, v, buckets)) for t in chunks(batch.column(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of at least this probability; columns are those of ``docs``."""
    vectors, network = fit(docs, labels, key, text)
    into, = fresh(docs, "score")
    return score(docs, vectors, network, text, into).filter(F.col(into) >= threshold).select(*docs.columns)
