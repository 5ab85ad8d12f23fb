"""The block encoder: distinct units are encoded once, texts are cut only where the library cuts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ablatrix.llm import tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [" "] * 6 + ["\n"] * 4 + ["'"] * 3 + list("\t\r\x0b\x0c\x00\x1c\x1f\x7fabstmdXYZ019.,;!?-<|>") + [
    "'s", "'ll", "<|endoftext|>", *map(chr, (
        0x85, 0xA0, 0xAB, 0xE9, 0xB2, 0x301, 0x660, 0x1680, 0x1681, 0x180E, 0x1EA1, 0x2000, 0x200A, 0x200B, 0x201C, 0x2028,
        0x2029, 0x202F, 0x205F, 0x2160, 0x3000, 0x3001, 0x3042, 0x65E5, 0xD7FF, 0xE000, 0xFEFF, 0x1F600, 0x10FFFF,
    )),
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def encoder(monkeypatch):
    """A new encoder that counts what it has encoded, in place of the process's own."""
    made = tokenizing.Encoder(PATH)
    encode, made.calls = made.encode, []
    made.encode = lambda piece: made.calls.append(piece) or encode(piece)
    monkeypatch.setattr(tokenizing, "encoder", lambda path: made)
    return made


def ids_of(texts, kind=None):
    return [np.frombuffer(x, "<u4").tolist() for x in tokenizing.encode_all(pa.array(texts, kind or pa.string()), PATH)]


def test_distinct_units_once(encoder, plain, monkeypatch):
    """Words that come round again cost one encoding each, even if the table is far too small for them."""
    monkeypatch.setattr(tokenizing, "TABLE_SIZE", 50)
    words = [f" {a}{b}xy" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = ["".join(words)] * 20
    assert ids_of(texts) == [plain(t) for t in texts]
    assert len(encoder.calls) == len(words)


def test_table_keeps_the_frequent(encoder, monkeypatch):
    """Units met in many blocks stay, rare and long ones leave."""
    monkeypatch.setattr(tokenizing, "TABLE_SIZE", 20)
    for i in range(30):
        ids_of([" the of and" + "".join(f" {chr(97 + i % 26)}{c}{i // 26 * 'q'}z" for c in "abcdefg"), "x" * 100])
    assert len(encoder.units) <= 20 and len(encoder.units) == len(encoder.ids) == len(encoder.met)
    assert {" the", " of", " and"} <= set(encoder.units.to_pylist()) and encoder.calls.count(" the") == 1
    assert encoder.calls.count("x" * 100) == 30


@pytest.mark.parametrize("size", [40, 10**6])
def test_odd_signs(encoder, plain, monkeypatch, size):
    monkeypatch.setattr(tokenizing, "TABLE_SIZE", size)
    draw = random.Random(size)
    for turn in range(40):
        texts = ["".join(draw.choices(SIGNS, k=draw.choice([0, 1, 2, 3, 5, 8, 20, 60]))) for _ in range(30)]
        texts = [None, *(t if draw.random() < 0.2 else t.replace("<|endoftext|>", "") for t in texts)]
        assert ids_of(texts, pa.large_string() if turn % 2 else None) == [plain(t) for t in texts]
    column = pa.array(["left out", "a ", " b\n", "\nc", None, " d"]).slice(1, 5)
    assert [len(x) // 4 for x in tokenizing.encode_all(column, PATH)] == [len(plain(t)) for t in column.to_pylist()]
    assert ids_of([]) == [] and ids_of(["", None]) == [[], []]


def test_blocks():
    """Short batches are put together, long ones cut; every row stays, in order."""
    sizes = [0, 3, 500, 0, 5000, 1, 40, 0, 900] * 7
    rows = [(i, None if n == 0 and i % 2 else "x" * n) for i, n in enumerate(sizes)]
    for step in (1, 4, 63):
        batches = [
            pa.RecordBatch.from_pydict({"key": [r[0] for r in rows[i:i + step]], "text": pa.array([r[1] for r in rows[i:i + step]], pa.string())})
            for i in range(0, len(rows), step)
        ]
        got = list(tokenizing.blocks(iter(batches), 1, 1000))
        assert [(r["key"], r["text"]) for b in got for r in b.to_pylist()] == rows
        weights = [[len(t or "") + tokenizing.TEXT_BYTES for t in b.column(1).to_pylist()] for b in got]
        assert all(sum(w[:-1]) < 1000 <= sum(w) for w in weights[:-1])
    assert list(tokenizing.blocks(iter([]), 1)) == []
