"""Texts to token ids with a tokenizer file, in Arrow batches.

A block of texts is cut where the byte-level tokenizer's own pattern is sure to cut, and asks once
for each distinct unit between the cuts. Most were met before: a bounded table of the worker
process keeps their ids, and only the others are encoded.
"""

from __future__ import annotations

import os
import sys
import types
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes encoded at a time, and what a text counts beyond its own.
BLOCK_BYTES, TEXT_BYTES = 2 * 2**20, 64
#: Units a process remembers, and the bytes of the longest one it keeps.
TABLE_SIZE, TABLE_LENGTH = 300_000, 48
#: What a pair of neighbouring bytes says: cut before the first, cut before the second, look further.
FIRST, SECOND, LOOK = 1, 2, 4
#: White space beyond ASCII as the number its bytes make, and the bytes it may begin with.
WIDE_SPACE = [int.from_bytes(c.encode()) for c in map(chr, (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
))]
WIDE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def sure_cuts() -> np.ndarray:
    """For each pair of bytes (256 times the first plus the second) the cuts that hold whatever stands around it.

    A blank or line end is cut off what comes before if a sign follows it or an ASCII sign precedes
    it; a blank stays with the sign behind it, a line end doesn't. In ASCII, letters, digits and
    other signs are parted, but an apostrophe may belong to the letter behind it.
    """
    out = np.zeros((256, 256), np.uint8)
    kinds = {c: chr(c).isalpha() + 2 * chr(c).isdigit() for c in range(0x21, 0x7F)}
    for c in (*kinds, *range(0xC2, 0xF5)):
        out[32, c], out[10, c] = (LOOK, LOOK) if c in WIDE_LEADS else (FIRST, FIRST | SECOND)
    for c, kind in kinds.items():
        out[c, [10, 32]] = SECOND
        if c != ord("'"):
            out[c, [d for d, other in kinds.items() if other != kind]] = SECOND
    return out.ravel()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = self.tokenizer.model
        # The tokenizer's spelling of bytes: its merges know each byte as a printable character.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        spelling = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for c in map(chr, range(128, 0x800)):
            spelling.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0]))
        for c in (chr(x) for x in range(0x800, 0x110000, 0x200) if not 0xD800 <= x < 0xE000):
            spelling.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0]))

        blank, number = spelling[32], attrgetter("id")

        def encode(piece: str) -> bytes:
            if piece.isascii() and piece.isprintable():
                spelled = piece.replace(" ", blank)
            else:
                spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(spelling)
            return array("I", map(number, model.tokenize(spelled))).tobytes()

        self.encode, self.pieces = encode, regex.compile(public_tokenizers.PATTERN).findall
        self.cuts = sure_cuts()
        # The table: units, their ids, and in how many blocks each was met.
        self.units, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)

    def unit(self, unit: str) -> bytes:
        if (unit[1:] if unit[0] == " " else unit).isalpha():
            return self.encode(unit)
        return b"".join(map(self.encode, self.pieces(unit)))

    def begins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the units begin in the bytes of texts with these ends, and the end of all."""
        inner = ends[(ends > 0) & (ends < len(data))]
        pairs = data[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= data[1:]
        found = self.cuts[pairs]
        found[inner - 1] = 0  # the next text says nothing
        look = np.flatnonzero(found & LOOK)
        if len(look):
            # A character of two or three bytes follows the blank or line end.
            wide = np.zeros(len(look), np.int64)
            for i in (1, 2, 3):
                wide = wide << 8 | data[np.minimum(look + i, len(data) - 1)]
            wide = np.where(data[look + 1] == 0xC2, wide >> 8, wide)
            sign = np.where(data[look] == 10, FIRST | SECOND, FIRST)
            found[look] = np.where(np.isin(wide, WIDE_SPACE), 0, sign)
        cut = np.zeros(len(data), bool)
        cut[:-1] = found & FIRST
        cut[1:] |= (found & SECOND) != 0
        cut[inner] = cut[0] = True
        return np.append(np.flatnonzero(cut), len(data)).astype(np.int32)

    def look_up(self, units: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids, and the place among them of each of these distinct units."""
        at = pc.index_in(units, value_set=self.units)
        new = units.filter(at.is_null())
        encoded = pa.array([self.unit(u) for u in new.to_pylist()], pa.large_binary())
        ids, places = pa.concat_arrays([self.ids, encoded]), at.fill_null(-1).to_numpy().copy()
        places[places < 0] = np.arange(len(self.ids), len(ids))
        met = np.append(self.met, np.zeros(len(new), np.int64))
        met[places] += 1
        # The table takes the new ones up; when it is full, those met in the fewest blocks leave.
        keep = np.ones(len(ids), bool)
        keep[len(self.ids):] = pc.binary_length(new).to_numpy() <= TABLE_LENGTH
        least = 1
        while np.count_nonzero(keep) > TABLE_SIZE:
            least *= 2
            keep &= met >= least
        self.units, self.ids = pa.concat_arrays([self.units, new]).filter(keep), ids.filter(keep)
        self.met = met[keep] // least if least > 1 else met[keep]
        return ids, places

    def block(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of the texts, none of which is null."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if whole.any():
            plain = self.block(pc.if_else(whole, "", texts))
            for text, ids, apart in zip(texts.to_pylist(), plain, whole.tolist()):
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if apart else ids
            return
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            yield from [b""] * len(texts)
            return
        data, ends = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]
        at = self.begins(data, ends)
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        ids, places = self.look_up(units.dictionary)
        _, offsets, data = ids.take(pa.array(places[units.indices.to_numpy()])).buffers()
        edges = np.frombuffer(offsets, np.int64)[np.searchsorted(at, ends)].tolist()
        data = memoryview(data)
        for begin, end in zip(edges, edges[1:]):
            yield data[begin:end].tobytes()

    def text(self, text: str) -> bytes:
        return next(self.block(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a file; later tasks of the process use it again."""
    shelf = sys.modules.setdefault("_ablatrix_encoders", types.ModuleType("_ablatrix_encoders"))
    made = shelf.__dict__.setdefault("made", {})
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


def blocks(batches: Iterable[pa.RecordBatch], text: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches' rows in blocks of about ``size`` text bytes: long batches cut, short ones put together."""
    size = size or BLOCK_BYTES
    held: list[pa.RecordBatch] = []
    room = size
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy()
        ends = np.cumsum(sizes.astype(np.int64) + TEXT_BYTES)
        begin = done = 0
        while begin < batch.num_rows:
            end = min(int(np.searchsorted(ends, done + room)) + 1, batch.num_rows)
            held.append(batch.slice(begin, end - begin))
            room -= int(ends[end - 1]) - done
            begin, done = end, int(ends[end - 1])
            if room <= 0:
                yield pa.concat_batches(held)
                held, room = [], size
    if held:
        yield pa.concat_batches(held)
    # A worker that waits for its next task gives back what this one needed.
    del held
    pa.default_memory_pool().release_unused()


def encode_all(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Ids of each text of a block; a null one counts as empty."""
    return encoder(path).block(texts.fill_null("")) if len(texts) else iter(())
