"""License scans: fuzzy search for short notices, from exact seeds to verified edits.

A notice may be met with a few edits (``allowed``). Cut into one piece more than that, at least one
piece of it stands unchanged in every such place (pigeonhole), so one pass of an automaton over the
folded text finds all candidates; the regex library then matches the whole notice around each seed
with its number of edits bounded, and what it confirms is reported as a span with its edits. Edits
are counted in characters of the folded text: words in lower case joined by single blanks, any
character outside ASCII being one sign of its own. A place begins and ends at word borders.

Defined cases: a null, empty or wordless text has no words and no spans; a text is searched whole,
however long; of places of one notice that overlap, the first is reported unless a better one begins
in its first half; repeated rows give repeated results; an empty table gives no rows; columns of ``docs`` that
have the names of results are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

#: Phrases that name a license, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices as they are usually worded, and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "you may not use this file except in compliance with the license": "apache",
    "all rights reserved": "all-rights-reserved",
}
#: One edit is allowed for so many characters of a notice, up to the most.
CHARS_PER_EDIT = 9
MOST_EDITS = 6

#: Lower case for A-Z, a blank for ASCII that is neither letter nor digit, and for the first byte of a
#: character outside ASCII a sign no folded word has otherwise; its further bytes are left out.
OTHER = ord("~")
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 if c < 128 else OTHER for c in range(256)
)
FURTHER = bytes(range(0x80, 0xC0))


def folded(text: str | None) -> tuple[int, str]:
    """The number of words, and the words between single blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD, FURTHER).split()
    return len(words), f" {b' '.join(words).decode('ascii')} "


def allowed(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(begin, piece) of ``edits + 1`` pieces of about equal length."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Seeds of all notices in one automaton, and a bounded-error pattern for each notice."""

    def __init__(self, notices: list[str]):
        self.notices = notices
        self.edits = [allowed(n) for n in notices]
        self.seeds = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for begin, piece in pieces(notice, self.edits[i]):
                owners.setdefault(piece, []).append((i, begin))
        for piece, own in owners.items():
            self.seeds.add_word(piece, (len(piece), own))
        self.seeds.make_automaton()
        bounded = [f"(?<= )(?:{regex.escape(n)}){{e<={e}}}(?= )" for n, e in zip(notices, self.edits)]
        self.any = [regex.compile(f"(?e){p}") for p in bounded]
        self.best = [regex.compile(f"(?b){p}") for p in bounded]

    def candidates(self, text: str) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
        """Per notice the stretches that may hold it, overlapping ones joined, and where it stands unchanged."""
        stretches: dict[int, list[tuple[int, int]]] = {}
        exact: dict[int, list[int]] = {}
        for last, (size, owners) in self.seeds.iter(text):
            for i, offset in owners:
                notice, edits = self.notices[i], self.edits[i]
                at = last + 1 - size - offset
                if not offset and text[at - 1] == " " and text.startswith(notice, at) and text[at + len(notice)] == " ":
                    exact.setdefault(i, []).append(at)
                begin, end = max(0, at - edits - 1), at + len(notice) + edits + 1
                own = stretches.setdefault(i, [])
                # Seeds of a notice come in order of their ends, so a stretch can begin before the last one.
                while own and begin <= own[-1][1]:
                    before = own.pop()
                    begin, end = min(begin, before[0]), max(end, before[1])
                own.append((begin, end))
        return stretches, exact

    def verified(self, text: str, i: int, stretch: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """(begin, end, edits) of the places of a notice in a stretch, from the left.

        A place gives way to a better one that begins within its first half; one that begins later but
        overlaps it is reported too. So every place overlaps a reported one, and none is better than the best.
        """
        begin, end = stretch
        reach = len(self.notices[i]) + self.edits[i] + 1
        part, at = text[begin:end], 0
        while m := self.any[i].search(part, at):
            first, last, edits = m.start(), m.end(), sum(m.fuzzy_counts)
            at = last
            if edits:
                shift = max(0, first - 1)
                m = self.best[i].search(part[shift:last + reach])
                start, n = shift + m.start(), sum(m.fuzzy_counts)
                if n < edits and start <= first + (last - first) // 2:
                    first, last, edits = start, shift + m.end(), n
                    at = last
                elif n < edits and start < last:
                    at = start - 1
            yield begin + first, begin + last, edits

    def scan(self, text: str) -> tuple[list[tuple[int, int, int, int]], dict[int, list[int]]]:
        """Spans (first word, word after the last, notice, edits), and the first words of unchanged places."""
        stretches, exact = self.candidates(text)
        places = {(b, e, i, n) for i, own in stretches.items() for s in own for b, e, n in self.verified(text, i, s)}
        marks = sorted({p for b, e, _, _ in places for p in (b, e)} | {p for own in exact.values() for p in own})
        words, at, number = {}, 0, 0
        for p in marks:  # the blanks before a place are the number of its word
            number += text.count(" ", at, p)
            words[p], at = number, p
        spans = sorted((words[b] - 1, words[e], i, n) for b, e, i, n in places)
        return spans, {i: [words[p] - 1 for p in own] for i, own in exact.items()}


SPAN = "struct<label:string,notice:string,begin:int,end:int,edits:int>"


def find_notices(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Add ``n_words``; ``phrase_places`` (phrase, first word) of phrases word by word; and ``spans`` of all notices.

    ``phrases`` and ``notices`` map a wording, folded as texts are, to its label; places of phrases with
    edits are spans too. One pass without a shuffle; a task holds a slice of rows.
    """
    labels = notices | phrases
    wordings = sorted(labels)
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "phrase_places", "spans")]
    at = kept.index(text)
    base = docs.select(*kept).withColumns({
        "n_words": F.lit(0).cast("bigint"),
        "phrase_places": F.array().cast("array<struct<phrase:string,word:int>>"),
        "spans": F.array().cast(f"array<{SPAN}>"),
    })

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings)
        for batch in slices(batches):
            counts, places, spans = [], [], []
            for t in batch.column(at).to_pylist():
                n, whole = folded(t)
                found, exact = scanner.scan(whole)
                counts.append(n)
                places.append(sorted(
                    ({"phrase": wordings[i], "word": w} for i, own in exact.items() if wordings[i] in phrases for w in own),
                    key=lambda p: (p["word"], p["phrase"]),
                ))
                spans.append([
                    {"label": labels[wordings[i]], "notice": wordings[i], "begin": b, "end": e, "edits": n} for b, e, i, n in found
                ])
            new = {
                "n_words": pa.array(counts, pa.int64()),
                "phrase_places": pa.array(places, batch.schema.field("phrase_places").type),
                "spans": pa.array(spans, batch.schema.field("spans").type),
            }
            columns = [new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return base.mapInArrow(scan, base.schema)


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def nearness(span: Column) -> Column:
    """1 for a place without edits, less the more of the allowed edits it needs, never 0."""
    room = F.least(F.lit(MOST_EDITS), F.floor(F.length(span["notice"]) / CHARS_PER_EDIT).cast("int")) + 1
    return F.lit(1.0) - span["edits"] / room


def report(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Add the digest of a scan: words, unchanged phrases and where they lie, labels, and a score."""
    found = find_notices(docs, text, **options)
    phrases = options.get("phrases", PHRASES)
    label_of = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    base = F.transform("phrase_places", lambda p: label_of[p["phrase"]])
    words = F.transform("phrase_places", lambda p: p["word"].cast("bigint"))
    results = {
        "n_base": F.size("phrase_places").cast("bigint"),
        "first_word": F.array_min(words),
        "last_word": F.array_max(words),
        "base_labels": joined_labels(base),
        "labels": joined_labels(F.concat(base, F.transform("spans", lambda s: s["label"]))),
        "score": F.coalesce(F.array_max(F.transform("spans", nearness)), F.lit(0.0)),
    }
    return found.drop(*[c for c in found.columns if c.lower() in results]).withColumns(results)
