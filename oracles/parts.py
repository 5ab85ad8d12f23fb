"""SQL building blocks for the result checks, in DuckDB's dialect.

Word boundaries: every word run is wrapped in chr(2), so a whole-word pattern is the word
between two marks, whatever script it is in. Replaced matches are wrapped in chr(1), the
text split there, and the pieces at even places are the matches.
"""

from __future__ import annotations

import hashlib

SPACES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "||".join(
    f"chr({p})"
    for p in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_{SPACES}]"

# Word lists and swap tables of the rewrites.
LOGIC = "all|any|every|if|then|because|therefore|hence|thus"
MATH = "add|sum|total|discount|multiply|divide|minus|plus|more than|less than|area|perimeter|average"
CAUSE = "because|so|due to|as a result"
TIME = {
    "before": "after", "after": "before", "earlier": "later", "later": "earlier", "first": "last",
    "last": "first", "start": "end", "end": "start", "began": "finished", "finished": "began",
    "am": "pm", "pm": "am",
}
PLACE = {
    "left": "right", "right": "left", "above": "below", "below": "above", "north": "south", "south": "north",
    "east": "west", "west": "east", "behind": "in front of", "in front of": "behind", "inside": "outside",
    "outside": "inside", "top": "bottom", "bottom": "top",
}


def trim(x: str) -> str:
    return f"trim({x}, {SPACE_CHARS})"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({trim(x)}, '([.!?])[{SPACES}]+', '\\1'||chr(1), 'g'), chr(1))"


def rev_sentences(x: str) -> str:
    return f"array_to_string(list_reverse({sentences(x)}), ' ')"


def space_tokens(x: str) -> str:
    return f"string_split_regex({trim(x)}, '[{SPACES}]+')"


def rev_words(x: str) -> str:
    return f"array_to_string(list_reverse({space_tokens(x)}), ' ')"


def at_matches(marked: str, render: str) -> str:
    """``render`` is SQL in ``s`` (a match) and ``i`` (its place, even)."""
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(1)), "
        f"lambda s, i: CASE WHEN i % 2 = 0 THEN {render} ELSE s END), '')"
    )


def scramble(x: str) -> str:
    return at_matches(f"regexp_replace({x}, '{WORD}+', chr(1)||'\\0'||chr(1), 'g')", "reverse(s)")


def mask(x: str) -> str:
    hit = rf"regexp_matches(w, '^\p{{Lu}}\p{{L}}*$') OR regexp_matches(w, '^\p{{Nd}}+([^\p{{L}}\p{{N}}_]|$)')"
    marked = (
        f"array_to_string(list_transform({space_tokens(x)}, "
        f"lambda w: CASE WHEN {hit} THEN chr(1)||w||chr(1) ELSE w END), ' ')"
    )
    return at_matches(marked, "'[ENT'||(i // 2)||']'")


def bounded(x: str) -> str:
    return f"regexp_replace({x}, '{WORD}+', chr(2)||'\\0'||chr(2), 'g')"


def unbound(x: str) -> str:
    return f"replace({x}, chr(2), '')"


def whole(words: str) -> str:
    """Pattern for whole words or phrases in bounded text."""
    return rf"\x02({words.replace(' ', chr(92) + 'x02 ' + chr(92) + 'x02')})\x02"


def drop(x: str, words: str) -> str:
    return unbound(f"regexp_replace({bounded(x)}, '(?i){whole(words)}', '', 'g')")


def swap(x: str, table: dict[str, str]) -> str:
    marked = f"regexp_replace({bounded(x)}, '(?i){whole('|'.join(table))}', chr(1)||'\\0'||chr(1), 'g')"
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return unbound(at_matches(marked, f"CASE lower({unbound('s')}) {arms} ELSE s END"))


def cause(x: str) -> str:
    cut = unbound(rf"regexp_replace({bounded(x)}, '(?i){whole(CAUSE)}[^\n.!?]*[.!?]', '', 'g')")
    return f"{trim(f'split_part({cut}, chr(46), 1)')} || '. Afterwards, a bird flew by.'"


def blank(x: str) -> str:
    return f"regexp_replace({x}, '[A-Za-z0-9]', 'X', 'g')"


def quant(x: str) -> str:
    numbers = rf"regexp_replace({bounded(x)}, '\x02\p{{Nd}}+\x02(\.\x02\p{{Nd}}+\x02)?', '<NUM>', 'g')"
    return drop(unbound(numbers), MATH)


def scramble_options(x: str) -> str:
    return f"list_transform({x}, lambda o: {scramble('o')})"


def words(x: str) -> str:
    return f"array_to_string({x}, '|')"


def numbers(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def order_hash(seed: int, *parts: str) -> str:
    text = "||':'||".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x'||substr(md5({text}), 1, 15))::BIGINT"


def permuted(source: str, x: str, n: str, seed: int, into: str, walks: int = 4) -> str:
    """CTEs ``{into}``: ``source`` with ``rank``, the place of ``x`` in a seeded permutation of 0 to n - 1.

    Two digits to bases near the root of n; each round shifts one by a keyed function of the other.
    """
    prime = 2**31 - 1
    keys = [
        [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[j:j + 8]) % prime for j in (0, 8, 16)] for i in range(6)
    ]
    steps = [
        f"{into}_n AS (SELECT *, ({x})::BIGINT AS y, ({n})::BIGINT AS size FROM {source})",
        f"{into}_b AS (SELECT *, greatest(1, floor(sqrt(greatest(0, size - 1)))::BIGINT + 1) AS ba FROM {into}_n)",
        f"{into}_w0 AS (SELECT *, greatest(1, (size + ba - 1) // ba) AS bb FROM {into}_b)",
    ]
    for w in range(walks):
        steps.append(f"{into}_s{w}_0 AS (SELECT *, y // bb AS u, y % bb AS v FROM {into}_w{w})")
        for i, (m, c, d) in enumerate(keys):
            t = f"((v * {m} + {c}) % {prime})"
            steps.append(
                f"{into}_s{w}_{i + 1} AS (SELECT * REPLACE (v AS u, (u + ({t} * {t} + {d}) % {prime}) % {('ba', 'bb')[i % 2]} AS v) FROM {into}_s{w}_{i})"
            )
        again = "TRUE" if w == 0 else "y >= size"
        steps.append(f"{into}_w{w + 1} AS (SELECT * EXCLUDE (u, v) REPLACE (CASE WHEN {again} THEN u * bb + v ELSE y END AS y) FROM {into}_s{w}_6)")
    steps.append(f"{into} AS (SELECT * EXCLUDE (y, size, ba, bb), y AS rank FROM {into}_w{walks})")
    return ", ".join(steps)
