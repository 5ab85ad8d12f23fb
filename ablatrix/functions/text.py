"""Column kernels on text. Everything here is a built-in expression; no Python worker runs.

Java's own ``\\w``, ``\\s`` and ``\\b`` differ from Unicode-aware text rules (and from SQL
engines), so the classes are spelled out.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, functions as F

# Code point ranges of whitespace; the class of word characters.
SPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
WHITESPACE = "".join(chr(p) for low, high in SPACE_RANGES for p in range(low, high + 1))
SPACE_BODY = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in SPACE_RANGES)
# Signs from ! to ~ are none: one test tells, before the ranges are gone through.
SPACE = f"[[^!-~]&&[{SPACE_BODY}]]"
WORD = r"[\p{L}\p{N}_]"
SENTENCE_GAP = rf"(?<=[.!?]){SPACE}+"
NUMBER = rf"(?<!{WORD})\p{{Nd}}+(?:\.\p{{Nd}}+)?(?!{WORD})"
# A token of the space-normalised text that is a capitalised all-letter word or opens with a whole number.
ENTITY = rf"(?<![^ ])(?:\p{{Lu}}\p{{L}}*|\p{{Nd}}+(?!{WORD})[^ ]*)(?![^ ])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def float_text(number: Column) -> Column:
    """A JSON number's text; with a power of ten only below 1e-4 and from 1e16 on, as ``1e-05`` and ``1e+16``."""

    def plain(parts: Column) -> Column:
        sign, first, rest, power = parts[0], parts[1], parts[2], parts[3].cast("int")
        rest = F.when(rest == "0", F.lit("")).otherwise(rest)
        digits = F.concat(first, rest)
        whole = F.rpad(digits, power + 1, F.lit("0"))
        fraction = F.substr(digits, power + 2, F.length(digits))
        exponent = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
        text = (
            F.when(power.between(0, 15), F.concat(whole, F.lit("."), F.when(fraction == "", F.lit("0")).otherwise(fraction)))
            .when(power.between(-4, -1), F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .otherwise(F.concat(first, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("e"),
                                F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), exponent))
        )
        return F.concat(sign, text)

    shape = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    parts = F.array(*[F.regexp_extract(number, shape, i) for i in range(1, 5)])
    return F.when(number.contains("E") & number.rlike(shape), let(parts, plain)).otherwise(number)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def tokens_by_space(c: Column) -> Column:
    """Whitespace-separated tokens; blank text gives one empty token."""
    return F.split(trim_space(c), SPACE + "+")


def any_word(words: Iterable[str]) -> str:
    """Case-insensitive pattern for whole words or phrases."""
    return rf"(?iu)(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"


def replace_matches(
    c: Column, pattern: str, render: Callable[..., Column], numbered: bool = False
) -> Column:
    """Replace every match of ``pattern`` by ``render(match)``, or ``render(match, n)`` with
    ``n`` counting from 0. Gaps and matches are split apart and zipped, so no marker
    character has to be kept out of the input. Patterns must not match the empty string.
    """
    gaps = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    if numbered:
        found = F.transform(found, lambda m, n: render(m, n))
        return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.array_join(
        F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(render(m), F.lit("")))), ""
    )


def reverse_sentences(c: Column) -> Column:
    return F.array_join(F.reverse(F.split(trim_space(c), SENTENCE_GAP)), " ")


def reverse_words(c: Column) -> Column:
    return F.array_join(F.reverse(tokens_by_space(c)), " ")


def reverse_letters(c: Column) -> Column:
    """Reverse the letters inside each word; everything between words stays in place."""
    return replace_matches(c, WORD + "+", F.reverse)


def mask_entities(c: Column) -> Column:
    """Number capitalised words and numerals as ``[ENT1]``, ``[ENT2]``, … per text."""
    return let(
        F.array_join(tokens_by_space(c), " "),
        lambda t: replace_matches(
            t, ENTITY, lambda _, n: F.concat(F.lit("[ENT"), (n + 1).cast("string"), F.lit("]")), numbered=True
        ),
    )


def swap_words(c: Column, swaps: Mapping[str, str]) -> Column:
    """Replace all listed words at once; a replacement is always in its listed lower case."""
    table = F.create_map(*[F.lit(x) for pair in swaps.items() for x in pair])
    return replace_matches(
        c, any_word(swaps), lambda m: F.coalesce(F.element_at(table, F.lower(m)), m)
    )


def drop_words(c: Column, words: Iterable[str]) -> Column:
    return F.regexp_replace(c, any_word(words), "")


def blank_alphanumerics(c: Column) -> Column:
    """Every ASCII letter or digit becomes ``X``."""
    alnum = string.ascii_letters + string.digits
    return F.translate(c, alnum, "X" * len(alnum))


def is_blank(c: Column) -> Column:
    """Whitespace only, or nothing but a literal backslash-n."""
    return (trim_space(c) == "") | (c == "\\n")


def split_sentences(c: Column) -> Column:
    """Rule-based sentences: break on whitespace after ``.``, ``!`` or ``?``; blank text has none."""
    return F.filter(F.split(trim_space(c), SENTENCE_GAP), lambda s: s != "")
