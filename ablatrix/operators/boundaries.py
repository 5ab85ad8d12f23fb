"""Sentence boundaries learned from the corpus itself, without labels.

Three things are counted over the whole corpus and judged by log-likelihood ratios: types that have a
period so often, being short, that it must be part of them (abbreviations); pairs of an abbreviation,
initial or number and the word after it that belong together (collocations); and words found after sure
boundaries more often than elsewhere (starters). The counts are aggregated map-side; the model is the few
words that pass. Texts are then split by built-in expressions alone, with the model's words as sets.

A token is what stands between white space; its type is its letters, digits and inner signs in lower case,
without periods at its end, and ``0`` for all numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import stage

# The limits of the three ratios, and how likely a period after an abbreviation is.
ABBREVIATION_LIMIT = 0.3
COLLOCATION_LIMIT = 7.88
STARTER_LIMIT = 30.0
PERIOD_OF_ABBREVIATION = 0.99
NUMBER_TYPE = "0"

BEFORE = r"^[^\p{L}\p{N}]+"
AFTER = r"[^\p{L}\p{N}.]+$"
NUMBER_SHAPE = r"^[\p{Nd}.,:-]*\p{Nd}[\p{Nd}.,:-]*$"
UPPER_FIRST = r"^[^\p{L}\p{N}]*\p{Lu}"
LOWER_FIRST = r"^[^\p{L}\p{N}]*\p{Ll}"
#: A stretch up to the white space after ``.``, ``!`` or ``?``.
PIECE = rf"(?s).*?(?:[.!?]{tx.SPACE}+|\z)"


@dataclass(frozen=True)
class Model:
    abbreviations: tuple[str, ...] = ()
    collocations: tuple[tuple[str, str], ...] = ()
    starters: tuple[str, ...] = ()


def _core(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, BEFORE, ""), AFTER, "")


def dotted(token: Column) -> Column:
    return F.endswith(_core(token), F.lit("."))


def type_of(token: Column) -> Column:
    word = F.lower(F.regexp_replace(_core(token), r"\.+$", ""))
    return tx.let(word, lambda w: F.when(F.rlike(w, F.lit(NUMBER_SHAPE)), F.lit(NUMBER_TYPE)).otherwise(w))


def type_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """``type``, ``with_period``, ``without``: how often each type stands with and without a period after it."""
    # Distinct tokens are counted first: each is looked at once, however often it occurs.
    tokens = df.select(F.explode(tx.tokens_by_space(F.coalesce(column, F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    typed = tokens.select(type_of(F.col("token")).alias("type"), dotted(F.col("token")).cast("bigint").alias("period"), "n")
    return typed.filter(F.col("type") != "").groupBy("type").agg(
        F.sum(F.col("n") * F.col("period")).alias("with_period"), F.sum(F.col("n") * (1 - F.col("period"))).alias("without")
    )


def abbreviation_score(n: float, periods: float) -> Column:
    """How much better a type's periods are explained by being its own, for short and dotted types more."""
    share = min(max(periods / n, 1e-12), 1 - 1e-12) if n else 0.5
    with_, without = F.col("with_period"), F.col("without")
    ratio = 2 * (
        with_ * (math.log(PERIOD_OF_ABBREVIATION) - math.log(share))
        + without * (math.log(1 - PERIOD_OF_ABBREVIATION) - math.log(1 - share))
    )
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    dots = F.length("type") - letters
    return ratio * F.exp(-letters.cast("double")) * (dots + 1) * F.pow(letters, -without)


def likelihood_ratio(first: Column, second: Column, both: Column, n: Column) -> Column:
    """Twice the log-likelihood gained when ``second`` may be likelier after ``first`` than elsewhere."""

    def logs(k: Column, m: Column, p: Column) -> Column:
        safe = F.greatest(F.lit(1e-300), p)
        rest = F.greatest(F.lit(1e-300), 1 - p)
        return F.when(k > 0, k * F.log(safe)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(rest)).otherwise(0.0)

    whole, after, other = second / n, both / first, (second - both) / (n - first)
    return 2 * (logs(both, first, after) + logs(second - both, n - first, other) - logs(both, first, whole) - logs(second - both, n - first, whole))


def _initial(kind: Column) -> Column:
    return F.rlike(kind, F.lit(r"^\p{L}$"))


def train_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """The model as a table: ``kind``, ``word``, ``next`` and the count that speaks for it.

    Two passes over the texts, the second knowing the abbreviations of the first.
    """
    types = stage(type_counts(df, column), "types")
    n, periods = types.agg(F.sum(F.col("with_period") + F.col("without")), F.sum("with_period")).first()
    score = abbreviation_score(n or 0, periods or 0)
    named = types.filter(F.rlike("type", F.lit(r"\p{L}")) & (score >= ABBREVIATION_LIMIT) & (F.col("with_period") > 0))
    abbreviations = stage(named.select(F.col("type").alias("word"), F.col("with_period").alias("n")), "abbreviations")
    known = [r["word"] for r in abbreviations.select("word").collect()]  # few pass: a type needs more periods the longer it is

    tokens = tx.tokens_by_space(F.coalesce(column, F.lit("")))
    pairs = tx.let(tokens, lambda ts: F.filter(
        F.zip_with(ts, F.slice(ts, 2, F.size(ts)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: F.rlike(p["a"], F.lit("[.!?]$")) & p["b"].isNotNull(),
    ))
    after = df.select(F.explode(pairs).alias("p")).select(
        type_of(F.col("p.a")).alias("word"), type_of(F.col("p.b")).alias("next"), dotted(F.col("p.a")).alias("period")
    ).filter("next <> ''")
    own = F.col("period") & (F.col("word").isin(known) | _initial(F.col("word")) | (F.col("word") == NUMBER_TYPE))
    kind = F.when(own, F.lit("collocation")).otherwise(F.lit("starter"))
    counted = after.groupBy(kind.alias("kind"), F.when(own, F.col("word")).alias("word"), "next").agg(F.count("*").alias("both"))
    counted = stage(counted, "following")
    # Numbers of what stands first: of a pair's word with its period, of all sure boundaries.
    firsts = counted.groupBy("kind", "word").agg(F.sum("both").alias("first"))
    seconds = types.select(F.col("type").alias("next"), (F.col("with_period") + F.col("without")).alias("second"))
    judged = counted.join(firsts.withColumnsRenamed({"kind": "k", "word": "w"}), (F.col("kind") == F.col("k")) & F.col("word").eqNullSafe(F.col("w"))).join(seconds, "next")
    ratio = likelihood_ratio(F.col("first"), F.col("second"), F.col("both"), F.lit(n or 1))
    limit = F.when(F.col("kind") == "starter", STARTER_LIMIT).otherwise(COLLOCATION_LIMIT)
    more = F.col("both") * F.lit(n or 1) > F.col("first") * F.col("second")
    passed = judged.filter((ratio > limit) & more).select("kind", "word", "next", F.col("both").alias("n"))
    return abbreviations.select(F.lit("abbreviation").alias("kind"), "word", F.lit(None).cast("string").alias("next"), "n").union(passed)


def train(df: DataFrame, column: str = "text") -> Model:
    rows = train_counts(df, column).drop("n").collect()

    def of(kind: str) -> list:
        return sorted((r for r in rows if r["kind"] == kind), key=lambda r: (r["word"] or "", r["next"] or ""))

    return Model(
        tuple(r["word"] for r in of("abbreviation")), tuple((r["word"], r["next"]) for r in of("collocation")), tuple(r["next"] for r in of("starter")),
    )


def _among(value: Column, words: tuple[str, ...]) -> Column:
    return value.isin(list(words)) if words else F.lit(False)


def is_boundary(last: Column, following: Column, model: Model) -> Column:
    """Whether a sentence ends between two tokens, the first of which has a final ``.``, ``!`` or ``?``."""

    def judge(types: Column) -> Column:
        word, after = types[0], types[1]
        number, short = word == NUMBER_TYPE, _initial(word) | _among(word, model.abbreviations)
        together = _among(F.concat(word, F.lit(" "), after), tuple(f"{a} {b}" for a, b in model.collocations))
        starts = _among(after, model.starters) & F.rlike(following, F.lit(UPPER_FIRST))
        sure = F.when(short, starts).when(number, ~F.rlike(following, F.lit(LOWER_FIRST))).otherwise(True)
        return sure & ~((number | short) & together)

    types = F.array(type_of(last), type_of(following))
    return F.when(F.endswith(last, F.lit(".")), tx.let(types, judge)).otherwise(True)


def split_trained(model: Model):
    """A splitter for ``sentences_of``: sentences with the white space they have inside; blank text has none."""

    def sentences(text: Column) -> Column:
        def grouped(pieces: Column) -> Column:
            # A piece's ends are cut at blanks before other white space is looked for.
            def last(a: Column) -> Column:
                end = F.substring_index(F.regexp_replace(a, rf"{tx.SPACE}+\z", ""), " ", -1)
                return F.regexp_replace(end, rf"(?s)^.*{tx.SPACE}", "")

            def first(b: Column) -> Column:
                return F.regexp_replace(F.substring_index(b, " ", 1), rf"(?s){tx.SPACE}.*\z", "")

            def judge(a: Column, b: Column) -> Column:
                return tx.let(F.array(last(a), first(b)), lambda ends: is_boundary(ends[0], ends[1], model))

            judged = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.slice(pieces, 2, F.size(pieces)), judge)
            # Begins: the first piece, and each after a boundary; a sentence lasts to the next begin.
            begins = F.concat(F.array(F.lit(1)), F.filter(F.transform(judged, lambda x, i: F.when(x, i + 2)), lambda x: x.isNotNull()))
            ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(pieces) + 1))
            return F.zip_with(begins, ends, lambda b, e: tx.trim_space(F.array_join(F.slice(pieces, b, e - b), "")))

        pieces = F.filter(F.regexp_extract_all(tx.trim_space(F.coalesce(text, F.lit(""))), F.lit(PIECE), F.lit(0)), lambda x: x != "")
        nothing = F.array().cast("array<string>")
        return tx.let(pieces, lambda ps: F.when(F.size(ps) == 0, nothing).otherwise(tx.let(ps, grouped)))

    return sentences
