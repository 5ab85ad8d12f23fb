"""Counterfactual rewriting of QA rows, chosen by question type.

Each rewrite is a function of three columns (context, question, options) returning three
columns, so a user can register more of them. A whole corpus is rewritten in one narrow
projection: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..sources.jsonl import json_kind

# The word lists the rewrites act on.
LOGIC_WORDS = ["all", "any", "every", "if", "then", "because", "therefore", "hence", "thus"]
MATH_WORDS = [
    "add", "sum", "total", "discount", "multiply", "divide", "minus", "plus",
    "more than", "less than", "area", "perimeter", "average",
]
CAUSE_WORDS = ["because", "so", "due to", "as a result"]
TIME_SWAPS = {
    "before": "after", "after": "before",
    "earlier": "later", "later": "earlier",
    "first": "last", "last": "first",
    "start": "end", "end": "start",
    "began": "finished", "finished": "began",
    "am": "pm", "pm": "am",
}
PLACE_SWAPS = {
    "left": "right", "right": "left",
    "above": "below", "below": "above",
    "north": "south", "south": "north",
    "east": "west", "west": "east",
    "behind": "in front of", "in front of": "behind",
    "inside": "outside", "outside": "inside",
    "top": "bottom", "bottom": "top",
}
NUMBER_MARK = "<NUM>"
CAUSE_ENDING = ". Afterwards, a bird flew by."

FIELDS = ("context", "question", "options")
Triple = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Rewrite:
    """A named rewrite and the fields it reads; an explicit null in one of those is an error."""

    name: str
    apply: Callable[[Column, Column, Column], Triple]
    reads: tuple[str, ...] = FIELDS


def scramble_options(options: Column) -> Column:
    """Reverse letters in every option; a null option reads as the text ``None``."""
    def scrambled(o: Column) -> Column:
        # Most options are one word, which is turned without looking for gaps.
        return F.when(F.rlike(o, F.lit(rf"^{tx.WORD}+\z")), F.reverse(o)).otherwise(tx.reverse_letters(F.coalesce(o, F.lit("None"))))

    return F.transform(options, scrambled)


def _deductive(c, q, o):
    return (
        tx.reverse_sentences(tx.drop_words(c, LOGIC_WORDS)),
        tx.let(tx.reverse_words(q), tx.reverse_letters),
        scramble_options(o),
    )


def _cause(c, q, o):
    effect = rf"{tx.any_word(CAUSE_WORDS)}[^\n.!?]*[.!?]"
    kept = F.substring_index(F.regexp_replace(c, effect, ""), ".", 1)
    return F.concat(tx.trim_space(kept), F.lit(CAUSE_ENDING)), tx.reverse_letters(q), scramble_options(o)


def _contextual(c, q, o):
    return tx.blank_alphanumerics(c), tx.blank_alphanumerics(q), o


def _knowledge(c, q, o):
    return tx.mask_entities(c), tx.reverse_letters(q), scramble_options(o)


def _semantic(c, q, o):
    return tx.reverse_words(c), q, scramble_options(o)


def _analogy(c, q, o):
    return c, tx.reverse_letters(q), scramble_options(o)


def _pattern(c, q, o):
    return tx.reverse_sentences(c), q, scramble_options(o)


def _quantitative(c, q, o):
    def strip(x: Column) -> Column:
        return tx.drop_words(F.regexp_replace(x, tx.NUMBER, NUMBER_MARK), MATH_WORDS)

    return strip(c), strip(q), o


def _temporal(c, q, o):
    return tx.reverse_sentences(tx.swap_words(c, TIME_SWAPS)), tx.swap_words(q, TIME_SWAPS), scramble_options(o)


def _spatial(c, q, o):
    return tx.reverse_sentences(tx.swap_words(c, PLACE_SWAPS)), q, scramble_options(o)


def _composition(c, q, o):
    return F.reverse(c), F.reverse(q), o


def _generic(c, q, o):
    return tx.reverse_words(c), tx.reverse_words(q), scramble_options(o)


DEDUCTIVE = Rewrite("deductive", _deductive)
CAUSE = Rewrite("cause", _cause)
CONTEXTUAL = Rewrite("contextual", _contextual, ("context", "question"))
KNOWLEDGE = Rewrite("knowledge", _knowledge)
SEMANTIC = Rewrite("semantic", _semantic, ("context", "options"))
ANALOGY = Rewrite("analogy", _analogy, ("question", "options"))
PATTERN = Rewrite("pattern", _pattern, ("context", "options"))
QUANTITATIVE = Rewrite("quantitative", _quantitative, ("context", "question"))
TEMPORAL = Rewrite("temporal", _temporal)
SPATIAL = Rewrite("spatial", _spatial, ("context", "options"))
COMPOSITION = Rewrite("composition", _composition, ("context", "question"))
GENERIC = Rewrite("generic", _generic)

# Which question type gets which rewrite.
REGISTRY: dict[str, Rewrite] = {
    "single_fact_recall": CONTEXTUAL,
    "multi_hop_recall": CONTEXTUAL,
    "world_fact": KNOWLEDGE,
    "roles_and_relations": SEMANTIC,
    "logic_puzzle": DEDUCTIVE,
    "pattern_completion": PATTERN,
    "analogy": ANALOGY,
    "arithmetic_word_problem": QUANTITATIVE,
    "temporal_order": TEMPORAL,
    "spatial_relation": SPATIAL,
    "everyday_cause_effect": CAUSE,
}


def require_type(df: DataFrame) -> DataFrame:
    """Keep rows that name a question type; of a JSON record, 0, false and empty lists or objects name none."""
    named = F.coalesce(F.col("question_type"), F.lit("")) != ""
    if "record" in df.columns:
        empty = F.exists("record", lambda e: (e["key"] == "question_type") & e["json"].isin("0", "0.0", "-0.0", "-0", "false", "[]", "{}"))
        named = named & ~F.coalesce(empty, F.lit(False))
    return df.filter(named)


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing texts read as empty, a missing option list as no options."""
    return df.withColumns(
        {
            "context": F.coalesce("context", F.lit("")),
            "question": F.coalesce("question", F.lit("")),
            "options": F.coalesce("options", F.array().cast("array<string>")),
        }
    )


def rewrite(df: DataFrame, how: Rewrite) -> DataFrame:
    """One rewrite on every row; all other columns pass through."""
    new = how.apply(*[F.col(f) for f in FIELDS])
    return df.withColumns(dict(zip(FIELDS, new)))


def _by_type(registry: Mapping[str, Rewrite]) -> dict[Rewrite, list[str]]:
    groups: dict[Rewrite, list[str]] = {}
    for question_type, how in registry.items():
        groups.setdefault(how, []).append(question_type)
    return groups


def corrupt(
    df: DataFrame, registry: Mapping[str, Rewrite] = REGISTRY, fallback: Rewrite = GENERIC
) -> DataFrame:
    """Rewrite each row as its question type asks; unlisted types get ``fallback``.

    One CASE per output column, so only the branch a row needs is evaluated.
    """
    fields = [F.col(f) for f in FIELDS]
    choices: list[Column | None] = [None, None, None]
    for how, types in _by_type(registry).items():
        hit = F.col("question_type").isin(types)
        for i, new in enumerate(how.apply(*fields)):
            choices[i] = F.when(hit, new) if choices[i] is None else choices[i].when(hit, new)
    last = fallback.apply(*fields)
    return df.withColumns(
        {f: last[i] if choices[i] is None else choices[i].otherwise(last[i]) for i, f in enumerate(FIELDS)}
    )


def fields_read(registry: Mapping[str, Rewrite] = REGISTRY, fallback: Rewrite = GENERIC) -> Column:
    """The fields that a row's rewrite reads, and writes anew."""
    reads: Column | None = None
    for how, types in _by_type(registry).items():
        hit, names = F.col("question_type").isin(types), F.array(*[F.lit(r) for r in how.reads])
        reads = F.when(hit, names) if reads is None else reads.when(hit, names)
    names = F.array(*[F.lit(r) for r in fallback.reads])
    return names if reads is None else reads.otherwise(names)


def field_error(
    registry: Mapping[str, Rewrite] = REGISTRY, fallback: Rewrite = GENERIC
) -> Column:
    """The name of a field that the row's rewrite can't read: a text that is no JSON string, options that
    can't be gone through; or a question type that is a list or an object. Null means the row is fine.

    Expects the ``record`` column of the JSONL source.
    """
    fit = {"context": ['"'], "question": ['"'], "options": ['"', "[", "{"], "question_type": ['"', "0", "t"]}

    def bad(e: Column) -> Column:
        kind, hit = json_kind(e["json"]), F.lit(False)
        for name, kinds in fit.items():
            hit = hit | ((e["key"] == name) & ~kind.isin(kinds))
        return hit

    wrong = F.transform(F.filter("record", bad), lambda e: e["key"])
    asked = F.concat(fields_read(registry, fallback), F.array(F.lit("question_type")))
    return F.try_element_at(F.array_intersect(wrong, asked), F.lit(1))


def corrupt_corpus(
    df: DataFrame, registry: Mapping[str, Rewrite] = REGISTRY, fallback: Rewrite = GENERIC
) -> DataFrame:
    """The whole step on parsed JSONL rows: drop broken, untyped and unusable rows, then rewrite.

    Rows with a ``record`` get ``written``: the fields that are new, all others stand in the record as before.
    """
    good = df.filter(F.col("_corrupt").isNull()) if "_corrupt" in df.columns else df
    good = require_type(good)
    if "record" in good.columns:
        good = good.filter(field_error(registry, fallback).isNull()).withColumn("written", fields_read(registry, fallback))
    return corrupt(with_defaults(good), registry, fallback)


def unseen_types(df: DataFrame, registry: Mapping[str, Rewrite] = REGISTRY) -> DataFrame:
    """Question types without a rewrite of their own, sorted."""
    return (
        require_type(df)
        .filter(~F.col("question_type").isin(list(registry)))
        .select("question_type")
        .distinct()
        .orderBy("question_type")
    )


def rewrite_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that reach a rewrite, per key."""
    return require_type(df).groupBy(*keys).agg(F.count("*").alias("n_rows"))
