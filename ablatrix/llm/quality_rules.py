"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of common words are held against references,
one per language, that are summed over the corpus. A document that is far from every reference
in Jensen-Shannon distance is rejected, as is one that breaks the base rules (too short, or
mostly repeated passages).

Defined cases: a null text is empty; an empty or blank text has zero counts and fails the base
rule; below the minimum lengths no distance is judged (it is null); documents of a language
without reference (``lang`` neither null nor among the references) are judged by the base rules
alone; equal documents get equal verdicts, one row each; an empty table gives no rows. Columns of
the input with the name of a result column are replaced.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import fresh, whole, words_of

#: Frequent function words of the languages that have references.
COMMON_WORDS = {
    "de": ["der", "die", "und", "das", "ist", "ein", "mit", "zu", "den", "von", "nicht", "für"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "que", "en", "un", "une", "du", "dans"],
}
#: Lower-case letters and blanks, taken out first.
LOWER_OR_BLANK = rf"[{ascii_lowercase} \t\n\x0B\f\r]+"
#: Classes taken in turn out of what is neither lower case nor blank; lower case and blanks stand
#: before them in a histogram, other signs after them.
CLASSES = {"upper": r"[A-Z]+", "letter": r"\p{L}+", "stop": r"[.,;:!?'\"()-]+", "digit": r"[0-9]+"}
N_CLASSES = len(CLASSES) + 3
ALL_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})
#: A printable character for each, so that a text's common words become one short string. As in
#: running text, a common word may begin with a capital or be written in capitals.
SIGNS = {w: chr(0x21 + i) for i, w in enumerate(ALL_COMMON)}
WRITTEN = {f: s for w, s in SIGNS.items() for f in (w, w.capitalize(), w.upper())}

MIN_WORDS = 50
MIN_CHARS = 200
#: Distances (0 to 1) beyond which a document is unlike every reference: by characters, by words,
#: or by both at once.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
MAX_BOTH = (0.16, 0.27)


def common_in(words: Column) -> Column:
    """The common words among ``words``, one sign each, joined to a string."""
    found = F.filter(words, lambda w: w.isin(list(WRITTEN)))
    signs = F.create_map(*[F.lit(x) for pair in WRITTEN.items() for x in pair])
    return F.array_join(F.transform(found, lambda w: signs[w]), "")


def word_counts(common: Column) -> Column:
    """Occurrences of each of ``ALL_COMMON``, from the signs."""
    n = F.length(common)
    return F.array(*[n - F.length(F.replace(common, F.lit(x), F.lit(""))) for x in SIGNS.values()]).cast("array<bigint>")


#: A window's place takes the low bits of its sort key, its hash the others.
PLACE_BITS = 24


def window(words: Column, i: Column) -> Column:
    return F.struct(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def near_equal(keys: Column, k: Column, j: Column) -> Column:
    """Whether the sorted key ``k`` at ``j`` has the hash of the next one."""
    return F.shiftright(k, PLACE_BITS) == F.shiftright(F.get(keys, j + 1), PLACE_BITS)


def place_of(key: Column) -> Column:
    return key.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")


def hash_misleads(words: Column, keys: Column) -> Column:
    """Whether two different windows share a hash, or the text has more places than a key can hold."""
    def differ(k: Column, j: Column) -> Column:
        return near_equal(keys, k, j) & (
            window(words, place_of(k)) != window(words, place_of(F.get(keys, j + 1)))
        )

    wrong = F.filter(F.transform(keys, lambda k, j: F.coalesce(differ(k, j), F.lit(False))), lambda x: x)
    return (F.size(wrong) > 0) | (F.size(words) > 1 << PLACE_BITS)


def places_by_hash(keys: Column) -> Column:
    """Sorted places of the windows whose hash is found twice or more."""
    def place(k: Column, j: Column) -> Column:
        after = F.coalesce(near_equal(keys, k, j), F.lit(False))
        before = (j > 0) & near_equal(keys, F.get(keys, F.greatest(j - 1, F.lit(0))), j - 1)
        return F.when(after | before, place_of(k)).otherwise(-1)

    return F.sort_array(F.filter(F.transform(keys, place), lambda i: i >= 0))


def places_by_words(words: Column) -> Column:
    """The same from the windows themselves, for the rare text in which hashes mislead."""
    windows = F.sort_array(F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.struct(window(words, i).alias("w"), i.alias("i")),
    ))

    def place(x: Column, j: Column) -> Column:
        after = F.coalesce(x["w"] == F.get(windows, j + 1)["w"], F.lit(False))
        before = (j > 0) & (x["w"] == F.get(windows, F.greatest(j - 1, F.lit(0)))["w"])
        return F.when(after | before, x["i"]).otherwise(-1)

    return F.sort_array(F.filter(F.transform(windows, place), lambda i: i >= 0))


def covered(places: Column) -> Column:
    """Length of the union of the windows that begin at the sorted ``places``."""
    steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, s: total + s)


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the contract and the two histograms, ``class_counts`` and ``common_counts``."""
    words, hashes, keys, places, common, *left = fresh(
        docs, "words", "hashes", "keys", "places", "common", *[f"left{i}" for i in range(len(CLASSES) + 1)]
    )
    w, k = F.col(words), F.col(keys)
    df = docs.withColumns({words: words_of(text), left[0]: F.regexp_replace(whole(text), LOWER_OR_BLANK, "")})
    for before, into, pattern in zip(left, left[1:], CLASSES.values()):
        df = df.withColumn(into, F.regexp_replace(before, pattern, ""))
    df = df.withColumns({
        common: common_in(w),
        hashes: F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    })
    # Windows are looked at again only where two of a document's hashes are equal.
    low = (1 << PLACE_BITS) - 1
    df = df.withColumn(keys, F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(~low).bitwiseOR(i.cast("bigint")))),
    ).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(places, F.when(hash_misleads(w, k), places_by_words(w)).otherwise(places_by_hash(k)))
    lines = F.filter(F.split(whole(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": (F.length(left[0]) - F.length(F.regexp_replace(left[0], r"[#*$%&|<>]", ""))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": covered(F.col(places)).cast("bigint"),
        "common_counts": word_counts(F.col(common)),
    })
    rest = [F.length(c).cast("bigint") for c in left]
    df = df.withColumn("class_counts", F.array(
        F.col("word_chars") - rest[0],  # lower case: what is in words and was taken out first
        F.length(whole(text)) - F.col("word_chars"),
        *[a - b for a, b in zip(rest, rest[1:])], rest[-1],
    ))
    return df.drop(words, hashes, keys, places, common, *left)


def language_references(features: DataFrame, lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Shares of character classes and of common words in all texts of each language.

    One small row per language of ``COMMON_WORDS`` comes to the driver, whatever the corpus size.
    """
    sums = [F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get("common_counts", F.lit(i))).alias(f"w{i}") for i in range(len(ALL_COMMON))]
    rows = features.filter(F.col(lang).isin(list(COMMON_WORDS))).groupBy(F.col(lang).alias("of"))
    references = {}
    for r in sorted(rows.agg(F.sum("n_words").alias("n"), *sums).collect(), key=lambda r: r["of"]):
        c = [r[f"c{i}"] for i in range(N_CLASSES)]
        at = {w: r[f"w{i}"] for i, w in enumerate(ALL_COMMON)}
        own = [at[w] for w in COMMON_WORDS[r["of"]]]
        if sum(c) and r["n"]:
            references[r["of"]] = {
                "classes": [x / sum(c) for x in c],
                "words": [x / r["n"] for x in [*own, r["n"] - sum(own)]],
            }
    return references


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance: the root of the divergence in bits, 0 to 1."""
    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*[F.lit(x) for x in reference]), lambda p, q: half(p, q) + half(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def least(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.least(a, b), columns) if columns else F.lit(None).cast("double")


def verdicts(
    features: DataFrame,
    references: dict[str, dict[str, list[float]]],
    lang: str = "lang",
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    max_both: tuple[float, float] = MAX_BOTH,
) -> DataFrame:
    """Add ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    n = F.col("n_words")
    n_chars = F.aggregate("class_counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    index = {x: i for i, x in enumerate(ALL_COMMON)}
    class_distances, word_distances = [], []
    for name, reference in references.items():
        class_distances.append(distance(F.transform("class_counts", lambda x: x / n_chars), reference["classes"]))
        own = [F.get("common_counts", F.lit(index[x])) for x in COMMON_WORDS[name]]
        rest = n - reduce(lambda a, b: a + b, own)
        word_distances.append(distance(F.array(*[c / n for c in [*own, rest]]), reference["words"]))
    df = features.withColumns({
        "class_distance": F.when(n_chars >= min_chars, least(class_distances)),
        "word_distance": F.when(n >= max(min_words, 1), least(word_distances)),
        "base_failed": (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n),
    })
    by_class, by_word = F.col("class_distance"), F.col("word_distance")
    unlike = (by_class > max_class_distance) | (by_word > max_word_distance) | (
        (by_class > max_both[0]) & (by_word > max_both[1])
    )
    judged = F.col(lang).isNull() | F.col(lang).isin(list(references))
    return df.withColumn("kept", ~(F.col("base_failed") | F.coalesce(judged & unlike, F.lit(False))))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """``docs`` with counts, distances and verdicts, held against the corpus's own references.

    Rows are written with their counts before they are judged: one pass over the texts, and short plans.
    """
    features = stage(document_features(docs, text), "features")
    return verdicts(features, language_references(features, lang), lang, **limits)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """The documents the rules keep; columns are those of ``docs``, whatever their names."""
    judged = quality_rules(docs.select(F.struct("*").alias("doc")), f"doc.{text}", f"doc.{lang}", **limits)
    return judged.filter("kept").select("doc.*")
