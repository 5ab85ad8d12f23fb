"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import license_scan, quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    langs = sorted(rules.COMMON_WORDS)
    classes = ["lower", "blank", *rules.CLASSES, "other"]
    pattern = {
        "lower": "[a-z]", "blank": r"[\x20\x09-\x0D]", "upper": "[A-Z]",
        "letter": r"[^\P{L}a-zA-Z]", "stop": r"[.,;:!?''\"()-]", "digit": "[0-9]",
    }
    common = {w: f"c{i}" for i, w in enumerate(rules.ALL_COMMON)}

    def written(w: str) -> str:
        return ", ".join(f"'{x}'" for x in (w, w.capitalize(), w.upper()))

    def half(p: str, q: str) -> str:
        return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END)"

    def distance(pairs: list[tuple[str, str]]) -> str:
        return f"sqrt(greatest(0, ({' + '.join(half(p, q) + ' + ' + half(q, p) for p, q in pairs)}) / 2))"

    ratios, references, by_class, by_word = [], [], [], []
    for lang in langs:
        own = [common[w] for w in rules.COMMON_WORDS[lang]]
        is_lang = f"FILTER (lang = '{lang}')"
        references += [f"sum({c})::DOUBLE {is_lang} / sum(n_chars) {is_lang} AS {lang}_{c}" for c in classes]
        references += [f"sum({c})::DOUBLE {is_lang} / sum(n_words) {is_lang} AS {lang}_{c}" for c in own]
        references.append(f"sum(n_words - ({' + '.join(own)}))::DOUBLE {is_lang} / sum(n_words) {is_lang} AS {lang}_rest")
        references = [r.replace(f"::DOUBLE {is_lang}", f" {is_lang}::DOUBLE") for r in references]
        ratios.append(f"(n_words - ({' + '.join(own)}))::DOUBLE / n_words AS p_{lang}_rest")
        by_class.append(distance([(f"p_{c}", f"{lang}_{c}") for c in classes]))
        by_word.append(distance([(f"p_{c}", f"{lang}_{c}") for c in own] + [(f"p_{lang}_rest", f"{lang}_rest")]))
    ratios += [f"{c}::DOUBLE / n_chars AS p_{c}" for c in classes]
    ratios += [f"{c}::DOUBLE / n_words AS p_{c}" for c in common.values()]
    counted = ", ".join(f"length(text) - length(regexp_replace(text, '{p}', '', 'g')) AS {c}" for c, p in pattern.items())
    commons = ", ".join(f"len(list_filter(words, lambda x: x IN ({written(w)}))) AS {c}" for w, c in common.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
i AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
g AS (SELECT rid, i FROM i QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM g) GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(text) AS n_chars, {counted}, {commons}
      FROM w LEFT JOIN r USING (rid)),
h AS (SELECT *, n_chars - ({' + '.join(pattern)}) AS other FROM f),
ref AS (SELECT {', '.join(references)} FROM h),
p AS (SELECT *, {', '.join(ratios)} FROM h),
j AS (SELECT p.*, CASE WHEN n_chars >= {rules.MIN_CHARS} THEN least({', '.join(by_class)}) END AS by_class,
        CASE WHEN n_words >= {rules.MIN_WORDS} THEN least({', '.join(by_word)}) END AS by_word,
        n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM p, ref)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR coalesce((lang IS NULL OR lang IN ({', '.join(f"'{x}'" for x in langs)})) AND (
        by_class > {rules.MAX_CLASS_DISTANCE} OR by_word > {rules.MAX_WORD_DISTANCE}
        OR (by_class > {rules.MAX_BOTH[0]} AND by_word > {rules.MAX_BOTH[1]})), FALSE)) AS kept
FROM j
"""


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def alphanumeric_words(text: str) -> str:
    return rf"regexp_extract_all({lowered(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination_sql(n: int = 13) -> str:
    words = alphanumeric_words
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS words FROM documents),
b AS (SELECT item_id, {words('text')} AS words FROM benchmark),
items AS (SELECT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS gram
          FROM (SELECT item_id, words, least(len(words), {n}) AS size,
                    unnest(range(1, len(words) - least(len(words), {n}) + 2)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
grams AS (SELECT rid, size, i, array_to_string(words[i:i + size - 1], ' ') AS gram
          FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes)),
hits AS (SELECT DISTINCT rid, grams.size, i, item_id FROM grams JOIN items USING (gram)
         WHERE grams.size = items.size),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items,
            sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hits GROUP BY rid),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN found USING (rid) LEFT JOIN hit USING (rid)
"""


def warc_sql() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digest = " || ".join(
        f"substr('{letters}', ((('0x' || substr(hex, {5 * i + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)"
        for i in range(8) for s in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
             sha1(coalesce(html, '')) AS hex FROM pages),
o AS (SELECT *, row_number() OVER same AS place, first(page_id) OVER same AS response
      FROM p WINDOW same AS (PARTITION BY hex ORDER BY page_id NULLS LAST, rid))
SELECT page_id, payload_bytes, {digest} AS payload_digest,
    CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN place > 1 THEN response END AS refers_to
FROM o
"""


def license_sql() -> str:
    """Edit distances of all word-bounded stretches of texts that hold a piece of the notice."""
    labels = license_scan.NOTICES | license_scan.PHRASES
    values = ", ".join(
        f"('{notice}', '{label}', {license_scan.allowed(notice)}, {len(notice.split())}, "
        f"[{', '.join(repr(p) for _, p in license_scan.pieces(notice, license_scan.allowed(notice)))}])"
        for notice, label in labels.items()
    )
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_scan.PHRASES.items())
    return rf"""
WITH notices(notice, label, edits, size, pieces) AS (VALUES {values}),
phrases(phrase, label, size) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {alphanumeric_words('text')} AS words FROM documents),
f AS (SELECT rid, doc_id, words, array_to_string(words, ' ') AS text, regexp_replace(array_to_string(words, ' '), '[^\x00-\x7F]', '~', 'g') AS folded FROM d),
starts AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM f),
base AS (SELECT rid, count(*) AS n_base, min(i - 1) AS first_word, max(i - 1) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
         FROM starts, phrases WHERE array_to_string(words[i:i + size - 1], ' ') = phrase GROUP BY rid),
c AS (SELECT rid, string_split(folded, ' ') AS words, notice, label, edits, size
      FROM f, notices WHERE len(list_filter(pieces, lambda p: contains(folded, p))) > 0),
w AS (SELECT rid, notice, label, edits, words, n, unnest(range(1, len(words) - n + 2)) AS i
      FROM (SELECT *, unnest(range(greatest(1, size - edits), size + edits + 1)) AS n FROM c)),
t AS (SELECT rid, notice, label, edits, array_to_string(words[i:i + n - 1], ' ') AS stretch FROM w),
near AS (SELECT rid, label, edits, levenshtein(stretch, notice) AS distance FROM t
         WHERE abs(length(stretch) - length(notice)) <= edits),
found AS (SELECT rid, label, max(1.0::DOUBLE - distance::DOUBLE / (edits + 1)) AS score FROM near WHERE distance <= edits GROUP BY rid, label),
named AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM f LEFT JOIN base USING (rid) LEFT JOIN named USING (rid)
"""


def crc32(text: str) -> str:
    """The checksum of ASCII text, two steps of four bits a character."""
    # The polynomial's table for four bits.
    steps = "[" + ", ".join(str(crc32_step(i)) for i in range(16)) + "]"

    def half(c: str) -> str:
        return f"xor({steps}[({c} & 15) + 1], {c} >> 4)"

    start = f"list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({start}, lambda c, x: {half(half('xor(c, x)'))}), 4294967295::BIGINT)"


def crc32_step(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def merkle_sql(levels: int = 8, trunk: int = 4) -> str:
    """Trees of at most 8 ** ``levels`` leaves a group and 8 ** ``trunk`` groups, level by level."""

    def leaf(text: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"

    def tree(name: str, first: str, depth: int) -> list[str]:
        """Per level: nodes (g, pos, h, n), and beside them what stands left and right in their runs."""
        out = [f"{name}0 AS ({first})"]
        for i in range(depth):
            run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
            out.append(
                f"{name}s{i} AS (SELECT g, pos, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i} WHERE n > 1)"
            )
            out.append(
                f"{name}{i + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, "
                f"(max(n) + 7) // 8 AS n FROM {name}{i} GROUP BY g, pos // 8)"
            )
        return out

    def climb(name: str, start: str, place: str, group: str, depth: int) -> list[str]:
        """Fold along the levels: p grows by the siblings, f is the node so far."""
        out, last = [], start
        for i in range(depth):
            out.append(
                f"{name}f{i} AS (SELECT x.* EXCLUDE (p, f), p || coalesce(l || r, '') AS p, CASE WHEN s.pos IS NULL THEN f ELSE sha256(l || f || r) END AS f "
                f"FROM {last} x LEFT JOIN {name}s{i} s ON s.g = x.{group} AND s.pos = x.{place} // {8**i})"
            )
            last = f"{name}f{i}"
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    groups = "SELECT lang AS name, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT lang FROM documents)"
    steps = [
        f"groups AS ({groups})",
        f"""d AS (SELECT doc_id, grp, {leaf('text')} AS leaf,
            CASE WHEN {crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other
          FROM documents JOIN groups ON lang IS NOT DISTINCT FROM name)""",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, 0 AS top, '' AS p, other AS f FROM d)",
        *tree("a", "SELECT grp AS g, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaves", levels),
        *climb("a", "leaves", "pos", "grp", levels),
        *tree("b", f"SELECT 0 AS g, g AS pos, h, count(*) OVER () AS n FROM a{levels}", trunk),
        *climb("b", f"af{levels - 1}", "grp", "top", trunk),
    ]
    return f"""WITH {', '.join(steps)}
SELECT doc_id, leaf, a{levels}.h AS subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified
FROM bf{trunk - 1} x JOIN a{levels} ON a{levels}.g = x.grp, (SELECT h AS root FROM b{trunk})
"""


def hard_negatives_sql() -> str:
    return """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, a.vec_id <> b.vec_id AS other,
        coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS place FROM s WHERE same AND other
      QUALIFY place <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.place ORDER BY n.score DESC, n.id)::INTEGER AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.rid = p.rid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
