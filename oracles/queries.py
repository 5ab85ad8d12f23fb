"""The SQL each catalog query is checked against, on the same parquet tables in DuckDB."""

from __future__ import annotations

from . import parts as p

ORACLES: dict[str, str] = {}

# Question types.
QA = """qa AS (
SELECT item_id,
 CASE doc_id % 12
  WHEN 0 THEN 'single_fact_recall' WHEN 1 THEN 'multi_hop_recall' WHEN 2 THEN 'world_fact'
  WHEN 3 THEN 'roles_and_relations' WHEN 4 THEN 'logic_puzzle' WHEN 5 THEN 'pattern_completion'
  WHEN 6 THEN 'analogy' WHEN 7 THEN 'arithmetic_word_problem' WHEN 8 THEN 'temporal_order'
  WHEN 9 THEN 'spatial_relation' WHEN 10 THEN 'everyday_cause_effect' ELSE 'unmapped_type' END AS question_type,
 CASE WHEN bare THEN ''
  ELSE concat(text, ' It rained because of wind. All boxes left of Bob moved before noon. Add 3.5 plus 2.') END AS context,
 concat(text, ' Was it first or in front of 7 at 2 pm?') AS question,
 string_split(text, ' ') AS options, lang AS answer
FROM (SELECT doc_id AS item_id, FALSE AS bare, doc_id, text, lang FROM documents
 UNION ALL SELECT doc_id + 1000000000, TRUE, doc_id, text, lang FROM documents WHERE doc_id % 7 = 0))"""

C, Q, O = "context", "question", "options"
SO = p.scramble_options(O)
REWRITES = {
    "tr_deductive": (p.rev_sentences(p.drop(C, p.LOGIC)), p.scramble(p.rev_words(Q)), SO),
    "tr_cause": (p.cause(C), p.scramble(Q), SO),
    "tr_contextual": (p.blank(C), p.blank(Q), O),
    "tr_knowledge": (p.mask(C), p.scramble(Q), SO),
    "tr_semantic": (p.rev_words(C), Q, SO),
    "tr_analogy": (C, p.scramble(Q), SO),
    "tr_pattern": (p.rev_sentences(C), Q, SO),
    "tr_quant": (p.quant(C), p.quant(Q), O),
    "tr_temporal": (p.rev_sentences(p.swap(C, p.TIME)), p.swap(Q, p.TIME), SO),
    "tr_spatial": (p.rev_sentences(p.swap(C, p.PLACE)), Q, SO),
    "tr_compo": (f"reverse({C})", f"reverse({Q})", O),
    "generic": (p.rev_words(C), p.rev_words(Q), SO),
}
TYPE_REWRITE = {
    "single_fact_recall": "tr_contextual", "multi_hop_recall": "tr_contextual", "world_fact": "tr_knowledge",
    "roles_and_relations": "tr_semantic", "logic_puzzle": "tr_deductive", "pattern_completion": "tr_pattern",
    "analogy": "tr_analogy", "arithmetic_word_problem": "tr_quant", "temporal_order": "tr_temporal",
    "spatial_relation": "tr_spatial", "everyday_cause_effect": "tr_cause",
}

for _name, _sql in {
    "rev_sentences": p.rev_sentences("text"), "rev_words": p.rev_words("text"),
    "scramble_letters": p.scramble("text"), "mask_content": p.mask("text"),
}.items():
    ORACLES[_name] = f"SELECT doc_id, {_sql} AS text FROM documents"

ORACLES["mutilate_options"] = f"WITH {QA} SELECT item_id, {p.words(SO)} AS options FROM qa"

for _name, (_c, _q, _o) in REWRITES.items():
    ORACLES[_name] = (
        f"WITH {QA} SELECT item_id, question_type, {_c} AS context, {_q} AS question, {p.words(_o)} AS options FROM qa"
    )


def _dispatch(i: int) -> str:
    arms = " ".join(f"WHEN '{t}' THEN {REWRITES[r][i]}" for t, r in TYPE_REWRITE.items())
    return f"CASE question_type {arms} ELSE {REWRITES['generic'][i]} END"


DISPATCH = (
    f"SELECT item_id, question_type, {_dispatch(0)} AS context, {_dispatch(1)} AS question, "
    f"{p.words(_dispatch(2))} AS options"
)
ORACLES["transform_dispatch"] = f"WITH {QA} {DISPATCH} FROM qa"
ORACLES["unseen_types"] = f"WITH {QA} SELECT DISTINCT question_type FROM qa WHERE question_type = 'unmapped_type'"
ORACLES["transform_counts"] = f"WITH {QA} SELECT question_type, count(*) AS n_rows FROM qa GROUP BY 1"

# A whole line per row, and one more of the kind that item_id % 10 names.
KINDS = [
    "broken", "null_context", "no_context", "number_context", "number_answer", "null_answer", "typed_options",
    "text_options", "number_options", "listed_type",
]
TYPED = """item_id || ',2.5,true,1.0,1.0E10,null,"left side"'"""


def _json(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def _line(context: str = C, question: str = Q, options: str = _json(O), added: str = "") -> str:
    """A row's line; ``options`` is JSON already, ``added`` follows at the end."""
    members = [
        f"""CASE kind WHEN 'listed_type' THEN '"question_type":["x"]' ELSE '"question_type":' || {_json('question_type')} END""",
        f"""CASE kind WHEN 'null_context' THEN '"context":null' WHEN 'number_context' THEN '"context":' || item_id
            WHEN 'no_context' THEN NULL ELSE '"context":' || {_json(context)} END""",
        f"""'"question":' || {_json(question)}""", f"""'"options":' || {options}""",
        f"""CASE kind WHEN 'number_answer' THEN '"answer":' || item_id % 1000 || '.0' WHEN 'null_answer' THEN '"answer":null'
            ELSE '"answer":' || {_json('answer')} END""",
        """'"item_id":' || item_id""",
    ] + [added] * bool(added)
    return f"'{{' || concat_ws(',', {', '.join(members)}) || '}}'"


KEPT_OPTIONS = f"""CASE kind WHEN 'typed_options' THEN '[' || {TYPED} || ']' WHEN 'text_options' THEN '"abc"'
 WHEN 'number_options' THEN '7' ELSE {_json(O)} END"""
LINES = f"""{QA}, k AS (SELECT *, 'whole' AS kind FROM qa
 UNION ALL SELECT *, {KINDS!r}[item_id % 10 + 1] FROM qa)"""
ORACLES["jsonl_parse"] = f"""WITH {LINES}
SELECT item_id, kind, CASE kind WHEN 'broken' THEN NULL WHEN 'listed_type' THEN '["x"]' ELSE question_type END AS question_type,
 CASE WHEN kind IN ('broken', 'null_context', 'no_context') THEN NULL WHEN kind = 'number_context' THEN item_id::VARCHAR ELSE context END AS context,
 CASE WHEN kind <> 'broken' THEN question END AS question,
 CASE WHEN kind IN ('broken', 'number_options') THEN NULL WHEN kind = 'text_options' THEN 'a|b|c'
  WHEN kind = 'typed_options' THEN item_id || '|2.5|True|1.0|10000000000.0|left side' ELSE {p.words(O)} END AS options,
 CASE WHEN kind IN ('broken', 'null_answer') THEN NULL WHEN kind = 'number_answer' THEN item_id % 1000 || '.0' ELSE answer END AS answer,
 CASE WHEN kind <> 'broken' THEN '{{"item_id":' || item_id || '}}' END AS extras,
 CASE kind WHEN 'null_context' THEN 'context' WHEN 'null_answer' THEN 'answer' WHEN 'broken' THEN NULL ELSE '' END AS null_fields,
 (kind = 'broken')::INTEGER AS is_corrupt FROM k"""
ORACLES["jsonl_roundtrip"] = f"""WITH {LINES}
SELECT item_id, answer AS ability, 'train' AS split, {_line(options=KEPT_OPTIONS)} AS line FROM k WHERE kind <> 'broken'"""
# Only the analogy rewrite leaves the context alone, and two leave the options; what they don't read may be anything.
READS_OPTIONS = "question_type NOT IN ('single_fact_recall', 'multi_hop_recall', 'arithmetic_word_problem')"
NEW_OPTIONS = f"""CASE WHEN NOT ({READS_OPTIONS}) THEN {KEPT_OPTIONS}
 WHEN kind = 'typed_options' THEN '["' || reverse(item_id::VARCHAR) || '","2.5","eurT","1.0","00000000001.0","enoN","tfel edis"]'
 WHEN kind = 'text_options' THEN '["a","b","c"]' ELSE {_json(_dispatch(2))} END"""
ORACLES["jsonl_corrupt"] = f"""WITH {LINES}, r AS (
 SELECT * REPLACE (CASE WHEN kind IN ('null_context', 'no_context', 'number_context') THEN '' ELSE context END AS context) FROM k
 WHERE kind NOT IN ('broken', 'listed_type') AND (kind NOT IN ('null_context', 'number_context') OR question_type = 'analogy')
  AND (kind <> 'number_options' OR NOT ({READS_OPTIONS})))
SELECT item_id, kind, {_line(_dispatch(0), _dispatch(1), NEW_OPTIONS,
    f"CASE kind WHEN 'no_context' THEN '" + '"context":' + f"' || {_json(_dispatch(0))} END")} AS line FROM r"""
ORACLES["line_counts"] = "SELECT sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents"
ORACLES["raw_lines"] = """SELECT len(line) AS line_length, count(*) AS n_lines
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"""

ORACLES["extract_text_keys"] = f"""WITH {QA}
SELECT item_id, context || ' ' || question || ' ' || array_to_string(options, ' ') || ' ' || answer AS text FROM qa"""
ORACLES["extract_text_list"] = f"WITH {QA} SELECT item_id, array_to_string(options, ' ') AS text FROM qa"
ORACLES["drop_blank"] = f"""SELECT doc_id, text FROM documents
WHERE {p.trim('text')} <> '' AND text <> '\\n'"""
ORACLES["require_type"] = f"""WITH {QA} SELECT item_id, question_type, context, question, {p.words(O)} AS options FROM qa
UNION ALL SELECT item_id, question_type, CASE WHEN item_id % 4 > 0 THEN context ELSE '' END, question,
 CASE WHEN item_id % 9 > 0 THEN {p.words(O)} ELSE '' END FROM qa WHERE item_id % 6 > 1 AND (item_id % 4 = 0 OR item_id % 9 = 0)"""

RENDERED = """'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10)
 || 'You are a helpful assistant.<|eot_id|>'"""
STRIPPED = """'<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)
 || CASE WHEN context = '' THEN '' ELSE 'Context: ' || context || chr(10) END || 'Question: ' || question || '<|eot_id|>'
 || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || 'Answer: ' || answer || '.<|eot_id|>'"""
ORACLES["chat_render"] = f"WITH {QA} SELECT item_id, {RENDERED} || {STRIPPED} AS content FROM qa"
ORACLES["chat_render_multiturn"] = """SELECT conv_id, turn,
 CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '<|begin_of_text|>' ELSE '' END
 || '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>' AS content FROM conversations"""
ORACLES["chat_render_lines"] = f"""WITH {LINES}, c AS (SELECT item_id, kind, {_line(options=KEPT_OPTIONS)} AS line, question,
  CASE kind WHEN 'null_context' THEN 'None' WHEN 'no_context' THEN '' WHEN 'number_context' THEN item_id::VARCHAR ELSE context END AS context,
  CASE kind WHEN 'number_answer' THEN item_id % 1000 || '.0' WHEN 'null_answer' THEN 'None' ELSE answer END AS answer FROM k)
SELECT item_id, kind, CASE kind WHEN 'broken' THEN line || ' {{}}' ELSE {RENDERED} || {STRIPPED} END AS content,
 CASE kind WHEN 'broken' THEN 'not a JSON object' END AS error FROM c"""
ORACLES["strip_system"] = f"""WITH {QA} SELECT item_id, {STRIPPED} AS text FROM qa
UNION ALL SELECT item_id, question FROM qa WHERE item_id % 3 = 0"""
_SPLIT = "['train', 'dev', 'test'][item_id % 3 + 1]"
ORACLES["transform_counts_by_split"] = f"""WITH {LINES} SELECT answer AS ability, {_SPLIT} AS split, count(*) AS n_rows FROM k
 WHERE kind NOT IN ('broken', 'listed_type') AND (kind NOT IN ('null_context', 'number_context') OR question_type = 'analogy')
  AND (kind <> 'number_options' OR NOT ({READS_OPTIONS})) GROUP BY ALL"""
ORACLES["abilities_roundtrip"] = f"""WITH {LINES}
SELECT answer AS ability, {_SPLIT} AS split, {_line(options=KEPT_OPTIONS)} AS line FROM k WHERE kind <> 'broken'"""

# --- tokens and segments -------------------------------------------------------------------

VOCAB = f"""vocab AS (
SELECT token, (row_number() OVER (ORDER BY {p.order_hash(7, 'token')}, token) + 2)::INT AS id
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{p.TOKEN}')) AS token FROM documents))"""


def encode(source: str, key: str, text: str) -> str:
    return f"""sent AS (SELECT k, unnest(ss) AS sentence, unnest(range(len(ss))) AS s FROM
 (SELECT {key} AS k, list_filter({p.sentences(text)}, lambda x: x <> '') AS ss FROM {source}
  WHERE {p.trim(text)} <> '' AND {text} <> '\\n')),
tok AS (SELECT k, s, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM
 (SELECT k, s, regexp_extract_all(sentence, '{p.TOKEN}') AS ts FROM sent)),
sids AS (SELECT k, s, list(id ORDER BY i) AS ids FROM tok JOIN vocab USING (token) GROUP BY ALL),
enc AS (SELECT k AS doc_id, s, CASE WHEN s = max(s) OVER (PARTITION BY k) THEN list_append(ids, 2) ELSE ids END AS ids FROM sids),
flat AS (SELECT doc_id, flatten(list(ids ORDER BY s)) AS ids FROM enc GROUP BY 1)"""


ENC = f"{VOCAB}, {encode('documents', 'doc_id', 'text')}"


def pieces(length: int) -> str:
    """Numbered pieces of at most ``length`` ids per document, in order."""
    return f"""cut AS (SELECT doc_id, s, j, ids[j * {length} + 1 : (j + 1) * {length}] AS piece FROM
 (SELECT *, unnest(range(greatest((len(ids) + {length} - 1) // {length}, 1))) AS j FROM enc)),
num AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, j) - 1 AS n, piece, len(piece) AS size FROM cut)"""


def greedy(length: int) -> str:
    """``seg``: consecutive pieces packed while they fit."""
    return f"""{pieces(length)},
run AS (SELECT doc_id, n, size, size AS filled, 0 AS seg FROM num WHERE n = 0
 UNION ALL
 SELECT b.doc_id, b.n, b.size, CASE WHEN a.filled + b.size > {length} THEN b.size ELSE a.filled + b.size END,
  CASE WHEN a.filled + b.size > {length} THEN a.seg + 1 ELSE a.seg END
 FROM run a JOIN num b ON b.doc_id = a.doc_id AND b.n = a.n + 1),
seg AS (SELECT doc_id, seg, flatten(list(piece ORDER BY n)) AS tokens FROM run JOIN num USING (doc_id, n) GROUP BY ALL)"""


GREEDY = f"WITH RECURSIVE {ENC}, {greedy(512)}"
SHORT = f"WITH RECURSIVE {ENC}, {greedy(64)}, sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_seg FROM seg)"
PACKED = f"""{GREEDY}, pk AS (SELECT doc_id, seg, tokens, len(tokens)::INT AS length,
 row_number() OVER w - 1 AS sample_id,
 coalesce(sum(len(tokens)) OVER (ORDER BY doc_id, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM seg WINDOW w AS (ORDER BY doc_id, seg))"""

REPORTS = r"""reports AS (SELECT doc_id, concat(t, ' Yesterday Dr. ', name, ' met Prof. J. ', name,
 ', i.e. the head. Then 3. place went to approx. ', doc_id % 90, ' of them. However, ', name, ' left at 5. However, it rained!') AS text
FROM (SELECT doc_id, t, coalesce(x[doc_id % 5 + 1], 'Wren') AS name FROM (SELECT doc_id, coalesce(text, '') AS t,
 regexp_extract_all(coalesce(text, ''), '\p{L}{3,}') AS x FROM documents)))"""


def _core(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', '')"


def _type(x: str) -> str:
    word = rf"lower(regexp_replace({_core(x)}, '\.+$', ''))"
    return rf"CASE WHEN regexp_matches({word}, '^[\p{{Nd}}.,:-]*\p{{Nd}}[\p{{Nd}}.,:-]*$') THEN '0' ELSE {word} END"


def _logs(k: str, m: str, q: str) -> str:
    return (
        f"(CASE WHEN {k} > 0 THEN {k} * ln(greatest(1e-300, {q})) ELSE 0 END"
        f" + CASE WHEN {m} > {k} THEN ({m} - {k}) * ln(greatest(1e-300, 1 - {q})) ELSE 0 END)"
    )


_RATIO = " ".join([
    "2 * (", _logs("n", "first", "(n::DOUBLE / first)"), "+", _logs("(second - n)", "(total - first)", "((second - n)::DOUBLE / (total - first))"),
    "-", _logs("n", "first", "(second::DOUBLE / total)"), "-", _logs("(second - n)", "(total - first)", "(second::DOUBLE / total)"), ")",
])
_LETTERS = "length(replace(type, '.', ''))"
BOUNDARY_MODEL = rf"""{REPORTS},
toks AS MATERIALIZED (SELECT doc_id, unnest(ts) AS a, unnest(list_concat(ts[2:], [NULL])) AS b FROM (SELECT doc_id, {p.space_tokens('text')} AS ts FROM reports)),
typed AS MATERIALIZED (SELECT a, b, {_type('a')} AS word, {_type('b')} AS next, ends_with({_core('a')}, '.') AS period FROM toks),
types AS MATERIALIZED (SELECT word AS type, sum(period::INTEGER) AS with_period, sum(1 - period::INTEGER) AS without FROM typed WHERE word <> '' GROUP BY 1),
totals AS (SELECT sum(with_period + without) AS total, sum(with_period) AS periods FROM types),
abbr AS MATERIALIZED (SELECT type AS word, with_period AS n FROM types, totals WHERE regexp_matches(type, '\p{{L}}') AND with_period > 0
 AND 2 * (with_period * (ln(0.99) - ln(periods / total)) + without * (ln(1 - 0.99) - ln(1 - periods / total)))
  * exp(-{_LETTERS}::DOUBLE) * (length(type) - {_LETTERS} + 1) * pow({_LETTERS}, -without) >= 0.3),
pairs AS (SELECT word, next, period AND (word IN (SELECT word FROM abbr) OR regexp_matches(word, '^\p{{L}}$') OR word = '0') AS own
 FROM typed WHERE regexp_matches(a, '[.!?]$') AND b IS NOT NULL AND next <> ''),
counted AS (SELECT CASE WHEN own THEN 'collocation' ELSE 'starter' END AS kind, CASE WHEN own THEN word END AS word, next, count(*) AS n
 FROM pairs GROUP BY 1, 2, 3),
judged AS (SELECT c.*, sum(n) OVER (PARTITION BY kind, word) AS first, with_period + without AS second, total
 FROM counted c JOIN types ON type = next, totals),
model AS MATERIALIZED (SELECT 'abbreviation' AS kind, word, NULL::VARCHAR AS next, n::BIGINT AS n FROM abbr
 UNION ALL SELECT kind, word, next, n::BIGINT FROM judged
 WHERE {_RATIO} > CASE kind WHEN 'starter' THEN 30 ELSE 7.88 END AND n * total > first * second)"""
ORACLES["boundary_model"] = f"WITH {BOUNDARY_MODEL} SELECT * FROM model"
ORACLES["sentence_split_trained"] = rf"""WITH {BOUNDARY_MODEL},
cut AS (SELECT doc_id, list_filter(regexp_extract_all({p.trim('text')}, '(?s).*?(?:[.!?][{p.SPACES}]+|$)'), lambda x: x <> '') AS ps FROM reports),
pieces AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM cut),
ends AS (SELECT *, {p.space_tokens('piece')}[-1] AS a, lead({p.space_tokens('piece')}[1]) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM pieces),
w AS (SELECT *, {_type('a')} AS word, {_type('b')} AS next FROM ends),
k AS (SELECT *, word = '0' AS num, regexp_matches(word, '^\p{{L}}$') OR word IN (SELECT word FROM abbr) AS short,
  (word, next) IN (SELECT word, next FROM model WHERE kind = 'collocation') AS together,
  next IN (SELECT next FROM model WHERE kind = 'starter') AND regexp_matches(b, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') AS starts FROM w),
j AS (SELECT doc_id, i, piece, b IS NOT NULL AND (NOT ends_with(a, '.') OR (NOT ((num OR short) AND together)
  AND CASE WHEN short THEN starts WHEN num THEN NOT regexp_matches(b, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') ELSE TRUE END)) AS stop FROM k),
g AS (SELECT doc_id, i, piece, coalesce(sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM j)
SELECT doc_id, s::INTEGER AS s, {p.trim("string_agg(piece, '' ORDER BY i)")} AS sentence FROM g GROUP BY doc_id, s"""
ORACLES["sentence_split"] = f"""SELECT doc_id, unnest(range(len(ss)))::INT AS s, unnest(ss) AS sentence FROM
 (SELECT doc_id, list_filter({p.sentences('text')}, lambda x: x <> '') AS ss FROM documents
  WHERE {p.trim('text')} <> '' AND text <> '\\n')"""
ORACLES["tokenize_ids"] = f"WITH {ENC} SELECT doc_id, s::INT AS s, {p.numbers('ids')} AS ids FROM enc"
ORACLES["tokenize_ids_by_join"] = f"WITH {ENC} SELECT doc_id, '1 ' || {p.numbers('ids')} AS ids FROM flat"
ORACLES["decode_ids"] = f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{p.TOKEN}'), ' ') AS text
FROM documents WHERE {p.trim('text')} <> '' AND text <> '\\n'"""
ORACLES["chunk_fixed"] = f"WITH {ENC}, {pieces(16)} SELECT doc_id, n::INT AS piece, {p.numbers('piece')} AS ids FROM num"
ORACLES["pack_drop"] = f"WITH {ENC} SELECT doc_id, 0 AS seg, {p.numbers('ids')} AS ids FROM flat WHERE len(ids) <= 512"
ORACLES["pack_greedy"] = f"{GREEDY} SELECT doc_id, seg, {p.numbers('tokens')} AS ids FROM seg"
ORACLES["corpus_chain"] = f"""WITH {QA}, chat AS (SELECT item_id, {STRIPPED} AS text FROM qa), {VOCAB},
{encode('chat', 'item_id', 'text').replace('JOIN vocab USING (token)', 'LEFT JOIN vocab USING (token)').replace('list(id ORDER BY i)', 'list(coalesce(id, 0) ORDER BY i)')}
SELECT doc_id AS item_id, {p.numbers('ids')} AS ids FROM flat WHERE len(ids) <= 512"""
ORACLES["segment_sample"] = f"""{SHORT}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
 CASE WHEN seg = 0 THEN 0 WHEN seg = n_seg - 1 THEN 1 ELSE 2 END, {p.order_hash(2023, 'doc_id', 'seg')}, seg) - 1 AS draw FROM sized)
SELECT doc_id, draw::INT AS draw, seg, len(tokens)::INT AS length FROM r WHERE draw < 4"""
ORACLES["segment_sample_two"] = f"""{SHORT}, d AS (SELECT DISTINCT doc_id, n_seg, unnest([1, 2]) AS j FROM sized)
SELECT d.doc_id, (j - 1)::INT AS draw, seg, len(tokens)::INT AS length
FROM d JOIN sized z ON z.doc_id = d.doc_id AND z.seg = {p.order_hash(2023, 'd.doc_id', 'j')} % d.n_seg"""

# --- packed tables -------------------------------------------------------------------------

ORACLES["offsets"] = f"{PACKED} SELECT doc_id, seg::INT AS draw, sample_id, start, length FROM pk"
ORACLES["boundary_stats"] = f"""{PACKED} SELECT count_if(tokens[1] = 1 AND tokens[-1] <> 2)::BIGINT AS bos_only,
 count_if(tokens[1] <> 1 AND tokens[-1] = 2)::BIGINT AS eos_only,
 count_if(tokens[1] <> 1 AND tokens[-1] <> 2)::BIGINT AS neither,
 count_if(tokens[1] = 1 AND tokens[-1] = 2)::BIGINT AS "both" FROM pk"""
ORACLES["integrity"] = f"""{PACKED}, sh AS (SELECT sample_id, length, start + (sample_id % 97 = 5)::INT AS start FROM pk),
nx AS (SELECT *, lead(start) OVER (ORDER BY sample_id) AS nxt FROM sh)
SELECT sample_id, 'gap' AS problem, 'shifted' AS "table" FROM nx WHERE nxt <> start + length
UNION ALL SELECT NULL, 'totals', 'shifted'"""
ORACLES["packed_roundtrip"] = f"{PACKED} SELECT sample_id, 0 AS type, start, length, {p.numbers('tokens')} AS ids FROM pk"
ORACLES["sample_access"] = f"""{PACKED}, n AS (SELECT max(sample_id) AS last FROM pk)
SELECT sample_id, start, length, {p.numbers('tokens[1:64]')} AS ids FROM pk, n
WHERE sample_id % greatest(1, last // 9) = 0 OR sample_id = last"""
ORACLES["packed_damage"] = f"""{PACKED}, d AS (SELECT sample_id, start + (sample_id % 97 = 5)::INT AS start, length FROM pk WHERE sample_id % 103 <> 50),
nx AS (SELECT *, lead(start) OVER (ORDER BY sample_id) AS nxt, lead(sample_id) OVER (ORDER BY sample_id) AS nid FROM d)
SELECT sample_id, 'gap' AS problem, 'damaged' AS "table" FROM nx WHERE nxt <> start + length OR nid <> sample_id + 1
UNION ALL SELECT sample_id, 'length', 'damaged' FROM d WHERE sample_id % 101 = 7 AND length <> 1
UNION ALL SELECT NULL, unnest(['totals', 'manifest', 'index']), 'damaged'"""
ORACLES["packed_manifest"] = f"{PACKED} SELECT 0 AS type, count(*) AS n_samples FROM pk"
ORACLES["truncate"] = f"{PACKED} SELECT sample_id, {p.numbers('tokens[1:128]')} AS ids FROM pk"
ORACLES["head20"] = f"""{PACKED}, t AS (SELECT sample_id, unnest(tokens) AS id, unnest(range(len(tokens))) AS i FROM pk WHERE sample_id < 20)
SELECT sample_id, string_agg(token, ' ' ORDER BY i) AS text FROM t JOIN vocab USING (id) GROUP BY 1"""

BY_SOURCE = f"""{GREEDY}, sp AS (SELECT source, substring(source, 4)::INT AS ordinal, doc_id, seg, len(tokens)::INT AS length
 FROM seg JOIN documents USING (doc_id)),
sk AS (SELECT *, (ordinal * 7) % 3 AS kind FROM sp)"""
ORACLES["offsets_by_source"] = f"""{BY_SOURCE} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, seg) - 1 AS sample_id,
 coalesce(sum(length) OVER (PARTITION BY source ORDER BY doc_id, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
 length FROM sk"""


def merged(order: str, extra: str = "") -> str:
    return f"""{BY_SOURCE}, fk AS (SELECT *, min(ordinal) OVER (PARTITION BY kind) AS first_seen FROM sk)
SELECT row_number() OVER (ORDER BY {order}) - 1 AS sample_id, {extra} source,
 coalesce(sum(length) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length FROM fk"""


ORACLES["merge_same_type"] = merged("ordinal, doc_id, seg")
ORACLES["merge_by_type"] = merged("first_seen, ordinal, doc_id, seg", "kind,")
ORACLES["merge_manifest"] = f"{BY_SOURCE} SELECT kind AS type, count(*) AS n_samples FROM sk GROUP BY 1"
ORACLES["incremental_rows"] = "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["split_stable"] = f"""SELECT doc_id, CASE WHEN {p.order_hash(42, 'doc_id')} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM documents"""
ORACLES["split_80_20"] = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {p.order_hash(42, 'doc_id')} DESC)
 <= ceil(0.2 * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split FROM documents"""

_CONTENT = """'{' || concat_ws(',', '"role":"' || role || '"', '"n":' || n) || '}'"""
ORACLES["split_without_key"] = f"""WITH t AS (SELECT role, length(text) % 5 AS n FROM conversations),
r AS (SELECT role, n, row_number() OVER (ORDER BY {p.order_hash(42, _CONTENT)} DESC) <= ceil(0.2 * (SELECT count(*) FROM t)) AS test FROM t)
SELECT role, n::INT AS n, CASE WHEN test THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows FROM r GROUP BY ALL"""

# --- batches -------------------------------------------------------------------------------

ORACLES["training_rows"] = f"{PACKED} SELECT sample_id, {p.numbers('tokens[1:1024]')} AS input_ids, {p.numbers('tokens[1:1024]')} AS labels FROM pk"
ORACLES["pad_batch"] = f"""{PACKED} SELECT sample_id, {p.numbers('list_resize(tokens, 1024, 2)')} AS input_ids,
 {p.numbers('list_resize(tokens, 1024, -100)')} AS labels FROM pk"""
ORACLES["attention_mask"] = f"""{PACKED}, pd AS (SELECT sample_id, list_resize(tokens, 1024, 2) AS ids FROM pk),
fp AS (SELECT *, list_position(ids, 2) AS first_pad FROM pd)
SELECT sample_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN x <> 2 OR i = first_pad THEN 1 ELSE 0 END), '') AS mask FROM fp"""
ORACLES["cap_samples"] = f"{PACKED} SELECT count(*) AS n_samples, sum(length)::BIGINT AS n_tokens FROM pk WHERE sample_id < 100"
DEALT = f"""{PACKED}, nn AS (SELECT count(*) AS n FROM pk),
pn AS (SELECT sample_id, n FROM pk, nn), {p.permuted('pn', 'sample_id', 'n', 0, 'rp')},
rk AS (SELECT sample_id, rank AS r FROM rp),
dl AS (SELECT sample_id, r FROM rk UNION ALL SELECT sample_id, r + n FROM rk, nn WHERE r < (3 - n % 3) % 3),
wk AS (SELECT sample_id, (r % 3)::INT AS worker, r // 3 AS turn FROM dl)"""
ORACLES["worker_assign"] = f"{DEALT} SELECT sample_id, worker, turn FROM wk"
ORACLES["batch_groups"] = f"""{DEALT} SELECT worker, turn // 4 AS batch_id, string_agg(sample_id::VARCHAR, ' ' ORDER BY turn) AS sample_ids
FROM wk GROUP BY ALL"""
ORACLES["checkpoint_label"] = f"""{PACKED}, nn AS (SELECT count(*) AS n FROM pk),
iv AS (SELECT n, CASE WHEN n >= 100000 THEN 100000 WHEN n >= 10000 THEN 10000 WHEN n >= 1000 THEN 1000 ELSE 100 END AS step_size FROM nn),
sv AS (SELECT unnest(range(step_size, n + 1, step_size)) AS samples FROM iv),
st AS (SELECT ceil(samples / 32)::BIGINT AS save_step, max(samples) AS samples FROM sv GROUP BY 1),
ps AS (SELECT sample_id, sample_id // 32 + 1 AS step FROM pk)
SELECT sample_id, step, (SELECT min_by(samples, save_step) FROM st WHERE save_step >= step) AS ckpt_samples FROM ps"""

# --- tensors -------------------------------------------------------------------------------

TENSORS = """tr AS (SELECT vec_id,
 CASE WHEN vec_id % 17 = 0 THEN 'model.embed_tokens.weight'
  WHEN vec_id % 3 = 0 THEN concat('model.layers.', label, '.mlp.gate_proj.weight')
  WHEN vec_id % 3 = 1 THEN concat('model.layers.', label, '.self_attn.q_proj.weight')
  ELSE concat('model.layers.', label, '.mlp.down_proj.weight') END AS tensor, embedding AS vals FROM embeddings),
bl AS (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY vec_id) - 1 AS block FROM tr),
meta AS (SELECT tensor, count(*) * 64 AS numel,
 nullif(regexp_extract(tensor, 'model\\.layers\\.(\\d+)\\.', 1), '')::INT AS layer FROM bl GROUP BY 1)"""
GRADS = """gr AS (SELECT a.tensor, a.block, a.vec_id, a.vals, b.embedding AS grad FROM bl a
 JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))"""
PRODUCT = f"""{TENSORS}, {GRADS},
pr AS (SELECT tensor, block, unnest(range(64)) AS i, unnest(grad) * unnest(vals) AS val FROM gr)"""
ROUNDED = f"""{PRODUCT},
sc AS (SELECT tensor, block, i, val::DOUBLE AS x, CASE WHEN val = 0 THEN 1.0
 ELSE pow(2.0, greatest(floor(log2(abs(val::DOUBLE))), -126) - 7) END AS q FROM pr),
rd AS (SELECT tensor, block, i, (round_even(x / q, 0) * q)::FLOAT AS val FROM sc)"""

ORACLES["grad_times_weight"] = f"WITH {PRODUCT} SELECT tensor, block, i::INT AS i, val::DOUBLE AS val FROM pr"
ORACLES["bf16_round"] = f"WITH {ROUNDED} SELECT tensor, block, i::INT AS i, val::DOUBLE AS val FROM rd"
MICRO = f"""WITH {TENSORS}, {GRADS}, mg AS (SELECT tensor, block % 4 AS block, block // 4 AS batch,
 unnest(range(64)) AS i, unnest(grad)::DOUBLE AS g FROM gr)"""
ORACLES["grad_sum"] = f"{MICRO} SELECT tensor, block, i::INT AS i, sum(g)::FLOAT::DOUBLE AS val FROM mg GROUP BY ALL"
ORACLES["grad_mean"] = f"{MICRO} SELECT tensor, block, i::INT AS i, avg(g)::FLOAT::DOUBLE AS val FROM mg GROUP BY ALL"
ORACLES["grad_last"] = f"{MICRO} SELECT tensor, block, i::INT AS i, arg_max(g, batch) AS val FROM mg GROUP BY ALL"

ORACLES["layer_parse"] = f"""WITH {TENSORS} SELECT vec_id, tensor, layer, replace(tensor, '.', '_') AS file_name, tensor AS bare_name
FROM tr JOIN meta USING (tensor)"""
ORACLES["mlp_filter"] = f"""WITH {TENSORS}, nl AS (SELECT max(layer) + 1 AS n_layers FROM meta)
SELECT 'checkpoint_full' AS ckpt, tensor, n_layers,
 coalesce(contains(lower(tensor), 'mlp') AND layer >= 1 AND layer < n_layers - 2, false) AS eligible FROM meta, nl"""

REGION = """el AS (SELECT *, coalesce(contains(tensor, 'mlp') AND layer IS NOT NULL, false) AS eligible FROM meta),
off AS (SELECT tensor, numel, layer, coalesce(sum(numel) OVER (ORDER BY layer, tensor
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM el WHERE eligible),
tot AS (SELECT sum(numel)::BIGINT AS total, sum(numel) FILTER (eligible)::BIGINT AS mlp_total FROM el),
ks AS (SELECT unnest([0.00001, 0.00004, 0.00016, 0.00064, 0.00256, 0.01024])::DOUBLE AS k),
bg AS (SELECT total, mlp_total, k, floor(k * total)::BIGINT AS budget FROM tot, ks),
fr AS (SELECT *, budget::DOUBLE / mlp_total AS fraction FROM bg WHERE mlp_total >= budget AND mlp_total > 0),
pl AS (SELECT *, greatest(1000, trunc(sqrt(mlp_total / (fraction + 1e-9)))::BIGINT) AS chunk_size FROM fr)"""
RAW = "src AS (SELECT tensor, block, unnest(range(64)) AS i, unnest(vals) AS val FROM bl)"
ELEMENTS = """e AS (SELECT tensor, block, i, block * 64 + i AS pos, "offset" + block * 64 + i AS gpos, val, abs(val) AS a
 FROM src JOIN off USING (tensor))"""
FROM_VALUES = f"WITH {TENSORS}, {REGION}, {RAW}, {ELEMENTS}"
FROM_ROUNDED = f"WITH {ROUNDED}, {REGION}, src AS (SELECT * FROM rd), {ELEMENTS}"
RANKED = """rg AS (SELECT *, row_number() OVER (ORDER BY a DESC, gpos) AS t, row_number() OVER (ORDER BY a, gpos DESC) AS b FROM e)"""
GLOBAL = f"""{RANKED}, pick AS (
 SELECT k, 'top' AS side, tensor, pos, gpos, val, a, 0 AS chunk FROM rg, pl WHERE t <= budget
 UNION ALL SELECT k, 'bottom', tensor, pos, gpos, val, a, 0 FROM rg, pl WHERE b <= budget)"""
CHUNKED = """ce AS (SELECT e.*, k, fraction, gpos // chunk_size AS chunk FROM e, pl),
cr AS (SELECT *, row_number() OVER (PARTITION BY k, chunk ORDER BY a DESC, gpos) AS t,
 row_number() OVER (PARTITION BY k, chunk ORDER BY a, gpos DESC) AS b, count(*) OVER (PARTITION BY k, chunk) AS n FROM ce),
pick AS (SELECT k, 'top' AS side, tensor, pos, gpos, val, a, chunk FROM cr WHERE t <= greatest(1, ceil(fraction * n))
 UNION ALL SELECT k, 'bottom', tensor, pos, gpos, val, a, chunk FROM cr WHERE b <= greatest(1, ceil(fraction * n)))"""
PICKED = "SELECT 'checkpoint_full' AS ckpt, k, side, tensor, pos, val::DOUBLE AS val FROM pick"

ORACLES["budget"] = f"""WITH {TENSORS}, {REGION} SELECT 'checkpoint_full' AS ckpt, total, mlp_total, k, budget, fraction, chunk_size,
 regexp_replace(printf('%.10f', k), '\\.?0+$', '') AS k_label FROM pl"""
CHECKPOINTS = f"""{TENSORS}, cm AS (SELECT ckpt, tensor, numel, layer FROM meta,
 (SELECT unnest(['checkpoint_full', 'checkpoint_low', 'checkpoint_attention', 'checkpoint_small']) AS ckpt)
 WHERE CASE ckpt WHEN 'checkpoint_low' THEN layer IS NULL OR layer < 5 WHEN 'checkpoint_attention' THEN NOT contains(tensor, 'mlp')
  WHEN 'checkpoint_small' THEN NOT contains(tensor, 'mlp') OR tensor = 'model.layers.0.mlp.down_proj.weight' ELSE TRUE END),
cl AS (SELECT *, max(layer) OVER (PARTITION BY ckpt) + 1 AS n_layers FROM cm)"""
ORACLES["checkpoint_layout"] = f"""WITH {CHECKPOINTS},
ce AS (SELECT *, coalesce(contains(tensor, 'mlp') AND layer >= 1 AND layer < n_layers - 1, false) AS eligible FROM cl)
SELECT ckpt, tensor, numel, n_layers, eligible, CASE WHEN eligible THEN
 coalesce(sum(numel) FILTER (eligible) OVER (PARTITION BY ckpt ORDER BY layer, tensor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS "offset" FROM ce"""
ORACLES["checkpoint_budget"] = f"""WITH {CHECKPOINTS},
ct AS (SELECT ckpt, sum(numel)::BIGINT AS total, coalesce(sum(numel) FILTER (contains(tensor, 'mlp')), 0)::BIGINT AS mlp_total FROM cl GROUP BY 1),
cb AS (SELECT *, floor(k * total)::BIGINT AS budget FROM ct, (SELECT unnest([0.01024, 0.3])::DOUBLE AS k))
SELECT *, budget::DOUBLE / mlp_total AS fraction FROM cb WHERE mlp_total > 0 AND mlp_total >= budget"""
ORACLES["tensor_offsets"] = f"""WITH {TENSORS}, {REGION} SELECT 'checkpoint_full' AS ckpt, tensor, numel, "offset" FROM off"""
ORACLES["topk_global"] = f"{FROM_VALUES}, {GLOBAL} {PICKED} WHERE side = 'top'"
ORACLES["bottomk_global"] = f"{FROM_VALUES}, {GLOBAL} {PICKED} WHERE side = 'bottom'"
ORACLES["topk_chunked"] = f"{FROM_VALUES}, {CHUNKED} {PICKED} WHERE side = 'top'"
ORACLES["bottomk_chunked"] = f"{FROM_VALUES}, {CHUNKED} {PICKED} WHERE side = 'bottom'"
ORACLES["topk_k_sweep"] = f"{FROM_ROUNDED}, {GLOBAL} {PICKED}"
ORACLES["topk_chunk_sweep"] = f"{FROM_ROUNDED}, {CHUNKED} {PICKED}"
ORACLES["random_pick"] = f"""{FROM_VALUES}, en AS (SELECT *, (SELECT max(mlp_total) FROM pl) AS mt FROM e), {p.permuted('en', 'gpos', 'mt', 11, 'rr')}
SELECT 'checkpoint_full' AS ckpt, k, 'random' AS side, tensor, pos FROM rr, pl WHERE rank < budget"""
ORACLES["nan_report"] = f"""WITH {TENSORS}, x AS (SELECT tensor, vec_id, unnest(range(64)) AS i FROM bl)
SELECT 'checkpoint_full' AS ckpt, tensor, count(*) AS n_nan FROM x WHERE (vec_id + i) % 50 = 0 GROUP BY tensor"""
ORACLES["index_to_tensor"] = f"""WITH {TENSORS}, {REGION}
SELECT 'checkpoint_full' AS ckpt, vec_id, vec_id * 61 AS gpos, off.tensor, vec_id * 61 - "offset" AS pos
FROM tr JOIN off ON vec_id * 61 >= "offset" AND vec_id * 61 < "offset" + numel"""
ORACLES["dense_mask"] = f"""{FROM_VALUES}, {GLOBAL}, vr AS (SELECT DISTINCT k, side FROM pick),
g AS (SELECT k, side, tensor, block, unnest(range(64)) AS i FROM bl JOIN meta USING (tensor), vr WHERE layer IS NOT NULL)
SELECT 'checkpoint_full' AS ckpt, g.k, g.side, g.tensor, g.block,
 string_agg(CASE WHEN pick.pos IS NULL THEN '0' ELSE '1' END, '' ORDER BY g.i) AS mask
FROM g LEFT JOIN pick ON pick.k = g.k AND pick.side = g.side AND pick.tensor = g.tensor AND pick.pos = g.block * 64 + g.i
GROUP BY ALL"""
STATS = f"""{FROM_VALUES}, {GLOBAL}, cn AS (SELECT k, tensor, count_if(side = 'top') AS t, count_if(side = 'bottom') AS b FROM pick GROUP BY ALL),
stats AS (SELECT k, tensor, numel, coalesce(t, 0)::BIGINT AS top_n, coalesce(b, 0)::BIGINT AS bottom_n
 FROM (SELECT k, m.* FROM meta m, pl WHERE layer IS NOT NULL) LEFT JOIN cn USING (k, tensor)),
pc AS (SELECT *, printf('%.2f', top_n::DOUBLE / numel * 100)::DOUBLE AS top_pct, printf('%.2f', bottom_n::DOUBLE / numel * 100)::DOUBLE AS bottom_pct FROM stats)"""
ORACLES["layer_stats"] = f"{STATS} SELECT 'checkpoint_full' AS ckpt, k, tensor, numel, top_n, top_pct, bottom_n, bottom_pct FROM pc"
ORACLES["stats_roundtrip"] = f"""{STATS} SELECT 'checkpoint_full' AS ckpt, k, 'Layer: ' || tensor || '.pt' AS "Layer",
 'Total Parameters: ' || numel AS total_parameters, printf('Top: %d (%.2f%%)', top_n, top_pct) AS "Top",
 printf('Bottom: %d (%.2f%%)', bottom_n, bottom_pct) AS "Bottom" FROM pc"""
INDICES = """SELECT 'checkpoint_full' AS ckpt, off.tensor AS layer_name, pl.k AS k_value, coalesce(pos // {size}, 0)::BIGINT AS part,
 coalesce(string_agg(pos::VARCHAR, ' ' ORDER BY pos), '') AS indices FROM off CROSS JOIN pl
 LEFT JOIN pick ON pick.tensor = off.tensor AND pick.k = pl.k AND side = 'top' GROUP BY ALL"""
ORACLES["selected_indices"] = f"{FROM_VALUES}, {GLOBAL} {INDICES.format(size=64)}"
ORACLES["selected_roundtrip"] = f"{FROM_VALUES}, {CHUNKED} {INDICES.format(size=16384)}"
ORACLES["selected_preview"] = f"""{FROM_VALUES}, {CHUNKED},
pv AS (SELECT k, tensor, count(*) AS index_count, (list(pos ORDER BY chunk, a DESC, gpos))[1:10] AS head
 FROM pick WHERE side = 'top' GROUP BY ALL)
SELECT 'checkpoint_full' AS ckpt, pl.k, off.tensor, coalesce(index_count, 0)::BIGINT AS index_count,
 coalesce('[' || array_to_string(head, ', ') || ']' || CASE WHEN index_count > 10 THEN '...' ELSE '' END, '[]') AS preview
 FROM off CROSS JOIN pl LEFT JOIN pv ON pv.tensor = off.tensor AND pv.k = pl.k"""
ORACLES["tensor_roundtrip"] = f"WITH {TENSORS}, {RAW} SELECT 'checkpoint_full' AS ckpt, tensor, block, i::INT AS i, val::DOUBLE AS val FROM src"
ORACLES["mask_roundtrip"] = f"{FROM_VALUES}, {GLOBAL} SELECT 'checkpoint_full' AS ckpt, k, side, tensor, pos FROM pick"

ONE = f"{FROM_VALUES}, {GLOBAL}, one AS (SELECT tensor, pos FROM pick WHERE k = 0.01024 AND side = 'top')"
ORACLES["apply_mask"] = f"""{ONE} SELECT s.tensor, s.block, s.i::INT AS i, CASE WHEN one.pos IS NULL THEN val::DOUBLE ELSE 0.0 END AS val
FROM src s LEFT JOIN one ON one.tensor = s.tensor AND one.pos = s.block * 64 + s.i"""
ORACLES["apply_mask_reshaped"] = f"""{ONE}, ly AS (SELECT s.tensor, s.block, s.i, s.val, layer, numel // 64 AS n_rows FROM src s JOIN meta USING (tensor)),
w AS (SELECT tensor, block, i, val FROM ly WHERE layer IS DISTINCT FROM 1 OR block < greatest(n_rows - 3, 1)
 UNION ALL SELECT tensor, n_rows + block, i, val FROM ly WHERE layer = 0 AND block < 3)
SELECT w.tensor, w.block, w.i::INT AS i, CASE WHEN one.pos IS NULL THEN val::DOUBLE ELSE 0.0 END AS val
FROM w LEFT JOIN one ON one.tensor = w.tensor AND one.pos = w.block * 64 + w.i"""
ORACLES["missing_masks"] = f"""{ONE} SELECT tensor, replace(tensor, '.', '_') AS name FROM meta WHERE layer IS NULL"""
SHAPES = """sh AS (SELECT tensor, [numel // 64, 64] AS mask_shape, CASE layer WHEN 0 THEN [numel // 64 + 3, 64]
 WHEN 1 THEN [greatest(numel // 64 - 3, 1), 64] WHEN 2 THEN [numel] WHEN 3 THEN [numel // 64, 128]
 ELSE [numel // 64, 64] END AS shape, CASE layer WHEN 0 THEN 'pad' WHEN 1 THEN (CASE WHEN numel = 64 THEN 'equal' ELSE 'cut' END)
 WHEN 2 THEN 'rank' WHEN 3 THEN 'inner' ELSE 'equal' END AS status FROM meta)"""
ORACLES["mask_shape_report"] = f"""WITH {TENSORS}, {SHAPES} SELECT tensor, {p.numbers('shape')} AS shape,
 {p.numbers('mask_shape')} AS mask_shape, status FROM sh"""
ORACLES["mask_shape_repair"] = f"""{ONE}, {SHAPES} SELECT tensor, pos FROM one JOIN sh USING (tensor)
WHERE status NOT IN ('rank', 'inner') AND pos < shape[1] * 64"""
ORACLES["damage_variants"] = f"""{FROM_VALUES}, {GLOBAL}, vr AS (SELECT DISTINCT k, side FROM pick),
dm AS (SELECT vr.k, vr.side, s.tensor, s.block, CASE WHEN pick.pos IS NULL THEN s.val::DOUBLE ELSE 0.0 END AS w
 FROM src s CROSS JOIN vr LEFT JOIN pick ON pick.k = vr.k AND pick.side = vr.side AND pick.tensor = s.tensor AND pick.pos = s.block * 64 + s.i)
SELECT 'checkpoint_full' AS ckpt, k, side, tensor, block, count_if(w = 0)::INT AS n_zero, round(sum(abs(w)), 6) AS "left" FROM dm GROUP BY ALL"""

# --- results -------------------------------------------------------------------------------

RESULTS = """cells(ckpt, side, k) AS (VALUES ('original', 'original', 0.0::DOUBLE), ('checkpoint_full', 'top', 0.00256::DOUBLE),
 ('checkpoint_full', 'bottom', 0.00256::DOUBLE), ('checkpoint_full', 'top', 0.01024::DOUBLE), ('checkpoint_full', 'bottom', 0.01024::DOUBLE)),
res AS (SELECT 'd' || ((doc_id // 10) % 2) AS dataset, ckpt, side, k, 'b' || (doc_id % 10) AS benchmark, doc_id AS item_id,
 CASE WHEN side = 'original' THEN quality ELSE quality * (1 - toxic) END AS correct
 FROM labels, cells WHERE NOT (doc_id % 10 = 3 AND side = 'bottom')),
scores AS (SELECT dataset, ckpt, side, k, benchmark, avg(correct) AS score, count(*) AS n_items FROM res GROUP BY ALL)"""
ORACLES["cell_scores"] = f"WITH {RESULTS} SELECT * FROM scores"
ORACLES["result_coverage"] = f"""WITH {RESULTS}, ds AS (SELECT DISTINCT dataset FROM res),
want AS (SELECT dataset, ckpt, side, k, 'b' || b AS benchmark FROM ds, cells, range(10) r(b))
SELECT want.* FROM want ANTI JOIN res USING (dataset, ckpt, side, k, benchmark)"""
_columns = ", ".join(f"max(change) FILTER (benchmark = 'b{i}') AS b{i}" for i in range(10))
ORACLES["change_matrix"] = f"""WITH {RESULTS}, ch AS (SELECT d.dataset, d.ckpt, d.side, d.k, d.benchmark, d.score - o.score AS change
 FROM scores d JOIN scores o ON o.dataset = d.dataset AND o.benchmark = d.benchmark AND o.side = 'original' WHERE d.side <> 'original')
SELECT dataset, ckpt, side, k, {_columns} FROM ch GROUP BY ALL"""
ORACLES["usable_checkpoints"] = f"""WITH {RESULTS} SELECT dataset, ckpt, count(*) AS n_rows FROM res WHERE item_id % 4 <> 0 GROUP BY ALL"""
