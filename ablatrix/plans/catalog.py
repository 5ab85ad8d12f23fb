"""Named queries over the sample tables, one or more per operator.

Results are shown in flat columns: arrays as text or one row per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as ar, chat, naming, numeric, text as tx
from ..operators import (
    attribution, batches, boundaries, corpus, corruption, damage, done, extraction, packing, region, results, splitting, tokens,
)
from ..session import scratch_path, stage
from ..sources import jsonl, packed, tensors
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

BOUNDARY = {"bos": corpus.BOS_ID, "eos": corpus.EOS_ID}
CHUNK_FLOOR = 1_000
WORKERS, BATCH = 3, 4
TRAIN_LENGTH = 1024
# Of the files that a query writes only to read them back.
SCRATCH_CODEC = "lz4"


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def words(c: str | Column) -> Column:
    return F.array_join(c, "|")


def numbers(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def flags(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")


# --- text kernels and rewrites -------------------------------------------------------------


def _on_documents(name: str, kernel: Callable[[Column], Column]) -> None:
    CATALOG[name] = lambda spark, sf: v.documents(spark, sf).select("doc_id", kernel(F.col("text")).alias("text"))


_on_documents("rev_sentences", tx.reverse_sentences)
_on_documents("rev_words", tx.reverse_words)
_on_documents("scramble_letters", tx.reverse_letters)
_on_documents("mask_content", tx.mask_entities)


@query
def mutilate_options(spark, sf):
    return v.qa_items(spark, sf).select("item_id", words(corruption.scramble_options(F.col("options"))).alias("options"))


def _qa_view(df: DataFrame) -> DataFrame:
    return df.select("item_id", "question_type", "context", "question", words("options").alias("options"))


def _rewritten(name: str, how: corruption.Rewrite) -> None:
    CATALOG[name] = lambda spark, sf: _qa_view(corruption.rewrite(v.qa_items(spark, sf), how))


for _name, _how in {
    "tr_deductive": corruption.DEDUCTIVE,
    "tr_cause": corruption.CAUSE,
    "tr_contextual": corruption.CONTEXTUAL,
    "tr_knowledge": corruption.KNOWLEDGE,
    "tr_semantic": corruption.SEMANTIC,
    "tr_analogy": corruption.ANALOGY,
    "tr_pattern": corruption.PATTERN,
    "tr_quant": corruption.QUANTITATIVE,
    "tr_temporal": corruption.TEMPORAL,
    "tr_spatial": corruption.SPATIAL,
    "tr_compo": corruption.COMPOSITION,
    "generic": corruption.GENERIC,
}.items():
    _rewritten(_name, _how)


@query
def transform_dispatch(spark, sf):
    return _qa_view(corruption.corrupt_corpus(v.qa_items(spark, sf)))


@query
def unseen_types(spark, sf):
    return corruption.unseen_types(v.qa_items(spark, sf))


@query
def transform_counts(spark, sf):
    return corruption.rewrite_counts(v.qa_items(spark, sf), "question_type")


@query
def transform_counts_by_split(spark, sf):
    """Lines that are rewritten, per ability and split."""
    lines = _qa_lines(spark, sf).withColumnRenamed("answer", "ability").withColumn("split", _split())
    return corruption.rewrite_counts(corruption.corrupt_corpus(jsonl.parse_qa_lines(lines)), "ability", "split")


def _split() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in jsonl.SPLITS]), (F.col("item_id") % len(jsonl.SPLITS)).cast("int") + 1)


# --- sources, projections, filters ---------------------------------------------------------


def _qa_lines(spark, sf) -> DataFrame:
    """QA rows as JSON lines, whole, and of every tenth one a further line of each unusual ``kind``."""
    names = ("question_type", "context", "question", "options", "answer", "item_id")
    # Columns, so that the lines of a row share them.
    items = v.qa_items(spark, sf).select(
        "item_id", "answer", *[F.concat(F.lit(f'"{n}":'), jsonl.json_of(F.col(n))).alias(f"__{n}") for n in names]
    )
    fields = {n: F.col(f"__{n}") for n in names}
    number = F.col("item_id").cast("string")

    def line(**changed: Column | None) -> Column:
        members = [m for m in (fields | changed).values() if m is not None]
        return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))

    unusual = {
        "broken": F.concat(line(), F.lit(" {}")),
        "null_context": line(context=F.lit('"context":null')),
        "no_context": line(context=None),
        "number_context": line(context=F.concat(F.lit('"context":'), number)),
        "number_answer": line(answer=F.concat(F.lit('"answer":'), (F.col("item_id") % 1000).cast("string"), F.lit(".0"))),
        "null_answer": line(answer=F.lit('"answer":null')),
        "typed_options": line(options=F.concat(F.lit('"options":['), number, F.lit(',2.5,true,1.0,1.0E10,null,"left side"]'))),
        "text_options": line(options=F.lit('"options":"abc"')),
        "number_options": line(options=F.lit('"options":7')),
        "listed_type": line(question_type=F.lit('"question_type":["x"]')),
    }
    chosen = [
        F.when(F.col("item_id") % len(unusual) == i, F.struct(F.lit(kind).alias("kind"), text.alias("value")))
        for i, (kind, text) in enumerate(unusual.items())
    ]
    lines = F.array(F.struct(F.lit("whole").alias("kind"), line().alias("value")), F.coalesce(*chosen))
    return items.select("item_id", "answer", F.explode(lines).alias("l")).select("item_id", "answer", "l.kind", "l.value")


def _qa_records(spark, sf) -> DataFrame:
    return jsonl.parse_qa_lines(_qa_lines(spark, sf).drop("answer"))


@query
def jsonl_parse(spark, sf):
    return _qa_records(spark, sf).select(
        "item_id", "kind", "question_type", "context", "question", words("options").alias("options"), "answer", "extras",
        words("null_fields").alias("null_fields"), F.col("_corrupt").isNotNull().cast("int").alias("is_corrupt"),
    )


@query
def jsonl_corrupt(spark, sf):
    """The whole step on JSONL lines: broken and unreadable rows drop out, only rewritten fields change."""
    done = corruption.corrupt_corpus(_qa_records(spark, sf))
    return done.select("item_id", "kind", jsonl.qa_line(done).alias("line"))


@query
def jsonl_roundtrip(spark, sf):
    """Lines parsed, written by ability and split, and read back: the same to the last sign."""
    lines = _qa_lines(spark, sf).filter("kind <> 'broken'").withColumnRenamed("answer", "ability")
    path = scratch_path(spark, "qa")
    jsonl.write_qa(jsonl.parse_qa_lines(lines).withColumn("split", F.lit("train")), path, compression=SCRATCH_CODEC)
    back = jsonl.read_splits(spark, path)
    return back.select(
        F.get_json_object("extras", "$.item_id").cast("bigint").alias("item_id"), "ability", "split", jsonl.qa_line(back).alias("line")
    )


@query
def abilities_roundtrip(spark, sf):
    """Lines written to a folder per ability and split as the reader expects them, found again and read."""
    lines = _qa_lines(spark, sf).filter("kind <> 'broken'").withColumnRenamed("answer", "ability").withColumn("split", _split())
    root = scratch_path(spark, "datasets")
    jsonl.write_abilities(jsonl.parse_qa_lines(lines), root, SCRATCH_CODEC)
    back = jsonl.read_abilities(spark, root)
    return back.select("ability", "split", jsonl.qa_line(back).alias("line"))


@query
def line_counts(spark, sf):
    """Documents written as text, one line per document line, and counted again."""
    path = scratch_path(spark, "lines")
    v.documents(spark, sf).select("text").write.text(path)
    return jsonl.count_lines(spark, path).agg(F.sum("n_lines").alias("n_lines"))


@query
def raw_lines(spark, sf):
    path = scratch_path(spark, "raw")
    v.documents(spark, sf).select("text").write.text(path)
    return jsonl.read_lines(spark, path).groupBy(F.length("value").alias("line_length")).agg(F.count("*").alias("n_lines"))


@query
def extract_text_keys(spark, sf):
    return extraction.extract_text(v.qa_items(spark, sf), ["context", "question", "options", "answer"]).select("item_id", "text")


@query
def extract_text_list(spark, sf):
    return extraction.extract_text(v.qa_items(spark, sf), "options").select("item_id", "text")


@query
def drop_blank(spark, sf):
    docs = v.documents(spark, sf).select("doc_id", "text")
    kind = F.col("doc_id") % 3
    blank = F.when(kind == 0, F.lit(" \n\t ")).when(kind == 1, F.lit("\\n")).otherwise(F.lit(""))
    return extraction.drop_blank(docs.union(docs.select("doc_id", blank)))


@query
def require_type(spark, sf):
    """All rows, and further ones without a type, context or options."""
    items, i = v.qa_items(spark, sf), F.col("item_id")
    kind = F.when(i % 6 == 0, F.lit("")).when(i % 6 == 1, F.lit(None)).otherwise(F.col("question_type"))
    lacking = items.filter((i % 6 < 2) | (i % 4 == 0) | (i % 9 == 0)).withColumns({
        "question_type": kind, "context": F.when(i % 4 > 0, F.col("context")), "options": F.when(i % 9 > 0, F.col("options")),
    })
    return _qa_view(corruption.with_defaults(corruption.require_type(items.unionByName(lacking))))


# --- chat and corpus -----------------------------------------------------------------------


@query
def chat_render(spark, sf):
    return corpus.chat_rows(v.qa_items(spark, sf), chat.TEMPLATES["header"]).select("item_id", "content")


@query
def chat_render_multiturn(spark, sf):
    turns = v.table(spark, sf, "conversations")
    return corpus.chat_turns(turns, chat.TEMPLATES["header"]).select("conv_id", "turn", "content")


@query
def chat_render_lines(spark, sf):
    """JSON lines rendered; what can't be read stays as it is, with the reason."""
    rows = corpus.chat_rows(_qa_records(spark, sf), chat.TEMPLATES["header"])
    return rows.select("item_id", "kind", "content", F.col("_error").alias("error"))


@query
def strip_system(spark, sf):
    rendered = corpus.chat_rows(v.qa_items(spark, sf), chat.TEMPLATES["header"])
    plain = rendered.filter("item_id % 3 = 0").select("item_id", F.col("question").alias("content"))
    every = rendered.select("item_id", "content").unionByName(plain)
    return every.select("item_id", chat.strip_system(F.col("content")).alias("text"))


def _reports(spark, sf) -> DataFrame:
    """Documents with a sentence of abbreviations, an initial and a number about their own words at the end."""
    text = F.coalesce("text", F.lit(""))
    # One of a text's first five words of three letters or more, without going through the others.
    place, name = F.col("doc_id").cast("int") % 5, None
    for i in range(5):
        word = F.regexp_extract(text, rf"(?s)\A(?>.*?\p{{L}}{{3,}}+){{{i}}}(?>.*?(\p{{L}}{{3,}}+))", 1)
        name = F.when(place == i, word) if name is None else name.when(place == i, word)

    def told(name: Column) -> Column:
        return F.concat(
            text, F.lit(" Yesterday Dr. "), name, F.lit(" met Prof. J. "), name, F.lit(", i.e. the head. Then 3. place went to approx. "),
            (F.col("doc_id") % 90).cast("string"), F.lit(" of them. However, "), name, F.lit(" left at 5. However, it rained!"),
        )

    once = F.array(tx.let(F.coalesce(F.nullif(name, F.lit("")), F.lit("Wren")), told))
    return v.documents(spark, sf).select("doc_id", F.explode(once).alias("text"))


@query
def boundary_model(spark, sf):
    """Abbreviations, collocations and sentence starters counted over all documents."""
    return boundaries.train_counts(_reports(spark, sf))


@query
def sentence_split_trained(spark, sf):
    texts = _reports(spark, sf)
    split = boundaries.split_trained(boundaries.train(texts))
    return corpus.sentences_of(texts, splitter=split).select("doc_id", F.posexplode("sentences").alias("s", "sentence"))


@query
def sentence_split(spark, sf):
    docs = corpus.sentences_of(v.documents(spark, sf).select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode("sentences").alias("s", "sentence"))


@query
def tokenize_ids(spark, sf):
    return v.encoded(spark, sf).select("doc_id", F.posexplode("ids").alias("s", "sentence")).select(
        "doc_id", "s", numbers("sentence").alias("ids")
    )


@query
def tokenize_ids_by_join(spark, sf):
    """The same with the vocabulary joined, as for one too large to ship."""
    docs = v.documents(spark, sf).select("doc_id", "text")
    ids = corpus.token_sentences(docs, v.vocab(spark, sf), bos=corpus.BOS_ID, local=False)
    return ids.select("doc_id", numbers(F.flatten("ids")).alias("ids"))


@query
def decode_ids(spark, sf):
    flat = v.encoded(spark, sf).select("doc_id", F.flatten("ids").alias("ids"))
    return tokens.decode_ids(flat, v.vocab(spark, sf), special=[corpus.BOS_ID, corpus.EOS_ID])


@query
def chunk_fixed(spark, sf):
    return v.encoded(spark, sf).select(
        "doc_id", F.posexplode(corpus.pieces_of(F.col("ids"), 16)).alias("piece", "p")
    ).select("doc_id", "piece", numbers("p").alias("ids"))


def _segments(spark, sf, mode: str) -> DataFrame:
    return v.drawn(spark, sf, mode).select("doc_id", F.posexplode("drawn").alias("draw", "x")).select("doc_id", "x.seg", numbers("x.tokens").alias("ids"))


@query
def pack_drop(spark, sf):
    return _segments(spark, sf, "drop")


@query
def pack_greedy(spark, sf):
    return _segments(spark, sf, "greedy")


@query
def corpus_chain(spark, sf):
    """QA rows rendered, stripped, tokenised and packed in one chain."""
    rendered = corpus.chat_rows(v.qa_items(spark, sf), chat.TEMPLATES["header"])
    texts = rendered.select("item_id", chat.strip_system(F.col("content")).alias("text"))
    ids = corpus.token_sentences(texts, v.vocab(spark, sf), key="item_id")
    segments = corpus.segments_of(ids, v.SEGMENT_LENGTH, "drop")
    return corpus.sample_segments(segments, -1, key="item_id").select("item_id", numbers("tokens").alias("ids"))


def _short_segments(spark, sf) -> DataFrame:
    return corpus.segments_of(v.encoded(spark, sf), 64, "greedy")


@query
def segment_sample(spark, sf):
    return corpus.sample_segments(_short_segments(spark, sf), 4).select("doc_id", "draw", "seg", F.size("tokens").alias("length"))


@query
def segment_sample_two(spark, sf):
    return corpus.sample_segments(_short_segments(spark, sf), 2).select("doc_id", "draw", "seg", F.size("tokens").alias("length"))


# --- packed tables -------------------------------------------------------------------------


@query
def offsets(spark, sf):
    return packing.number_segments(v.drawn(spark, sf)).select("doc_id", "draw", "sample_id", "start", "length")


@query
def boundary_stats(spark, sf):
    return corpus.boundary_stats(v.packed_table(spark, sf), **BOUNDARY)


@query
def integrity(spark, sf):
    """A sound table has no problems; shifted starts and a wrong total are found."""
    table = v.packed_table(spark, sf)
    sound = packing.integrity_violations(table).withColumn("table", F.lit("sound"))
    shifted = table.withColumn("start", F.when(F.col("sample_id") % 97 == 5, F.col("start") + 1).otherwise(F.col("start")))
    bad = packing.integrity_violations(shifted, n_samples=-1).withColumn("table", F.lit("shifted"))
    return sound.unionByName(bad)


@query
def packed_roundtrip(spark, sf):
    return v.packed_table(spark, sf).select("sample_id", "type", "start", "length", numbers("tokens").alias("ids"))


@query
def sample_access(spark, sf):
    """Samples by id out of the files that hold them, cut to 64 tokens."""
    path = v.packed_path(spark, sf)
    last = packed.read_index(spark, path).agg(F.max("hi")).first()[0]
    found = packed.samples_at(spark, path, [*range(0, last + 1, max(1, last // 9)), last, last + 1], 64)
    return found.select("sample_id", "start", "length", numbers("tokens").alias("ids"))


@query
def packed_damage(spark, sf):
    """Validation of the sound packed table, and of a copy with moved, cut and missing samples."""
    sound = packed.check_packed(spark, v.packed_path(spark, sf)).select("sample_id", "problem", F.lit("sound").alias("table"))
    table, path = v.packed_table(spark, sf), scratch_path(spark, "damaged")
    packed.write_packed(table, path)
    i = F.col("sample_id")
    damaged = table.filter(i % 103 != 50).withColumns({
        "start": F.when(i % 97 == 5, F.col("start") + 1).otherwise(F.col("start")),
        "tokens": F.when(i % 101 == 7, ar.truncate(F.col("tokens"), 1)).otherwise(F.col("tokens")),
    })
    damaged.write.mode("overwrite").parquet(f"{path}/samples")
    found = packed.check_packed(spark, path).withColumn("table", F.lit("damaged"))
    return sound.unionByName(found)


@query
def packed_manifest(spark, sf):
    return packing.manifest(v.packed_table(spark, sf))


@query
def truncate(spark, sf):
    return v.packed_table(spark, sf).select("sample_id", numbers(ar.truncate(F.col("tokens"), 128)).alias("ids"))


@query
def head20(spark, sf):
    first = packing.head_samples(v.packed_table(spark, sf)).select("sample_id", F.col("tokens").alias("ids"))
    return tokens.decode_ids(first, v.vocab(spark, sf), special=[corpus.BOS_ID, corpus.EOS_ID], key="sample_id")


@query
def offsets_by_source(spark, sf):
    return v.packed_by_source(spark, sf).select("source", "sample_id", "start", "length")


@query
def merge_same_type(spark, sf):
    merged = packing.merge_packed(v.packed_by_source(spark, sf), "ordinal")
    return merged.select("sample_id", "source", "start", "length")


@query
def merge_by_type(spark, sf):
    merged = packing.merge_packed(v.packed_by_source(spark, sf), "ordinal", "kind")
    return merged.select("sample_id", "kind", "source", "start", "length")


@query
def merge_manifest(spark, sf):
    merged = packing.merge_packed(v.packed_by_source(spark, sf), "ordinal", "kind")
    return packing.manifest(merged.withColumn("type", F.col("kind")))


@query
def incremental_rows(spark, sf):
    """Documents without a label, by a filter merged of two runs' filters and then exactly."""
    docs, labels = v.documents(spark, sf).select("doc_id", "lang", "n_chars"), v.table(spark, sf, "labels")
    runs = [done.build_filter(labels.filter(F.col("doc_id") % 2 == i), ["doc_id"]) for i in (0, 1)]
    path = scratch_path(spark, "filter")
    done.write_filter(done.merge_filters(*runs), path)
    return done.not_done(docs, labels, ["doc_id"], done.read_filter(spark, path))


@query
def split_stable(spark, sf):
    return splitting.split_stable(v.documents(spark, sf), "doc_id").select("doc_id", "split")


@query
def split_80_20(spark, sf):
    return splitting.ensure_splits(v.documents(spark, sf), "doc_id").select("doc_id", "split")


@query
def split_without_key(spark, sf):
    """Conversation turns of few different contents, split by content alone: sizes are exact all the same."""
    turns = v.table(spark, sf, "conversations").select("role", (F.length("text") % 5).alias("n"))
    return splitting.split_exact(turns).groupBy("role", "n", "split").agg(F.count("*").alias("n_rows"))


# --- batches -------------------------------------------------------------------------------


@query
def training_rows(spark, sf):
    rows = batches.training_rows(v.packed_table(spark, sf), TRAIN_LENGTH)
    return rows.select("sample_id", numbers("input_ids").alias("input_ids"), numbers("labels").alias("labels"))


@query
def pad_batch(spark, sf):
    rows = batches.training_rows(v.packed_table(spark, sf))
    padded = batches.pad_rows(rows, TRAIN_LENGTH, corpus.EOS_ID)
    return padded.select("sample_id", numbers("input_ids").alias("input_ids"), numbers("labels").alias("labels"))


@query
def attention_mask(spark, sf):
    rows = batches.training_rows(v.packed_table(spark, sf))
    return batches.pad_rows(rows, TRAIN_LENGTH, corpus.EOS_ID).select("sample_id", flags("attention_mask").alias("mask"))


@query
def cap_samples(spark, sf):
    return packing.cap_samples(v.packed_table(spark, sf), 100).agg(
        F.count("*").alias("n_samples"), F.sum("length").alias("n_tokens")
    )


def _dealt(spark, sf) -> DataFrame:
    return batches.assign_workers(v.packed_table(spark, sf).select("sample_id", "length"), WORKERS)


@query
def worker_assign(spark, sf):
    return _dealt(spark, sf).select("sample_id", "worker", "turn")


@query
def batch_groups(spark, sf):
    grouped = batches.group_batches(_dealt(spark, sf), BATCH, ["sample_id"])
    return grouped.select("worker", "batch_id", numbers(F.col("samples.sample_id")).alias("sample_ids"))


@query
def checkpoint_label(spark, sf):
    ranked = v.packed_table(spark, sf).select("sample_id")
    return batches.label_checkpoints(ranked, 8 * BATCH, position="sample_id")


# --- attribution ---------------------------------------------------------------------------


def _elements(blocks: DataFrame, keys: list[str], column: str) -> DataFrame:
    return attribution.explode_blocks(blocks.select(*keys, column), column).withColumn("val", F.col("val").cast("double"))


@query
def grad_times_weight(spark, sf):
    raw = attribution.grad_times_weight(v.gradients(spark, sf).drop("shape"), v.weights(spark, sf), rounded=False)
    return _elements(raw, ["tensor", "block"], "vals")


@query
def bf16_round(spark, sf):
    return _elements(v.attribution_blocks(spark, sf), ["tensor", "block"], "vals")


@query
def grad_sum(spark, sf):
    return _elements(attribution.accumulate(v.micro_gradients(spark, sf)), ["tensor", "block"], "grad")


@query
def grad_mean(spark, sf):
    return _elements(attribution.accumulate(v.micro_gradients(spark, sf), "mean"), ["tensor", "block"], "grad")


@query
def grad_last(spark, sf):
    return _elements(attribution.accumulate(v.micro_gradients(spark, sf), "last"), ["tensor", "block"], "grad")


# --- region --------------------------------------------------------------------------------


@query
def layer_parse(spark, sf):
    return v.tensor_rows(spark, sf).select(
        "vec_id", "tensor", naming.layer_of(F.col("tensor")).alias("layer"),
        naming.file_safe(F.concat("tensor", F.lit(".pt"))).alias("file_name"),
        naming.strip_module(F.concat(F.lit("module."), "tensor")).alias("bare_name"),
    )


@query
def mlp_filter(spark, sf):
    meta = region.with_eligibility(region.tensor_meta(v.tensor_blocks(spark, sf)), front=1, back=2)
    return meta.select("ckpt", "tensor", "n_layers", "eligible")


@query
def budget(spark, sf):
    plan = region.budgets(region.layout(v.tensor_blocks(spark, sf)), v.K_VALUES, CHUNK_FLOOR)
    return plan.withColumn("k_label", numeric.format_k(F.col("k")))


@query
def tensor_offsets(spark, sf):
    meta = region.layout(v.tensor_blocks(spark, sf))
    return meta.filter("eligible").select("ckpt", "tensor", "numel", "offset")


@query
def checkpoint_layout(spark, sf):
    """Eligibility and offsets of several checkpoints: whole, of fewer layers, without MLP tensors, and a small one."""
    meta = region.layout(v.checkpoint_blocks(spark, sf), front=1, back=1)
    return meta.select("ckpt", "tensor", "numel", "n_layers", "eligible", "offset")


@query
def checkpoint_budget(spark, sf):
    """Budgets of several checkpoints; those without eligible elements, or with too few, have none."""
    return region.budgets(region.layout(v.checkpoint_blocks(spark, sf)), [0.01024, 0.3], CHUNK_FLOOR).select(
        "ckpt", "total", "mlp_total", "k", "budget", "fraction"
    )


def _global(spark, sf, sides=region.SIDES) -> DataFrame:
    blocks = v.tensor_blocks(spark, sf)
    return region.select_global(blocks, region.layout(blocks), v.K_VALUES, v.VECTOR_LENGTH, sides)


def _chunked(spark, sf, sides=region.SIDES) -> DataFrame:
    blocks = v.tensor_blocks(spark, sf)
    return region.select_chunked(
        blocks, region.layout(blocks), v.K_VALUES, v.VECTOR_LENGTH, sides, CHUNK_FLOOR
    )


def _picked(df: DataFrame) -> DataFrame:
    return df.select("ckpt", "k", "side", "tensor", "pos", F.col("val").cast("double").alias("val"))


@query
def topk_global(spark, sf):
    return _picked(_global(spark, sf, ["top"]))


@query
def bottomk_global(spark, sf):
    return _picked(_global(spark, sf, ["bottom"]))


@query
def topk_chunked(spark, sf):
    return _picked(_chunked(spark, sf, ["top"]))


@query
def bottomk_chunked(spark, sf):
    return _picked(_chunked(spark, sf, ["bottom"]))


@query
def topk_k_sweep(spark, sf):
    """Both sides and all k on rounded attributions, where many values tie."""
    blocks = v.attribution_blocks(spark, sf)
    return _picked(region.select_global(blocks, region.layout(blocks), v.K_VALUES, v.VECTOR_LENGTH))


@query
def topk_chunk_sweep(spark, sf):
    blocks = v.attribution_blocks(spark, sf)
    return _picked(
        region.select_chunked(blocks, region.layout(blocks), v.K_VALUES, v.VECTOR_LENGTH, chunk_floor=CHUNK_FLOOR)
    )


@query
def random_pick(spark, sf):
    blocks = v.tensor_blocks(spark, sf)
    picked = region.select_random(blocks, region.layout(blocks), v.K_VALUES, 11, v.VECTOR_LENGTH)
    return picked.select("ckpt", "k", "side", "tensor", "pos")


@query
def nan_report(spark, sf):
    """Attribution with some values undefined: how many the selection leaves out."""
    blocks = v.tensor_blocks(spark, sf)
    holed = blocks.withColumn(
        "vals", F.transform("vals", lambda x, i: F.when((F.col("vec_id") + i) % 50 == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    )
    return region.nan_counts(holed)


@query
def index_to_tensor(spark, sf):
    blocks = v.tensor_blocks(spark, sf)
    indices = v.tensor_rows(spark, sf).select(
        F.lit("checkpoint_full").alias("ckpt"), F.col("vec_id"), (F.col("vec_id") * 61).alias("gpos")
    )
    return region.index_to_tensor(indices, region.layout(blocks), bucket_bits=8)


@query
def dense_mask(spark, sf):
    blocks = v.attribution_blocks(spark, sf).filter(naming.layer_of(F.col("tensor")).isNotNull())
    chosen = stage(_global(spark, sf), "chosen")  # it is read twice
    variants = chosen.select("ckpt", "k", "side").distinct()
    masks = damage.dense_masks(blocks, chosen, variants, v.VECTOR_LENGTH)
    return masks.select("ckpt", "k", "side", "tensor", "block", flags("mask").alias("mask"))


def _stats(spark, sf) -> DataFrame:
    blocks = v.tensor_blocks(spark, sf)
    return region.layer_stats(region.layout(blocks), _global(spark, sf), v.K_VALUES)


@query
def layer_stats(spark, sf):
    return _stats(spark, sf).select("ckpt", "k", "tensor", "numel", "top_n", "top_pct", "bottom_n", "bottom_pct")


@query
def stats_roundtrip(spark, sf):
    path = scratch_path(spark, "stats")
    tensors.write_stats(_stats(spark, sf), path)
    return tensors.read_stats(spark, path).select(
        "ckpt", F.col("k_label").cast("double").alias("k"), "Layer",
        F.col("Total Parameters").alias("total_parameters"), "Top", "Bottom",
    )


@query
def selected_indices(spark, sf):
    meta = region.layout(v.tensor_blocks(spark, sf))
    parts = region.selected_indices(_global(spark, sf), meta, v.K_VALUES, v.VECTOR_LENGTH)
    return parts.select("ckpt", "layer_name", "k_value", "part", numbers("indices").alias("indices"))


@query
def selected_roundtrip(spark, sf):
    path = scratch_path(spark, "selected")
    meta = region.layout(v.tensor_blocks(spark, sf))
    tensors.write_selected(region.selected_indices(_chunked(spark, sf), meta, v.K_VALUES, 1 << 14), path)
    back = tensors.read_selected(spark, path)
    return back.select("ckpt", "layer_name", "k_value", "part", numbers("indices").alias("indices"))


@query
def selected_preview(spark, sf):
    return region.selected_preview(_chunked(spark, sf), region.layout(v.tensor_blocks(spark, sf)), v.K_VALUES)


@query
def tensor_roundtrip(spark, sf):
    path = scratch_path(spark, "tensors")
    tensors.write_tensors(v.tensor_blocks(spark, sf).drop("vec_id"), path)
    return _elements(tensors.read_tensors(spark, path), ["ckpt", "tensor", "block"], "vals")


@query
def mask_roundtrip(spark, sf):
    path = scratch_path(spark, "masks")
    tensors.write_masks(_global(spark, sf), path)
    return tensors.read_masks(spark, path)


# --- damage and results --------------------------------------------------------------------


def _one_mask(spark, sf) -> DataFrame:
    blocks = v.tensor_blocks(spark, sf)
    return region.select_global(blocks, region.layout(blocks), [0.01024], v.VECTOR_LENGTH, ["top"])


@query
def apply_mask(spark, sf):
    weights = v.weights(spark, sf)
    damaged = damage.apply_mask(weights, _one_mask(spark, sf), v.VECTOR_LENGTH, weights.select("tensor", "shape").distinct())
    return _elements(damaged, ["tensor", "block"], "weight")


@query
def apply_mask_reshaped(spark, sf):
    """Masks on parameters with three first rows fewer (layer 1) or more (layer 0) than they have."""
    whole, rows = v.weights(spark, sf), F.col("shape")[0]
    layer = F.coalesce(naming.layer_of(F.col("tensor")), F.lit(-1))
    fewer = whole.filter((layer != 1) | (F.col("block") < F.greatest(rows - 3, F.lit(1))))
    more = whole.filter((layer == 0) & (F.col("block") < 3)).withColumn("block", rows + F.col("block"))
    changed = F.when(layer == 0, rows + 3).when(layer == 1, F.greatest(rows - 3, F.lit(1))).otherwise(rows)
    weights = fewer.unionByName(more).withColumn("shape", F.array(changed, F.col("shape")[1]))
    shapes = whole.select("tensor", "shape").distinct()
    masks = damage.mask_containers(_one_mask(spark, sf), v.VECTOR_LENGTH)
    return _elements(damage.apply_mask(weights, masks, v.VECTOR_LENGTH, shapes), ["tensor", "block"], "weight")


@query
def missing_masks(spark, sf):
    masks = region.masked_tensors(region.layout(v.tensor_blocks(spark, sf)))
    return damage.missing_masks(v.weights(spark, sf), masks).select("tensor", "name")


def _param_shapes(spark, sf) -> DataFrame:
    """Parameters whose shapes partly differ from their masks'."""
    meta = region.layout(v.tensor_blocks(spark, sf))
    rows, layer = F.col("shape")[0], F.col("layer")
    new = (
        F.when(layer == 0, F.array(rows + 3, F.lit(v.VECTOR_LENGTH)))
        .when(layer == 1, F.array(F.greatest(rows - 3, F.lit(1)), F.lit(v.VECTOR_LENGTH)))
        .when(layer == 2, F.array(rows * v.VECTOR_LENGTH))
        .when(layer == 3, F.array(rows, F.lit(v.VECTOR_LENGTH * 2)))
        .otherwise(F.col("shape"))
    )
    return meta.select("tensor", F.col("shape").alias("mask_shape"), new.alias("shape"))


@query
def mask_shape_report(spark, sf):
    shapes = _param_shapes(spark, sf)
    report = damage.shape_report(shapes.select("tensor", "shape"), shapes.select("tensor", F.col("mask_shape").alias("shape")))
    return report.select("tensor", numbers("shape").alias("shape"), numbers("mask_shape").alias("mask_shape"), "status")


@query
def mask_shape_repair(spark, sf):
    shapes = _param_shapes(spark, sf)
    report = damage.shape_report(shapes.select("tensor", "shape"), shapes.select("tensor", F.col("mask_shape").alias("shape")))
    usable = report.filter(~F.col("status").isin("rank", "inner"))
    return damage.repair(_one_mask(spark, sf), usable).select("tensor", "pos")


@query
def damage_variants(spark, sf):
    """Zeroed elements and remaining magnitude of every damaged variant, per block."""
    weights = v.weights(spark, sf)
    shapes = weights.select("tensor", "shape").distinct()
    damaged = damage.damage_variants(weights, _global(spark, sf), v.VECTOR_LENGTH, shapes)
    left = F.aggregate(
        "weight", F.lit(0.0), lambda total, x: total + F.abs(x.cast("double"))
    )
    return damaged.select(
        "ckpt", "k", "side", "tensor", "block",
        F.size(F.filter("weight", lambda x: x == 0.0)).alias("n_zero"), F.round(left, 6).alias("left"),
    )


@query
def result_coverage(spark, sf):
    scores = v.results(spark, sf)
    runs = scores.filter(F.col("side") != "original").select("dataset", "ckpt")
    return results.missing_cells(scores, results.expected_cells(runs, [0.00256, 0.01024], v.BENCHMARKS))


@query
def cell_scores(spark, sf):
    return results.cell_scores(v.results(spark, sf))


@query
def change_matrix(spark, sf):
    return results.change_matrix(v.results(spark, sf), v.BENCHMARKS)


@query
def usable_checkpoints(spark, sf):
    """Result rows of checkpoints that are not themselves damaged ones."""
    marked = v.results(spark, sf).withColumn(
        "ckpt", F.when(F.col("item_id") % 4 == 0, F.concat("ckpt", F.lit("_damaged"))).otherwise(F.col("ckpt"))
    )
    return region.usable_checkpoints(marked).groupBy("dataset", "ckpt").agg(F.count("*").alias("n_rows"))
