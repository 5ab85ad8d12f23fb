"""Sources, sinks, tokens, batches and the chains end to end."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ablatrix.functions import chat
from ablatrix.operators import (
    attribution, batches, corpus, corruption, done, extraction, packing, region, results, splitting, tokens,
)
from ablatrix.plans import workflows
from ablatrix.sources import jsonl, packed, tensors
from ablatrix.streaming.incremental import corrupt_new_files


def _write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + end, encoding="utf-8")


def _qa(**fields):
    return json.dumps(fields, ensure_ascii=False)


@pytest.fixture()
def abilities(tmp_path):
    root = tmp_path / "datasets"
    _write(
        root / "Cause_&_Effect" / "original" / "train.jsonl",
        [
            _qa(question_type="analogy", context="A b", question="ab cd", options=["xy", None], answer="é", level=3.5),
            "not json",
            _qa(question_type="", question="x"),
            _qa(question="no type"),
            _qa(question_type="world_fact", context=None, question="q"),
            _qa(question_type="analogy", context=None, question="ab", options=[]),
            '{"question_type": "analogy"} {"x": 1}',
            "[1]",
            "",
            _qa(question_type="analogy"),
        ],
    )
    _write(root / "Cause_&_Effect" / "original" / "extra.jsonl", [_qa(question_type="analogy")])
    _write(root / "B c" / "original" / "dev.jsonl", [_qa(question_type="new", context="a b", question="c d", options=["ef"])])
    _write(root / "NoOriginal" / "train.jsonl", [_qa(question_type="analogy")])
    return str(root)


def test_discovery(spark, abilities):
    rows = jsonl.read_abilities(spark, abilities)
    assert {(r["ability"], r["split"]) for r in rows.select("ability", "split").distinct().collect()} == {
        ("Cause_&_Effect", "train"), ("B c", "dev"),
    }
    assert rows.filter("_corrupt is not null").count() == 4


def test_corrupt_abilities(spark, abilities, tmp_path):
    target = str(tmp_path / "out")
    counts = workflows.corrupt_abilities(spark, abilities, target)
    assert {(r["ability"], r["split"]): r["n_rows"] for r in counts.collect()} == {
        ("Cause_&_Effect", "train"): 3, ("B c", "dev"): 1,
    }
    lines = [json.loads(r["value"]) for r in spark.read.text(target).collect()]
    full = next(x for x in lines if x.get("level"))
    assert full == {
        "question_type": "analogy", "context": "A b", "question": "ba dc", "options": ["yx", "enoN"],
        "answer": "é", "level": 3.5,
    }
    assert {"question_type": "analogy", "context": "", "question": "", "options": []} in lines
    assert {"question_type": "new", "context": "b a", "question": "d c", "options": ["fe"]} in lines


def test_abilities_are_written_as_they_are_read(spark, abilities, tmp_path):
    rows, root = jsonl.read_abilities(spark, abilities).filter("_corrupt is null"), str(tmp_path / "again")
    jsonl.write_abilities(rows, root)
    back = jsonl.read_abilities(spark, root)
    both = [sorted((r["ability"], r["split"], r["line"]) for r in d.select("ability", "split", jsonl.qa_line(d).alias("line")).collect()) for d in (rows, back)]
    assert both[0] == both[1] and len(both[0]) == 7
    with pytest.raises(FileExistsError):
        jsonl.write_abilities(rows, root)
    assert back.count() == 7


def _rewritten(spark, lines):
    done = corruption.corrupt_corpus(jsonl.parse_qa_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    return [r[0] for r in done.select(jsonl.qa_line(done)).collect()]


def test_only_rewritten_fields_change(spark):
    lines = [
        '{"answer":3,"question_type":"analogy","context":null,"question":"ab cd","options":[1,2.5,true,1.0,null,"xy"],"x":{"b":1.0,"a":[]}}',
        '{"question_type":"single_fact_recall","options":[1,1.0,null],"context":"a5","question":"q","x":1,"q\\"k":"v\\n","x":2.0}',
        '{"question_type":"analogy","answer":null,"options":"abc"}',
        '{"question_type":"analogy","options":{"ab":1,"cd":2},"context":7}',
        '{"question_type":5,"context":"a b","question":"c d"}',
        '{"question_type":"single_fact_recall","context":"","question":"","options":"x"}',
    ]
    assert _rewritten(spark, lines) == [
        '{"answer":3,"question_type":"analogy","context":null,"question":"ba dc","options":["1","2.5","eurT","1.0","enoN","yx"],"x":{"b":1.0,"a":[]}}',
        '{"question_type":"single_fact_recall","options":[1,1.0,null],"context":"XX","question":"X","q\\"k":"v\\n","x":2.0}',
        '{"question_type":"analogy","answer":null,"options":["a","b","c"],"context":"","question":""}',
        '{"question_type":"analogy","options":["ba","dc"],"context":7,"question":""}',
        '{"question_type":5,"context":"b a","question":"d c","options":[]}',
        '{"question_type":"single_fact_recall","context":"","question":"","options":"x"}',
    ]


def test_unreadable_fields_are_row_errors(spark):
    lines = [
        '{"question_type":"world_fact","context":5}', '{"question_type":"world_fact","question":["q"]}',
        '{"question_type":"analogy","options":7}', '{"question_type":"analogy","options":true}', '{"question_type":"analogy","options":null}',
        '{"question_type":{"a":1}}', '{"question_type":false}', '{"question_type":0}', '{"question_type":[]}', '{"question_type":""}',
    ]
    assert _rewritten(spark, lines) == []


def test_numbers_as_text(spark):
    numbers = [0.1, 100000.0, 1e7, 123456789.5, 1e15, 1e16, 1.5e300, 0.001, 0.00012, 0.0001, 1e-5, -1.5e-7, -0.0, 12, -3]
    lines = [json.dumps({"question_type": "analogy", "options": [n]}) for n in numbers]
    options = [r["options"] for r in jsonl.parse_qa_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert options == [[str(n)] for n in numbers]


def test_new_files_only(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    _write(tmp_path / "in" / "a.jsonl", [_qa(question_type="roles_and_relations", context="a b", question="q", note="n")])
    corrupt_new_files(spark, source, target, progress)
    _write(tmp_path / "in" / "b.jsonl", ["broken", _qa(question_type="roles_and_relations", context="c d", question="q")])
    corrupt_new_files(spark, source, target, progress)
    corrupt_new_files(spark, source, target, progress)
    lines = [json.loads(r["value"]) for r in spark.read.text(target).collect()]
    assert sorted(x["context"] for x in lines) == ["b a", "d c"]
    assert sorted(x.get("note", "") for x in lines) == ["", "n"]


def test_count_lines(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "empty.txt").write_bytes(b"")
    (folder / "open.txt").write_bytes(b"a\r\nb\rc")
    (folder / "closed.txt").write_bytes(b"a\n\nb\n")
    got = {r["file"].rsplit("/", 1)[1]: r["n_lines"] for r in jsonl.count_lines(spark, str(folder)).collect()}
    assert got == {"empty.txt": 0, "open.txt": 2, "closed.txt": 3}


def test_extract_text(spark):
    df = spark.createDataFrame([("a", ["b", "c"]), (None, ["d"])], "x string, y array<string>")
    assert extraction.extract_text(df.limit(1), ("x", "y")).first()["text"] == "a b c"
    with pytest.raises(ValueError):
        extraction.extract_text(df, "z")
    with pytest.raises(Exception, match="key not found: x"):
        extraction.extract_text(df, "x").collect()


def test_chat(spark):
    lines = ['{"question": "q", "answer": "a"}', '{"context": "c", "question": null}', "broken <|eot_id|>"]
    df = jsonl.parse_qa_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = corpus.chat_rows(df, chat.TEMPLATES["im"]).collect()
    assert rows[0]["content"].endswith(
        "<|im_start|>user\nQuestion: q<|im_end|>\n<|im_start|>assistant\nAnswer: a.<|im_end|>\n"
    )
    assert "Context: c\nQuestion: None<|im_end|>" in rows[1]["content"] and rows[1]["content"].count("Answer: .") == 1
    assert (rows[2]["content"], rows[2]["_error"]) == ("broken <|eot_id|>", "not a JSON object")
    assert rows[0]["_error"] is None
    texts = spark.createDataFrame([("no header<|eot_id|>x",), (None,)], "t string")
    assert [r[0] for r in texts.select(chat.strip_system(F.col("t"))).collect()] == ["no header<|eot_id|>x", None]


VOCAB = [("a", 3), ("b", 4), (".", 5), ("!", 6)]


@pytest.mark.parametrize("local", [True, False])
def test_encode_and_decode(spark, local):
    docs = spark.createDataFrame(
        [(1, "a b. zz a!"), (2, "  "), (3, "\\n"), (4, "b"), (5, "."), (6, None)], "doc_id long, text string"
    )
    vocab = spark.createDataFrame(VOCAB, "token string, id int")
    ids = corpus.token_sentences(docs, vocab, bos=1, local=local)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {1: [[1, 3, 4, 5], [0, 3, 6, 2]], 4: [[1, 4, 2]], 5: [[1, 5, 2]]}
    flat = ids.select("doc_id", F.flatten("ids").alias("ids"))
    text = tokens.decode_ids(flat, vocab, special=[0, 1, 2], local=local)
    assert {r["doc_id"]: r["text"] for r in text.collect()} == {1: "a b . a !", 4: "b", 5: "."}


def test_encode_in_small_batches_and_empty_input(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b. a!").alias("text"))
        vocab = spark.createDataFrame(VOCAB, "token string, id int")
        rows = corpus.token_sentences(docs, vocab).collect()
        assert len(rows) == 20 and all(r["ids"] == [[3, 4, 5], [3, 6, 2]] for r in rows)
        assert corpus.token_sentences(docs.limit(0), vocab).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plugged_tokenizer_and_splitter(spark):
    def build_tokenizer():
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = Tokenizer(models.WordLevel({"a": 10, "b": 11, "[UNK]": 0}, unk_token="[UNK]"))
        model.pre_tokenizer = pre_tokenizers.Whitespace()
        return lambda text: model.encode(text).ids

    tokens.register_tokenizer("words", build_tokenizer)
    tokens.register_splitter("lines", lambda: lambda text: text.split("\n"))
    df = spark.createDataFrame([("a b\nzz",), ("b",)], "text string")
    ids = df.select(tokens.encode_with("words")(tokens.split_with("lines")(F.col("text"))).alias("ids"))
    assert [r["ids"] for r in ids.collect()] == [[[10, 11], [0]], [[11]]]


@pytest.mark.parametrize("parts", [1, 4])
def test_sampling(spark, parts):
    segments = [[[i, j] for j in range(n)] for i, n in enumerate([0, 1, 2, 3, 10])]
    df = spark.createDataFrame(list(enumerate(segments)), "doc_id long, segments array<array<int>>").repartition(parts)

    def picks(n):
        out = {}
        for r in corpus.sample_segments(df, n).orderBy("doc_id", "draw").collect():
            assert r["tokens"] == [r["doc_id"], r["seg"]]
            out.setdefault(r["doc_id"], []).append(r["seg"])
        return out

    assert picks(-1) == {1: [0], 2: [0, 1], 3: [0, 1, 2], 4: list(range(10))}
    four = picks(4)
    assert four[1] == [0] and four[2] == [0, 1] and four[3] == [0, 2, 1]
    assert four[4][:2] == [0, 9] and len(set(four[4])) == 4
    two = picks(2)
    assert sorted(two) == [1, 2, 3, 4] and all(len(x) == 2 for x in two.values())
    assert picks(0) == {}


@pytest.mark.parametrize("n, workers", [(10, 3), (9, 3), (2, 5), (0, 3)])
def test_workers_get_equally_many(spark, n, workers):
    df = spark.range(n).withColumnRenamed("id", "sample_id")
    rows = batches.assign_workers(df, workers).collect()
    share = math.ceil(n / workers)
    assert len(rows) == share * workers
    per_worker = {}
    for r in rows:
        per_worker.setdefault(r["worker"], []).append(r["turn"])
    assert all(sorted(t) == list(range(share)) for t in per_worker.values())
    assert {r["sample_id"] for r in rows} == set(range(n))


@pytest.mark.parametrize("n, batch, interval", [(1000, 32, 1000), (950, 7, 100), (950, 300, 100), (1234, 1, 100), (250, 4, 250)])
def test_checkpoint_labels(spark, n, batch, interval):
    saves = {}
    for samples in range(interval, n + 1, interval):
        saves[math.ceil(samples / batch)] = samples
    rows = spark.range(n).select("id", batches.checkpoint_of(F.col("id"), n, batch, interval).alias("c")).collect()
    for r in rows:
        later = [s for s in saves if s >= r["id"] // batch + 1]
        assert r["c"] == (saves[min(later)] if later else None)


def test_checkpoint_interval():
    assert [batches.checkpoint_interval(n) for n in (100, 5000, 10_000, 499_999)] == [100, 1000, 10_000, 100_000]
    assert batches.checkpoint_interval(5, full=True) == 5
    with pytest.raises(ValueError):
        batches.checkpoint_interval(99)


def test_incremental_and_existing_splits(spark):
    df = spark.range(10)
    assert done.not_done(df, df.filter("id < 7"), ["id"]).count() == 3
    split = df.withColumn("split", F.when(F.col("id") < 3, "dev").otherwise("train"))
    assert splitting.ensure_splits(split, "id").filter("split = 'dev'").count() == 3
    assert splitting.ensure_splits(df, "id").filter("split = 'test'").count() == 2


def test_attribution_chain(spark):
    grads = spark.createDataFrame(
        [("module.w", 0, 0, [1.0, 2.0]), ("module.w", 0, 1, [3.0, -2.5])], "tensor string, block long, batch int, grad array<float>"
    )
    weights = spark.createDataFrame([("w", 0, [2.0, 1.001])], "tensor string, block long, weight array<float>")
    total = attribution.accumulate(grads)
    assert total.first()["grad"] == [4.0, -0.5]
    assert attribution.accumulate(grads, "mean").first()["grad"] == [2.0, -0.25]
    assert attribution.accumulate(grads, "last").first()["grad"] == [3.0, -2.5]
    assert attribution.grad_times_weight(total, weights).first()["vals"] == [8.0, -0.5]


def test_prepare_corpus(spark, tmp_path):
    rows = [(i, "" if i % 2 else "b a.", "a b?" * (i + 1), "a") for i in range(30)]
    qa = spark.createDataFrame(rows, "item_id long, context string, question string, answer string")
    vocab = spark.createDataFrame(VOCAB, "token string, id int")
    for mode in ("drop", "greedy"):
        target = str(tmp_path / mode)
        assert workflows.prepare_corpus(qa, vocab, target, length=60, mode=mode).count() == 0
        table = packed.read_packed(spark, target)
        assert packed.read_manifest(spark, target).first()["n_samples"] == table.count()
        assert table.agg(F.max("length")).first()[0] <= 60
        assert len(packed.sample(table, 3, 5).first()["tokens"]) == 5
    assert table.count() > packed.read_packed(spark, str(tmp_path / "drop")).count()


def test_numbering_in_parallel(spark):
    """Repeated and sparse keys, a document of many segments, groups: as one pass in order would number them."""
    rng = random.Random(2)
    keys = [0, 0, 0, 5, -7, 2**40, 2**40 + 1, None] + [rng.randrange(10**6) for _ in range(300)] + [9] * 40
    rows = [(k, f"g{i % 3}", [{"seg": j, "tokens": [i] * rng.randint(0, 5)} for j in range(2000 if i == 3 else rng.randint(0, 4))]) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, g string, drawn array<struct<seg:int,tokens:array<int>>>").repartition(5)
    for by in ([], ["g"]):
        got = packing.number_segments(df, by=by).collect()
        assert len(got) == sum(len(r[2]) for r in rows)
        for g in {r["g"] for r in got} if by else {None}:
            own = sorted((r for r in got if g in (None, r["g"])), key=lambda r: r["sample_id"])
            assert [r["sample_id"] for r in own] == list(range(len(own)))
            at = 0
            for r in own:
                assert (r["start"], r["length"]) == (at, len(r["tokens"]))
                at += r["length"]
            order = [(-(2**63) if r["doc_id"] is None else r["doc_id"]) for r in own]
            assert order == sorted(order)
            for r, following in zip(own, own[1:]):
                assert following["draw"] in (0, r["draw"] + 1)


def test_access_by_id(spark, tmp_path):
    path, n = str(tmp_path / "packed"), 5000
    df = spark.range(n).select(
        F.col("id").alias("sample_id"), (F.col("id") % 3).cast("int").alias("type"), (F.col("id") * 4).alias("start"), F.lit(4).alias("length"),
        F.array(*[F.col("id").cast("int")] * 4).alias("tokens"),
    ).repartition(7)
    packed.write_packed(df, path)
    files = packed.read_index(spark, path).count()
    assert files > 4 and packed.check_index(spark, path).count() == 0 and packed.check_packed(spark, path).count() == 0
    found = packed.samples_at(spark, path, [17, 4999, 17, n, -1], 2)
    assert sorted((r["sample_id"], r["tokens"]) for r in found.collect()) == [(17, [17, 17]), (4999, [4999, 4999])]
    assert len(found.inputFiles()) == 2  # no other file is read
    assert packed.samples_at(spark, path, [n + 5]).count() == packed.samples_at(spark, path, []).count() == 0
    packed.file_ranges(packed.read_packed(spark, path)).filter("lo > 0").write.parquet(f"{path}/part")
    spark.read.parquet(f"{path}/part").withColumn("hi", F.col("hi") + 1).write.mode("overwrite").parquet(f"{path}/index")
    assert {r["problem"] for r in packed.check_index(spark, path).collect()} == {"index", "manifest"}
    assert {r["problem"] for r in packed.check_packed(spark, path).collect()} == {"index"}


def test_extract_and_damage(spark, tmp_path):
    names = [f"model.layers.{i}.mlp.w" for i in range(3)] + ["model.norm"]
    blocks = [(t, [4, 4], b, [float((i * 7 + b * 3 + x * 5) % 11 - 5) for x in range(8)]) for i, t in enumerate(names) for b in range(2)]
    weights = spark.createDataFrame(blocks, "tensor string, shape array<int>, block long, weight array<float>")
    grads = weights.select(F.lit("checkpoint_full").alias("ckpt"), "tensor", "shape", "block", F.col("weight").alias("grad"))
    target = str(tmp_path / "run")
    stats = workflows.extract_and_damage(grads, weights, [0.05, 0.2], target, block_size=8).collect()
    assert len(stats) == 6 and sum(r["top_n"] for r in stats) == 3 + 12
    damaged = spark.read.parquet(f"{target}/damaged")
    assert damaged.count() == 4 * weights.count()
    selected = tensors.read_selected(spark, f"{target}/selected")
    assert selected.select(F.sum(F.size("indices"))).first()[0] == 15
    assert tensors.read_stats(spark, f"{target}/stats").count() == 6
    assert spark.read.option("header", True).csv(f"{target}/preview").columns[:4] == ["Layer", "K Value", "Index Count", "Indices"]


def test_result_reports(spark):
    rows = [("d", "original", "original", 0.0, "b0", 1), ("d", "c1", "top", 0.1, "b0", 0), ("d", "c1", "bottom", 0.1, "b0", 1)]
    scores = spark.createDataFrame(rows, "dataset string, ckpt string, side string, k double, benchmark string, correct int")
    runs = scores.filter("side <> 'original'").unionByName(scores.filter("side = 'top'").withColumn("ckpt", F.lit("c1_damage")))
    expected = results.expected_cells(runs, [0.1], ["b0", "b1"])
    assert expected.count() == 4 + 2
    missing = {(r["side"], r["benchmark"]) for r in results.missing_cells(scores, expected).collect()}
    assert missing == {("original", "b1"), ("top", "b1"), ("bottom", "b1")}
    matrix = {r["side"]: (r["b0"], r["b1"]) for r in results.change_matrix(scores, ["b0", "b1"]).collect()}
    assert matrix == {"top": (-1.0, None), "bottom": (0.0, None)}


@pytest.mark.parametrize("local", [True, False])
def test_rows_with_repeated_and_null_keys_stay_apart(spark, local):
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, id int")
    rows = [(1, [["a", "b"]]), (1, [["c"]]), (None, [["a"]]), (2, []), (3, [[], ["z"]])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<array<string>>")
    got = tokens.encode_tokens(df, vocab, 0, local=local).collect()
    want = [(1, [[3, 4]]), (1, [[5]]), (None, [[3]]), (2, []), (3, [[], [0]])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    flat = spark.createDataFrame([(1, [3, 4]), (1, [5]), (None, [3])], "doc_id long, ids array<int>")
    texts = [r["text"] for r in tokens.decode_ids(flat, vocab, local=local).collect()]
    assert sorted(texts) == ["a", "a b", "c"]


def test_opening_goes_to_the_first_turn(spark):
    turns = spark.createDataFrame(
        [(1, 1, "user", "x"), (1, 2, "assistant", "y"), (None, 3, "user", "z")], "conv_id long, turn long, role string, text string"
    )
    template = chat.TEMPLATES["header"]
    got = {(r["conv_id"], r["turn"]): r["content"] for r in corpus.chat_turns(turns, template).collect()}
    assert {k for k, c in got.items() if c.startswith(template.opening)} == {(1, 1), (None, 3)}


def test_null_keys_are_done_once(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "id long")
    assert [r["id"] for r in done.not_done(df, df.filter("id is null or id = 1"), ["id"]).collect()] == [2]


def test_cap_is_stated(spark):
    samples = spark.range(10).withColumnRenamed("id", "sample_id")
    assert packing.cap_samples(samples, 4).count() == 4 and packing.cap_samples(samples, None).count() == 10


def test_extraction_keeps_checkpoints_of_any_name(spark):
    blocks = spark.createDataFrame(
        [("c_damage_study", "model.layers.0.mlp.up_proj.weight", [2, 2], 0, [1.0, 2.0, 3.0, 4.0])],
        "ckpt string, tensor string, shape array<int>, block long, vals array<float>",
    )
    assert region.tensor_meta(blocks).count() == 1


def test_lookup_split_by_frequency(spark, monkeypatch):
    """Few counters and many values: frequent, rare, unknown and empty ones, each found once per row."""
    rng = random.Random(3)
    words = ["the"] * 400 + [f"w{i}" for i in range(900)]
    docs = [(i % 40 or None, [rng.choices(words, k=rng.randint(0, 12)) for _ in range(rng.randint(0, 4))]) for i in range(300)] + [(1, None), (2, [[]])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<array<string>>").repartition(4)
    vocab = {w: i + 1 for i, w in enumerate(sorted(set(words))) if i % 9}
    table = spark.createDataFrame(list(vocab.items()), "token string, id int")
    monkeypatch.setattr(tokens._look_up, "__defaults__", (20,))
    often = {r["v"]: r["n"] for r in tokens.frequent_values(df, "tokens", 20).collect()}
    true = Counter(w for _, d in docs for s in d or [] for w in s)
    assert "the" in often and len(often) <= 20 and all(n <= true[w] for w, n in often.items())
    got = tokens.encode_tokens(df, table, 0, local=False).collect()
    want = [(k, [[vocab.get(w, 0) for w in s] for s in d or []]) for k, d in docs]
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in got))) == sorted(map(repr, want))
    flat = spark.createDataFrame([(k, [x for s in d for x in s]) for k, d in want], "doc_id long, ids array<int>").repartition(3)
    back, spelled = tokens.decode_ids(flat, table, special=[0], local=False).collect(), {i: w for w, i in vocab.items()}
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back))) == sorted(
        map(repr, ((k, " ".join(spelled[x] for s in d for x in s if x)) for k, d in want))
    )
