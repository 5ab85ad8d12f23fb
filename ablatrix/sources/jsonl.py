"""JSONL sources and sinks for QA corpora, and raw text lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..session import setting, small_table, typed_nulls

# The fields of a QA row, the splits, and the folder that holds them.
QA_SCHEMA = {
    "question_type": "string",
    "context": "string",
    "question": "string",
    "options": "array<string>",
    "answer": "string",
}
SPLITS = ("train", "dev", "test")
SPLIT_FOLDER = "original"
# Files a task writes at a time; one that meets more folders sorts the rest of its rows by folder.
OPEN_FILES = 64


def _entries(line: Column) -> Column:
    """The members of a line's object as ``key``, ``json`` and ``value``; null unless it is one JSON object.

    ``json`` is what stands in the line, so ``1.0`` stays ``1.0``; ``value`` is the same with strings as plain
    text. Of repeated keys the last counts.
    """
    # One object per line: inside brackets, trailing text makes the whole array invalid.
    wrapped = F.concat(F.lit("["), line, F.lit("]"))

    def parsed(kind: str) -> Column:
        return tx.let(F.from_json(wrapped, f"array<map<string,{kind}>>"), lambda p: F.when(F.size(p) == 1, F.try_element_at(p, F.lit(1))))

    # Variants tell strings from the rest, but forget how numbers were written; plain texts know that. Only strings are
    # written again as JSON: a variant writes each element of a list by a generator of its own.
    def by_variants(texts: Column) -> Column:
        return F.zip_with(F.map_entries(parsed("variant")), F.map_values(texts), lambda e, t: F.struct(
            e["key"].alias("key"), F.when(F.schema_of_variant(e["value"]) == "STRING", F.to_json(e["value"])).otherwise(F.coalesce(t, F.lit("null"))).alias("json"),
            t.alias("value"),
        ))

    # The looks of the texts tell as well, if the members written so are the line: equal texts are read alike. Most lines are
    # the very text; of others spaces don't count, and numbers and lists are looked for among the strings.
    def by_looks(texts: Column, line: Column | None = None) -> Column:
        return F.transform(F.map_entries(texts), lambda e: F.struct(
            e["key"].alias("key"), _likely_json(e["value"], line).alias("json"), e["value"].alias("value"),
        ))

    def without_spaces(text: Column) -> Column:
        return F.replace(text, F.lit(" "), F.lit(""))

    def other(texts: Column) -> Column:
        return tx.let(without_spaces(line), lambda bare: tx.let(by_looks(texts, bare), lambda es: (
            F.when(without_spaces(_object(es)) == bare, _last_of_key(es)).otherwise(tx.let(by_variants(texts), _last_of_key))
        )))

    # What ``let`` returns is copied, so few hand on the long texts.
    return tx.let(parsed("string"), lambda texts: tx.let(by_looks(texts), lambda es: (
        F.when(_object(es) == line, _last_of_key(es)).otherwise(other(texts))
    )))


def _last_of_key(entries: Column) -> Column:
    """Of repeated keys the last, at its own place."""
    keys = F.transform(entries, lambda e: e["key"])
    last = tx.let(F.reverse(keys), lambda back: F.filter(entries, lambda e, i: F.array_position(back, e["key"]) == F.size(entries) - i))
    return F.when(F.size(F.array_distinct(keys)) == F.size(entries), entries).otherwise(last)


def _likely_json(value: Column, line: Column | None) -> Column:
    """The JSON that a member's plain text most likely comes from, given the line without spaces or not.

    What holds an object counts as a string here.
    """
    listed = F.startswith(value, F.lit("[")) & ~F.contains(value, F.lit("{"))
    plain = (F.octet_length(value) < 40) & F.rlike(value, F.lit(r"^(?:-?\d{1,18}(?:\.\d{1,18})?|true|false)\z"))
    unquoted = listed | plain
    if line is not None:
        unquoted = unquoted & ~F.contains(line, F.concat(F.lit(':"'), F.when(listed, F.lit("[")).otherwise(F.concat(value, F.lit('"')))))
    return F.when(value.isNull(), F.lit("null")).when(unquoted, value).otherwise(json_of(value))


def json_of(value: Column) -> Column:
    """A value as JSON text, null included."""
    # Brackets are taken off as bytes, so that no signs are counted.
    listed = F.to_json(F.array(value)).cast("binary")
    return tx.let(listed, lambda b: F.substr(b, F.lit(2), F.octet_length(b) - 2).cast("string"))


def json_kind(json: Column) -> Column:
    """The first sign of a JSON text, with all numbers as ``0`` and both truth values as ``t``."""
    return tx.let(F.substring(json, 1, 1), lambda sign: (
        F.when(sign.isin('"', "[", "{", "n"), sign).when(sign.isin("t", "f"), F.lit("t")).otherwise(F.when(sign.isNotNull(), F.lit("0")))
    ))


def json_text(json: Column, value: Column) -> Column:
    """A JSON value as text: numbers with a fraction or exponent by ``tx.float_text``, ``True``, ``False``."""
    return tx.let(json_kind(json), lambda kind: (
        F.when(kind == "0", tx.float_text(value))
        .when(kind == "t", F.when(value == "true", F.lit("True")).otherwise(F.lit("False")))
        .when(kind != "n", value)
    ))


def _options(json: Column, value: Column) -> Column:
    """What going through the options gives: the elements of a list, the signs of a text, the keys of an object."""
    kinds = F.transform(F.from_json(value, "array<variant>"), lambda v: F.to_json(v))
    # Written again, a list of strings alone is the same text: its elements have no kinds to tell.
    elements = tx.let(F.from_json(value, "array<string>"), lambda plain: (
        F.when(F.to_json(plain) == value, plain).otherwise(F.zip_with(kinds, plain, json_text))
    ))
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    return tx.let(json_kind(json), lambda kind: (
        F.when(kind == "[", elements)
        .when(kind == '"', signs)
        .when(kind == "{", F.map_keys(F.from_json(value, "map<string,string>")))
    ))


def parse_qa_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text rows to QA columns; the text column is replaced.

    ``record`` carries the whole object as it was written, key by key, for ``qa_line``. Of the QA columns
    ``options`` is an array of texts, the others are texts whatever their JSON type. ``extras`` holds unknown
    fields as JSON, ``null_fields`` names fields present as an explicit null (a missing field is just null),
    ``_corrupt`` holds a line that is not one JSON object.
    """

    def fields(entries: Column) -> Column:
        def column_of(name: str) -> Column:
            member = F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))
            return tx.let(member, lambda e: (_options if name == "options" else json_text)(e["json"], e["value"]))

        record = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["json"].alias("json")))
        return F.struct(record.alias("record"), *[column_of(n).alias(n) for n in QA_SCHEMA])

    # Generated rather than projected, so that filters on the fields do not parse the line again.
    rows = lines.select("*", F.explode(F.array(tx.let(_entries(F.col(column)), fields))).alias("__obj"))
    record = F.col("__obj.record")
    unknown = F.filter(record, lambda e: ~e["key"].isin(list(QA_SCHEMA)))
    null_keys = F.transform(F.filter(record, lambda e: e["json"] == "null"), lambda e: e["key"])
    return rows.withColumns(
        {
            **{n: F.col(f"__obj.{n}") for n in QA_SCHEMA},
            "extras": F.when(F.size(unknown) > 0, _object(unknown)),
            "null_fields": F.when(record.isNotNull(), F.filter(F.array(*[F.lit(n) for n in QA_SCHEMA]), lambda n: F.array_contains(null_keys, n))),
            "record": record,
            "_corrupt": F.when(record.isNull(), F.col(column)),
        }
    ).drop("__obj", column)


def _object(entries: Column) -> Column:
    """Members as one JSON object."""
    members = F.transform(entries, lambda e: F.concat(json_of(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def qa_line(df: DataFrame) -> Column:
    """One JSON object per row, unknown fields included, text unescaped.

    With a ``record``, all it holds is written as it was, key by key, but for the columns that ``written``
    names: they take their places, or follow at the end, as do QA columns of rewritten rows that the record lacks.
    """
    if "record" in df.columns:
        return _patched(df)
    body = F.to_json(F.struct(*[n for n in QA_SCHEMA if n in df.columns]))
    if "extras" not in df.columns:
        return body
    merged = F.concat(
        F.substr(body, F.lit(1), F.length(body) - 1),
        F.when(body == "{}", F.lit("")).otherwise(F.lit(",")),
        F.substr(F.col("extras"), F.lit(2)),
    )
    return F.when(F.col("extras").isNull(), body).otherwise(merged)


def _patched(df: DataFrame) -> Column:
    if "written" not in df.columns:
        return _object(F.col("record"))
    columns = [n for n in ("context", "question", "options") if n in df.columns]

    def new(e: Column) -> Column:
        json = None
        for n in columns:
            hit = (e["key"] == n) & F.array_contains("written", n)
            json = F.when(hit, json_of(F.col(n))) if json is None else json.when(hit, json_of(F.col(n)))
        return F.struct(e["key"].alias("key"), (e["json"] if json is None else json.otherwise(e["json"])).alias("json"))

    keys = F.transform("record", lambda e: e["key"])
    added = F.array(*[F.when(~F.array_contains(keys, F.lit(n)), F.struct(F.lit(n).alias("key"), json_of(F.col(n)).alias("json"))) for n in columns])
    missing = F.filter(added, lambda e: e.isNotNull())
    return _object(F.concat(F.transform("record", new), missing))


def read_qa_file(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a JSONL file or folder, broken ones included under ``_corrupt``."""
    return parse_qa_lines(spark.read.text(path))


def read_abilities(spark: SparkSession, root: str) -> DataFrame:
    """All ``<ability>/original/{train,dev,test}.jsonl`` under ``root``, files or folders of files, with ``ability``
    and ``split``."""
    names = "{" + ",".join(SPLITS) + "}.jsonl"
    lines = (
        spark.read.text(f"{root.rstrip('/')}/*/{SPLIT_FOLDER}/{names}")
        .withColumn("__path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    )
    where = rf"([^/]+)/{SPLIT_FOLDER}/({'|'.join(SPLITS)})\.jsonl(?:/[^/]+)?$"
    return parse_qa_lines(
        lines.withColumns(
            {"ability": F.regexp_extract("__path", where, 1), "split": F.regexp_extract("__path", where, 2)}
        ).drop("__path")
    )


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON, one folder per ability and split."""
    df.write.mode(mode).partitionBy("ability", "split").json(path)


def write_qa(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """QA rows as JSON lines, one folder per ability and split, unknown fields kept.

    A task keeps a file open per folder, so whole lines are not sorted by folder and spilled. ``compression`` is a codec of
    Spark's text files, which readers know by the files' endings.
    """
    lines = df.select("ability", "split", qa_line(df).alias("value"))
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        writer = lines.write.mode(mode).partitionBy("ability", "split")
        (writer.option("compression", compression) if compression else writer).text(path)


def write_abilities(df: DataFrame, root: str, compression: str | None = None) -> None:
    """QA rows as ``<ability>/original/<split>.jsonl`` under ``root``, the layout ``read_abilities`` reads.

    Each ``.jsonl`` is a folder of files, written in one job under another name and moved folder by folder.
    A split that is there already raises an error, before anything is moved.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    staging = f"{root.rstrip('/')}/_writing-{uuid.uuid4().hex[:12]}"
    write_qa(df, staging, compression=compression)
    files = path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moves = []
    for ability in (s.getPath() for s in files.listStatus(path(staging)) if s.isDirectory()):
        name = unescaped(ability.getName().split("=", 1)[1])
        if "/" in name:
            raise ValueError(f"an ability can't be named {name!r}")
        for split in (s.getPath() for s in files.listStatus(ability)):
            moves.append((split, path(f"{root.rstrip('/')}/{name}/{SPLIT_FOLDER}/{unescaped(split.getName().split('=', 1)[1])}.jsonl")))
    for _, target in moves:
        if files.exists(target):
            raise FileExistsError(target.toString())
    for source, target in moves:
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"{source.toString()} could not be moved to {target.toString()}")
    files.delete(path(staging), True)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_qa`` or ``write_splits`` wrote."""
    return parse_qa_lines(spark.read.text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _one_slash(uri: Column) -> Column:
    """``file:///a`` and ``file:/a`` are the same path."""
    return F.regexp_replace(uri, "^([a-z0-9+.-]+):///(?!/)", "$1:/")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines per file, an unterminated last line included; an empty file has none."""
    lines = spark.read.option("lineSep", "\n").text(path)
    counts = lines.groupBy(_one_slash(F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("n_lines"))
    # A scan skips empty files; the listing has them.
    files = small_table(spark, [(f,) for f in sorted(lines.inputFiles())], StructType().add("file", "string"))
    files = files.select(_one_slash(F.col("file")).alias("file"))
    return files.join(counts, "file", "left").withColumn(
        "n_lines", F.coalesce("n_lines", F.lit(0).cast("bigint"))
    )


def as_qa(df: DataFrame) -> DataFrame:
    """Any table with some QA columns, the missing ones added as nulls."""
    return typed_nulls(df, QA_SCHEMA)
