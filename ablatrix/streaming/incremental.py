"""Rewriting newly arrived JSONL files only, as a file stream.

The stream's checkpoint records which files are done, so a re-run does only the new ones.
The rewrite is a stateless projection and is the same as in a batch run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..operators.corruption import GENERIC, REGISTRY, Rewrite, corrupt_corpus
from ..sources.jsonl import parse_qa_lines, qa_line


def corrupt_new_files(
    spark: SparkSession, source: str, target: str, progress: str,
    registry: Mapping[str, Rewrite] = REGISTRY, fallback: Rewrite = GENERIC,
) -> None:
    """Process every file under ``source`` that ``progress`` does not know yet, then stop."""
    lines = spark.readStream.schema("value string").text(source)
    rewritten = corrupt_corpus(parse_qa_lines(lines), registry, fallback)
    query = (
        rewritten.select(qa_line(rewritten).alias("value"))
        .writeStream.format("text")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
