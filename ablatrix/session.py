"""Session helpers: local sessions for tests, the shared folder, small-table handling."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# What a table may have at most to be kept as a local relation and broadcast.
SMALL_ROWS = 200_000
SMALL_BYTES = 64 * 2**20


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ablatrix")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a cluster
    a machine-local folder would lose data with the machine, so the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ablatrix-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share rows out when the input has fewer splits than there are task slots.

    A large input has many splits and is left as it is, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, key)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several passes read the same expensive rows; survives executor loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> tuple[DataFrame, list | None]:
    """Evaluate a table that is expected to be small: once if it is, twice if not.

    Within the bounds it becomes a local relation marked for broadcast: its size is known then,
    not guessed. Beyond them it is computed again and checkpointed in the shared folder, and joins
    are left to the planner. Returns the table and its rows when local.
    """
    spark = df.sparkSession
    # Below another operator the limit is one job, not a search partition by partition.
    head = df.limit(max_rows + 1).coalesce(1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= max_bytes:
        return F.broadcast(spark.createDataFrame(head, df.schema)), head.to_pylist()
    shared_dir(spark)
    return df.checkpoint(), None


def small_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A local relation of rows already in the driver, marked for broadcast."""
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema)]
    return F.broadcast(spark.createDataFrame(pa.table(columns, schema.names), schema))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps null keys together; ``right`` contributes only its other columns."""
    if not on:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = None
    for c in on:
        part = left[c].eqNullSafe(renamed[f"__r_{c}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def typed_nulls(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns that ``df`` lacks as typed nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df
