"""Session helpers: local test session, written checkpoints, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_ROWS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folders: dict[str, str] = {}  # temporary folder of each local application that names none


def local_session(cores: int | str = 8, app: str = "zygospark") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are small but compute-heavy: keep one task per core after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Driver-side rows as a local relation: exact statistics, no Python workers."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def _shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the session's `spark.checkpoint.dir`.

    Only a local session without one gets a temporary folder, one per application.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="zygospark-checkpoint-")
    return _local_folders[app]


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they are done."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """A Parquet table in the shared folder, for data that is read several times.

    Cuts lineage like a reliable checkpoint, but computes the data once, keeps
    column pruning and pushdown, and gives the optimizer the true size.  The
    shuffle files that made it are deleted when it is done.
    """
    path = f"{_shared_folder(df.sparkSession)}/zygospark-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count proves that a table has at most max_rows rows."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def when_small(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint for a table already known to be small."""
    return F.broadcast(df) if small else df


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a count proves the side small.

    Larger sides come back unchanged: the join is then shuffled and adaptive
    execution splits skewed partitions.  Meant for reference tables (kits,
    chain segments, query lists), whose count is cheap next to a scan of calls.
    """
    return when_small(df, is_small(df, max_rows))
