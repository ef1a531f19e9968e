"""Continuous import: files landing in a folder are imported as kits, once each."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zygospark.session import small_table
from zygospark.sources.importer import SAME_SOURCE, Options, import_files


REJECTED = "file string, reason string"
FOUND = "path string, modificationTime timestamp, length bigint, content binary"


def _import_or_reject(spark: SparkSession, root: str, files: list[str], options: Options | None) -> None:
    """Import files together; if that fails, one by one, and note those that fail."""
    try:
        import_files(spark, root, files, options, replace=SAME_SOURCE)
    except ValueError as e:
        if len(files) == 1:
            small_table(spark, [(files[0], str(e))], REJECTED).write.mode("append").parquet(f"{root}/rejected")
        else:
            for f in files:
                _import_or_reject(spark, root, [f], options)


def ingest_folder(
    spark: SparkSession, landing: str, root: str, checkpoint: str, options: Options | None = None
) -> StreamingQuery:
    """Start a file stream that runs the import job on every new file.

    The header of a file is needed to read its body, so a micro-batch only names
    the new files and the batch import reads them whole.  A batch that is run
    again after a failure replaces the kits that came from the same files.
    Files that cannot be imported are set aside with the reason in the table
    `rejected` of the store, and do not hold up the others.
    """
    # Only names are taken: a file's content column is never read here.
    found = spark.readStream.format("binaryFile").schema(FOUND).load(landing).select(F.col("_metadata.file_path").alias("file"))

    def run(batch: DataFrame, _: int) -> None:
        files = [unquote(r.file) for r in batch.distinct().collect()]  # new file names of one batch
        if files:
            _import_or_reject(batch.sparkSession, root, sorted(files), options)

    return (
        found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
