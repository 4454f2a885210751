"""New trace files as a stream: parsed, normalised and scanned as they arrive; an extension, as stored scans are batch jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import channels as ops
from ..signals import trace
from ..sources import abif

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.fsa", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(_FILES).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)


def peaks_of(files: DataFrame, how: trace.Scan = trace.CHANNEL_SCAN) -> DataFrame:
    """Peaks of files (path, content) of one batch; a file is whole in itself, so there is no state between batches."""
    own = abif.assays(abif.channels(abif.parse_files(files)))
    return ops.scan(ops.normalise(own), how)


def scan_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, how: trace.Scan = trace.CHANNEL_SCAN, available_now: bool = True) -> StreamingQuery:
    """Appends the peaks of new files to a Parquet table; a batch that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        peaks_of(batch, how).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = file_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
