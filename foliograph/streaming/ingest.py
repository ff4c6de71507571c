"""Files as they arrive: a stream of new files, each content once, in micro-batches through the same guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliograph.config import Settings
from foliograph.sources import files


def arriving(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """The scan of sources.files as a stream; contents seen within `delay` are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    named = stream.withColumn("sha256", F.sha2("content", 256)).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return named.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"]).withColumn("doc_id", F.col("sha256"))


def ingest(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, DataFrame, int], None], settings: Settings | None = None) -> StreamingQuery:
    """Run all files that are there, then stop; handle gets (accepted, quarantine, batch id) and must be idempotent by batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        accepted, refused = files.guarded(df, settings)
        handle(accepted, refused, epoch)

    return arriving(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
