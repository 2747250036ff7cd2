"""Files that arrive as a stream: markers as they come, and tables kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gnomon.operators.insights import FINDING, todos


def source(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def marker_counts(stream: DataFrame, time: str = "ingested_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Marker lines per repository and window of arrival, late files accepted up to `late`."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    found = F.regexp_count("content", F.lit(r"(?i)#\s*(TODO|FIXME|HACK|XXX)\b"))
    return s.groupBy(F.window("_t", window), "repo").agg(F.sum(F.coalesce(found, F.lit(0))).alias("markers"), F.count("*").alias("files")).select(F.col("window.start").alias("start"), "repo", "files", "markers")


def keep_findings(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Marker findings of each batch go to `write` with the batch's number, which makes rewriting a batch harmless."""

    def each(batch: DataFrame, number: int) -> None:
        write(todos(batch).select(*FINDING), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(counts: DataFrame, folder: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and gives its last complete result, kept below `folder`."""
    out = f"{folder}/result"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.parquet(out)
