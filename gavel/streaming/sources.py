"""Streams over the given tables and helpers to run a stream to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import run_dir
from gavel.sources.tables import TABLES
from gavel.streaming.state import use_durable_state


def read_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a file stream. Event times become zoned timestamps, as watermarks need."""
    reader = spark.readStream.schema(TABLES[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The bracket makes the path a pattern, so that a single file and a folder both work.
    df = reader.parquet(f"{directory.rstrip('/')}/{name}.parque[t]")
    zoned = [F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
    return df.select(*zoned)


def drain_append(stream: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Run all available input through an append-mode file sink and read the result.

    With a ``folder`` (shared by all executors) the result and the checkpoint stay there: the next call on it goes on
    where the last committed batch ended, also after the process was killed.
    """
    spark = stream.sparkSession
    use_durable_state(spark)
    at = folder or run_dir(spark, purpose)
    out, check = f"{at}/rows", f"{at}/checkpoint"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_complete(stream: DataFrame, purpose: str) -> DataFrame:
    """Run all available input in complete mode; every batch writes its own folder and the newest
    one is the result, so a repeated batch overwrites only itself."""
    spark = stream.sparkSession
    out, check = run_dir(spark, purpose), run_dir(spark, f"{purpose}-checkpoint")
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last.append(batch_id)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", check).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(last)}")
