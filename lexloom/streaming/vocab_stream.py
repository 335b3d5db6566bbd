"""Streaming vocabulary counts and incremental classification over a growing folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import tokens


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int | None = None) -> DataFrame:
    """files: how many files a micro-batch takes; by default as many as tasks run at once, so that no batch leaves cores idle."""
    files = files or max(1, spark.sparkContext.defaultParallelism)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def vocabulary_counts(docs: DataFrame) -> DataFrame:
    """token, freq over all rows so far (complete or update mode)."""
    return docs.filter("text is not null").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def windowed_counts(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts of tumbling windows; rows later than the watermark allows are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_once(df: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Process all that is there, one table per micro-batch under path, and return the last: the whole result in complete mode."""
    last = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last[:] = [number]

    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    return spark.read.parquet(f"{path}/batch-{last[0]}") if last else spark.createDataFrame([], df.schema)


def append_labelled(df: DataFrame, label, path: str, checkpoint: str):
    """Write every micro-batch, labelled by a batch function, as one appended Parquet set; reruns of a batch replace it."""

    def sink(batch: DataFrame, number: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
