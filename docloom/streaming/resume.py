"""Incremental translation: new chunk files are translated as they arrive, each text once.

A micro-batch is the unit of durability: its results are written before its offsets are, and a batch that is run
again after a failure finds them and asks only for what is missing. Rate limits are kept by maxFilesPerTrigger, the
trigger's interval and the translator's own pauses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import state

RESULTS = "source_hash string, model string, target_lang string, translation string, status string, stored_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results; none where nothing has been stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).parquet(path)


def stream_translations(
    spark: SparkSession, chunks_path: str, schema: str, results_path: str, checkpoint: str, translator: Callable[[DataFrame], DataFrame], model: str, target_lang: str, max_files: int = 1, interval: str | None = None,
) -> StreamingQuery:
    """Start the query; without an interval it ends when all that is there has been done."""
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(chunks_path)

    def one(batch: DataFrame, _: int) -> None:
        todo = state.pending(batch, read_results(batch.sparkSession, results_path), model, target_lang).select("source_hash", "source_text").dropDuplicates(["source_hash"])
        done = translator(todo).filter(F.col("translation").isNotNull())
        done.select("source_hash", F.lit(model).alias("model"), F.lit(target_lang).alias("target_lang"), "translation", F.lit("done").alias("status"), F.current_timestamp().alias("stored_at")).write.mode("append").parquet(results_path)

    writer = chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def job_events(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events (at, job_id, type) of a stream counted by window and type; later than the watermark ones are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "type").agg(F.count(F.lit(1)).alias("n"))

