"""Structured Streaming over prediction shards (S8 -> A3 as a stream).

Inference jobs drop JSON-lines shards into a folder; this keeps the mean
prediction per (gene, tf) up to date as shards arrive. State is one
(sum, count) per pair in the state store, checkpointed to the given folder,
so the query resumes after a failure without re-reading processed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqedge.sources.readers import PREDICTION_SCHEMA


def prediction_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``gene, tf, prediction`` from JSON-lines shards."""
    r = spark.readStream.schema(PREDICTION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.json(source_dir)
    return s.select(F.col("gene_id").alias("gene"), F.col("DBID").alias("tf"),
                    F.when(F.isnan("prediction"), None).otherwise(F.col("prediction")).alias("prediction"))


def running_mean_by_pair(stream: DataFrame) -> DataFrame:
    """A3 on a stream: running mean and count per (gene, tf)."""
    return (stream.filter(F.col("prediction").isNotNull()).groupBy("gene", "tf")
            .agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n")))


def start_mean_by_pair(spark: SparkSession, source_dir: str, checkpoint: str, sink: str = "memory",
                       query_name: str = "pair_means", output_path: str | None = None,
                       trigger_once: bool = False) -> StreamingQuery:
    """Start the running-mean query. ``sink='memory'`` (tests) exposes table
    ``query_name``; ``sink='parquet'`` rewrites a snapshot of the current
    means to ``output_path`` at every micro-batch (``foreachBatch``)."""
    agg = running_mean_by_pair(prediction_stream(spark, source_dir))
    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").queryName(query_name).start()
    if sink == "parquet":
        if not output_path:
            raise ValueError("output_path is required for the parquet sink")
        return w.foreachBatch(lambda df, _epoch: df.write.mode("overwrite").parquet(output_path)).start()
    raise ValueError(f"unknown sink {sink!r}")
