"""Incremental scoring: the E4 + E5 plan over prediction files as they land.

The reference scores a finished list; here the same operators run on a
Structured Streaming file source, so per-(run, task) accuracy is kept up to
date while generation is still writing files. State is one row per
(run, task) -- bounded by the number of runs x tasks, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.scoring import score_predictions
from evalspark.session import scratch_path

GENERATED_SCHEMA = "id string, task string, label string, generated_text string"


def generated_text_stream(spark: SparkSession, path: str, schema: str = GENERATED_SCHEMA,
                          extra_cols: str = "", max_files_per_trigger: int | None = None
                          ) -> DataFrame:
    """A file stream of generated-text JSONL records (schema required)."""
    full = schema + (", " + extra_cols if extra_cols else "")
    reader = spark.readStream.schema(full)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def running_accuracy(stream: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Score each record and keep counts per (run, task); accuracy is derived
    from the running sums, so it equals the batch ``task_accuracy``."""
    scored = score_predictions(stream)
    agg = scored.groupBy(*run_cols, "task").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("long")).alias("n_correct"))
    return agg.withColumn("accuracy", F.col("n_correct").cast("double") / F.col("n"))


def start_accuracy_sink(acc: DataFrame, query_name: str, checkpoint: str | None = None,
                        output_mode: str = "complete", sink: str = "memory",
                        available_now: bool = False) -> StreamingQuery:
    """Start the stream. The checkpoint lives under the shared checkpoint root
    (``spark.checkpoint.dir``), so a restarted driver resumes where it stopped."""
    spark = acc.sparkSession
    location = checkpoint or scratch_path(spark, f"stream-{query_name}")
    writer = (acc.writeStream.outputMode(output_mode).format(sink)
                 .queryName(query_name).option("checkpointLocation", location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
