"""Run summary (F1-F4): metrics rows + optional metadata -> one summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trainable_percentage(trainable: str = "trainable_parameters",
                         total: str = "total_parameters"):
    """t / total * 100, 0.0 when total <= 0 (guarded: ANSI raises on /0)."""
    t, n = F.col(trainable), F.col(total)
    return F.when(n > 0, t.cast("double") / n.cast("double") * 100.0).otherwise(F.lit(0.0))


def attach_metadata(metrics: DataFrame, metadata: DataFrame | None,
                    key: str = "run_dir") -> DataFrame:
    """left join per run; counts and percentage only when *both* counts exist."""
    if metadata is None:
        return metrics
    cols = set(metadata.columns)
    if not {"trainable_parameters", "total_parameters"} <= cols:
        return metrics
    meta = metadata.select(
        key,
        F.col("trainable_parameters").cast("long").alias("_t"),
        F.col("total_parameters").cast("long").alias("_n"))
    both = F.col("_t").isNotNull() & F.col("_n").isNotNull()
    base = metrics.drop("trainable_parameters", "total_parameters", "trainable_percentage")
    joined = base.join(meta, key, "left")
    return (joined
            .withColumn("trainable_parameters", F.when(both, F.col("_t")))
            .withColumn("total_parameters", F.when(both, F.col("_n")))
            .withColumn("trainable_percentage",
                        F.when(both, trainable_percentage("_t", "_n")))
            .drop("_t", "_n"))


def empty_summary(spark: SparkSession) -> DataFrame:
    """no runs -> just the ``run_name, macro_average`` header."""
    schema = T.StructType([T.StructField("run_name", T.StringType()),
                           T.StructField("macro_average", T.DoubleType())])
    return spark.createDataFrame([], schema)


def summarize_runs(metrics: DataFrame | None, metadata: DataFrame | None = None,
                   key: str = "run_dir", spark: SparkSession | None = None,
                   keep_key: bool = False) -> DataFrame:
    """all keys over all runs, columns in code-point order, missing -> null.

    ``metrics`` is the (schema-merged) metrics scan; ``None`` means no run
    was found and yields :func:`empty_summary`.
    """
    if metrics is None:
        if spark is None:
            raise ValueError("need a session to build the empty summary")
        return empty_summary(spark)
    out = attach_metadata(metrics, metadata, key)
    if not keep_key:
        out = out.drop(key)
    return out.select(*sorted(out.columns))
