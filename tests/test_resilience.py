"""Jobs survive failed task attempts: a retried task recomputes the same rows.

The test session allows one retry per task (``local[4,2]``); these tests
fail the first attempt of chosen tasks and check the results are exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.operators import scoring as E
from evalspark.operators.common import dense_position


def test_generation_survives_a_failed_attempt(spark):
    def flaky_factory():
        def gen(prompts):
            from pyspark import TaskContext
            ctx = TaskContext.get()
            if ctx is not None and ctx.attemptNumber() == 0 and ctx.partitionId() in (0, 2):
                raise RuntimeError("injected failure on the first attempt")
            return [p.upper() for p in prompts]
        return gen

    rows = [(str(i), "boolq", "true", i, f"prompt {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, task string, label string, pos long, prompt string")
    out = E.generate_batches(df.repartition(4), flaky_factory, batch_size=3).collect()
    assert sorted(r.generated_text for r in out) == sorted(f"PROMPT {i}" for i in range(40))


def test_positions_survive_a_failed_attempt(spark):
    @F.pandas_udf("long")
    def flaky_identity(v: pd.Series) -> pd.Series:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        if ctx is not None and ctx.attemptNumber() == 0 and ctx.partitionId() == 1:
            raise RuntimeError("injected failure on the first attempt")
        return v

    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("grp"),
        ((F.col("id") * 7919) % 2000).alias("key")).repartition(6)
    got = dense_position(df, ["key"], ["grp"], out="p").withColumn("p", flaky_identity("p"))
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("grp").orderBy("key")) - 1)
    assert sorted(got.collect()) == sorted(want.collect())
