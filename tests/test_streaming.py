"""Incremental scoring equals batch scoring over the same files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from evalspark.operators import scoring as E
from evalspark.plans import bindings as B
from evalspark.streaming import scoring as S


def test_stream_matches_batch(spark, sf_small, tmp_dir):
    gen = B.generated_text(spark, sf_small).select(
        F.col("id").cast("string").alias("id"), "method", "task", "label", "generated_text")
    src = os.path.join(tmp_dir, "generated")
    # Two drops of files, as a generator would write them.
    gen.filter(F.col("id") % 2 == 0).write.json(os.path.join(src, "part-a"))
    gen.filter(F.col("id") % 2 == 1).write.json(os.path.join(src, "part-b"))
    stream = S.generated_text_stream(spark, os.path.join(src, "*"), extra_cols="method string")
    q = S.start_accuracy_sink(S.running_accuracy(stream, ["method"]), "acc_test",
                              checkpoint=os.path.join(tmp_dir, "ckpt"))
    try:
        q.processAllAvailable()
        got = {(r.method, r.task): (r.n, r.accuracy)
               for r in spark.sql("select * from acc_test").collect()}
    finally:
        q.stop()
    batch = E.task_accuracy(E.score_predictions(gen), ("method",))
    want = {(r.method, r.task): (r.n, r.accuracy) for r in batch.collect()}
    assert got == want and len(want) == 16
