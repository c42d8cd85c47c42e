"""Scoring (E1-E7) and run summaries (F1-F4) on literal rows."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from evalspark.operators import runs as R
from evalspark.operators import scoring as E

JOB_ERRORS = (PySparkException, Py4JJavaError)


def test_parse_task_selection():
    assert E.parse_task_selection(None) is None
    assert E.parse_task_selection(" , ") is None
    assert E.parse_task_selection("BOOLQ, arc-easy") == ("boolq", "ARC-Easy")
    assert E.parse_task_selection(["piqa", "hellaswag,winogrande"]) == (
        "piqa", "hellaswag", "winogrande")
    assert len(E.parse_task_selection("all")) == 8
    with pytest.raises(ValueError):
        E.parse_task_selection("all,boolq")
    with pytest.raises(ValueError):
        E.parse_task_selection("mmlu")


def test_select_tasks_default_is_run_list(spark):
    df = spark.createDataFrame([("boolq", ["boolq"]), ("piqa", ["boolq"])],
                               "task string, tasks array<string>")
    assert E.select_tasks(df, None, spec_tasks_col="tasks").count() == 1
    assert E.select_tasks(df, "piqa").count() == 1


def test_score_and_accuracy(spark):
    rows = [("r", "boolq", "true", "  The answer is TRUE.\n"),
            ("r", "boolq", "false", "true"),
            ("r", "piqa", "solution1", "solution1"),
            ("r", "piqa", "solution2", "")]
    df = spark.createDataFrame(rows, "run string, task string, label string, generated_text string")
    scored = E.score_predictions(df)
    got = scored.collect()
    assert got[0].generated_text == "The answer is TRUE."
    assert [r.prediction for r in got] == ["true", "true", "solution1", ""]
    assert [r.correct for r in got] == [True, False, True, False]
    acc = {r.task: r.accuracy for r in E.task_accuracy(scored, ("run",)).collect()}
    assert acc == {"boolq": 0.5, "piqa": 0.5}


def test_macro_average_and_wide(spark):
    acc = spark.createDataFrame([("r", "boolq", 0.5), ("r", "piqa", 1.0)],
                                "run string, task string, accuracy double")
    m = E.macro_average(acc, ("run",)).collect()[0]
    assert (m.macro_average, m.n_tasks) == (0.75, 2)
    wide = E.run_metrics(acc, ("run",)).collect()[0]
    assert wide.boolq == 0.5 and wide.piqa == 1.0 and wide.hellaswag is None
    assert wide.macro_average == 0.75


def test_empty_requested_task_raises(spark):
    df = spark.createDataFrame([("r", "boolq", True)], "run string, task string, correct boolean")
    with pytest.raises(JOB_ERRORS):
        E.task_accuracy(df, ("run",), requested=["boolq", "piqa"]).collect()


def test_batch_slices_last_short(spark):
    df = spark.createDataFrame([("t", i) for i in range(10)] + [("u", i) for i in range(3)],
                               "task string, pos long")
    rows = E.batch_slices(df, 4).collect()
    t_batches = sorted((r.pos, r.batch, r.batch_offset) for r in rows if r.task == "t")
    assert [b for _, b, _ in t_batches] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert [o for _, _, o in t_batches][-2:] == [0, 1]
    assert sorted(r.batch for r in rows if r.task == "u") == [0, 0, 0]


def test_generate_batches(spark):
    # Defined here so it ships to the Python workers by value.
    def _echo_factory():
        def gen(prompts):
            return [p.upper() for p in prompts]
        return gen

    df = spark.createDataFrame([(str(i), "boolq", "true", i, f"p{i}") for i in range(7)],
                               "id string, task string, label string, pos long, prompt string")
    out = E.generate_batches(df, _echo_factory, batch_size=3).collect()
    assert sorted(r.generated_text for r in out) == [f"P{i}" for i in range(7)]
    assert E.eval_batch_size  # device rule is a column expression


def test_trainable_percentage_and_metadata(spark):
    metrics = spark.createDataFrame([("a", 0.5), ("b", 0.6), ("c", 0.7)],
                                    "run_dir string, macro_average double")
    meta = spark.createDataFrame([("a", 100, 1000), ("b", 5, 0), ("c", 7, None)],
                                 "run_dir string, trainable_parameters long, total_parameters long")
    got = {r.run_dir: r for r in R.attach_metadata(metrics, meta).collect()}
    assert got["a"].trainable_percentage == 10.0
    assert got["b"].trainable_percentage == 0.0
    assert got["c"].trainable_parameters is None and got["c"].trainable_percentage is None


def test_summary_columns_sorted_and_empty(spark):
    metrics = spark.createDataFrame([("a", "r1", 0.5)], "run_dir string, run_name string, zeta double")
    s = R.summarize_runs(metrics)
    assert s.columns == sorted(s.columns) and "run_dir" not in s.columns
    empty = R.summarize_runs(None, spark=spark)
    assert empty.columns == ["run_name", "macro_average"] and empty.count() == 0


def test_dense_position_skewed_groups(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from evalspark.operators.common import dense_position
    # One group holds a third of the rows; rows arrive shuffled over many partitions.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("grp"),
        (F.col("id") * 7919 % 3000).alias("key")).repartition(13)
    got = dense_position(df, ["key"], ["grp"], out="p")
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("grp").orderBy("key")) - 1)
    a = sorted((r.grp, r.key, r.p) for r in got.collect())
    b = sorted((r.grp, r.key, r.p) for r in want.collect())
    assert a == b
    flat = dense_position(df, ["grp", "key"], out="p")
    ps = sorted(r.p for r in flat.collect())
    assert ps == list(range(3000))


def test_generators_of_one_maker_stay_apart(spark):
    from functools import partial

    from evalspark.operators.scoring import generate_batches

    def maker(tag):
        return lambda: lambda prompts: [f"{tag}:{p}" for p in prompts]

    def build(tag):
        return lambda prompts: [f"{tag}:{p}" for p in prompts]

    df = spark.createDataFrame([("1", "x")], "id string, prompt string")
    for factory, tag in ((maker("a"), "a"), (maker("b"), "b"), (partial(build, "c"), "c"), (partial(build, "d"), "d")):
        assert generate_batches(df, factory).first()["generated_text"] == f"{tag}:x"
