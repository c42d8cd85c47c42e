"""Wrong or missing input fails the job, whichever columns are used later, and
nothing drops out silently."""

from __future__ import annotations

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import adapters as H
from evalspark.operators import compare as G
from evalspark.operators import configs as I
from evalspark.operators import scoring as E
from evalspark.operators import sequences as D
from evalspark.sources import readers, writers

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _weights(spark, modules):
    return spark.createDataFrame([(m, 0, [1.0, 2.0], [3.0], 1.0) for m in modules],
                                 "module string, row_idx int, w array<double>, b array<double>, m double")


def test_module_without_low_rank_rows_fails(spark):
    a = spark.createDataFrame([("m1", 0, [1.0, 1.0])], "module string, k int, a array<double>")
    x = spark.createDataFrame([("m2", 1, [1.0, 1.0])], "module string, x_id int, x array<double>")
    assert H.merge_lora(_weights(spark, ["m1"]), a, 2, 1).count() == 1
    for frame in (H.lowrank_delta(_weights(spark, ["m1", "m2"]), a, 2, 1),
                  H.merge_dora(_weights(spark, ["m1", "m2"]), a, 2, 1)):
        with pytest.raises(JOB_ERRORS):
            frame.select("row_idx").collect()
    with pytest.raises(JOB_ERRORS):
        H.project_lora(x, _weights(spark, ["m2"]), a, 2, 1).collect()


def _runs(spark, rows, schema="run_dir string, method string, scope string, v double"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.col("v").alias(t) for t in K.TASKS], F.col("v").alias("macro_average"))


def test_repeated_runs_count_once_by_first(spark):
    runs = _runs(spark, [("b", "lora", "full", 0.9), ("a", "lora", "full", 0.5), ("c", "dora", "full", 0.6)])
    gains = G.paired_gains(runs)
    assert gains.first()["macro_average"] == pytest.approx(0.1)
    row = G.scope_summary(runs, gains).first()
    assert (row["lora_macro"], row["dora_macro"]) == (0.5, 0.6)
    with pytest.raises(JOB_ERRORS):
        G.paired_gains(runs.drop("run_dir")).collect()


def test_unknown_names_fail_unselected(spark):
    with pytest.raises(JOB_ERRORS):
        G.label_conditions(_runs(spark, [("a", "lora", "nowhere", 0.5)])).select("macro_average").collect()
    specs = spark.createDataFrame([(["boolq", "chess"], 1)], "task_names array<string>, n int")
    with pytest.raises(JOB_ERRORS):
        I.validate_spec(specs).select("n").collect()


def test_training_rows_have_places_and_required_fields(spark, tmp_dir):
    path = os.path.join(tmp_dir, "train.json")
    rows = [{"instruction": f"i{k}", "output": "o"} for k in range(7)]
    with open(path, "w") as fh:
        json.dump(rows, fh)
    got = D.cap_samples(readers.read_training_json(spark, path), 3).orderBy("pos").collect()
    assert [(r["pos"], r["instruction"]) for r in got] == [(0, "i0"), (1, "i1"), (2, "i2")]
    bad = os.path.join(tmp_dir, "bad.json")
    with open(bad, "w") as fh:
        json.dump([{"output": "o"}], fh)
    with pytest.raises(JOB_ERRORS):
        readers.read_training_json(spark, bad).select("output").collect()


def test_samples_without_places_keep_file_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "piqa.jsonl")
    with open(path, "w") as fh:
        for k in range(2000):
            fh.write(json.dumps({"id": str(k), "task": "piqa", "instruction": f"i{k}",
                                 "choices": ["a", "b"], "label": "solution1"}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # several splits
    try:
        got = sorted((r["pos"], r["id"]) for r in readers.read_eval_samples(spark, path, 5).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k, str(k)) for k in range(5)]


def test_zip_rejects_bad_lines_and_lengths(spark, tmp_dir):
    def files(name, lines, labels):
        for part, content in (("r", lines), ("l", labels)):
            with open(os.path.join(tmp_dir, f"{name}.{part}"), "w") as fh:
                fh.write("\n".join(content) + "\n")
        return [os.path.join(tmp_dir, f"{name}.{part}") for part in "rl"]

    good = readers.zip_labels(spark, *files("good", ['{"a": 1}', '{"a": 2}'], ["0", "1"]), "a int")
    assert sorted((r["a"], r["label"]) for r in good.collect()) == [(1, "0"), (2, "1")]
    for lines, labels in ((['{"a": 1}', "{oops"], ["0", "1"]), (['{"a": 1}'], ["0", "1"])):
        with pytest.raises(JOB_ERRORS):
            readers.zip_labels(spark, *files(f"bad{len(lines)}", lines, labels), "a int").select("pos").collect()


def test_snapshots_lack_nothing(spark, tmp_dir):
    full = ('experiment_name = "x"\ntask_names = ["boolq"]\n[model]\nname = "m"\nmodel_id = "o/m"\n'
            'learning_rate = 2e-4\n[adapter]\nmethod = "dora"\nscope = "full"\n[runtime]\nname = "rt"\n'
            'per_device_batch_size = 2\neffective_batch_size = 4\ngradient_checkpointing = false\n')
    cases = {"lack": full.replace('model_id = "o/m"\n', ""),
             "kind": full.replace('scope = "full"', 'scope = "full"\nrank = "abc"')}
    for name, text in cases.items():
        os.makedirs(os.path.join(tmp_dir, name, "run"))
        with open(os.path.join(tmp_dir, name, "run", "config.snapshot.toml"), "w") as fh:
            fh.write(text)
        with pytest.raises(JOB_ERRORS):
            readers.read_run_specs(spark, os.path.join(tmp_dir, name)).select("run_dir").collect()


def test_metrics_are_found_where_they_are_written(spark, tmp_dir):
    root = os.path.join(tmp_dir, "metrics")
    writers.write_metrics_json(spark.createDataFrame(
        [("r1", 0.5)], "run_name string, macro_average double"), root)
    assert [r["run_dir"] for r in readers.read_run_metrics(spark, root).collect()] == ["r1"]


def test_run_without_predictions(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run string")
    preds = spark.createDataFrame([("r1", "boolq", True)], "run string, task string, correct boolean")
    with pytest.raises(JOB_ERRORS):
        E.task_accuracy(preds, ("run",), requested=["boolq"], runs=runs).select("accuracy").collect()
    macro = E.macro_average(E.task_accuracy(preds, ("run",)), ("run",), runs=runs)
    assert {r["run"]: (r["macro_average"], r["n_tasks"]) for r in macro.collect()} == {
        "r1": (1.0, 1), "r2": (0.0, 0)}


def test_overwriting_a_part_keeps_the_others(spark, tmp_dir):
    path = os.path.join(tmp_dir, "preds")
    both = spark.createDataFrame([("boolq", 1), ("piqa", 1)], "task string, v int")
    writers.write_jsonl(both, path, partition_col="task")
    writers.write_jsonl(spark.createDataFrame([("boolq", 2)], "task string, v int"), path,
                        partition_col="task", keep_other_parts=True)
    got = spark.read.schema("task string, v int").json(path).collect()
    assert sorted((r["task"], r["v"]) for r in got) == [("boolq", 2), ("piqa", 1)]


def _selections(df, column, good):
    """Ways in which a caller may go on from a checked frame."""
    c = F.col(column)
    yield "equal", lambda d: d.filter(c == good)
    yield "null-safe", lambda d: d.filter(c.eqNullSafe(good))
    yield "in", lambda d: d.filter(c.isin(good, "nothing else"))
    yield "not", lambda d: d.filter(c != good)
    yield "groups", lambda d: d.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    yield "join", lambda d: d.join(df.sparkSession.createDataFrame([(good, 1)], f"{column} string, one int"), column)


@pytest.mark.parametrize("column,good", [("scope", "full"), ("method", "lora")])
def test_checks_leave_later_selections_alone(spark, column, good):
    rows = [("a", "LoRA", "Full", 0.5), ("b", "dora", "attention_only", 0.6), ("c", "dora", "full", 0.7),
            ("d", "lora", "mlp_only", 0.4)]
    runs = _runs(spark, rows)
    plain = runs.withColumn("method", F.lower("method")).withColumn("scope", F.lower("scope"))
    for name, step in _selections(runs, column, good):
        key = sorted(plain.columns) if name != "groups" else [column, "n"]
        got, want = step(G.label_conditions(runs)), step(plain)
        both = [c for c in key if c in want.columns]
        assert sorted(got.select(both).collect()) == sorted(want.select(both).collect()), name
    bad = G.label_conditions(_runs(spark, [*rows, ("e", "lora", "nowhere", 0.1)]))
    for name, step in _selections(runs, column, good):
        with pytest.raises(JOB_ERRORS):
            step(bad).collect()
    with pytest.raises(JOB_ERRORS):
        bad.select("run_dir").collect()
    with pytest.raises(JOB_ERRORS):
        bad.count()


def test_every_check_survives_an_equality_on_its_column(spark):
    """The same exposure in the other operators that check rows."""
    specs = spark.createDataFrame([(["boolq"], 1), (["piqa", "boolq"], 2)], "task_names array<string>, n int")
    assert I.validate_spec(specs).filter(F.size("task_names") == 2).count() == 1
    from evalspark.operators import normalize as N
    raw = spark.createDataFrame([(0, "1", "c", ["a", "b", "c", "d"], "0"), (1, "2", "c", ["a", "b", "c", "d", "e"], "1")],
                                "pos long, ind string, ctx string, endings array<string>, label string")
    assert N.normalize_hellaswag(raw).filter(F.size("choices") == 4).count() == 1
    a = spark.createDataFrame([("m1", 0, [1.0, 1.0]), ("m2", 0, [1.0, 2.0])], "module string, k int, a array<double>")
    merged = H.merge_lora(_weights(spark, ["m1", "m2"]), a, 2, 1)
    assert merged.filter(F.col("module") == "m2").count() == 1
