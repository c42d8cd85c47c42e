"""Run configuration (I1-I4) and sources/sinks (A1-A11) round trips."""

from __future__ import annotations

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from evalspark.operators import configs as I
from evalspark.operators import runs as R
from evalspark.sources import readers, writers

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _req(spark, rows):
    return spark.createDataFrame(rows, "experiment string, model string, runtime string, "
                                       "method string, scope string, rank int")


def test_overlay_precedence(spark):
    rows = [("paper_llama2_7b", "llama2_7b", "official", "lora", "full", None),
            ("paper_llama2_7b", "llama2_7b", "official", "dora", "full", 4),
            ("paper_colab", "llama2_7b", "official", "dora", "mlp_only", None),
            ("default", "llama3_8b", "colab_t4", "lora", "full", None)]
    got = {(r.experiment, r.method, r.scope): r for r in I.overlay_presets(_req(spark, rows)).collect()}
    lora = got[("paper_llama2_7b", "lora", "full")]
    assert (lora["rank"], lora.alpha, lora.learning_rate) == (32, 64, 3e-4)
    dora = got[("paper_llama2_7b", "dora", "full")]
    assert (dora["rank"], dora.alpha, dora.learning_rate) == (4, 32, 2e-4)  # explicit rank wins
    colab = got[("paper_colab", "dora", "mlp_only")]
    assert colab.learning_rate == 2e-4  # no override: the model preset's rate
    dflt = got[("default", "lora", "full")]
    assert (dflt["rank"], dflt.alpha, dflt.learning_rate, dflt.max_train_samples) == (8, 16, 1e-4, None)
    assert dflt.per_device_batch_size == 1


def test_overlay_unknown_preset_raises(spark):
    with pytest.raises(JOB_ERRORS):
        I.overlay_presets(_req(spark, [("nope", "llama2_7b", "official", "lora", "full", None)])).collect()


def test_run_matrix_and_validation(spark):
    req = spark.createDataFrame([("m", "lora", "rt", None), ("m", "dora", "rt", 8)],
                                "model string, method string, runtime string, rank int")
    names = sorted(r.run_name for r in I.run_matrix(req, stamp="T").collect())
    assert len(names) == 6 and "T-m-lora-full-rt" in names and "T-m-dora-mlp_only-rt-r8" in names
    bad = spark.createDataFrame([(["boolq", "mmlu"],)], "task_names array<string>")
    with pytest.raises(JOB_ERRORS):
        I.validate_spec(bad).collect()
    ok = spark.createDataFrame([(["boolq"], None, 3)], "task_names array<string>, m int, n int")
    snap = I.drop_null_fields(ok).collect()[0].snapshot_json
    assert json.loads(snap) == {"task_names": ["boolq"], "n": 3}


def test_training_json_array(spark, tmp_dir):
    path = os.path.join(tmp_dir, "train.json")
    with open(path, "w") as fh:
        json.dump([{"instruction": "a", "output": "b", "extra": 1},
                   {"instruction": 5, "input": "ctx", "output": "d"}], fh)
    rows = readers.read_training_json(spark, path).collect()
    assert [(r.instruction, r.input, r.output) for r in rows] == [("a", "", "b"), ("5", "ctx", "d")]
    bad = os.path.join(tmp_dir, "bad.json")
    with open(bad, "w") as fh:
        json.dump([{"input": "x", "output": "y"}], fh)
    with pytest.raises(JOB_ERRORS):
        readers.read_training_json(spark, bad).collect()


def test_json_array_writer_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("i1", None, "o1"), ("i2", "x", "o2")],
                               "instruction string, input string, output string").repartition(3)
    path = writers.write_json_array(df, os.path.join(tmp_dir, "arr"))
    back = sorted((r.instruction, r.input) for r in readers.read_training_json(spark, path).collect())
    assert back == [("i1", ""), ("i2", "x")]


def test_jsonl_failfast(spark, tmp_dir):
    path = os.path.join(tmp_dir, "s.jsonl")
    with open(path, "w") as fh:
        fh.write('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, path, "a long").count() == 2
    with open(path, "a") as fh:
        fh.write("{not json\n")
    with pytest.raises(JOB_ERRORS):
        readers.read_jsonl(spark, path, "a long").collect()


def test_zip_labels(spark, tmp_dir):
    rec, lab = os.path.join(tmp_dir, "dev.jsonl"), os.path.join(tmp_dir, "dev-labels.lst")
    with open(rec, "w") as fh:
        fh.write("\n".join(json.dumps({"goal": f"g{i}"}) for i in range(5)) + "\n")
    with open(lab, "w") as fh:
        fh.write("\n".join(str(i % 2) for i in range(5)) + "\n")
    got = sorted((r.pos, r.goal, r.label) for r in
                 readers.zip_labels(spark, rec, lab, "goal string").collect())
    assert got == [(i, f"g{i}", str(i % 2)) for i in range(5)]
    with open(lab, "a") as fh:
        fh.write("1\n")
    with pytest.raises(JOB_ERRORS):
        readers.zip_labels(spark, rec, lab, "goal string").collect()


def test_run_files_schema_union_and_summary(spark, tmp_dir):
    root = os.path.join(tmp_dir, "runs")
    for run, payload in {"r1": {"run_name": "r1", "boolq": 0.5, "macro_average": 0.5},
                         "r2": {"run_name": "r2", "piqa": 1.0, "macro_average": 1.0}}.items():
        os.makedirs(os.path.join(root, run))
        with open(os.path.join(root, run, "metrics.json"), "w") as fh:
            json.dump(payload, fh, indent=2)
    with open(os.path.join(root, "r1", "run.metadata.json"), "w") as fh:
        json.dump({"trainable_parameters": 100, "total_parameters": 1000}, fh)
    metrics = readers.read_run_metrics(spark, root)
    metadata = readers.read_run_metadata(spark, root)
    summary = R.summarize_runs(metrics, metadata)
    assert summary.columns == sorted(summary.columns)
    rows = {r.run_name: r for r in summary.collect()}
    assert rows["r1"].piqa is None and rows["r2"].boolq is None
    assert rows["r1"].trainable_percentage == 10.0 and rows["r2"].trainable_percentage is None
    assert readers.read_run_metrics(spark, os.path.join(tmp_dir, "none")) is None


def test_metrics_writer_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("a", 0.5, None), ("b", 0.6, 0.1)],
                               "run_name string, macro_average double, boolq double")
    root = writers.write_metrics_json(df, os.path.join(tmp_dir, "m"))
    back = {r.run_dir: r for r in readers.read_run_metrics(spark, root, "*/*.json").collect()}
    assert back["a"].macro_average == 0.5 and back["b"].boolq == 0.1


def test_run_specs_toml_defaults(spark, tmp_dir):
    d = os.path.join(tmp_dir, "snap", "run1")
    os.makedirs(d)
    with open(os.path.join(d, "config.snapshot.toml"), "w") as fh:
        fh.write('experiment_name = "x"\ntask_names = ["boolq"]\n\n[model]\nname = "m"\n'
                 'model_id = "org/m"\nlearning_rate = 2e-4\n\n[adapter]\nmethod = "dora"\n'
                 'scope = "full"\n\n[runtime]\nname = "rt"\nper_device_batch_size = 2\n'
                 'effective_batch_size = 4\ngradient_checkpointing = false\n')
    r = readers.read_run_specs(spark, os.path.join(tmp_dir, "snap")).collect()[0]
    assert (r.run_dir, r.method, r["rank"], r.alpha, r.dropout, r.seed, r.cutoff_len) == (
        "run1", "dora", 8, 16, 0.05, 42, 256)
    assert r.max_train_samples is None and list(r.task_names) == ["boolq"]


def test_results_csv_and_tables(spark, tmp_dir):
    df = spark.createDataFrame([("lora", "full", 0.77)], "method string, scope string, macro_average double")
    paths = writers.write_tables(os.path.join(tmp_dir, "t"), {"summary_table": (df, ["scope", "method",
                                                                                    "macro_average"])})
    back = readers.read_results_csv(spark, paths["summary_table"])
    assert back.columns == ["scope", "method", "macro_average"]
    assert back.collect()[0].macro_average == 0.77
    out = writers.write_jsonl(df, os.path.join(tmp_dir, "j"))
    first = spark.read.text(out).collect()[0].value
    assert list(json.loads(first)) == ["macro_average", "method", "scope"]


def test_lines_with_position_many_splits(spark, tmp_dir):
    d = os.path.join(tmp_dir, "lines")
    os.makedirs(d)
    for f in range(3):
        with open(os.path.join(d, f"part-{f}.txt"), "w") as fh:
            fh.write("\n".join(f"f{f}-l{i}" + "x" * (i % 7) for i in range(400)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many splits per file
    try:
        got = [(r.pos, r.line) for r in readers.lines_with_position(spark, d).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(f * 400 + i, f"f{f}-l{i}" + "x" * (i % 7)) for f in range(3) for i in range(400)]
    assert sorted(got) == want
