"""Flows that join several operators: training data, run snapshots, presets,
rank sweep, labels apart, metrics of unlike runs."""

from __future__ import annotations

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import compare as G
from evalspark.operators import configs as I
from evalspark.plans import commands as C
from evalspark.sources import readers

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_training_file_to_batches(spark, tmp_dir):
    records = [{"instruction": f"add {i}", "output": "x " * (i % 7) + "y"} | ({"input": "given"} if i % 2 else {})
               for i in range(50)]
    source = _put(tmp_dir, "train.json", json.dumps(records, indent=1))
    vocab = spark.createDataFrame([(t, i + 4) for i, t in enumerate(["add", "x", "y", "given", "Instruction", "Response"])],
                                  "token string, id int")
    done = C.prepare_training(spark, source, vocab, os.path.join(tmp_dir, "out"), batch_size=4, max_train_samples=40,
                              val_set_size=6, seed=3, cutoff_len=64)
    assert spark.read.json(done.samples).count() == 50
    report = {r["split"]: r["examples"] for r in done.report.collect()}
    assert report == {"train": 34, "validation": 6}
    rows = spark.read.parquet(done.batches).collect()
    assert sorted(r["pos"] for r in rows) == list(range(40))
    for split, n in (("train", 34), ("validation", 6)):
        mine = [r for r in rows if r["split"] == split]
        assert {r["batch"] for r in mine} == set(range(-(-n // 4)))
        for b in {r["batch"] for r in mine}:
            sizes = {len(r[c]) for r in mine if r["batch"] == b for c in ("input_ids", "attention_mask", "labels")}
            assert len(sizes) == 1 and sizes.pop() % 8 == 0
    one = next(r for r in rows if r["pos"] == 0)
    real = [i for i, m in zip(one["input_ids"], one["attention_mask"]) if m]
    assert real[-1] == K.EOS_ID and [x for x in one["labels"] if x != K.IGNORE_INDEX] == real[-2:]
    no_split = C.prepare_training(spark, source, vocab, os.path.join(tmp_dir, "whole"), 8, val_set_size=50)
    assert {r["split"] for r in no_split.report.collect()} == {"train"}


SNAPSHOT = """experiment_name = "e"
task_names = ["piqa", "winogrande"]
train_data_path = "d.json"

[model]
name = "m"
model_id = "org/m"
learning_rate = 1e-4

[adapter]
method = "dora"
scope = "mlp_only"

[runtime]
name = "rt"
per_device_batch_size = 3
effective_batch_size = 6
gradient_checkpointing = false
"""


def _samples(spark, root):
    rows = [(str(i), t, f"Answer format: {o}1/{o}2", [f"{o}1", f"{o}2"], f"{o}{1 + i % 2}", i)
            for t, o in (("piqa", "solution"), ("winogrande", "option"), ("boolq", "true")) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, task string, instruction string, choices array<string>, label string, pos bigint")
    from evalspark.sources.writers import write_jsonl
    return write_jsonl(df, os.path.join(root, "samples"), partition_col="task")


def test_evaluation_follows_the_snapshot(spark, tmp_dir):
    _put(tmp_dir, "runs/r1/config.snapshot.toml", SNAPSHOT)
    seen = os.path.join(tmp_dir, "sizes")

    def factory(spec):
        first = spec["max_new_tokens"]

        def make():
            def gen(prompts):
                with open(seen, "a") as f:
                    f.write(f"{len(prompts)} {first}\n")
                return [p.split("Answer format: ")[1].split("/")[0] for p in prompts]
            return gen
        return make

    row = C.evaluate_snapshot(spark, os.path.join(tmp_dir, "runs"), "r1", _samples(spark, tmp_dir), factory, device="cuda").first()
    assert (row["method"], row["scope"], row["model_id"], row["runtime"]) == ("dora", "mlp_only", "org/m", "rt")
    assert row["piqa"] == row["winogrande"] == 0.5 and row["macro_average"] == 0.5 and "boolq" not in row.asDict()
    sizes = {tuple(map(int, line.split())) for line in open(seen)}
    assert max(n for n, _ in sizes) <= 12 and {m for _, m in sizes} == {8}
    again = C.evaluate_snapshot(spark, os.path.join(tmp_dir, "runs"), "r1", os.path.join(tmp_dir, "samples"), factory,
                                tasks="piqa").first()
    assert "winogrande" not in again.asDict() and again["macro_average"] == 0.5
    found = readers.read_run_metrics(spark, os.path.join(tmp_dir, "runs"), pattern="r1/metrics/*/*.json")
    assert found is not None and found.first()["method"] == "dora"


def test_presets_as_arguments_and_files(spark, tmp_dir):
    _put(tmp_dir, "experiments/mine.toml", 'rank = 4\nmax_train_samples = 9\ntask_names = ["piqa"]\ntrain_data_path = "own.json"\n'
         "[method_overrides.dora]\nlearning_rate = 0.5\nalpha = 7\n")
    _put(tmp_dir, "experiments/bare.toml", "seed = 1\n")
    _put(tmp_dir, "models/tiny.toml", 'model_id = "t"\nlearning_rate = 0.25\n')
    _put(tmp_dir, "runtime/box.toml", "per_device_batch_size = 2\neffective_batch_size = 8\ngradient_checkpointing = true\n"
         'bnb_4bit_quant_type = "fp4"\n')
    requests = spark.createDataFrame(
        [("mine", "tiny", "box", "lora", "full", None, None), ("mine", "tiny", "box", "dora", "full", None, "given.json"),
         ("bare", "tiny", "box", "dora", "full", 64, None)],
        "experiment string, model string, runtime string, method string, scope string, rank int, train_data_path string")
    from_files = readers.read_presets(spark, tmp_dir)
    given = I.preset_tables(
        spark, {"mine": {"rank": 4, "max_train_samples": 9, "task_names": ("piqa",), "train_data_path": "own.json",
                         "method_overrides": {"dora": {"learning_rate": 0.5, "alpha": 7}}}, "bare": {"seed": 1}},
        {"tiny": {"model_id": "t", "learning_rate": 0.25}},
        {"box": {"per_device_batch_size": 2, "effective_batch_size": 8, "gradient_checkpointing": True,
                 "bnb_4bit_quant_type": "fp4"}})
    for presets in (from_files, given):
        rows = {(r["experiment"], r["method"]): r for r in I.overlay_presets(requests, presets).collect()}
        lora, dora, bare = rows["mine", "lora"], rows["mine", "dora"], rows["bare", "dora"]
        assert (lora["rank"], lora["alpha"], lora["learning_rate"], lora["train_data_path"]) == (4, 16, 0.25, "own.json")
        assert (dora["rank"], dora["alpha"], dora["learning_rate"], dora["train_data_path"]) == (4, 7, 0.5, "given.json")
        assert (bare["rank"], bare["seed"], bare["task_names"], bare["max_train_samples"]) == (64, 1, list(K.TASKS), None)
        assert bare["train_data_path"] == K.DEFAULT_TRAIN_DATA_PATH and bare["cutoff_len"] == 256
        assert {(r["bnb_4bit_quant_type"], r["bnb_4bit_compute_dtype"], r["use_4bit"]) for r in rows.values()} == {("fp4", "bfloat16", False)}
        with pytest.raises(JOB_ERRORS):
            I.overlay_presets(requests.withColumn("model", F.lit("none")), presets).select("rank").collect()
    with pytest.raises(ValueError):
        I.preset_tables(spark, {"x": {"ranks": 4}})
    lacking = I.preset_tables(spark, {"mine": {}, "bare": {}}, {"tiny": {"model_id": "t"}},
                              {"box": {"per_device_batch_size": 2, "effective_batch_size": 8, "gradient_checkpointing": True}})
    with pytest.raises(JOB_ERRORS):
        I.overlay_presets(requests, lacking).select("rank").collect()


def test_labels_in_a_file_of_their_own(spark, tmp_dir):
    records = _put(tmp_dir, "r.jsonl", "".join(json.dumps({"goal": f"g{i}", "sol1": "a", "sol2": "b"}) + "\n" for i in range(5)))
    labels = _put(tmp_dir, "l.lst", "0\n1\n1\n0\n1\n")
    out = os.path.join(tmp_dir, "out")
    for _ in range(2):  # a second run replaces the task's own folder only
        C.prepare_labelled(spark, "piqa", records, labels, "goal string, sol1 string, sol2 string", out)
    got = readers.read_eval_samples(spark, out, limit=4).collect()
    assert sorted((r["pos"], r["id"], r["label"]) for r in got) == [
        (0, "g0", "solution1"), (1, "g1", "solution2"), (2, "g2", "solution2"), (3, "g3", "solution1")]


def test_rank_sweep_in_the_analysis(spark, tmp_dir):
    cols = ["method", "scope", "macro_average", *K.TASKS]
    runs = [(m, s, 0.7 + i / 100, *[0.6] * 8) for i, (m, s) in enumerate((m, s) for s in K.SCOPES for m in K.METHODS)]
    spark.createDataFrame(runs, cols).write.option("header", True).csv(f"{tmp_dir}/summary")
    ranked = [("lora", "full", 0.5, 8), ("dora", "full", 0.75, 8), ("lora", "full", 0.6, 32), ("dora", "mlp_only", 0.1, 8)]
    spark.createDataFrame(ranked, "method string, scope string, macro_average double, Rank int").write.option(
        "header", True).csv(f"{tmp_dir}/ranked")
    res = C.analyze(spark, f"{tmp_dir}/tables", results_csv=f"{tmp_dir}/summary", ranked_csv=f"{tmp_dir}/ranked")
    assert [(r["method"], r["rank"]) for r in res["rank_sweep"].collect()] == [("dora", 8), ("lora", 8), ("lora", 32)]
    gap = spark.read.option("header", True).csv(f"{tmp_dir}/tables/rank_matched_gap").collect()
    assert [(r["rank"], float(r["gap_points"])) for r in gap] == [("8", 25.0)]
    assert "rank_sweep" not in C.analyze(spark, f"{tmp_dir}/t2", results_csv=f"{tmp_dir}/summary")


def test_metrics_of_runs_with_disjoint_tasks(spark, tmp_dir):
    _put(tmp_dir, "a/metrics.json", json.dumps({"run_name": "a", "boolq": 1, "n": 3, "x.y": 1, "only": None}))
    _put(tmp_dir, "b/metrics.json", json.dumps({"run_name": "b", "ARC-Easy": 0.25, "boolq": 0.5, "deep": {"k": [1, 2.5]}}))
    got = {r["run_dir"]: r.asDict(recursive=True) for r in readers.read_run_metrics(spark, tmp_dir).collect()}
    assert got["a"] == {"run_dir": "a", "run_name": "a", "boolq": 1.0, "n": 3, "x.y": 1, "only": None, "ARC-Easy": None, "deep": None}
    assert got["b"]["ARC-Easy"] == 0.25 and got["b"]["deep"] == {"k": [1.0, 2.5]} and got["b"]["n"] is None
    _put(tmp_dir, "c/metrics.json", '{"run_name": "c", broken')
    with pytest.raises(JOB_ERRORS):
        readers.read_run_metrics(spark, tmp_dir)
    assert {r["run_dir"] for r in readers.read_run_metrics(spark, tmp_dir, strict=False).collect()} == {"a", "b"}
    assert readers.read_run_metrics(spark, os.path.join(tmp_dir, "none")) is None


def test_sketch_quartiles_stay_within_the_stated_rank_error(spark):
    df = spark.range(40_000).select((F.col("id") % 3 == 0).alias("g"), ((F.col("id") * 7919) % 40_009).cast("double").alias("v"))
    exact = {r["g"]: r for r in G.box_statistics(df, "v", ["g"]).collect()}
    rough = {r["g"]: r for r in G.box_statistics(df, "v", ["g"], exact=False).collect()}
    for g, r in rough.items():
        assert (r["least"], r["greatest"], r["n"]) == (exact[g]["least"], exact[g]["greatest"], exact[g]["n"])
        values = sorted(x["v"] for x in df.filter(F.col("g") == g).collect())
        for c, rank in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            below = sum(v < r[c] for v in values) / len(values)
            assert abs(below - rank) <= G.SKETCH_ERROR
    plan = G.box_statistics(df, "v", ["g"], exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg" in plan
