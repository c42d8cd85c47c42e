"""End-to-end command flows: prepare -> evaluate (two runs) -> summarize -> analyze."""

from __future__ import annotations

import os

import pytest

from evalspark import constants as K
from evalspark.plans import bindings as B
from evalspark.plans import commands as C


@pytest.fixture(scope="module")
def flow(spark, sf_small):
    import tempfile

    # Defined here so the workers receive them by value.
    def first_option_factory():
        import re
        rx = re.compile(r"Answer format: ([a-z0-9]+)")

        def gen(prompts):
            return [f" {m.group(1)} " if (m := rx.search(p)) else "" for p in prompts]
        return gen

    def last_option_factory():
        import re
        rx = re.compile(r"Answer format: ([a-z0-9/]+)")

        def gen(prompts):
            return [f"I choose {m.group(1).split('/')[-1]}." if (m := rx.search(p)) else ""
                    for p in prompts]
        return gen

    root = tempfile.mkdtemp(prefix="evalspark-flow-")
    samples = C.prepare_benchmarks(B.raw_benchmarks(spark, sf_small), f"{root}/benchmarks")
    runs = [C.RunConfig("lora-full", "lora", "full", "m", "org/m", "rt"),
            C.RunConfig("dora-full", "dora", "full", "m", "org/m", "rt")]
    factories = {"lora-full": first_option_factory, "dora-full": last_option_factory}
    metrics = {r.run_name: C.evaluate_run(spark, samples, r, factories[r.run_name],
                                          f"{root}/predictions", f"{root}/runs", batch_size=4)
               .collect()[0] for r in runs}
    return root, samples, metrics


def test_prepare_writes_one_folder_per_task(flow):
    root, samples, _ = flow
    folders = sorted(d for d in os.listdir(samples) if d.startswith("_part="))
    assert folders == sorted(f"_part={t}" for t in K.TASKS)


def test_evaluate_matches_expected_accuracy(spark, flow):
    from pyspark.sql import functions as F

    from evalspark.sources.readers import read_eval_samples
    root, samples, metrics = flow
    s = read_eval_samples(spark, samples)
    # The first-option generator is right exactly when the label is the first option.
    first = {"boolq": "true", "piqa": "solution1", "social_i_qa": "answer1", "hellaswag": "ending1",
             "winogrande": "option1"}
    expect = {r.task: r.acc for r in s.groupBy("task").agg(F.avg(
        (F.col("label") == F.coalesce(F.element_at(F.create_map(*[
            x for k, v in first.items() for x in (F.lit(k), F.lit(v))]), F.col("task")),
            F.lit("answer1"))).cast("double")).alias("acc")).collect()}
    m = metrics["lora-full"]
    for t in K.TASKS:
        assert m[t] == pytest.approx(expect[t], abs=1e-12)
    assert m.macro_average == pytest.approx(sum(expect.values()) / 8, abs=1e-12)
    preds = spark.read.json(f"{root}/predictions/lora-full")
    assert preds.count() == s.count()


def test_summarize_and_analyze(spark, flow):
    root, _, metrics = flow
    summary = C.summarize(spark, f"{root}/runs", f"{root}/out")
    assert summary.columns == sorted(summary.columns)
    assert {r.run_name for r in summary.collect()} == {"lora-full", "dora-full"}
    back = spark.read.option("header", True).csv(f"{root}/out/summary")
    assert back.count() == 2
    res = C.analyze(spark, f"{root}/tables", metrics_root=f"{root}/runs")
    gains = res["gains"].collect()[0]
    for t in K.TASKS:
        assert gains[t] == pytest.approx(metrics["dora-full"][t] - metrics["lora-full"][t], abs=1e-12)
    ss = res["scope_summary"].collect()[0]
    assert ss.task_wins + ss.task_ties + ss.task_losses == 8
    assert sorted(os.listdir(f"{root}/tables")) == sorted(
        ["summary_table", "dora_gains_table", "scope_summary", "task_summary",
         "official_reference_comparison"])


def test_summarize_without_runs_writes_header(spark, tmp_dir):
    out = C.summarize(spark, os.path.join(tmp_dir, "nothing"), os.path.join(tmp_dir, "out"))
    assert out.columns == ["run_name", "macro_average"] and out.count() == 0
    text = spark.read.text(os.path.join(tmp_dir, "out", "summary")).collect()
    assert [r.value for r in text] == ["run_name,macro_average"]


def test_analyze_falls_back_to_results_csv(spark, tmp_dir):
    rows = [(m, s, 0.7 + 0.01 * i, *[0.6 + 0.01 * (i + j) for j in range(8)])
            for i, (m, s) in enumerate([(m, s) for s in K.SCOPES for m in K.METHODS])]
    cols = ["method", "scope", "macro_average", *K.TASKS]
    csv = os.path.join(tmp_dir, "summary_table")
    spark.createDataFrame(rows, cols).write.option("header", True).csv(csv)
    res = C.analyze(spark, os.path.join(tmp_dir, "tables"), results_csv=csv)
    assert res["gains"].count() == 3
    with pytest.raises(FileNotFoundError):
        C.analyze(spark, os.path.join(tmp_dir, "t2"), metrics_root=os.path.join(tmp_dir, "none"))


def test_task_override_changes_the_macro_denominator(spark, flow):
    root, samples, metrics = flow

    def answer_true_factory():
        def gen(prompts):
            return ["true"] * len(prompts)
        return gen

    row = C.evaluate_run(spark, samples, C.RunConfig("override", "lora", "full"),
                         answer_true_factory, f"{root}/predictions-o", f"{root}/runs-o",
                         tasks="BOOLQ, piqa").collect()[0]
    fields = row.asDict()
    assert "boolq" in fields and "piqa" in fields and "hellaswag" not in fields
    assert fields["piqa"] == 0.0  # "true" never matches a piqa label
    assert row.macro_average == pytest.approx((fields["boolq"] + fields["piqa"]) / 2, abs=1e-12)
