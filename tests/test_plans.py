"""Scale properties of the physical plans, pinned so a regression fails a test.

A hot task (a third of all rows) must be pre-aggregated or pre-limited
before any shuffle; token lookups must not shuffle tokens; projections over
weight rows must not shuffle the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import adapters as H
from evalspark.operators import normalize as N
from evalspark.operators import scoring as E
from evalspark.operators import sequences as D
from evalspark.plans import bindings as B
from evalspark.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_outside_broadcasts(plan: str) -> int:
    """Hash shuffles that are not inside a broadcast (small-side) subtree.

    In the printed tree a node's subtree is the following lines indented
    deeper than the node, so a stack of BroadcastExchange depths tells
    whether a line belongs to a broadcast side.
    """
    count, stack = 0, []
    for line in plan.splitlines():
        depth = next((i for i, ch in enumerate(line) if ch.isalpha()), len(line))
        while stack and depth <= stack[-1]:
            stack.pop()
        if "BroadcastExchange" in line:
            stack.append(depth)
        elif "Exchange hashpartitioning" in line and not stack:
            count += 1
    return count


def _hot_predictions(spark):
    # One task holds a third of the rows.
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("boolq")).otherwise(
            F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("task"),
        (F.col("id") % 2).alias("run"), (F.col("id") % 7 == 0).alias("correct"))


def test_accuracy_aggregates_before_the_shuffle(spark):
    plan = plan_of(E.task_accuracy(_hot_predictions(spark), ("run",)))
    partial = plan.find("partial_count")
    exchange = plan.find("Exchange hashpartitioning")
    assert partial > exchange > 0  # printed top-down: the partial aggregate sits below the shuffle


def _exchanged(plan: str) -> list[str]:
    """The lines under each shuffle, with what the shuffled rows hold."""
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_head_limit_moves_no_rows_and_has_one_plan(spark):
    import re
    df = _hot_predictions(spark).withColumns({"pos": F.col("correct").cast("long") * 0 + F.monotonically_increasing_id(),
                                              "payload": F.lit("x")})
    plans = [plan_of(N.head_limit(df, n)) for n in (50, 900)]
    for plan in plans:
        assert shuffles_outside_broadcasts(plan) == 0  # only keys are shuffled, on the broadcast side
        assert "WindowGroupLimit" not in plan and "BroadcastHashJoin" in plan
    clean = [re.sub(r"#\d+L?|\b(50|900)\b|plan_id=\d+", "", p) for p in plans]
    assert clean[0] == clean[1]


def test_holdout_neither_sorts_nor_shuffles_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("payload").alias("text"))
    plan = plan_of(D.holdout_split(df, 120, 42, ["k"]))
    assert "Exchange" not in plan and "Sort" not in plan and "Scan ExistingRDD" not in plan


def test_token_lookup_explodes_and_shuffles_nothing(spark):
    vocab = spark.createDataFrame([(t, i + 4) for i, t in enumerate(["a", "b", "c"])],
                                  "token string, id int")
    texts = spark.createDataFrame([(i, "a b c d " * (i % 5)) for i in range(50)], "k int, t string")
    plan = plan_of(D.encode_tokens(texts, "t", vocab, ["k"], out="ids"))
    assert "Exchange" not in plan and "Generate" not in plan and "ArrowEvalPython" in plan
    # Unused, the lookup is pruned away.
    assert "ArrowEvalPython" not in plan_of(D.encode_tokens(texts, "t", vocab, ["k"], out="ids").select("k"))


def test_batches_are_laid_out_on_keys_alone(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.array_repeat(F.lit(7), 3).alias("input_ids"),
                                 F.array_repeat(F.lit(1), 3).alias("attention_mask"),
                                 F.array_repeat(F.lit(7), 3).alias("labels"))
    index = D.batch_index(df, 8, ["k"])
    assert index.columns == ["k", "batch", "padded_length"]
    leaves = [line for line in plan_of(index).splitlines() if "Scan ExistingRDD" in line]
    assert leaves and all("input_ids" not in line for line in leaves)  # what was checkpointed holds no tokens


def test_normalisation_is_narrow(spark, sf_small):
    raw = B.raw_benchmarks(spark, sf_small)
    raw.pop("boolq")  # the boolq binding itself joins documents to labels
    plan = plan_of(N.normalize_all(raw))
    assert "Exchange" not in plan


def test_projection_never_shuffles_weight_rows(spark, sf_small):
    y = H.project_dora(B.input_batch(spark, sf_small), B.weight_rows(spark, sf_small),
                       B.a_rows(spark, sf_small), B.ADAPTER_ALPHA, B.ADAPTER_RANK)
    plan = plan_of(y)
    # A and the inputs are broadcast values: weight rows are mapped where they are.
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_selecting_modules_scans_the_inventory_once(spark, sf_small):
    plan = plan_of(H.select_modules(B.modules(spark, sf_small)))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_no_registered_query_uses_a_nested_loop_join(spark):
    registry.load_all()
    bad = []
    for name, fn in sorted(registry.QUERIES.items()):
        plan = plan_of(fn(spark, "/root/testdata/sf0.01"))
        if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
            bad.append(name)
    assert bad == []
