"""Adapter tables (H1-H10): closed forms, merge law, module selection, counts."""

from __future__ import annotations

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark.operators import adapters as H

W = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
A = np.array([[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]])
Bm = np.array([[1.0, 2.0], [3.0, 4.0]])
BIAS = np.array([0.5, -0.5])
X = np.array([[1.0, -1.0, 2.0], [0.5, 0.5, 0.5]])

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _tables(spark, m=(4.0, 2.5), bias=True):
    rows = [("mod", i, W[i].tolist(), Bm[i].tolist(), float(BIAS[i]) if bias else 0.0, float(m[i]))
            for i in range(2)]
    w = spark.createDataFrame(rows, "module string, row_idx int, w array<double>, b array<double>, "
                                    "bias double, m double")
    a = spark.createDataFrame([("mod", k, A[k].tolist()) for k in range(2)],
                              "module string, k int, a array<double>")
    x = spark.createDataFrame([("mod", j, X[j].tolist()) for j in range(2)],
                              "module string, x_id long, x array<double>")
    return w, a, x


def _y(df):
    return {(r.x_id, r.row_idx): r.y for r in df.collect()}


def test_row_norms(spark):
    w = spark.createDataFrame([(0, [3.0, 4.0, 0.0]), (1, [0.0, 5.0, 12.0])], "row_idx int, w array<double>")
    assert [r.magnitude for r in H.row_magnitude(w).orderBy("row_idx").collect()] == [5.0, 13.0]


def test_lora_closed_form(spark):
    w, a, x = _tables(spark)
    s = 6 / 2
    got = _y(H.project_lora(x, w, a, alpha=6, rank=2))
    want = X @ W.T + BIAS + s * (X @ A.T) @ Bm.T
    for (xi, ri), v in got.items():
        assert v == pytest.approx(want[xi, ri], abs=1e-9)
    delta = {r.row_idx: r.delta for r in H.lowrank_delta(w, a, 6, 2).collect()}
    np.testing.assert_allclose(np.array([delta[0], delta[1]]), s * Bm @ A, atol=1e-12)


def test_dora_closed_form_and_merge_law(spark):
    w, a, x = _tables(spark, m=(4.0, 2.5))
    s = 2 / 2
    merged_w = W + s * Bm @ A
    g = np.array([4.0, 2.5]) / np.linalg.norm(merged_w, axis=1)
    base = X @ W.T + BIAS
    want = base + (g - 1) * (base - BIAS) + g * s * ((X @ A.T) @ Bm.T)
    got = _y(H.project_dora(x, w, a, alpha=2, rank=2))
    for (xi, ri), v in got.items():
        assert v == pytest.approx(want[xi, ri], abs=1e-9)
    # Projecting with merged rows equals the unmerged projection (within 1e-6).
    w2, a2, x2 = _tables(spark, m=(2.5, 1.75), bias=False)
    merged = H.merge_dora(w2, a2, 2, 2)
    via_merge = _y(H.project_rows(x2, merged))
    direct = _y(H.project_dora(x2, w2, a2, 2, 2))
    for key, v in direct.items():
        assert via_merge[key] == pytest.approx(v, abs=1e-6)
    lora_merged = _y(H.project_rows(x, H.merge_lora(w, a, 6, 2)))
    lora_direct = _y(H.project_lora(x, w, a, 6, 2))
    for key, v in lora_direct.items():
        assert lora_merged[key] == pytest.approx(v, abs=1e-6)


def test_rank_must_be_positive(spark):
    w, a, _ = _tables(spark)
    with pytest.raises(ValueError):
        H.lowrank_delta(w, a, 4, 0)


SUFFIXES = ["q_proj", "k_proj", "v_proj", "up_proj", "down_proj"]


def _modules(spark, suffixes=SUFFIXES, model="m"):
    rows = [(model, f"model.layers.{layer}.{'self_attn' if 'proj' in s and s[0] in 'qkv' else 'mlp'}.{s}",
             8, 4) for layer in range(2) for s in suffixes]
    return spark.createDataFrame(rows, "model string, module_name string, in_features long, "
                                       "out_features long")


def test_select_modules_per_scope(spark):
    sel = H.select_modules(_modules(spark)).groupBy("scope").count().collect()
    assert {r.scope: r["count"] for r in sel} == {"full": 10, "attention_only": 6, "mlp_only": 4}


def test_select_modules_zero_match_raises(spark):
    with pytest.raises(JOB_ERRORS):
        H.select_modules(_modules(spark, ["q_proj", "k_proj"])).collect()


def test_select_modules_bad_type_raises(spark):
    mods = _modules(spark).withColumn("module_type", F.lit("Conv1d"))
    with pytest.raises(JOB_ERRORS):
        H.select_modules(mods, type_col="module_type").collect()


def test_published_parameter_counts(spark):
    # 32 decoder layers: q, k, v are 4096x4096; up 4096->11008; down 11008->4096.
    rows = []
    for layer in range(32):
        for s in ("q_proj", "k_proj", "v_proj"):
            rows.append(("llama", f"layers.{layer}.{s}", 4096, 4096))
        rows.append(("llama", f"layers.{layer}.up_proj", 4096, 11008))
        rows.append(("llama", f"layers.{layer}.down_proj", 11008, 4096))
        rows.append(("llama", f"layers.{layer}.o_proj", 4096, 4096))
    mods = spark.createDataFrame(rows, "model string, module_name string, in_features long, "
                                       "out_features long")
    got = {(r.scope, r.method, r["rank"]): r.trainable_parameters
           for r in H.adapter_parameters(H.select_modules(mods), [4, 8, 16, 32]).collect()}
    assert got[("full", "lora", 32)] == 56_098_816
    assert got[("full", "dora", 16)] == 28_925_952
    assert got[("full", "lora", 16)] == 28_049_408
    assert got[("full", "dora", 8)] == 14_901_248
    assert got[("full", "dora", 4)] == 7_888_896


def test_manifest_and_reconcile(spark):
    sel = H.select_modules(_modules(spark)).filter("scope = 'mlp_only'")
    lora = H.parameter_manifest(sel.withColumn("method", F.lit("lora")))
    dora = H.parameter_manifest(sel.withColumn("method", F.lit("dora")))
    assert lora.count() == 8 and dora.count() == 12
    diff = H.reconcile_names(dora, lora).collect()
    assert {r.kind for r in diff} == {"missing"} and len(diff) == 4
    assert all(r.param_name.endswith(".magnitude") for r in diff)
    assert H.reconcile_names(lora, lora).count() == 0
    with pytest.raises(JOB_ERRORS):
        H.require_reconciled(H.reconcile_names(dora, lora)).collect()


def _many(spark, rows=300, inputs=40, rank=3, width=5, seed=1):
    """A module with a third of all rows among several small ones."""
    r = np.random.default_rng(seed)
    modules = ["hot" if i % 3 == 0 else f"m{i % 4}" for i in range(rows)]
    vec = lambda n: r.standard_normal(n).round(3).tolist()
    w = [(m, i, vec(width), vec(rank), float(i % 5), float(1 + i % 3)) for i, m in enumerate(modules)]
    a = [(m, k, vec(width)) for m in sorted(set(modules)) for k in range(rank)]
    x = [("hot" if j % 3 == 0 else f"m{j % 4}", j, vec(width)) for j in range(inputs)]
    return (w, a, x), (
        spark.createDataFrame(w, "module string, row_idx int, w array<double>, b array<double>, bias double, m double"),
        spark.createDataFrame(a, "module string, k int, a array<double>").repartition(5),
        spark.createDataFrame(x, "module string, x_id long, x array<double>"))


@pytest.mark.parametrize("bound", [1 << 28, 8])
def test_products_over_many_modules(spark, monkeypatch, bound):
    from evalspark.operators import blocks, common
    monkeypatch.setattr(common, "BROADCAST_BYTE_LIMIT", bound)
    monkeypatch.setattr(blocks, "ROW_BLOCK", 16)
    monkeypatch.setattr(blocks, "MATRIX_BLOCK", 4)
    (w, a, x), (wt, at, xt) = _many(spark)
    s, mats = 4 / 3, {}
    for m, k, v in sorted(a):
        mats.setdefault(m, []).append(v)
    want, dora = {}, {}
    for m, i, wv, bv, bias, mag in w:
        d = s * np.array(bv) @ np.array(mats[m])
        g = mag / np.linalg.norm(np.array(wv) + d)
        for mx, j, xv in x:
            if mx == m:
                base = np.dot(wv, xv) + bias
                low = s * np.dot(bv, np.array(mats[m]) @ xv)
                want[j, i] = base + low
                dora[j, i] = base + (g - 1) * (base - bias) + g * low
    for got, exact in ((H.project_lora(xt, wt, at, 4, 3), want), (H.project_dora(xt, wt, at, 4, 3), dora)):
        y = _y(got)
        assert y.keys() == exact.keys() and all(y[k] == pytest.approx(v, abs=1e-9) for k, v in exact.items())
    plan = H.project_lora(xt, wt, at, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert ("FlatMapCoGroupsInArrow" in plan) == (bound == 8)
    merged = {r["row_idx"]: r["merged"] for r in H.merge_lora(wt, at, 4, 3).collect()}
    assert len(merged) == len(w)
    for m, i, wv, bv, _, _ in w:
        assert merged[i] == pytest.approx(np.array(wv) + s * np.array(bv) @ np.array(mats[m]), abs=1e-9)
    per_block = H.project_lora_blocks(xt, wt, at, 4, 3).collect()
    assert all(len(r["row_idx"]) == len(r["y"]) for r in per_block) and len(per_block) < len(want)


def test_vectors_that_do_not_fit_fail(spark):
    w, a, x = _tables(spark)
    with pytest.raises(JOB_ERRORS):
        H.lowrank_delta(w.withColumn("b", F.array(F.lit(1.0))), a, 2, 1).collect()
    with pytest.raises(JOB_ERRORS):
        H.merge_dora(w.withColumn("m", F.lit(None).cast("double")), a, 2, 1).collect()
    with pytest.raises(JOB_ERRORS):
        H.lowrank_delta(w.withColumn("module", F.lit(None).cast("string")), a, 2, 1).collect()
    assert H.project_lora(x.limit(0), w, a, 2, 1).count() == 0
    assert H.merge_lora(w.limit(0), a, 2, 1).count() == 0


def test_projection_without_broadcast_matches(spark, monkeypatch):
    from evalspark.operators import common
    w, a, x = _tables(spark)
    small = _y(H.project_lora(x, w, a, 6, 2))
    monkeypatch.setattr(common, "BROADCAST_BYTE_LIMIT", 8)  # every vector side is "too big"
    df = H.project_lora(x, w, a, 6, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    big = _y(df)
    assert big.keys() == small.keys()
    for key, v in small.items():
        assert big[key] == pytest.approx(v, abs=1e-12)


def test_manifest_sorted_names(spark):
    sel = H.select_modules(_modules(spark)).filter("scope = 'full'")
    names = [r.param_name for r in
             H.parameter_manifest(sel.withColumn("method", F.lit("dora")), sort=True).collect()]
    assert names == sorted(names) and len(names) == 30
