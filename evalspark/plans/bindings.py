"""Bindings: the reference's input shapes, derived from the driver tables.

Each function reads parquet tables under ``sf_dir`` and returns a DataFrame
with the shape an operator expects (predictions, raw benchmark rows,
training samples, modules, weight rows ...). The same derivations are
written in DuckDB SQL next to each registered query (``plans/q_*.py``, ``plans/sql.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import constants as K

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


# Resolved scans per (session, path): a DataFrame is an immutable plan, so
# reusing it skips repeated file listing and footer reads (no data is held).
_SCANS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(getattr(spark, "_jsparkSession", spark)), path)
    df = _SCANS.get(key)
    if df is None:
        df = _SCANS.setdefault(key, spark.read.parquet(path))
    return df


def forget_scans() -> None:
    """Drop memoised scans (e.g. after the files under a path changed)."""
    _SCANS.clear()


def _case(key: Column, values: list[str]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per order: every method x scope x task cell is filled."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.when(k % 2 == 0, "lora").otherwise("dora").alias("method"),
        _case(F.floor(k / 2) % 3, ["full", "attention_only", "mlp_only"]).alias("scope"),
        _case((F.floor(k / 6) % 8).cast("int"), list(K.TASKS)).alias("task"),
        (((F.col("o_custkey") * 7 + k * 13) % 100) < 70).alias("ok"))


def rank_sweep_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions re-labelled as the seven (method, rank) sweep runs, full scope."""
    p = predictions(spark, sf_dir)
    r = p["id"] % 7
    method = F.when(r <= 3, "lora").otherwise("dora")
    rank = _case(r.cast("int"), ["32", "16", "8", "4", "16", "8", "4"]).cast("int")
    return p.select("id", "task", "ok", method.alias("method"), rank.alias("rank"),
                    F.lit("full").alias("scope"))


def generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output per prediction: right answers in capitals, wrong ones as
    near-misses, every tenth without an answer."""
    p = predictions(spark, sf_dir)
    label = (F.when(F.col("task") == "boolq", "true")
              .when(F.col("task") == "piqa", "solution2")
              .when(F.col("task") == "hellaswag", "ending4")
              .when(F.col("task") == "winogrande", "option1")
              .otherwise("answer3"))
    word = (F.when(F.col("id") % 10 == 9, F.lit("unclear"))
             .when(F.col("ok"), F.upper(label)).otherwise(F.lit("untrue")))
    return p.select("id", "method", "scope", "task", label.alias("label"),
                    F.concat(F.lit("The answer is "), word, F.lit(".")).alias("generated_text"))


def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn, the assistant turn after it and the conversation's system
    text as input (empty when none)."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    y = c.filter(F.col("role") == "system").select("conv_id", F.col("text").alias("_sys"))
    return (u.join(a, ["conv_id", "turn"])
             .join(y, "conv_id", "left")
             .select("conv_id", "turn", "instruction",
                     F.coalesce("_sys", F.lit("")).alias("input"), "output"))


_PROJ = ["q_proj", "k_proj", "v_proj", "o_proj", "up_proj", "down_proj", "gate_proj"]


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear-layer inventory: one module per part, model = brand."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("layers."), F.col("p_partkey").cast("string"), F.lit("."),
                    _case((F.col("p_partkey") % 7).cast("int"), _PROJ))
    return p.select(F.col("p_brand").alias("model"), name.alias("module_name"),
                    (F.col("p_size") * 64).cast("long").alias("in_features"),
                    ((F.col("p_size") + 1) * 32).cast("long").alias("out_features"))


# --- raw benchmark shapes -----------------------------------------------------

def boolq_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    return j.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("Is document "), F.col("doc_id").cast("string"), F.lit(" acceptable?"))
         .alias("question"),
        F.col("text").alias("passage"),
        (F.col("quality") == 1).alias("answer"))


def piqa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("goal"),
        F.col("o_orderstatus").alias("sol1"), F.col("o_orderpriority").alias("sol2"),
        (F.col("o_orderkey") % 2).alias("label"))


def social_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"),
        F.col("c_name").alias("context"), F.lit("Which segment?").alias("question"),
        F.col("c_mktsegment").alias("answerA"), F.lit("NONE").alias("answerB"),
        F.lit("OTHER").alias("answerC"),
        (F.col("c_custkey") % 3 + 1).cast("string").alias("label"))


def hellaswag_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ind"), F.col("p_partkey").alias("pos"),
        F.concat(F.lit("Part "), F.col("p_name")).alias("ctx"),
        F.array(F.col("p_brand"), F.col("p_type"), F.col("p_name"),
                F.col("p_size").cast("string")).alias("endings"),
        (F.col("p_partkey") % 4).cast("int").alias("label"))


def winogrande_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("qID"), F.col("s_suppkey").alias("pos"),
        F.concat(F.col("s_name"), F.lit(" paid _")).alias("sentence"),
        F.lit("cash").alias("option1"), F.lit("credit").alias("option2"),
        (F.col("s_suppkey") % 2 + 1).cast("string").alias("answer"))


def arc_easy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested multiple choice: question.stem + question.choices[].text, letter keys;
    every fifth row has no id (falls back to the stem)."""
    p = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("Which brand makes the "), F.col("p_name"), F.lit("?"))
    choices = F.array(*[F.struct(c.alias("text")) for c in (
        F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size").cast("string"))])
    key = F.substring(F.lit("ABCD"), ((F.col("p_partkey") % 4) + 1).cast("int"), 1)
    return p.select(
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("pos"),
        F.struct(stem.alias("stem"), choices.alias("choices")).alias("question"),
        key.alias("answerKey"))


def arc_challenge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested multiple choice over events, digit keys."""
    e = table(spark, sf_dir, "events")
    stem = F.concat(F.lit("What kind of event is "), F.col("event_id").cast("string"), F.lit("?"))
    choices = F.array(*[F.struct(F.lit(t).alias("text")) if isinstance(t, str)
                        else F.struct(t.alias("text"))
                        for t in (F.col("event_type"), "view", "click", "purchase", "error")])
    key = (F.col("event_id") % 5 + 1).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"),
        F.struct(stem.alias("stem"), choices.alias("choices")).alias("question"),
        key.alias("answerKey"))


def openbookqa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat multiple choice: ``question`` is null, empty or set; otherwise
    ``question_stem`` is used. Mixed letter/digit keys."""
    c = table(spark, sf_dir, "customer")
    r = F.col("c_custkey") % 3
    question = (F.when(r == 0, F.lit(None).cast("string")).when(r == 1, F.lit(""))
                 .otherwise(F.concat(F.lit("Segment of "), F.col("c_name"), F.lit("?"))))
    key = F.when(F.col("c_custkey") % 2 == 0, F.lit("A")).otherwise(F.lit("4"))
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("pos"),
        question.alias("question"),
        F.concat(F.lit("What is the market segment of "), F.col("c_name"), F.lit("?"))
         .alias("question_stem"),
        F.struct(F.array(F.col("c_mktsegment"), F.lit("NONE"), F.lit("OTHER"), F.lit("ALL"))
                 .alias("text")).alias("choices"),
        key.alias("answerKey"))


RAW_BINDINGS = {
    "boolq": boolq_raw,
    "piqa": piqa_raw,
    "social_i_qa": social_raw,
    "hellaswag": hellaswag_raw,
    "winogrande": winogrande_raw,
    "ARC-Easy": arc_easy_raw,
    "ARC-Challenge": arc_challenge_raw,
    "openbookqa": openbookqa_raw,
}


def raw_benchmarks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {task: fn(spark, sf_dir) for task, fn in RAW_BINDINGS.items()}


# --- vectors --------------------------------------------------------------------

ADAPTER_RANK = 2
ADAPTER_ALPHA = 4.0
DORA_MAGNITUDE = 1.5


def _module(label_col) -> Column:
    return F.concat(F.lit("layer"), label_col.cast("string"))


def weight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W rows from embeddings (as double), one module per label (``layer<label>``),
    B row ``b_k = ((vec_id+k) % 5 - 2)/10``, bias ``label/10`` and magnitude 1.5."""
    e = table(spark, sf_dir, "embeddings")
    b = F.array(*[((F.col("vec_id") + k) % 5 - 2) / 10.0 for k in range(ADAPTER_RANK)])
    return e.select(
        _module(F.col("label")).alias("module"), F.col("vec_id").alias("row_idx"),
        F.transform("embedding", lambda x: x.cast("double")).alias("w"),
        b.alias("b"), (F.col("label") / 10.0).alias("bias"),
        F.lit(DORA_MAGNITUDE).alias("m"))


def a_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per module: its ``rank`` lowest-id embedding rows (a per-module top-k,
    planned as a partial group limit)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    top = e.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= ADAPTER_RANK)
    return top.select(_module(F.col("label")).alias("module"), (F.col("_rn") - 1).cast("int").alias("k"),
                      F.transform("embedding", lambda x: x.cast("double")).alias("a"))


def input_batch(spark: SparkSession, sf_dir: str, width: int = 64, modules: int = 10
                ) -> DataFrame:
    """Input vectors, one per nation, fed to module ``layer<key % modules>``:
    ``x_j = ((key*7 + j) % 11 - 5)/10``."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    x = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: ((key * 7 + j) % 11 - 5) / 10.0)
    return n.select(_module(key % modules).alias("module"), key.cast("long").alias("x_id"),
                    x.alias("x"))
