"""Benchmark normalisation (B1-B11): raw task rows -> one EvalSample table.

Each normaliser is a single projection (narrow, no shuffle). The sample
schema is ``id, task, instruction, choices ARRAY<STRING>, label, pos`` where
``pos`` is the row's position in its source (used for head limits and
position joins; ids are not keys).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import as_text, label_to_index
from evalspark.operators.common import require, small_table
from evalspark.operators.selection import first_n

def _id_or(df: DataFrame, id_col: str, fallback: Column) -> Column:
    """``id`` when the column exists and is non-null, else the fallback text."""
    if id_col in df.columns:
        return F.coalesce(F.col(id_col).cast("string"), fallback)
    return fallback


def _pos(df: DataFrame, pos_col: str) -> Column:
    return F.col(pos_col).cast("long") if pos_col in df.columns else F.lit(None).cast("long")


def _sample(df: DataFrame, task: str, id_c: Column, instruction: Column, choices: Column,
            label: Column, pos_col: str) -> DataFrame:
    return df.select(
        id_c.alias("id"), F.lit(task).alias("task"), instruction.alias("instruction"),
        choices.alias("choices"), label.alias("label"), _pos(df, pos_col).alias("pos"))


def normalize_boolq(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """B1. ``answer`` must be BOOLEAN (a string 'false' would be truthy upstream)."""
    if dict(df.dtypes).get("answer") != "boolean":
        raise TypeError("boolq 'answer' must be a BOOLEAN column")
    label = F.when(F.col("answer"), F.lit("true")).otherwise(F.lit("false"))
    instruction = F.concat(
        F.lit(K.BOOLQ_HEAD + "Passage: "), as_text("passage"),
        F.lit("\nQuestion: "), as_text("question"),
        F.lit("\n\n" + K.BOOLQ_FORMAT))
    return _sample(df, "boolq", _id_or(df, "id", as_text("question")), instruction,
                   F.array(F.lit("true"), F.lit("false")), label, pos_col)


def normalize_piqa(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """B2. 0-based label -> solution{label+1}."""
    label = F.concat(F.lit("solution"), (F.col("label").cast("int") + 1).cast("string"))
    instruction = F.concat(
        F.lit(K.PIQA_HEAD + "Goal: "), as_text("goal"),
        F.lit("\nsolution1: "), as_text("sol1"),
        F.lit("\nsolution2: "), as_text("sol2"),
        F.lit("\n\n" + K.PIQA_FORMAT))
    return _sample(df, "piqa", _id_or(df, "id", as_text("goal")), instruction,
                   F.array(as_text("sol1"), as_text("sol2")), label, pos_col)


def normalize_social(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """B3. 1-based label -> answer{label} (no shift)."""
    label = F.concat(F.lit("answer"), F.col("label").cast("int").cast("string"))
    instruction = F.concat(
        F.lit(K.SOCIAL_HEAD + "Context: "), as_text("context"),
        F.lit("\nQuestion: "), as_text("question"),
        F.lit("\nanswer1: "), as_text("answerA"),
        F.lit("\nanswer2: "), as_text("answerB"),
        F.lit("\nanswer3: "), as_text("answerC"),
        F.lit("\n\n" + K.SOCIAL_FORMAT))
    return _sample(df, "social_i_qa", _id_or(df, "id", as_text("question")), instruction,
                   F.array(as_text("answerA"), as_text("answerB"), as_text("answerC")),
                   label, pos_col)


def normalize_hellaswag(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """B4. Text shows endings 1-4, choices keeps all; fewer than 4 is an error."""
    df = require(df, F.size("endings") >= 4, "hellaswag row has fewer than 4 endings")
    endings = F.transform(F.col("endings"), lambda e: as_text(e))
    checked = endings
    label = F.concat(F.lit("ending"), (F.col("label").cast("int") + 1).cast("string"))
    instruction = F.concat(
        F.lit(K.HELLASWAG_HEAD + "Context: "), as_text("ctx"),
        F.lit("\nending1: "), F.element_at(checked, 1),
        F.lit("\nending2: "), F.element_at(checked, 2),
        F.lit("\nending3: "), F.element_at(checked, 3),
        F.lit("\nending4: "), F.element_at(checked, 4),
        F.lit("\n\n" + K.HELLASWAG_FORMAT))
    return _sample(df, "hellaswag", _id_or(df, "ind", as_text("ctx")), instruction,
                   endings, label, pos_col)


def normalize_winogrande(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """B5. option{answer}: the answer text is pasted, not cast."""
    label = F.concat(F.lit("option"), as_text("answer"))
    instruction = F.concat(
        F.lit(K.WINOGRANDE_HEAD + "Sentence: "), as_text("sentence"),
        F.lit("\noption1: "), as_text("option1"),
        F.lit("\noption2: "), as_text("option2"),
        F.lit("\n\n" + K.WINOGRANDE_FORMAT))
    return _sample(df, "winogrande", _id_or(df, "qID", as_text("sentence")), instruction,
                   F.array(as_text("option1"), as_text("option2")), label, pos_col)


def _mc_instruction(question_text: Column, choices: Column) -> Column:
    lines = F.array_join(
        F.transform(choices, lambda c, i: F.concat(
            F.lit("\nanswer"), (i + 1).cast("string"), F.lit(": "), c)), "")
    return F.concat(
        F.lit(K.MC_HEAD + "\n\nQuestion: "), question_text, lines,
        F.lit("\n\n" + K.MC_FORMAT))


def normalize_mc_nested(df: DataFrame, task: str, pos_col: str = "pos") -> DataFrame:
    """B6. ``question`` is a struct: stem + choices[].text."""
    q = as_text("question.stem")
    choices = F.transform(F.col("question.choices"), lambda c: as_text(c["text"]))
    label = F.concat(F.lit("answer"), label_to_index("answerKey").cast("string"))
    return _sample(df, task, _id_or(df, "id", q), _mc_instruction(q, choices), choices,
                   label, pos_col)


def normalize_mc_flat(df: DataFrame, task: str, pos_col: str = "pos") -> DataFrame:
    """B7. ``question`` string, or ``question_stem`` when question is absent or empty."""
    # Either column may be missing from the file; a row needs one of them.
    q = (as_text("question_stem") if "question_stem" in df.columns
         else F.raise_error(F.lit("row has no question text")).cast("string"))
    if "question" in df.columns:
        q = F.coalesce(F.nullif(F.col("question").cast("string"), F.lit("")), q)
    choices = F.transform(F.col("choices.text"), lambda c: as_text(c))
    label = F.concat(F.lit("answer"), label_to_index("answerKey").cast("string"))
    return _sample(df, task, _id_or(df, "id", q), _mc_instruction(q, choices), choices,
                   label, pos_col)


def normalize_mc(df: DataFrame, task: str, pos_col: str = "pos") -> DataFrame:
    """Pick B6 or B7 from the raw schema (struct ``question`` or not)."""
    qtype = dict(df.dtypes).get("question", "")
    if qtype.startswith("struct"):
        return normalize_mc_nested(df, task, pos_col)
    return normalize_mc_flat(df, task, pos_col)


NORMALIZERS = {
    "boolq": normalize_boolq,
    "piqa": normalize_piqa,
    "social_i_qa": normalize_social,
    "hellaswag": normalize_hellaswag,
    "winogrande": normalize_winogrande,
    "ARC-Easy": lambda df, pos_col="pos": normalize_mc(df, "ARC-Easy", pos_col),
    "ARC-Challenge": lambda df, pos_col="pos": normalize_mc(df, "ARC-Challenge", pos_col),
    "openbookqa": lambda df, pos_col="pos": normalize_mc(df, "openbookqa", pos_col),
}


def normalize_task(task: str, df: DataFrame, pos_col: str = "pos") -> DataFrame:
    if task not in NORMALIZERS:
        raise ValueError(f"Unsupported benchmark task: {task}")
    return NORMALIZERS[task](df, pos_col=pos_col)


def normalize_all(raw_by_task: Mapping[str, DataFrame], pos_col: str = "pos",
                  limit: int | None = None) -> DataFrame:
    """B9 (+B10): normalise every task and union them into one sample table."""
    parts = [normalize_task(task, df, pos_col) for task, df in raw_by_task.items()]
    if not parts:
        raise ValueError("no benchmark tasks given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return head_limit(out, limit)


def head_limit(samples: DataFrame, n: int | None, group: Sequence[str] = ("task",),
               order: Sequence[str] = ("pos",)) -> DataFrame:
    """First ``n`` rows per task in source order; None keeps everything.
    Null positions are an error, as are rows that tie at the limit."""
    return first_n(samples, n, list(order), list(group))


def benchmark_catalog(spark: SparkSession,
                      catalog: Mapping[str, tuple[str, str | None, str]] = K.BENCHMARK_CATALOG
                      ) -> DataFrame:
    """Task -> (dataset, subset, split) dimension table."""
    rows = [(t, d, s, sp) for t, (d, s, sp) in catalog.items()]
    return small_table(spark, rows, "task string, dataset string, subset string, split string")


def attach_catalog(samples: DataFrame) -> DataFrame:
    """Join samples to the (tiny, broadcast) catalog; unknown tasks get nulls."""
    return samples.join(benchmark_catalog(samples.sparkSession), "task", "left")
