"""Prompt wrapper and answer extraction on literal rows."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import (
    eval_prompt,
    extract_prediction,
    format_prompt,
    label_to_index,
    py_strip,
    training_prompt,
    user_prompt,
)

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _extract(spark, rows):
    df = spark.createDataFrame(rows, "task string, text string")
    return [r[0] for r in df.select(extract_prediction("task", "text")).collect()]


def test_extraction_cases(spark):
    rows = [("boolq", "The answer is true."), ("piqa", "solution2 looks better"),
            ("social_i_qa", "I pick answer3."), ("hellaswag", "ending4"),
            ("winogrande", "option1")]
    assert _extract(spark, rows) == ["true", "solution2", "answer3", "ending4", "option1"]


def test_extraction_first_match_lowercase_and_empty(spark):
    rows = [("piqa", "not solution1 but solution2"), ("boolq", "  TRUE\n"),
            ("ARC-Easy", "answer6 or answer9"), ("openbookqa", "nothing here"),
            ("boolq", "untrue"), ("boolq", "étrue")]
    assert _extract(spark, rows) == ["solution1", "true", "", "", "", ""]


def test_extraction_unknown_task_raises(spark):
    with pytest.raises(JOB_ERRORS):
        _extract(spark, [("nope", "true")])


def test_strip_matches_python(spark):
    texts = ["\t a\n", " x ", "  ", "\x1cq\x1f", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(py_strip("t")).collect()]
    assert got == [t.strip() for t in texts]


def test_prompt_sections(spark):
    df = spark.createDataFrame([("Do it.", "ctx", "out"), ("Do it.", "", "out")],
                               "instruction string, input string, output string")
    rows = df.select(format_prompt("instruction", "input").alias("p"),
                     training_prompt("instruction", "input", "output").alias("t"),
                     user_prompt("instruction", "input").alias("u"),
                     eval_prompt("instruction").alias("e")).collect()
    with_input, no_input = rows
    assert with_input.p.startswith(K.PROMPT_WITH_INPUT_HEAD)
    assert "### Input:\nctx\n\n" in with_input.p
    assert with_input.p.endswith("### Response:\n")
    assert no_input.p.startswith(K.PROMPT_NO_INPUT_HEAD)
    assert "### Input" not in no_input.p
    assert with_input.t == with_input.p + "out"
    assert with_input.u == with_input.p
    assert no_input.e == no_input.p


def test_label_to_index(spark):
    df = spark.createDataFrame([(k,) for k in "ABCDE12345"], "k string")
    assert [r[0] for r in df.select(label_to_index("k")).collect()] == [1, 2, 3, 4, 5] * 2
    bad = spark.createDataFrame([("F",)], "k string")
    with pytest.raises(JOB_ERRORS):
        bad.select(label_to_index("k")).collect()


def test_extraction_has_one_regex_per_distinct_pattern(spark):
    df = spark.createDataFrame([("boolq", "true")], "task string, text string")
    plan = df.select(extract_prediction("task", "text").alias("p"))._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert plan.count("regexp_extract") == len(set(K.ANSWER_PATTERNS.values()))
    assert F  # keep import
