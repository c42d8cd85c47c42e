"""One raw row per benchmark shape -> normalised sample."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from evalspark.operators import normalize as N

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_boolq(spark):
    df = spark.createDataFrame([("Q", "P", True, 0)],
                               "question string, passage string, answer boolean, pos long")
    r = _one(N.normalize_boolq(df))
    assert (r.label, r.id, list(r.choices), r.task) == ("true", "Q", ["true", "false"], "boolq")
    assert r.instruction.endswith("Passage: P\nQuestion: Q\n\nAnswer format: true/false")


def test_boolq_rejects_string_answers(spark):
    df = spark.createDataFrame([("Q", "P", "false")], "question string, passage string, answer string")
    with pytest.raises(TypeError):
        N.normalize_boolq(df)


def test_piqa(spark):
    df = spark.createDataFrame([("G", "S1", "S2", 1)], "goal string, sol1 string, sol2 string, label int")
    r = _one(N.normalize_piqa(df))
    assert r.label == "solution2" and r.id == "G" and list(r.choices) == ["S1", "S2"]
    assert "solution1: S1\nsolution2: S2" in r.instruction


def test_social(spark):
    df = spark.createDataFrame([("C", "Q", "A", "B", "X", "2")],
                               "context string, question string, answerA string, answerB string, "
                               "answerC string, label string")
    r = _one(N.normalize_social(df))
    assert r.label == "answer2" and list(r.choices) == ["A", "B", "X"]


def test_hellaswag(spark):
    df = spark.createDataFrame([("ctx", ["e1", "e2", "e3", "e4", "e5"], 0)],
                               "ctx string, endings array<string>, label int")
    r = _one(N.normalize_hellaswag(df))
    assert r.label == "ending1" and r.id == "ctx" and len(r.choices) == 5
    assert "ending4: e4\n\n" in r.instruction and "e5" not in r.instruction


def test_hellaswag_needs_four_endings(spark):
    df = spark.createDataFrame([("ctx", ["e1", "e2"], 0)], "ctx string, endings array<string>, label int")
    with pytest.raises(JOB_ERRORS):
        N.normalize_hellaswag(df).collect()


def test_winogrande(spark):
    df = spark.createDataFrame([("S _", "a", "b", "2")],
                               "sentence string, option1 string, option2 string, answer string")
    assert _one(N.normalize_winogrande(df)).label == "option2"


NESTED = ("question struct<stem string, choices array<struct<text string>>>, answerKey string, "
          "id string")


@pytest.mark.parametrize("task,key,label", [("ARC-Easy", "B", "answer2"),
                                            ("ARC-Challenge", "D", "answer4")])
def test_mc_nested(spark, task, key, label):
    df = spark.createDataFrame([(("Stem?", [("a",), ("b",), ("c",), ("d",)]), key, None)], NESTED)
    r = _one(N.normalize_mc(df, task))
    assert r.label == label and r.id == "Stem?" and list(r.choices) == ["a", "b", "c", "d"]
    assert r.instruction == ("Choose the correct answer to the multiple-choice question.\n\n"
                             "Question: Stem?\nanswer1: a\nanswer2: b\nanswer3: c\nanswer4: d\n\n"
                             "Answer format: answer1/answer2/answer3/answer4/answer5")


def test_mc_flat_uses_stem_when_question_empty(spark):
    schema = "question string, question_stem string, choices struct<text array<string>>, answerKey string"
    df = spark.createDataFrame([("", "Stem", (["x", "y"],), "1"),
                                (None, "Stem2", (["x"],), "A"),
                                ("Q", "Stem3", (["x"],), "1")], schema)
    rows = N.normalize_mc(df, "openbookqa").collect()
    assert [r.id for r in rows] == ["Stem", "Stem2", "Q"]
    assert [r.label for r in rows] == ["answer1", "answer1", "answer1"]


def test_normalize_all_and_head_limit(spark):
    piqa = spark.createDataFrame([(f"g{i}", "a", "b", i % 2, i) for i in range(10)],
                                 "goal string, sol1 string, sol2 string, label int, pos long")
    wino = spark.createDataFrame([(f"s{i}", "a", "b", "1", i) for i in range(3)],
                                 "sentence string, option1 string, option2 string, answer string, pos long")
    allt = N.normalize_all({"piqa": piqa, "winogrande": wino})
    assert allt.count() == 13
    head = N.head_limit(allt, 4).collect()
    assert sorted((r.task, r.pos) for r in head) == (
        [("piqa", i) for i in range(4)] + [("winogrande", i) for i in range(3)])
    big = N.head_limit(allt, 5000)
    assert big.count() == 13
    with pytest.raises(ValueError):
        N.normalize_all({"nope": piqa})


def test_catalog(spark):
    cat = {r.task: (r.dataset, r.subset, r.split) for r in N.benchmark_catalog(spark).collect()}
    assert cat["winogrande"] == ("allenai/winogrande", "winogrande_xl", "validation")
    assert len(cat) == 8


def test_flat_rows_without_question_stem(spark):
    df = spark.createDataFrame(
        [("1", "Why?", (["a", "b"], ["A", "B"]), "B", 0)],
        "id string, question string, choices struct<text:array<string>,label:array<string>>, answerKey string, pos int")
    row = N.normalize_mc_flat(df, "ARC-Easy").first()
    assert "Why?" in row["instruction"] and row["answer" if "answer" in row else "label"] == "answer2"
