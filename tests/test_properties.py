"""Property tests: column functions against Python's own semantics, and laws.

Each hypothesis example is one batch of rows, evaluated in a single Spark
job, so the number of jobs stays small.
"""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import extract_prediction, py_strip
from evalspark.operators import compare as G
from evalspark.operators import scoring as E
from evalspark.operators.common import dense_position

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

# ASCII pieces around answers (RE2/Java/Python agree on ASCII word boundaries).
PIECES = ["true", "false", "True", "FALSE", "untrue", "truely", "solution1", "solution2",
          "solution3", "answer1", "answer5", "answer6", "ending4", "ending5", "option1",
          "option2", "xoption2", "a", "the", "is", ".", ",", "!", " ", "  ", "\t", "\n", "_",
          "2", "-"]
texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=8).map("".join)


def python_extract(task: str, text: str) -> str:
    m = re.search(K.ANSWER_PATTERNS[task], text.strip().lower())
    return m.group(1) if m else ""


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(list(K.TASKS)), texts), min_size=1, max_size=30))
def test_extract_matches_python(spark, rows):
    df = spark.createDataFrame(rows, "task string, text string")
    got = [r[0] for r in df.select(extract_prediction("task", "text")).collect()]
    assert got == [python_extract(t, x) for t, x in rows]


WS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　"]


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(WS + ["a", "b", " c "]), max_size=8).map("".join),
                min_size=1, max_size=30))
def test_strip_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(py_strip("v")).collect()]
    assert got == [v.strip() for v in values]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", "c"]),
                          st.integers(0, 10_000)), min_size=1, max_size=200, unique=True))
def test_dense_position_matches_row_number(spark, rows):
    df = spark.createDataFrame(rows, "grp string, key long").repartition(5)
    got = dense_position(df, ["key"], ["grp"], out="p")
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("grp").orderBy("key")) - 1)
    assert sorted(got.collect()) == sorted(want.collect())


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["lora", "dora"]), st.sampled_from(list(K.SCOPES))),
                min_size=1, max_size=6, unique=True),
       st.integers(0, 2**31 - 1))
def test_pivot_unpivot_round_trip(spark, runs, seed):
    rows = [(m, s, t, ((seed + i * 31 + j * 7) % 97) / 97.0)
            for i, (m, s) in enumerate(runs) for j, t in enumerate(K.TASKS)]
    acc = spark.createDataFrame(rows, "method string, scope string, task string, accuracy double")
    wide = E.run_metrics(acc)
    back = G.long_accuracy(wide).select("method", "scope", "task", "accuracy")
    assert sorted(back.collect()) == sorted(acc.collect())
    macros = {(r.method, r.scope): r.macro_average for r in wide.collect()}
    for m, s in runs:
        vals = [a for (mm, ss, _, a) in rows if (mm, ss) == (m, s)]
        assert abs(macros[(m, s)] - sum(vals) / len(vals)) < 1e-12


@SETTINGS
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.integers(1, 9))
def test_padding_law(spark, lengths, batch):
    from evalspark.operators.sequences import pad_batches
    rows = [(i, list(range(1, n + 1)), [1] * n, list(range(1, n + 1))) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>, attention_mask array<int>, "
                                     "labels array<int>")
    got = pad_batches(df, batch, ["k"]).collect()
    longest: dict[int, int] = {}
    for i, n in enumerate(lengths):
        longest[i // batch] = max(longest.get(i // batch, 0), n)
    for r in got:
        n = lengths[r.k]
        target = -(-longest[r.k // batch] // 8) * 8
        assert r.batch == r.k // batch and len(r.input_ids) == target
        assert list(r.input_ids[target - n:]) == list(range(1, n + 1))
        assert sum(r.attention_mask) == n
