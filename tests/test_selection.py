"""Order statistics by counting, against a plain sort."""

from __future__ import annotations

import datetime
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from evalspark.operators import selection as S
from evalspark.operators import sequences as D

JOB_ERRORS = (PySparkException, Py4JJavaError)


def _rows(seed=3, n=900):
    r = random.Random(seed)
    groups = ["hot"] * 6 + ["a", "b", None]
    return [(r.choice(groups), i, f"{'shared prefix ' if i % 3 else ''}{r.randint(0, 999):03d}-{i}",
             r.choice([-1.5e200, 0.0, 2.5, float("inf"), float("nan")]), i % 2 == 0,
             datetime.date(2020, 1, 1) + datetime.timedelta(days=i)) for i in r.sample(range(n), n)]


SCHEMA = "g string, k long, s string, d double, b boolean, t date"


def _key(row, cols):
    out = []
    for c in cols:
        v = row[SCHEMA.replace(",", "").split()[::2].index(c)]
        out.append((1, 0) if isinstance(v, float) and v != v else (0, v))
    return tuple(out)


@pytest.mark.parametrize("ranked", [200_000, 25])
@pytest.mark.parametrize("order", [["k"], ["s"], ["d", "k"], ["b", "s"], ["t"]])
@pytest.mark.parametrize("n", [1, 40, 500])
def test_first_rows_equal_a_sort(spark, monkeypatch, ranked, order, n):
    if ranked == 25 and n == 500 and order == ["t"]:
        pytest.skip("as k")
    monkeypatch.setattr(S, "RANKED", ranked)
    monkeypatch.setattr(S, "RANGES", 8)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for row in sorted(rows, key=lambda x: _key(x, order)):
        want.setdefault(row[0], []).append(row[1])
    got = {}
    for r in S.first_n(df, n, order, ["g"]).collect():
        got.setdefault(r["g"], set()).add(r["k"])
    assert got == {g: set(ks[:n]) for g, ks in want.items()}
    if n == 40:
        flat = {r["k"] for r in S.first_n(df, n, order).collect()}
        assert flat == {x[1] for x in sorted(rows, key=lambda x: _key(x, order))[:n]}


def test_limits_and_bad_keys(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5)], "g string, k int")
    assert S.first_n(df, None, ["k"]).count() == 3 and S.first_n(df, 0, ["k"]).count() == 0
    assert S.first_n(df, 9, ["k"], ["g"]).count() == 3 and S.first_n(df, 3, ["k"]).count() == 3
    assert S.first_n(df.limit(0), 3, ["k"], ["g"]).count() == 0 and S.first_n(df.limit(0), 3, ["k"]).count() == 0
    with pytest.raises(ValueError, match="null"):
        S.first_n(spark.createDataFrame([("x", None)], "g string, k int"), 1, ["k"], ["g"])
    tied = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2)], "g string, k int")
    with pytest.raises(JOB_ERRORS):
        S.first_n(tied, 2, ["k"], ["g"]).collect()
    assert S.first_n(tied, 1, ["k"], ["g"]).count() == 1 and S.first_n(tied, 3, ["k"]).count() == 3


@pytest.mark.parametrize("ranked", [200_000, 100])
def test_holdout_is_the_rows_of_smallest_hash(spark, monkeypatch, ranked):
    import hashlib
    monkeypatch.setattr(S, "RANKED", ranked)
    df = spark.range(3000).selectExpr("id as a", "cast(id % 7 as string) as b", "repeat('x', 50) as payload")
    by_hash = sorted(range(3000), key=lambda i: hashlib.sha256(f"9:{i}:{i % 7}".encode()).hexdigest())
    for size in (1, 120, 2999):
        got = D.holdout_split(df, size, 9, ["a", "b"]).filter("split = 'validation'")
        assert {r["a"] for r in got.collect()} == set(by_hash[:size])


def test_repeated_keys_fail_in_batches(spark):
    rows = [(1, [5], [1], [5]), (1, [6], [1], [6]), (2, [7], [1], [7])]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    with pytest.raises(JOB_ERRORS):
        D.pad_batches(df, 2, ["k"]).collect()
    with pytest.raises(JOB_ERRORS):
        D.pad_batches(df.limit(0).union(spark.createDataFrame([(None, [5], [1], [5])], df.schema)), 2, ["k"]).collect()


def test_token_lookup_cases(spark):
    vocab = spark.createDataFrame([("a", 9), ("a", 5), ("b", 6)], "token string, id int")
    df = spark.createDataFrame([(1, None), (2, ""), (2, "b a zz"), (None, "a")], "k int, t string")
    got = sorted((tuple(r["ids"]) for r in D.encode_tokens(df, "t", vocab, ["k"], out="ids").collect()))
    assert got == [(), (), (5,), (6, 5, 3)]
