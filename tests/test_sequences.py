"""Training-sequence preparation (D1-D9) on literal rows and laws."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark.operators import sequences as D

VOCAB = ["<pad>", "<s>", "</s>", "<unk>", "Below", "is", "an", "instruction", "that", "describes",
         "a", "task", "Write", "response", "appropriately", "completes", "the", "request",
         "Instruction", "Response", "Answer", "true", "false", "or", "Q1", "Q2"]

JOB_ERRORS = (PySparkException, Py4JJavaError)


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, id int")


def test_encode_word_level(spark, vocab):
    df = spark.createDataFrame([(1, "Answer true or false."), (2, "")], "k int, text string")
    got = {r.k: list(r.ids) for r in D.encode_tokens(df, "text", vocab, ["k"], out="ids").collect()}
    # '.' is an unknown piece -> unk (3); an empty text encodes to nothing.
    assert got == {1: [20, 21, 23, 22, 3], 2: []}


def test_truncate_and_eos(spark):
    df = spark.createDataFrame([([5, 6],), ([5, 2],), ([5, 6, 7, 8],)], "ids array<int>")
    got = [list(r[0]) for r in df.select(D.truncate_append_eos("ids", 3)).collect()]
    assert got == [[5, 6, 2], [5, 2], [5, 6, 7]]
    empty = spark.createDataFrame([([],)], "ids array<int>")
    with pytest.raises(JOB_ERRORS):
        empty.select(D.truncate_append_eos("ids", 3)).collect()


def test_mask_labels(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 2), ([1, 2], 5)], "ids array<int>, n int")
    rows = df.select(D.mask_labels("ids", F.col("n")).alias("l"), D.attention_mask("ids").alias("m"),
                     D.mask_labels("ids", F.col("n"), train_on_inputs=True).alias("t")).collect()
    assert list(rows[0].l) == [-100, -100, 3, 4, 5]
    assert list(rows[1].l) == [-100, -100]  # capped at the sequence length
    assert list(rows[0].m) == [1] * 5 and list(rows[0].t) == [1, 2, 3, 4, 5]


def test_tokenize_examples_prompt_positions(spark, vocab):
    df = spark.createDataFrame([(1, "Answer true or false Q1", "Answer true or false")],
                               "k int, full_prompt string, user_prompt string")
    r = D.tokenize_examples(df, vocab, ["k"], cutoff=128).collect()[0]
    assert list(r.input_ids) == [20, 21, 23, 22, 24, 2]
    assert r.prompt_len == 4
    assert list(r.labels) == [-100] * 4 + [24, 2]


def test_holdout_exact_and_disjoint(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    s = D.holdout_split(df, 12, 42, ["k"]).cache()
    assert s.filter("split = 'validation'").count() == 12
    assert s.count() == 100 and s.select("k").distinct().count() == 100
    again = D.holdout_split(df.repartition(7), 12, 42, ["k"]).filter("split = 'validation'")
    assert sorted(r.k for r in again.collect()) == sorted(
        r.k for r in s.filter("split = 'validation'").collect())
    assert D.holdout_split(df, 0, 42, ["k"]).filter("split = 'validation'").count() == 0
    assert D.holdout_split(df, 100, 42, ["k"]).filter("split = 'validation'").count() == 0


def test_pad_batches(spark):
    rows = [(i, list(range(1, i + 2)), [1] * (i + 1), list(range(1, i + 2))) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>, attention_mask array<int>, "
                                     "labels array<int>")
    got = D.pad_batches(df, 4, ["k"]).collect()
    for r in got:
        assert len(r.input_ids) % 8 == 0 and len(r.input_ids) == r.padded_length
        k = r.padded_length - (r.k + 1)
        assert list(r.input_ids[:k]) == [0] * k and list(r.attention_mask[:k]) == [0] * k
        assert list(r.labels[:k]) == [-100] * k
    assert {r.batch for r in got} == {0, 1, 2}


def test_accumulation_and_report(spark):
    good = spark.createDataFrame([(16, 8)], "e int, p int")
    assert good.select(D.accumulation_steps("e", "p")).collect()[0][0] == 2
    df = spark.createDataFrame([(16, 8), (16, 3)], "e int, p int")
    with pytest.raises(JOB_ERRORS):
        df.select(D.accumulation_steps("e", "p")).collect()
    seqs = spark.createDataFrame([("train", [1, 2], [-100, -100]), ("train", [1, 2], [-100, 2]),
                                  ("validation", [1], [1])],
                                 "split string, input_ids array<int>, labels array<int>")
    rep = {r.split: r for r in D.sequence_report(seqs).collect()}
    assert (rep["train"].examples, rep["train"].fully_masked, rep["train"].tokens) == (2, 1, 4)


def test_cap_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "pos")
    assert sorted(r.pos for r in D.cap_samples(df, 5).collect()) == [0, 1, 2, 3, 4]
    assert D.cap_samples(df, None).count() == 50
    assert D.cap_samples(df, 2000).count() == 50


def test_build_vocabulary(spark):
    df = spark.createDataFrame([("b a a",), ("c a b",)], "text string")
    got = [(r.token, r.id) for r in D.build_vocabulary(df, size=2).orderBy("id").collect()]
    assert got == [("a", 4), ("b", 5)]


def test_encode_join_fallback_matches_broadcast(spark, vocab, monkeypatch):
    df = spark.createDataFrame([(1, "Answer true or false. Q2"), (2, "the request is"), (3, "")],
                               "k int, text string")
    fast = {r.k: list(r.ids) for r in D.encode_tokens(df, "text", vocab, ["k"], out="ids").collect()}
    monkeypatch.setattr(D, "VOCAB_BROADCAST_LIMIT", 3)  # vocabulary now "too big": shuffle join
    slow = {r.k: list(r.ids) for r in D.encode_tokens(df, "text", vocab, ["k"], out="ids").collect()}
    assert fast == slow
    both = spark.createDataFrame([(1, "Answer true Q1", "Answer true")],
                                 "k int, full_prompt string, user_prompt string")
    r = D.tokenize_examples(both, vocab, ["k"], cutoff=128).collect()[0]
    assert list(r.labels) == [-100, -100, 24, 2]
