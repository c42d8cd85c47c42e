"""The classifier's steps against a plain dictionary version."""

import math
import random

import numpy as np
import pytest

from evalspark.llm import quality as Q


class Plain:
    """FTRL-proximal with dictionaries, one coordinate at a time. Places may
    repeat in a row (spaces share the table); each entry then steps by itself
    from the same state, as the update does."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, i):
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        if abs(z) <= Q.L1:
            return 0.0
        return (math.copysign(Q.L1, z) - z) / ((Q.BETA + math.sqrt(n)) / Q.ALPHA + Q.L2)

    def update(self, row, label):
        w = [self.weight(i) for i, _ in row]
        p = 1 / (1 + math.exp(-sum(a * x for a, (_, x) in zip(w, row))))
        old = {i: self.n.get(i, 0.0) for i, _ in row}
        for a, (i, x) in zip(w, row):
            g = (p - label) * x
            sigma = (math.sqrt(old[i] + g * g) - math.sqrt(old[i])) / Q.ALPHA
            self.n[i] = self.n.get(i, 0.0) + g * g
            self.z[i] = self.z.get(i, 0.0) + g - sigma * a


def test_steps_equal_a_plain_version():
    r = random.Random(5)
    model, plain = Q.Ftrl(40), Plain()
    for _ in range(500):
        row = [(r.randrange(40), r.uniform(0.1, 1)) for _ in range(r.randint(0, 8))]
        label = int(sum(i % 3 == 0 for i, _ in row) > 2)
        model.update(np.array([i for i, _ in row], int), np.array([x for _, x in row]), label)
        plain.update(row, label)
    got = model.weights()
    assert got == pytest.approx([plain.weight(i) for i in range(40)], abs=1e-9) and (got != 0).any()


def test_score_is_the_sparse_dot_product():
    texts = [b"", b"one two two THREE", "é è é 12 12!".encode(), b"a " * 4000]
    w = np.random.default_rng(2).standard_normal((1 << Q.BITS) + 1).astype(np.float32)
    for text, score in zip(texts, Q.scores_of(texts, w)):
        row, place, value = Q.vectors([text])
        margin = sum(float(w[p]) * v for p, v in zip(place, value))
        assert score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, margin)))), abs=1e-6)


def test_query_on_held_out_labels(spark):
    from evalspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = [(r["score"], r["quality"]) for r in got.join(labels, "doc_id").collect() if r["held_out"]]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    assert good and bad
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.9
