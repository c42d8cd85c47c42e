"""The factorization machine against a plain version, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from evalspark.llm import toxicity as T


def test_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(1)
    model = r.standard_normal((21, 4)).astype(np.float32)
    model[[3, 8, 9]] = 0  # terms that aren't in use
    rows = [(0, 3), (0, 5), (0, 7), (2, 1), (2, 5), (2, 8), (2, 19)]
    x = r.random(len(rows))
    got = T.margins(np.array([a for a, _ in rows]), np.array([b for _, b in rows]), x, 3, model)
    for text in range(3):
        mine = [(b, v) for (a, b), v in zip(rows, x) if a == text]
        want = model[-1, 0] + sum(model[b, 0] * v for b, v in mine) + sum(
            model[b1, 1:] @ model[b2, 1:] * v1 * v2
            for i, (b1, v1) in enumerate(mine) for b2, v2 in mine[i + 1:])
        assert got[text] == pytest.approx(want, abs=1e-5)


class Plain:
    """The same steps with dictionaries and loops over pairs."""

    def __init__(self, start, factors):
        self.z, self.n, self.v, self.nv, self.factors = {}, {}, start, {}, factors

    def weight(self, i):
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        if abs(z) <= T.L1:
            return 0.0
        return (math.copysign(T.L1, z) - z) / ((T.BETA + math.sqrt(n)) / T.ALPHA + T.L2)

    def update(self, terms, label, weight):
        w = {i: self.weight(i) for i in terms}
        used = [i for i in terms if w[i]]
        y = self.weight("b") + sum(w[i] * x for i, x in terms.items())
        for a, i in enumerate(used):
            for j in used[a + 1:]:
                y += sum(p * q for p, q in zip(self.v[i], self.v[j])) * terms[i] * terms[j]
        g = weight * (1 / (1 + math.exp(-y)) - label)
        steps = {i: [g * terms[i] * sum(self.v[j][k] * terms[j] for j in used if j != i) + T.SHRINK_V * self.v[i][k]
                     for k in range(self.factors)] for i in used}
        for i, x in [*terms.items(), ("b", 1.0)]:
            n, old = self.n.get(i, 0.0), self.weight(i)
            self.n[i] = n + (g * x) ** 2
            self.z[i] = self.z.get(i, 0.0) + g * x - (math.sqrt(self.n[i]) - math.sqrt(n)) / T.ALPHA * old
        for i, step in steps.items():
            for k, gv in enumerate(step):
                self.nv[i, k] = self.nv.get((i, k), 1.0) + gv * gv
                self.v[i][k] -= T.RATE_V * gv / math.sqrt(self.nv[i, k])


def test_steps_equal_a_plain_version():
    r = random.Random(4)
    model = T.FactorizationMachine(size=30, factors=3)
    plain = Plain({i: list(map(float, model.v[i])) for i in range(30)}, 3)
    for _ in range(400):
        terms = {i: r.uniform(0.5, 2) for i in sorted(r.sample(range(30), r.randint(0, 6)))}
        label = int(3 in terms and 4 in terms or 7 in terms)
        weight = T.RARE if label else 1.0
        model.update(np.array(list(terms), int), np.array(list(terms.values())), label, weight)
        plain.update(terms, label, weight)
    got = model.parameters()
    for i in range(30):
        assert got[i, 0] == pytest.approx(plain.weight(i), abs=2e-3)
        if got[i, 0]:
            assert got[i, 1:] == pytest.approx(plain.v[i], abs=2e-3)
    assert got[-1, 0] == pytest.approx(plain.weight("b"), abs=2e-3) and (got[:-1, 0] != 0).any()


def test_pair_that_no_linear_weights_tell():
    """Toxic only where an insult meets a group: either alone is harmless."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(2000):
        kind = r.randrange(4)
        text = [word() for _ in range(12)] + ["zwrkq"] * (kind & 1) + ["vpnm"] * (kind >> 1)
        r.shuffle(text)
        rows.append((" ".join(text).encode(), int(kind == 3)))
    pack = []
    for text, label in rows:
        row, place, value = T.vectors([text])
        pack.append((place, value, label))
    model = T.train(pack[:1500], epochs=8)
    got = T.scores_of([t for t, _ in rows[1500:]], model) >= 0.5
    assert np.mean(got == np.array([x for _, x in rows[1500:]])) > 0.97
    insult, group = (T.vectors([t])[1][0] for t in (b"zwrkq", b"vpnm"))
    assert model[insult, 1:] @ model[group, 1:] > 0.1


def test_vectors_do_not_depend_on_segments(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("ab é,\n.") for _ in range(n)).encode() for n in (0, 5, 900, 40, 3000)]
    whole = T.vectors(texts)
    monkeypatch.setattr(T.words, "SEGMENT", 64)
    for a, b in zip(whole, T.vectors(texts)):
        assert np.allclose(a, b)


ROWS = [(1, "fine words", "t"), (1, "fine words", "t"), (None, "you utter zwrkq", "t"), (3, None, None), (4, "", "x"),
        (5, "long zwrkq " * 5000, "x"), (6, " \n", "x")]


def test_cases(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id bigint, text string, lang string, t int, `sc.ore` int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (5, 1, 1), (None, 1, 1), (77, 1, 1), (3, 2, 0), (4, None, 0)],
                                   "doc_id bigint, toxic int, quality int")
    got = T.toxicity_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (3, 4, 6)}
    assert len(blank) == 1
    assert {r["doc_id"]: r["held_out"] for r in got} == {
        k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k, *_ in ROWS}
    none = T.toxicity_scores(docs, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0
    kept = T.drop_toxic(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_query_on_held_out_labels(spark):
    """A few labels are noise: some toxic documents hold no word that tells them."""
    from evalspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = [r for r in got.join(labels, "doc_id").collect() if r["held_out"]]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    caught = np.mean([r["predicted"] for r in rows if r["toxic"] == 1])
    clean = np.mean([r["predicted"] for r in rows if r["toxic"] == 0])
    assert caught > 0.85 and clean < 0.01


def test_labels_of_the_held_out_fold_are_not_read(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["aa", "bb", "zwrkq", "cc"]) for _ in range(9))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = []
    for flip in (0, 1):
        labels = [(i, int("zwrkq" in t) ^ (flip if i in held else 0)) for i, t in rows]
        scores.append(sorted(map(tuple, T.toxicity_scores(
            docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect())))
    assert scores[0] == scores[1] and held
