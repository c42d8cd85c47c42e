"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from evalspark.llm import periodic_runs as R


def brute_runs(w):
    """Every maximal stretch of each period, kept if no smaller period holds."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            part = w[start:start + length]
            smallest = next(p for p in range(1, length + 1) if part[p:] == part[:length - p])
            if smallest == q and length >= max(6, 4 * q):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(key, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode())
    if plant and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or [None] * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_sequences_equal_brute_force(letters):
    r = random.Random(letters)
    for _ in range(250):
        w = []
        while len(w) < r.randint(0, 90):
            part = [r.randrange(letters) for _ in range(r.randint(1, 7))]
            w += (part * r.randint(1, 9))[:r.randint(1, 60)]
        assert sorted(R.runs_of(w), key=lambda x: (x[0], x[2])) == brute_runs(w), w


def test_square_of_squares():
    assert R.runs_of([0, 0, 1] * 8 + [0, 0, 0]) == sorted(brute_runs([0, 0, 1] * 8 + [0, 0, 0]))
    assert R.runs_of([4] * 6) == [(0, 6, 1)] and R.runs_of([4] * 5) == []
    assert R.runs_of([1, 2] * 4) == [(0, 8, 2)] and R.runs_of([1, 2] * 3) == []


def corpus():
    r = random.Random(3)
    texts = [None, "", " \t\n ", "word", "a a a a a a", "a a a a a", "A a A a A a A a", "é é é é é é\x0bé\x0cé",
             "x y " * 9, " ".join(["the same line of seven words here"] * 40),
             " ".join(str(i) for i in range(3000)), "z " * 20000]
    for k in range(120):
        words = []
        for _ in range(r.randint(1, 12)):
            part = [r.choice("abcdefgh") for _ in range(r.randint(1, 9))]
            words += part * r.choice([1, 1, 1, 2, 4, 5, 9])
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    return texts


def test_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "TEXT_SLICE", 300)
    rows = [*enumerate(corpus()), (13, "b c " * 30), (13, "b c " * 30), (None, "b c " * 30), (None, None)]
    docs = spark.createDataFrame([(*x, 0, "s", "t") for x in rows],
                                 "doc_id bigint, text string, runs int, collapsed string, t string")
    got = [tuple(x) for x in R.run_digest(R.find_runs(docs, edit=R.repeated_tail)).collect()]
    assert sorted(got, key=repr) == sorted((brute(*x) for x in rows), key=repr)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k is not None)


def test_real_outputs(spark):
    docs = spark.createDataFrame([("k", "to be or  to be or to be or to be or not")], "`a.b` string, text string")
    row = R.find_runs(docs, id_col="a.b").first()
    assert row["collapsed"] == "to be or not"
    assert [tuple(x) for x in row["runs"]] == [(0, 12, 3)] and row["n_words"] == 13


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.run_digest(R.find_runs(docs)).count() == 0


def test_query_equals_brute_force(spark, sf_small):
    from evalspark.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(x) for x in QUERIES["op13_periodic_runs"](spark, sf_small).collect()]
    assert sorted(got) == sorted(brute(*x) for x in rows)
