"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import suffix


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a:a + length] for _, t in texts for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a:a + length]] > 1:
                gone[a:a + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for x, y in zip(b"\0" + bytes(gone), gone) if y and not x)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (15, 25, 60, 120)]
    texts = [prose(r.randint(1, 150)) for _ in range(40)]
    for i in range(30):
        texts.append(prose(r.randint(0, 30)) + r.choice(shared) + prose(r.randint(0, 30)) + r.choice(shared))
    texts += [texts[3], texts[3], texts[5][:200] + "X" + texts[5][200:], "a" * 700, "ab" * 300, "", None]
    return list(enumerate(texts)) + [(7, texts[7]), (None, shared[3])]


@pytest.mark.parametrize("hot", [1 << 19, 200])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix, "TASK_BYTES", 4000)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "k")
    got = suffix.remove_repeats(docs, length=100, gram=32).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 100)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, k int, runs int")
    assert suffix.remove_repeats(docs).count() == 0


def test_segments_cut_nothing(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    text = ("".join(random.Random(1).choice("ab") for _ in range(300)) * 2).encode()
    places = sum(int((n * times).sum()) for _, n, _, times, _, _ in suffix.anchors(text, 100, 32))
    assert places == len(text) - 99


def test_pointers_order_suffixes():
    data = np.frombuffer(b"abracadabra" * 3 + b"cabra", np.uint8)
    pointer = suffix.bucket_pointers(data, 20)
    raw = data.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:i + 20])
    for rank, i in enumerate(order):
        assert pointer[i] <= rank and raw[i:i + 20] == raw[order[pointer[i]]:order[pointer[i]] + 20]
