"""Null and repeated ids, clashing and dotted column names, large vocabularies."""

import random
from collections import Counter

import pytest

from evalspark.llm import decontaminate, mixing, near_dup, quality

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


CLASH = ("doc_id bigint, text string, source string, `a.b` int, __kept_id int, __mix_source int, copy int, row int, "
         "at int, key int, t int, rate int, draw int, size int, target int")
EXTRA = tuple(range(12))


def rows_with_ids(rows):
    return [(*r, *EXTRA) for r in rows]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    one, other, third = text(1), text(2), text(3)
    rows = [(1, one, "s"), (None, one, "s"), (None, other, "s"), (None, other + " more", "s"), (7, third, "s"),
            (7, third, "s"), (7, text(4), "s"), (None, "", "s"), (None, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows_with_ids(rows), CLASH)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got[1, one] == 1 and got[None, one] == 0
    assert got[None, other] + got[None, other + " more"] == 1
    assert got[7, third] == 1 and got[7, text(4)] == 1
    assert got[None, ""] == 2 and got[None, None] == 1  # empty sets are linked with nothing


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_sources_meet_their_targets_without_ids(spark, ids):
    rows = [({"null": None, "one": 5, "own": i}[ids], text(i % 9, 10), "ab"[i % 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows_with_ids(rows), CLASH)
    taken = Counter(r["source"] for r in mixing.mix_sources(docs).collect())
    plan = mixing.mixture_plan(docs).groupBy("source").agg({"target": "max", "size": "sum"}).collect()
    for r in plan:
        assert abs(taken[r["source"]] * 10 / r["max(target)"] - 1) < 0.06
    assert mixing.mix_sources(docs).columns == docs.columns
    again = Counter(map(tuple, mixing.mix_sources(docs).collect()))
    assert again == Counter(map(tuple, mixing.mix_sources(docs).collect()))


def test_stages_keep_dotted_columns(spark):
    rows = [(i, text(i), "s") for i in range(20)]
    docs = spark.createDataFrame(rows_with_ids(rows), CLASH)
    benchmark = spark.createDataFrame([("b", " ".join(text(3).split()[5:20]), 0)], "item_id string, text string, `x.y` int")
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(20)) - {3}
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == 20


def brute(docs, items, window):
    out = {}
    for key, t in docs:
        ws = decontaminate.words((t or "").encode())
        hit, who = set(), set()
        for item, it in items:
            iw = decontaminate.words((it or "").encode())
            size = min(window, len(iw))
            for i in range(len(iw) - size + 1 if size else 0):
                for j in range(len(ws) - size + 1):
                    if ws[j:j + size] == iw[i:i + size]:
                        hit.update(range(j, j + size))
                        who.add(item)
        out[key] = (len(ws), len(hit), len(who))
    return out


@pytest.mark.parametrize("singles", [1_000_000, 20])
@pytest.mark.parametrize("block", [1 << 25, 90])
def test_any_number_of_words_and_blocks(spark, monkeypatch, singles, block):
    """More words than characters: pairs; a benchmark in several blocks; repeated rows and items."""
    monkeypatch.setattr(decontaminate, "SINGLES", singles)
    monkeypatch.setattr(decontaminate, "TRAILS", 7)
    r = random.Random(singles + block)
    vocab = [f"v{i}" for i in range(90)]
    items = [(f"i{k}", " ".join(r.choice(vocab) for _ in range(r.randint(0, 9)))) for k in range(25)]
    items += [("i1", items[1][1]), ("twin", items[2][1]), ("none", None)]
    known = [t for _, t in items if t]
    docs = [(k, " ".join(r.choice(vocab) for _ in range(30)) + f" {r.choice(known)} tail" if k % 4 else None)
            for k in range(25)]
    got = decontaminate.contamination_digest(
        spark.createDataFrame([*docs, docs[5]], "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id string, text string"), window=4, block_bytes=block).collect()
    want = brute(docs, items, 4)
    assert len(got) == len(docs) + 1
    for row in got:
        assert (row["n_words"], row["n_hit"], row["n_items"]) == want[row["doc_id"]]
