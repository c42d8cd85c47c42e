"""The pipeline's stages against plain versions, on texts with nulls, repeats and copies."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evalspark.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(12)
    vocab = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [line(r.randint(1, 90)) for _ in range(50)]
    for i in range(12):  # near copies of every degree
        words = texts[i].split()
        for k in r.sample(range(len(words)), min(len(words), i % 5)):
            words[k] = f"other{k}"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), "", " \n", None, "tiny", "tiny", "two words", line(3000)]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], i) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s1", 3), (None, texts[5], "en", "s2", 0), (None, line(20), "en", "s2", 0),
             (None, None, None, None, None), (7, line(30), "en", None, 7)]
    return rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def groups(rows):
    """Union of rows linked at similarity 0.8: a set of row numbers for each row."""
    sets, of = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                of[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    for group in groups(rows):
        mine = [rows[i] for i in group]
        ids = [r[0] for r in mine if r[0] is not None]
        left = [r for r in set(mine) for _ in range(kept[r])] if len(group) > 1 else [r for r in mine if kept[r]]
        assert len(left) == 1, mine
        assert left[0][0] == (min(ids) if ids else None)
    assert sum(kept.values()) == len(groups(rows))


def windows(text, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, {tuple(w[i:i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} - {()}


def test_decontamination_stage(spark, tmp_dir):
    rows = corpus()
    items = [("a", " ".join(rows[70][1].split()[100:115])), ("b", "Tiny"), ("c", None), ("d", ""), ("e", rows[2][1])]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(map(tuple, corpus_pipeline.drop_contaminated(spark, docs, tmp_dir).collect()))
    keys = [k for _, t in items for k in windows(t)[1]]

    def hit(text):
        w = windows(text)[0]
        return any(tuple(w[i:i + len(k)]) == k for k in keys for i in range(len(w) - len(k) + 1))

    assert got == Counter(r for r in rows if not hit(r[1])) and sum(got.values()) < len(rows)


def targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, open_, out = 1.5 * sum(sizes.values()), dict(sizes), {}
    while open_:
        level = (want - sum(out.values())) / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * level >= 2 * sizes[s]]
        if not full:
            return out | {s: weights[s] * level for s in open_}
        for s in full:
            out[s] = 2 * open_.pop(s)
    return out


def test_mixing_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    plan = mixing.mixture_plan(docs).collect()
    assert {r["source"]: r["target"] for r in plan} == pytest.approx(want)
    got = Counter(map(tuple, corpus_pipeline.mix(spark, docs, "").collect()))
    for r in rows:
        rate = want[r[3]] / sizes[r[3]]
        times = got[r] / rows.count(r)
        assert math.floor(rate) <= times <= math.floor(rate) + 1
    assert corpus_pipeline.mix(spark, docs, "").columns == docs.columns


def test_encoding_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[r[0], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    out = corpus_pipeline.encode(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):  # ids without gaps, null ids first
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


def test_every_stage_on_an_empty_table(spark, tmp_dir):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0
