"""The manifest against a plain one-machine version and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from evalspark.llm import merkle
from evalspark.llm.oracles import ORACLES

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(part, row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    steps = []
    for row in tree[:-1]:
        steps.append((i & 1, row[i ^ 1] if i ^ 1 < len(row) else None))
        i >>= 1
    return steps


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees, top = {}, []
    for g in sorted(groups):
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (ordered, levels([leaf(r) for r in ordered]))
        top.append(trees[g][1][-1][0])
    over, out = levels(top), []
    for gi, g in enumerate(sorted(groups)):
        ordered, tree = trees[g]
        for i, r in enumerate(ordered):
            steps = way(tree, i) + way(over, gi)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for odd, h in steps:
                node = H(h or "", node) if odd else H(node, h or "")
            out.append((r[0], leaf(r), tree[-1][0], over[-1][0], H(*(h for _, h in steps if h)), node,
                        node == over[-1][0]))
    return sorted(out, key=repr)


def corpus(n, seed=1):
    r = random.Random(seed)
    langs = ["en"] * 12 + ["de"] * 5 + ["é", "zz", "", None, "a.b"]
    rows = [(i, r.choice(["s1", None, "x" * 30]), r.choice(langs), r.choice([0, 9, 99, None, 2**62]),
             r.choice([None, "", "text", "ü" * r.randint(1, 40)])) for i in range(n)]
    return rows + [(n, "s", "lone", 1, "t"), (3, "s1", "en", 5, "t"), (3, "s1", "en", 5, "t"), (None, None, None, None, None),
                   (None, "s", "en", 9, "a"), (None, "s", "en", 9, "a")]


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digests(docs, every):
    m = merkle.build_manifest(docs, every=every, claimed={"n_chars": merkle.changed_counts()})
    got = merkle.proofs(m).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return m, sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("n,every", [(90, 1), (90, 2), (300, 3), (300, 8), (0, 2)])
def test_equals_brute_force(spark, n, every):
    rows = corpus(n)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", grp int, `in.dex` string")
    m, got = digests(docs, every)
    assert got == brute(rows)
    if every == 2 and n:
        assert len(m.levels) > 1 and len(m.top_levels) > 1


def test_single_leaf_and_empty_table(spark):
    one = [(7, "s", "en", 3, "abc")]
    _, got = digests(spark.createDataFrame(one, SCHEMA), 2)
    assert got == brute(one) and got[0][2] == got[0][1] == got[0][3]
    assert digests(spark.createDataFrame([], SCHEMA), 2)[1] == []


def test_siblings_lead_to_the_root(spark):
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    m = merkle.build_manifest(docs, every=2)
    for r in merkle.proofs(m, siblings=True).collect():
        assert r["verified"] and H(*r["siblings"]) == r["proof_sha256"]


def test_other_order_of_rows_gives_the_same_root(spark):
    rows = corpus(80)
    roots = {bytes(merkle.build_manifest(spark.createDataFrame(x, SCHEMA).repartition(k), every=3).root.first()["digest"])
             for k, x in ((2, rows), (7, rows[::-1]))}
    assert len(roots) == 1
    changed = [(*rows[0][:4], "another"), *rows[1:]]
    assert bytes(merkle.build_manifest(spark.createDataFrame(changed, SCHEMA)).root.first()["digest"]) not in roots


def test_query_equals_sql(spark, sf_small):
    from evalspark.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_small}/documents.parquet')")
    res = con.execute(ORACLES["op11_merkle_manifest"])
    names = [d[0] for d in res.description]
    got = QUERIES["op11_merkle_manifest"](spark, sf_small)
    assert got.columns == names
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(res.fetchall()) and not all(r[-1] for r in rows) and any(r[-1] for r in rows)
