"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing
columns and empty tables, against SQL or a plain Python version."""

import re
import zlib

import duckdb
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evalspark.llm import bpe, decontaminate, exact, mixing, near_dup, quality, token_files, warc
from evalspark.llm.oracles import ORACLES

PROSE = ("The quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion of "
         "unusual strength beside the old mill near the river bank every single autumn evening")
ROWS = [
    (0, PROSE, "a"), (1, PROSE, "b"), (2, PROSE + " again", "a"), (3, None, None), (4, "", "a"),
    (5, " \t\n ", "b"), (6, "one two", "b"), (7, "ONE two", None), (8, PROSE.replace(" ", "\n"), "c"),
    (9, "naïve café ΑΒΓ 12345 <|endoftext|> it's", "c"), (10, "x" * 5000, "c"),
    (11, (PROSE + "\r\n") * 200, "a"), (12, "a b  c\x0bd", "a"),
]
NAMES = ["id", "t", "k", "key", "n", "size", "runs", "row", "cls", "copies", "target", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *[0] * len(NAMES)) for r in ROWS]
    schema = "doc_id bigint, text string, source string" + "".join(f", {c} int" for c in NAMES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [("i1", " ".join(PROSE.split()[3:16])), ("i2", "One, TWO!"), ("i3", None), ("i4", ""), (None, "café")]
    return spark.createDataFrame(items, "item_id string, text string")


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def by_sql(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v.toPandas().astype(object).where(lambda x: x.notna(), None))
        if k == "documents":
            con.execute("create view documents2 as select doc_id::bigint doc_id, text::varchar as text, "
                        "source::varchar as source from documents")
    sql = ORACLES[name].replace("FROM documents", "FROM documents2")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def test_near_duplicates_equal_sql(docs):
    assert rows_of(near_dup.near_duplicates(docs)) == by_sql("op2_near_duplicates", documents=docs)


def test_exact_dedup_equals_sql(docs):
    assert rows_of(exact.exact_dedup(docs)) == by_sql("op5_exact_dedup", documents=docs)


def test_decontamination_hits_and_offsets(docs, benchmark):
    got = {r["doc_id"]: r for r in decontaminate.contamination_digest(docs, benchmark).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {0, 1, 2, 6, 7, 8, 9, 11}
    assert got[0]["n_hit"] == 13 and got[6]["n_hit"] == 2 and got[3]["n_words"] == 0
    assert got[9]["n_items"] == 0  # an item without id lists nothing
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.contaminated_spans(docs, benchmark).collect()}
    assert [PROSE[s["start"]:s["end"]] for s in spans[0]] == [" ".join(PROSE.split()[3:16])]
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 10, 12}


def test_mixture_sizes_and_targets(docs):
    plan = mixing.mixture_plan(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in ROWS}
    assert {r["doc_id"]: r["size"] for r in plan} == size
    assert all(0 <= r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] for r in plan)
    whole = {r["source"]: r["target"] for r in plan}
    assert sum(whole.values()) == pytest.approx(1.5 * sum(size.values()))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)


def test_token_files_equal_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in ROWS}
    got = token_files.token_table(docs, path).orderBy("doc_id").collect()
    start = 0
    for r in got:
        want = ids[r["doc_id"]]
        raw = b"".join(x.to_bytes(4, "little") for x in want)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(raw))
        start += len(want)
    assert len(got) == len(ROWS)


def test_token_memory_overflows_within_a_slice(monkeypatch):
    """New pieces that outnumber a nearly full memory don't push out the old ones of the same slice."""
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), token_files.Encoder(path)
    old = " ".join(f"w{i}" for i in range(6))
    for texts in ([old], [old + " " + " ".join(f"n{i}" for i in range(8))], [old, old + " é"]):
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert [[int(x) for x in memoryview(b).cast("H")] for b in enc.encode(texts)] == want


def test_token_counts_equal_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.token_counts(docs, path).collect():
        text = ROWS[r["doc_id"]][1] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "x" * 100_000)],
        "page_id bigint, url string, html string")
    assert rows_of(warc.archive_pages(pages)) == by_sql("op4_warc", pages=pages)


def test_quality_learns_and_holds_out(spark):
    rows = [(i, (PROSE if i % 2 else "buy cheap pills now !!! CLICK HERE") + f" {i}") for i in range(200)]
    docs = spark.createDataFrame([*rows, (200, None), (None, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    for i in range(200):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == i % 2
    assert got[None]["held_out"] is False and 0 <= got[200]["score"] <= 1
    # Held-out labels must not matter.
    flipped = spark.createDataFrame(
        [(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 3 == 1 else i % 2) for i in range(200)],
        "doc_id bigint, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_empty_tables(spark, benchmark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    path = public_tokenizers.path
    for df in (near_dup.near_duplicates(docs), exact.exact_dedup(docs), mixing.mixture_plan(docs),
               mixing.mix_sources(docs), decontaminate.contamination_digest(docs, benchmark),
               token_files.token_table(docs, path("byte_bpe_50k.json")),
               bpe.token_counts(docs, path("word_bpe_49k.json")), quality.quality_scores(docs, labels)):
        assert df.count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_dir):
    """The stages on a small folder: junk, copies and leaks go, the rest is
    encoded as often as the mix takes it."""
    clean = [f"{PROSE} part {i} " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(40)) for i in range(60)]
    texts = clean + ["buy cheap pills now !!! CLICK HERE " * 3 + str(i) for i in range(60)] + [clean[0], clean[1]]
    leak = "zero knowledge answers about distant moons are never easy to verify at home"
    texts.append(clean[2] + " " + leak + " " + " ".join(f"q{k}" for k in range(200)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, quality int").write.parquet(
        f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, tmp_dir)
        assert at.columns == docs.columns
        kept[name] = sorted({r["doc_id"] for r in at.collect()})
    assert set(kept["quality"]) >= set(range(60)) and not set(kept["quality"]) & set(range(60, 120))
    assert not set(kept["near_duplicates"]) & {120, 121}
    assert 122 not in kept["decontaminate"]
    assert set(kept["decontaminate"]) == set(kept["near_duplicates"]) - {122}
    out = corpus_pipeline.run(spark, tmp_dir)
    counts = {r["doc_id"]: r["count"] for r in at.groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == counts
    assert set(counts.values()) <= {1, 2} and set(counts) <= set(kept["decontaminate"])


def test_pipeline_links_copies_from_four_fifths(spark):
    """Similarity 87/105 (0.83) goes, 84/108 (0.78) stays; op2 keeps its own 0.85."""
    words = [f"w{i}" for i in range(100)]
    texts = [words, words[:-9] + [f"x{i}" for i in range(9)], words[:-12] + [f"y{i}" for i in range(12)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 2}
    assert near_dup.near_duplicates(docs).filter("kept").count() == 3
