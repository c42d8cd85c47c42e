"""Token ids in binary files.

Ids are renumbered by falling frequency, so that common tokens take one byte,
and stored byte-aligned: a stream of control bytes holds the byte lengths of
four numbers each (two bits a number), a second stream the numbers' bytes.
Reading looks the lengths of a control byte up in a table and gathers all
numbers of a block at once.

A token folder holds ``blocks`` (Parquet rows of whole documents: ``shard``,
``block``, ``offset`` of the block's first id in its shard, ``doc_ids``,
``lengths``, the two streams ``control`` and ``data``, ``crc``) and ``ranks``
(``rank``, ``token_id``, ``n``). Parquet is the container because Spark commits
it whole to any store and re-writes the part of a lost executor.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.bpe import CACHE_ENTRIES, load_tokenizer
from evalspark.llm.common import as_bytes, written
from evalspark.session import scratch_path

END_ID = 0
BLOCK_IDS = 1 << 19
TEXT_SLICE = 4 << 20  # bytes cut into pieces at once
JOINED = 1000  # pre-tokens that go to the model together

# ---------------------------------------------------------------- the coding

_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
_LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS) & 3) + 1  # by control byte


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(numbers, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[:len(v)] = extra
    control = (codes.reshape(-1, 4) << _SHIFTS).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of two streams."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    if n and ends[-1] != len(data):
        raise ValueError("token block is damaged: its streams differ in length")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        some = np.flatnonzero(lengths > k) if k else slice(None)
        out[some] |= raw[starts[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out

# ------------------------------------------------------------- the tokenizer


_MARK = "\x00"
# Two blanks in a row, the mark, or blanks other than the space and the line break.
_FANCY = (r"[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Fixed value: the pre-token pattern of byte-level vocabularies, its Unicode
# classes written out for ASCII and the Latin letters U+00C0 to U+024F.
_LETTER = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\n").findall
_PLAIN = re.compile(rf" ?[!-~{_LETTER}]+\Z").match
_PLAIN_LETTERS = [c for c in map(chr, range(0x250)) if _PLAIN(c)] + [" "]
_END = object()  # the piece that stands for the end id


class _Numbers(dict):
    """Numbers of keys by first use; ``new`` holds those not yet learned."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Table:
    """The ids of numbered keys, one after the other in one array."""

    def __init__(self, dtype: np.dtype):
        self.numbers = _Numbers()
        self.flat, self.start, self.size = (np.empty(0, t) for t in (dtype, np.int64, np.int64))

    def numbered(self, keys, learn) -> np.ndarray:
        codes = np.fromiter(map(self.numbers.__getitem__, keys), np.int64)
        if self.numbers.new:
            flat, start, size = learn(self.numbers.new)
            self.numbers.new = []
            self.start = np.append(self.start, len(self.flat) + start)
            self.size = np.append(self.size, size)
            self.flat = np.concatenate([self.flat, flat])
        return codes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the keys in a row, where each key's ids end)."""
        size = self.size[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[codes] - ends + size, size)], ends


class Encoder:
    """Whole texts through the ``tokenizers`` library, remembering the ids of
    pieces that no pre-token spans: where no two blanks meet, a word with the
    space before it, and a line break. Pieces of a slice of texts are numbered
    and their ids gathered from one array. New pieces in plain letters are cut
    into pre-tokens, and each new one goes to the library's model; other
    pieces, and texts with special strings, other blanks or blanks in a row,
    go to the library whole."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fancy = "|".join([_FANCY, *map(re.escape, special)])  # for RE2
        rule = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        # The rule under which a piece is never part of a larger pre-token.
        self.cuts = (self.tokenizer.normalizer is None and rule.get("type") == "ByteLevel"
                     and rule["use_regex"] and not rule["add_prefix_space"])
        self.model, self.letters = self.tokenizer.model, {}
        if self.cuts:
            # How the file's rule writes the bytes of each plain letter.
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {ord(c): split(c)[0][0] for c in _PLAIN_LETTERS}
        self.break_id = self._break(json.loads(self.tokenizer.to_str())["model"]) if self.cuts else None
        self.forget()

    def _break(self, model: dict) -> int | None:
        """The id of a byte that plain letters don't have and no other token
        holds, so that no merge joins it with anything; it parts words."""
        shared = set().union(*(t for t in model["vocab"] if len(t) > 1), *self.letters.values())
        free = sorted(t for t in model["vocab"] if len(t) == 1 and t not in shared)
        if model["type"] != "BPE" or not free:
            return None
        self.letters[ord("\n")] = free[-1]
        return model["vocab"][free[-1]]

    def forget(self) -> None:
        self.pieces, self.words = _Table(self.dtype), _Table(self.dtype)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pre-tokens; the line break that parts pieces has none. Many
        go to the model as one word, parted by a byte that no merge joins."""
        size = np.zeros(len(new), np.int64)
        own = [i for i, w in enumerate(new) if w != "\n"]
        parts = [np.empty(0, self.dtype)]
        step = JOINED if self.break_id is not None else 1
        for at in range(0, len(own), step):
            some = own[at:at + step]
            line = "\n".join([new[i] for i in some]).translate(self.letters)
            ids = np.fromiter((t.id for t in self.model.tokenize(line)), self.dtype)
            parted = ids == self.break_id if step > 1 else np.zeros(len(ids), bool)
            size[some] = np.diff(np.append(np.flatnonzero(parted), len(ids)), prepend=-1) - 1 if step > 1 else len(ids)
            parts.append(ids[~parted])
        return np.concatenate(parts), np.cumsum(size) - size, size

    def _learn_pieces(self, new: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, size, parts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [np.empty(0, self.dtype)]
        plain = [i for i, p in enumerate(new) if type(p) is str and self.cuts and _PLAIN(p)]
        if plain:
            # All at once, parted by line breaks, which are pre-tokens of their own.
            words = _PRE_TOKENS("\n".join([new[i] for i in plain]))
            codes = self.words.numbered(words, self._learn_words)
            flat, ends = self.words.gather(codes)
            breaks = np.flatnonzero(codes == self.words.numbers["\n"]) if len(plain) > 1 else []
            stops = np.append(ends[breaks], len(flat))
            size[plain] = np.diff(stops, prepend=0)
            start[plain] = stops - size[plain]
            parts = [flat]
        at = sum(map(len, parts))
        for i in np.setdiff1d(np.arange(len(new)), plain).tolist():
            p = new[i]
            part = np.array([END_ID] if p is _END else self.ids(p[1] if type(p) is tuple else p), self.dtype)
            start[i], size[i] = at, len(part)
            at += len(part)
            parts.append(part)
        return np.concatenate(parts), start, size

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of ``dtype``."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()))
        return [x[:-1].tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it, and how many
        each has)."""
        held = self.pieces
        if len(held.numbers) > CACHE_ENTRIES or len(held.flat) > 8 * CACHE_ENTRIES or len(self.words.numbers) > CACHE_ENTRIES:
            self.forget()  # between slices only: a slice needs all of its pieces
        whole = (pc.match_substring_regex(texts, self.fancy).to_numpy(zero_copy_only=False) if self.cuts
                 else np.ones(len(texts), bool))
        cut = texts.filter(pa.array(~whole))
        for blank, parted in (("\n", "\x00\n\x00"), (" ", "\x00 ")):
            cut = pc.replace_substring(cut, blank, parted)
        lists = pc.split_pattern(cut, _MARK)
        found = lists.flatten().dictionary_encode()  # a piece is looked up once a slice
        learn = self._learn_pieces
        of_piece = self.pieces.numbered(found.dictionary.to_pylist(), learn)
        of_whole = self.pieces.numbered([("whole", t) for t in texts.filter(pa.array(whole)).to_pylist()], learn)
        end = self.pieces.numbered([_END], learn)
        pieces = np.full(len(texts), 2)
        pieces[~whole] = pc.list_value_length(lists).to_numpy(zero_copy_only=False) + 1
        last = np.cumsum(pieces) - 1
        codes = np.full(int(pieces.sum()), -1)
        codes[last] = end
        codes[last[whole] - 1] = of_whole
        codes[codes < 0] = of_piece[found.indices.to_numpy(zero_copy_only=False)]
        ids, ends = self.pieces.gather(codes)
        return ids, np.diff(ends[last], prepend=0)


_ENCODERS: dict[str, Encoder] = {}  # per Python worker


def encoder(path: str) -> Encoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow array of neighbouring pieces of ``data``, ``sizes`` entries each."""
    ends = np.append(0, np.cumsum(sizes * data.itemsize))
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _strings(texts: pa.BinaryArray) -> pa.StringArray:
    """As text; null is empty, and bytes that aren't UTF-8 are replaced."""
    texts = pc.fill_null(texts, b"")
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([as_bytes(v).decode("utf-8", "replace") for v in texts], pa.string())


def _encode(path: str):
    """Rows (``doc_id``, ``n_tokens``, ``ids``, null), and a last one that holds
    in ``counts`` how often the task met each id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = encoder(path), None
        seen = np.zeros(enc.vocabulary, np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]

        def rows(keys, texts):
            ids, sizes = enc.encode_all(texts)
            np.add(seen, np.bincount(ids, minlength=len(seen)), out=seen)
            return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), _binaries(ids, sizes),
                                               pa.nulls(len(keys), pa.binary())], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            texts = _strings(batch.column(1))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TEXT_SLICE
            cuts = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1)) if len(texts) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield rows(batch.column(0).slice(a, b - a), texts.slice(a, b - a))
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()),
                                              pa.array([seen.tobytes()], pa.binary())], names=names)
    return run


def _encoded(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(tokenizer_path), f"doc_id {kind}, n_tokens bigint, ids binary, counts binary")


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text with the end id
    behind them, as little-endian bytes (two a token if the vocabulary allows,
    else four). A null text is empty."""
    return _encoded(docs, tokenizer_path, id_col, text_col).filter("counts is null").drop("counts")

# ------------------------------------------------------------------ the files


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids that some encoding tasks met, with their numbers."""
    for batch in batches:
        if batch.num_rows:
            seen = sum(np.frombuffer(as_bytes(v), np.int64) for v in batch.column(0))
            ids = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())],
                                             names=["token_id", "n"])


def _blocks(dtype: np.dtype, rank_of, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, offset = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        parts: list[np.ndarray] = []
        held = 0
        kind = None

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            control, data = pack(rank_of.value[ids])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([offset], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([pa.array([k.as_py() for k in keys], kind)], pa.list_(kind)),
                 pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                 pa.array([zlib.crc32(data, zlib.crc32(control))], pa.int64())],
                names=["shard", "block", "offset", "n_ids", "doc_ids", "lengths", "control", "data", "crc"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(as_bytes(value), dtype)
                if parts and held + len(ids) > block_ids:
                    yield row()
                    block, offset, keys, parts, held = block + 1, offset + held, [], [], 0
                keys.append(key)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield row()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write a token folder of all documents in ascending id order.

    Texts are encoded where they are read; ids (two bytes a token) are then
    range-partitioned by document id. Defined cases: a null text is empty and
    holds the end id alone; null ids come first; rows of equal id are ordered
    by a hash of their tokens; a document is never split, so a very long one makes a
    block of its own; an empty table writes an empty folder. The frequency
    table has at most one row per vocabulary entry, which bounds what the
    driver collects and sends.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer_path)
    tokens = written(_encoded(docs, tokenizer_path, id_col, text_col), "tokens")
    ranks = (tokens.filter("counts is not null").select("counts").mapInArrow(_frequencies, "token_id bigint, n bigint")
             .groupBy("token_id").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "token_id").collect())
    rank_of = np.zeros(enc.vocabulary, np.uint32)
    rank_of[[r["token_id"] for r in ranks]] = np.arange(len(ranks))
    rank_rows = [(i, r["token_id"], r["n"]) for i, r in enumerate(ranks)]
    (spark.createDataFrame(rank_rows, "rank int, token_id bigint, n bigint")
     .coalesce(1).write.parquet(f"{path}/ranks"))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    # Rows of one id, or without one, are spread by their tokens and their place.
    order = ["doc_id", F.crc32("ids"), F.monotonically_increasing_id()]
    ordered = (tokens.filter("counts is null").select("doc_id", "ids", *[c.alias(n) for n, c in zip(("_crc", "_at"), order[1:])])
               .repartitionByRange("doc_id", "_crc", "_at").sortWithinPartitions("doc_id", "_crc", "_at").select("doc_id", "ids"))
    (ordered.mapInArrow(
        _blocks(enc.dtype, spark.sparkContext.broadcast(rank_of), block_ids),
        f"shard int, block int, offset bigint, n_ids bigint, doc_ids array<{kind}>, "
        "lengths array<bigint>, control binary, data binary, crc bigint")
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def _read(id_of, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {n: batch.column(n)[i] for n in batch.schema.names}
                control, data = as_bytes(at["control"]), as_bytes(at["data"])
                if zlib.crc32(data, zlib.crc32(control)) != at["crc"].as_py():
                    raise ValueError("token block is damaged")
                lengths = np.array(at["lengths"].as_py(), np.int64)
                ids = id_of.value[unpack(control, data, int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * a:4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                cols = [at["doc_ids"].values, pa.array(at["start"].as_py() + ends - lengths),
                        pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts],
                                         pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a token folder: ``doc_id``, ``start`` (ids of
    all documents before it), ``n_tokens``, ``ids_crc32`` and, if asked for,
    ``ids``. Shard totals (one short row per shard, so the broadcast is bounded
    by the number of files written) give each shard its first position."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r["token_id"] for r in ranks], np.uint32))
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return (blocks.join(F.broadcast(shards), "shard")
            .select("doc_ids", "lengths", "control", "data", "crc",
                    (F.col("base") + F.col("offset")).alias("start"))
            .mapInArrow(_read(id_of, with_ids), schema + (", ids array<bigint>" if with_ids else "")))


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the token folder of the documents and read it back."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer_path, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
