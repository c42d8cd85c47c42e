"""Tokenisation with public byte-pair vocabularies: token counts by heap-and-
linked-list merging, and token ids in a frequency-ranked byte-aligned format."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import as_bytes

# Entries a worker remembers; a full memory starts anew, which costs time only.
CACHE_ENTRIES = 600_000


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


_PLACE_BITS = 32  # a heap entry is rank << 32 | place
_ID_BITS = 24  # a pair of symbols is first << 24 | second


def merge_count(symbols: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """How many merges byte-pair encoding makes in one word.

    ``merges`` maps a pair of symbols to its rank and the symbol it becomes.
    The symbols form a doubly linked list; a heap holds the adjacent pairs by
    rank, then place. The lowest is popped, checked against the list (its
    symbols may have changed since) and merged, and the two new neighbour
    pairs are pushed. Tokens are the initial symbols minus the merges.
    """
    n = len(symbols)
    get = merges.get
    heap = []
    for i in range(n - 1):
        m = get(symbols[i] << _ID_BITS | symbols[i + 1])
        if m is not None:
            heap.append(m[0] << _PLACE_BITS | i)
    if not heap:
        return 0
    symbols = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    pop, push, done = heapq.heappop, heapq.heappush, 0
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        m = get(symbols[i] << _ID_BITS | symbols[j])
        if m is None or m[0] != top >> _PLACE_BITS:
            continue
        s = symbols[i] = m[1]
        symbols[j] = -1
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            m = get(s << _ID_BITS | symbols[k])
            if m is not None:
                push(heap, m[0] << _PLACE_BITS | i)
        h = before[i]
        if h >= 0:
            m = get(symbols[h] << _ID_BITS | s)
            if m is not None:
                push(heap, m[0] << _PLACE_BITS | h)
    return done


def _plain_splitter(spec: dict):
    """For pieces of printable ASCII, the file's own split pattern as a
    ``re`` pattern, if its rules are the ones known here (else None): lower
    case, keep what the pattern finds, bytes as they are."""
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
        return None
    split, level = parts
    if split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
        return None
    pattern = split["pattern"]["Regex"]
    for unicode_class, ascii_class in ((r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9"), (r"\s", " ")):
        pattern = pattern.replace(unicode_class, ascii_class)
    return None if "\\" in pattern else re.compile(pattern).findall


class TokenCounter:
    """Counts the tokens of texts under a word-level byte-pair vocabulary
    (a ``tokenizers`` JSON file).

    Normalising and splitting into words are left to the file's own rules as
    the library applies them; merging is counted here. Words are remembered,
    so a common word is merged once per worker.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-complete vocabularies are supported")
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.ids = ids = model["vocab"]
        self.merges = {ids[a] << _ID_BITS | ids[b]: (i, ids[a + b]) for i, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        tokenizer = load_tokenizer(path)
        self.plain = _plain_splitter(spec)
        self.normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) \
            if special else None
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            ids = self.ids
            symbols = [ids[c] for c in word[:-1]]
            symbols.append(ids[word[-1] + self.suffix])
            n = len(symbols) - merge_count(symbols, self.merges)
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = n
        return n

    def piece(self, piece: str) -> int:
        """Tokens of a piece of text that no word reaches across."""
        if self.plain is not None and piece.isascii() and piece.isprintable():
            words = self.plain(piece.lower())
        else:
            words = [w for w, _ in self.split(self.normalise(piece)) if w]
        n = sum(map(self.word, words))
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text. A special string in it is one token, found before
        anything else, as the library does by default. White space is dropped
        and no word spans it, so the rest is counted between blanks."""
        total = 0
        if self.special is not None:
            found = self.special.findall(text)
            if found:
                return len(found) + sum(map(self.count, filter(None, self.special.split(text))))
        get, piece = self.pieces.get, self.piece
        for p in text.replace("\n", " ").split(" "):
            if p:
                n = get(p)
                total += piece(p) if n is None else n
        return total


_COUNTERS: dict[str, TokenCounter] = {}  # per Python worker


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, TokenCounter(path))
        for batch in batches:
            texts = [as_bytes(v) for v in batch.column(1)]
            tokens = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens), with no shuffle.

    ``tokenizer_path`` must be readable on every executor. Defined cases: a
    null text is empty and has no tokens; repeated rows are counted each; null
    ids pass through; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_counts(tokenizer_path),
                              f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
