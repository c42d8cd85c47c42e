"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A word enters as itself and as its form (how it is cased, how long it is, what
it ends in, whether it repeats a word just before); n-grams of one and two of
both are hashed into one weight table. Labels are learned from a bounded
sample; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evalspark.llm import words
from evalspark.llm.common import as_bytes

BITS = 18  # of the weight table
SAMPLE = 8192  # labelled rows that are learned from, at most
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1.0
TEXT_SLICE = 2 << 20
_SPACES = 4  # words, word pairs, forms, form pairs
_UPPER, _DIGIT, _LETTER = np.zeros(256, np.int32), np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _segment_forms(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, word hashes, form hashes) of a segment's words."""
    starts, ends, h = words.hash_segment(data.lower())
    if not len(starts):
        return starts, h, h
    b = np.frombuffer(data + b" ", np.uint8)
    edges = np.stack([starts, ends], 1).ravel()
    upper, digits, letters = (np.add.reduceat(t[b], edges)[::2] for t in (_UPPER, _DIGIT, _LETTER))
    n, first, last = ends - starts, b[starts], b[ends - 1]
    case = np.where(upper == 0, 0, np.where(upper >= np.maximum(letters - 1, 2), 2, 1))
    other = np.minimum(n - letters - digits, 3)
    head, tail = (np.where(_LETTER[x] > 0, 0, x).astype(np.uint64) for x in (first, last))
    small = ((case * 4 + other) * 4 + np.minimum(digits, 3)) * 8 + np.minimum(n, 24) // 4
    return starts, h, words.mix(small.astype(np.uint64) << np.uint64(16) | head << np.uint64(8) | tail)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse vectors of some texts as (text, place, value), sorted by
    text. In each of the four spaces a text's counts are scaled to length 1;
    the last place is the constant 1."""
    (h, form), bounds = words.per_word(texts, _segment_forms)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for back in (1, 2):  # a word said again at once has a form of its own
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (text[back:] == text[:-back])
        form = np.where(same, words.mix(form ^ np.uint64(back)), form)
    inside = text[1:] == text[:-1]
    rows, places, values = [], [], []
    with np.errstate(over="ignore"):
        pair = lambda x: words.mix(x[:-1] * np.uint64(3) + x[1:])[inside]
        for k, x in enumerate((h, pair(h), form, pair(form))):
            owner = (text[1:][inside] if k % 2 else text).astype(np.uint64)
            place = words.mix(x ^ np.uint64(k + 1)) & np.uint64((1 << BITS) - 1)
            keys, n = np.unique(owner << np.uint64(BITS) | place, return_counts=True)
            row = (keys >> np.uint64(BITS)).astype(np.int64)
            length = np.sqrt(np.bincount(row, n.astype(float) ** 2, len(texts)))
            rows.append(row)
            places.append((keys & np.uint64((1 << BITS) - 1)).astype(np.int64))
            values.append(n / length[row])
    rows.append(np.arange(len(texts)))
    places.append(np.full(len(texts), 1 << BITS))
    values.append(np.ones(len(texts)))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(places)[order], np.concatenate(values)[order]


class Ftrl:
    """FTRL-proximal logistic regression (per-coordinate steps, L1 and L2)."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        # Places may repeat between the spaces of a text.
        old = self.n[at]
        np.add.at(self.n, at, g * g)
        sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA
        np.add.at(self.z, at, g - sigma * w)


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS) -> np.ndarray:
    model, packed = Ftrl(), []
    for at in range(0, len(rows), 256):
        row, place, value = vectors([t for t, _ in rows[at:at + 256]])
        cuts = np.searchsorted(row, np.arange(len(rows[at:at + 256]) + 1)).tolist()
        packed += [(place[a:b].astype(np.int32), value[a:b].astype(np.float32), label)
                   for a, b, (_, label) in zip(cuts, cuts[1:], rows[at:at + 256])]
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(packed)):
            model.update(*packed[i])
    return model.weights().astype(np.float32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[bytes, int]] = []
    for batch in batches:
        rows += zip(map(as_bytes, batch.column("t")), batch.column("label").to_pylist())
    rows.sort()  # the order in which rows arrive must not matter
    yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], names=["w"])


def in_fold(key, folds: int, fold: int):
    """Whether crc32(key as text) mod ``folds`` is ``fold``; not for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE, folds: int = 3, held: int = 1) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled rows outside the
    held-out fold: those of smallest hash, so the choice is spread over the
    table and the same in every run. The chosen ids (bounded by ``sample``)
    are broadcast; one task of bounded input makes the updates. Without any
    labelled row all weights are 0 and every score is one half."""
    spark = docs.sparkSession
    chosen = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
              .filter(F.col("k").isNotNull() & F.col("label").isin(0, 1))
              .filter(~in_fold(F.col("k"), folds, held)).distinct()
              .orderBy(F.xxhash64("k"), "k", "label").limit(sample))
    rows = (docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t"))
            .join(F.broadcast(chosen), "k").select("t", "label").repartition(1))
    got = rows.mapInArrow(_train, "w binary").first()
    size = (1 << BITS) + 1
    return np.frombuffer(bytes(got["w"]), np.float32) if got else np.zeros(size, np.float32)


def scores_of(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each text."""
    out, at = [np.empty(0)], 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= TEXT_SLICE):
            held += len(texts[stop])
            stop += 1
        row, place, value = vectors(texts[at:stop])
        margin = np.bincount(row, w[place] * value, stop - at)
        out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
        at = stop
    return np.concatenate(out)


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            scores = scores_of([as_bytes(v) for v in batch.column("t")], w)
            cols = {n: batch.column(n) for n in batch.schema.names if n != "t"}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(scores, pa.float64())],
                                             names=[*cols, "score"])
    return run


def _scored(docs: DataFrame, weights: np.ndarray, text_col: str, **columns) -> DataFrame:
    rows = docs.select(*[c.alias(n) for n, c in columns.items()],
                       F.col(text_col).cast("binary").alias("t"))
    schema = StructType([*(StructField(n, rows.schema[n].dataType) for n in columns), StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MiB, whatever the input
    return rows.mapInArrow(_score(sent), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and
    ``predicted``.

    Defined cases: null and empty texts are scored by the constant alone;
    repeated rows are scored each; a null id is never held out and never has a
    label; labels other than 0 and 1 are passed over; empty tables give no
    rows. No column but id and text is read from the documents, and the id
    only to choose the labelled rows.
    """
    folds, held = options.get("folds", 3), options.get("held", 1)
    weights = fit(docs, labels, id_col, text_col, **options)
    scored = _scored(docs, weights, text_col, doc_id=F.col(id_col))
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
              text_col: str = "text", **options) -> DataFrame:
    """The documents, columns unchanged, that score at least ``threshold``."""
    weights = fit(docs, labels, id_col, text_col, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _scored(docs, weights, text_col, row=row).filter(F.col("score") >= threshold).select("row.*")
