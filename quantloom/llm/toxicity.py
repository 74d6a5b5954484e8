"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 make a sparse weight vector, small enough to broadcast: at most 2**BITS
weights whatever the corpus. Features of a text: words (ASCII punctuation taken as white space, lower case),
adjacent pairs, pairs one word apart and, as a shorter word n-gram, the words' first STEM characters; each
present or absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import frugal, mix64

BITS = 20
STEM = 6
#: Bound on the labelled rows that a fit reads; which rows is decided by a hash of doc_id.
MAX_ROWS = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.5
_SPACES = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature indices of the whole text; index 0 is the bias. Null or empty: the bias alone."""
    words = text.lower().encode().translate(_SPACES).split() if text else []
    if not words:
        return np.zeros(1, np.int64)
    h = xxhash.xxh3_64_intdigest
    # distinct words first, then their places: long texts repeat most of their words
    place: dict[bytes, int] = {}
    at = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    w = np.array([h(x) for x in place], np.uint64)
    stems = np.array([h(s) for s in {x.decode(errors="ignore")[:STEM] for x in place}], np.uint64)
    seq = w[at]
    odd = np.uint64(0x9E3779B97F4A7C15)
    parts = [w, stems + np.uint64(1), mix64(seq[:-1] * odd + seq[1:]), mix64(seq[:-2] * odd + seq[2:] + np.uint64(7))]
    idx = (mix64(np.concatenate(parts)) >> np.uint64(64 - bits)).astype(np.int64)
    idx[idx == 0] = 1
    return np.append(np.unique(idx), 0)


class Ftrl:
    """FTRL-proximal: w follows from z and n by soft-thresholding, with a rate of its own for each coordinate."""

    def __init__(self, dims: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(dims), np.zeros(dims)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, i: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> DataFrame:
    """(index int, weight double), non-zero weights only; learned from `label` in labels, joined by doc_id.

    Rows with a null doc_id, label or text are left out; of several labels of one doc_id the largest counts. At
    most max_rows labelled rows are read, the first by a hash of doc_id, streamed through one task in a fixed order
    once an epoch, so that memory is one batch. No labelled rows: no weights."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
        .select("doc_id", "_y", F.xxhash64("doc_id").alias("_order"))
        .orderBy("_order", "doc_id").limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text").where("text is not null")
        .join(F.broadcast(picked), "doc_id")  # at most max_rows short rows
        .withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .repartition(1).sortWithinPartitions("_epoch", "_order", "doc_id", F.xxhash64("text"))
        .select("text", "_y")
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << bits)
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                model.learn(features(text.as_py(), bits), y)
        w = model.weights()
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w[i])], names=["index", "weight"])

    return rows.mapInArrow(frugal(train), "index int, weight double")


def score(docs: DataFrame, weights: DataFrame, keep: list[str], threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """docs' columns `keep`, then score double (0 to 1) and predicted int. Null and empty texts get the bias's score.

    weights has at most 2**bits rows; it is collected and broadcast."""
    t = weights.toArrow()
    dense = np.zeros(1 << bits, np.float32)
    dense[t["index"].to_numpy()] = t["weight"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(dense), dense[np.flatnonzero(dense)]))
    own = ["score", "predicted"]
    names = [c for c in keep if c not in own]
    needs = list(dict.fromkeys([*names, "text"]))
    schema = docs.select(*(f"`{c}`" for c in names)).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits, np.float32)
        i, v = shared.value
        w[i] = v
        for b in batches:
            x = np.array([w[features(t.as_py(), bits)].sum(dtype=np.float64) for t in b.column(needs.index("text"))])
            p = 1 / (1 + np.exp(-np.clip(x, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], names=names + own)

    return docs.select(*(f"`{c}`" for c in needs)).mapInArrow(frugal(run), schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learned from the rows that aren't held out."""
    weights = fit(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), weights, ["doc_id", "held_out"])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, in the same columns, without those scored toxic. Learns from all labels."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return score(docs, fit(docs, labels), names, threshold).where("predicted = 0").select(*(f"`{c}`" for c in docs.columns if c in names))
