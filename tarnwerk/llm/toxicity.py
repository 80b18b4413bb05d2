"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their stems, of pairs of neighbours and of
pairs that skip one word. Training runs over a bounded, documented sample of labelled rows in one task; per-coordinate
rates and the L1 term leave a few thousand weights, which are small enough to ship to every task.
Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .workspace import digest, whole

BITS = 20
#: Chosen by three folds inside the rows that labels are learned from.
ALPHA, L1_ROOT = 2.0, 0.1
#: A word's first bytes stand for its inflected forms.
STEM_BYTES = 5


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, owner, feature) by block; a feature may repeat within its text."""
    inside, values = tb.letter_bytes(), tb.byte_values(7, True)
    shift = np.uint64(64 - bits)
    for block in tb.blocks(column):
        starts, ends, text = tb.spans(block, inside)
        prefix = block.prefix(values)
        word = tb.span_hash(prefix, starts, ends)
        stem = tb.span_hash(prefix, starts, np.minimum(ends, starts + STEM_BYTES)) + np.uint64(0x632BE59BD9B4E019)
        found, owner = [word >> shift, tb.mix(stem) >> shift], [text, text]
        for gap, salt in ((1, 0x51ED2701), (2, 0x7F4A7C15)):
            if len(word) > gap:
                same = text[:-gap] == text[gap:]
                pair = tb.mix(word[:-gap][same] * np.uint64(0x2545F4914F6CDD1D) + word[gap:][same] + np.uint64(salt))
                found.append(pair >> shift)
                owner.append(text[:-gap][same])
        yield block.first, len(block), np.concatenate(owner), np.concatenate(found).astype(np.int64)


def train(rows: list[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = ALPHA, beta: float = 1.0, l1_root: float = L1_ROOT, l2: float = 0.0, epochs: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of distinct feature numbers: bias, indices, weights. The L1 term is ``l1_root``
    times the root of the number of rows, as the noise in a coordinate's sum of gradients grows. Without both
    labels there are no weights, and the bias alone carries the share of label 1, one row of each added."""
    if not rows or not any(labels) or all(labels):
        ones = sum(labels)
        return float(np.log((ones + 1) / (len(labels) - ones + 1))) - (0.0 if ones else 1e-3), np.zeros(0, np.int64), np.zeros(0, np.float32)
    l1 = l1_root * len(rows) ** 0.5
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    bias = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2), 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * bias
            n0 += g * g
            bias = -z0 / ((beta + np.sqrt(n0)) / alpha)
    live = np.flatnonzero(np.abs(z) > l1)
    w = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return float(bias), live, w.astype(np.float32)


def fit(docs: DataFrame, labelled: DataFrame, max_rows: int = 16_000, max_features: int = 40_000_000, bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """Train on a bounded sample of the rows of ``labelled`` (doc_id, label), in the order of a hash of doc_id:
    at most about ``max_rows`` of them, and no more than hold ``max_features`` features (4 bytes each) together.
    Texts come from ``docs``. Rows without an id, a label or a text are left out; of several labels of
    one id the largest counts, and of several texts the one with the least digest."""
    known = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, max_rows / max(n, 1)) * (1 << 30))))
    texts = docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").alias("text")).where("text is not null")
    # the sample is bounded by max_rows, so it may be shipped to every task
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")), "text")).alias("r")).select("doc_id", "label", "r.text")

    def extract(batches):
        for batch in batches:
            for first, count, owner, found in features(batch.column(2), bits):
                key = np.unique((owner.astype(np.int64) << bits) | found)
                cut = np.searchsorted(key >> bits, np.arange(count + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), batch.column(1).slice(first, count), lists], names=["doc_id", "label", "x"])

    def learn(batches):
        x: list[np.ndarray] = []
        y: list[int] = []
        held = 0
        for batch in batches:
            for label, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held += len(found.values)
                if held > max_features:
                    break
                x.append(np.array(found.values))
                y.append(int(label > 0))
            if held > max_features:
                break
        bias, live, w = train(x, y, bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(live, -1)), pa.array(np.append(w.astype(np.float64), bias))], names=["feature", "weight"])

    found = rows.mapInArrow(extract, "doc_id long, label int, x array<int>")
    model = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learn, "feature long, weight double").toArrow()
    at, w = model["feature"].to_numpy(), model["weight"].to_numpy()
    return float(w[at == -1][0]) if len(w) else train([], [])[0], at[at >= 0], w[at >= 0].astype(np.float32)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], bits: int = BITS, digests: bool = False) -> DataFrame:
    """doc_id and score double (0 to 1) of every row of ``docs``: the text alone decides, the empty or
    null text has the bias's score, repeated rows come back as often. With ``digests`` the text's digest
    comes too. Other columns are ignored."""
    bias, live, weights = model

    def run(batches):
        table = np.zeros(1 << bits, np.float32)
        table[live] = weights
        for batch in batches:
            for first, count, owner, found in features(batch.column(1), bits):
                hit = np.flatnonzero(table[found])
                key = np.unique((owner[hit].astype(np.int64) << bits) | found[hit])
                total = bias + np.bincount(key >> bits, weights=table[key & ((1 << bits) - 1)].astype(np.float64), minlength=count)
                own = [batch.column(k).slice(first, count) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))), *own], names=["doc_id", "score", "digest"][: 2 + len(own)])

    more = [digest(docs).alias("digest")] if digests else []
    texts = docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").alias("text"), *more)
    return texts.mapInArrow(run, "doc_id long, score double" + (", digest string" if digests else ""))


def held_out(doc_id) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> tuple[float, np.ndarray, np.ndarray]:
    """The model of the labels' ``column``, without held-out rows."""
    mine = labels.select(whole(labels, "doc_id", "long").alias("doc_id"), whole(labels, column, "int").alias("label"))
    return fit(docs, mine.where(~held_out(F.col("doc_id"))))
