"""Best-fit packing by exact-complement hashing.

1. Every text is tokenized once into pieces of at most ``capacity`` tokens, written as a table of
   lengths and checksums.
2. Lengths alone decide the plan, and there are at most ``capacity`` of them, so the plan is made on
   the counts by length: singles, pairs and triples whose sums fill a sequence exactly are looked up
   by their complement and consumed as often as their counts allow; what is left goes by best fit
   on counts. The plan has a few rows a length, whatever the number of documents.
3. A piece finds its place from its rank among pieces of its length: ranks are dealt by (length,
   salt), the salts' counts are summed up, and intervals of ranks belong to steps of the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .wordcache import ENCODE_BYTES, PieceEncoder
from .workspace import Workspace, whole

CAPACITY = 2048


@dataclass
class Step:
    """``times`` sequences that each hold the given lengths in order."""

    lengths: tuple[int, ...]
    times: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Sequences for ``counts`` pieces of each length (1..capacity). Each step uses up a length or all
    exact partners of it, so the number of steps follows ``capacity``, not the counts."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] += n
    steps: list[Step] = []

    def use(*lengths: int) -> bool:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
            steps.append(Step(tuple(sorted(lengths, reverse=True)), times))
        return times > 0

    use(capacity)
    for a in range(capacity - 1, 0, -1):  # longest first: they have the fewest partners
        if left[a] and capacity - a <= a:
            use(a, capacity - a)
    live = np.flatnonzero(left)
    for a in live[::-1].tolist():  # triples: the gap beside a is looked up among sums of pairs
        if left[a]:
            b = live[live <= a]
            c = capacity - a - b
            for k in np.flatnonzero((c > 0) & (c <= b) & (left[b] > 0) & (left[np.maximum(c, 0)] > 0))[::-1].tolist():
                use(a, int(b[k]), int(c[k]))
    sums = np.zeros(2 * capacity + 1, bool)
    for i, a in enumerate(np.flatnonzero(left)[::-1].tolist()):  # quadruples as a pair's sum beside another pair's
        if not left[a]:
            continue
        there = (left > 0).astype(np.int64)
        if i % 64 == 0:  # lengths only run out, so older sums are a superset
            sums = np.convolve(there, there) > 0
        pool = np.flatnonzero(left)
        some = pool[(pool <= a) & (capacity - a - pool >= 2)]
        for b in some[sums[capacity - a - some]][::-1].tolist():
            gap = capacity - a - b
            for c in pool[(pool <= b) & (pool >= gap - b) & (pool < gap)][::-1].tolist():
                d = gap - c
                if d > c or not (left[a] and left[b]):
                    break
                if left[c] and left[d]:
                    use(a, b, c, d)
    # best fit on what is left: a sequence takes the largest length that still fits, again and again
    while left.any():
        gap, lengths, taken = capacity, [], np.zeros_like(left)
        while True:
            fits = np.flatnonzero((left - taken)[1 : gap + 1]) + 1
            if not len(fits):
                break
            x = int(fits[-1])
            lengths.append(x)
            taken[x] += 1
            gap -= x
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left[used] -= taken[used] * times
        steps.append(Step(tuple(lengths), times))
    return steps


def _intervals(steps: list[Step]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, first sequences and offsets of the intervals of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for step in steps:
        at = 0
        for x in step.lengths:
            rank = used.get(x, 0)
            out.setdefault(x, []).append((rank, sequence, at))
            used[x] = rank + step.times
            at += x
        sequence += step.times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def tokenize_pieces(docs: DataFrame, encoder: Callable[[], PieceEncoder], end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every text's pieces, and ``number``, the piece's in its task.
    A text's ids get ``end_id`` at their end, so the null or empty text is one piece of one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        number = 0
        for batch in batches:
            for block in tb.blocks(batch.column(1), ENCODE_BYTES):
                ids, cut = encode.block(block)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    whole_ids = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(whole_ids), capacity)):
                        part = whole_ids[at : at + capacity]
                        rows.append(block.first + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(number, number + len(rows)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "number"])
                number += len(rows)

    return docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, number long")


def pack(docs: DataFrame, encoder: Callable[[], PieceEncoder], end_id: int = 0, capacity: int = CAPACITY, rows_a_salt: int = 500_000) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) in as few sequences of ``capacity`` tokens as the plan finds.

    Returns per piece doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long
    and offset long. Only texts of more than ``capacity`` tokens are cut. Null and empty texts have
    the end token alone; rows without an id and repeated rows are packed like any other. An empty
    table gives no rows. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.keep(tokenize_pieces(docs, encoder, end_id, capacity))
    total = pieces.count()
    salts = max(1, -(-total // rows_a_salt))
    # repeated rows differ by their number, so that they are spread too
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "number"), F.lit(salts)).cast("int"))
    by_salt = work.keep(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    intervals = _intervals(plan(counts, capacity))
    before = by_salt.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "number"))
    ranked = salted.withColumn("rank", rank - 1).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, seq, off = intervals[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = seq[k] + rank[rows] - first[k]
                offset[rows] = off[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
