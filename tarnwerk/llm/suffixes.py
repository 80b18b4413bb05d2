"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds long repeated strings.

All strings of ``length`` bytes that start at more than one place are found, exactly but for 64-bit
hash collisions, without a suffix for every byte:

1. *Anchors.* In each string of ``length`` bytes the leftmost least k-gram (by hash) is its anchor.
   Equal strings have their anchor at the same offset, so only suffixes that start at anchors need an
   index: one in about ``(length - k) / 2`` bytes. Strings of a second, greater length begin with
   one of the first, so the same anchors serve both.
2. *Candidates.* Anchor hashes that occur once are dropped by a distributed count. The others get
   their context: the bytes to the left and right that their strings can cover.
3. *Index family.* Contexts are dealt by anchor hash into shards of bounded size, and come to a shard
   in batches. A batch gets a suffix array (contexts in lexicographic order with the common prefixes
   of neighbours) and is scanned for strings that two of its contexts hold: to the right by the array's
   intervals of common prefixes, to the left by the hash of the remaining bytes. Levels of as many
   batches merge, and a merge scans what has neighbours of the other level only. Equal contexts
   become one entry when they meet, so every pair of contexts meets in exactly one batch or merge.
4. *Large groups.* An anchor hash with more contexts than a task should hold goes another way to the
   same result: its strings' hashes are counted by a distributed aggregation.
5. Texts that are copies of each other are one text in all of this, and are removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .workspace import Workspace, empty, fresh_name, whole

LENGTH, GRAM = 400, 128
#: Bytes of about fifty short words, and the k-gram that goes with them.
PASSAGE, PASSAGE_GRAM = 240, 80
#: Start positions that one slice of a very long text covers.
_SLICE = 4 << 20
_POSITION = np.uint64((1 << 24) - 1)
_VALUES = tb.byte_values(11, False)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values, by runs of prefix and suffix minima."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, reach: int = 0, starts_end: int | None = None):
    """Anchors of a buffer's texts: (text, position, first and last string start, k-gram hash, context
    hash), ordered by text and position. Strings never cross texts, nor start at ``starts_end`` or later.
    Contexts go on for ``reach`` bytes, or to the end of the text."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    long = np.flatnonzero(ends - starts >= length)
    if not len(long):
        return empty
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_VALUES[data] * tb.powers(len(data)), out=prefix[1:])
    inverse = tb.powers(len(data) + 1, inverse=True)
    hashes = tb.mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(prefix) - gram])
    keys = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min(keys, length - gram + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1 if starts_end is None else np.minimum(ends[long] - length + 1, starts_end), -1)
    p = np.flatnonzero(np.cumsum(valid[: len(least)]) > 0)
    at = (least[p] & _POSITION).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    run = np.flatnonzero(new)
    first, last, at = p[run], p[np.append(run[1:], len(p)) - 1], at[run]
    text = np.searchsorted(starts, first, side="right") - 1
    context = tb.span_hash(prefix, first, np.minimum(last + length + reach, ends[text])) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return text, at, first, last, hashes[at], context


def _pieces(column: pa.Array, length: int, reach: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int | None, int]]:
    """(first row, buffer, starts, ends, end of string starts, bytes before the buffer in its text) of a
    column; a text of more than a slice comes alone, in overlapping slices."""
    for block in tb.blocks(column):
        n = int(block.ends[-1])
        if len(block) == 1 and n > _SLICE + length:
            for at in range(0, n - length + 1, _SLICE):
                to = min(n, at + _SLICE + length - 1 + reach)
                yield block.first, block.data[at:to], np.array([0]), np.array([to - at]), _SLICE, at
        else:
            yield block.first, block.data, block.starts, block.ends, None, 0


def _scan(length: int, gram: int, reach: int):
    """Batches of (node, text) -> anchors; ``own`` marks those whose strings all repeat within their
    own text: they are decided here, and one of each kind stays for the others."""

    def run(batches):
        for batch in batches:
            for first_row, data, starts, ends, starts_end, before in _pieces(batch.column(1), length, reach):
                text, at, first, last, gram_hash, context = anchors(data, starts, ends, length, gram, reach, starts_end)
                if not len(text):
                    continue
                order = np.lexsort((at, context, gram_hash, text))
                same = np.zeros(len(order), bool)
                same[1:] = (text[order][1:] == text[order][:-1]) & (gram_hash[order][1:] == gram_hash[order][:-1]) & (context[order][1:] == context[order][:-1])
                again = np.zeros(len(order), bool)
                again[order] = same
                twin = np.zeros(len(order), bool)
                twin[order] = same | np.append(same[1:], False)
                base = before - starts[text]
                size = np.minimum(last + length + reach, ends[text]) - at
                for own, rows in ((False, np.flatnonzero(~again)), (True, np.flatnonzero(twin))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram_hash[rows].view(np.int64)), batch.column(0).take(pa.array(first_row + text[rows])), pa.array(at[rows] + base[rows]), pa.array((at - last)[rows].astype(np.int32)), pa.array((at - first)[rows].astype(np.int32)), pa.array(size[rows].astype(np.int32)), pa.array(np.full(len(rows), own))],
                        names=["gram", "node", "at", "lo", "hi", "size", "own"],
                    )

    return run


def _contexts():
    """Batches of (node, text, list of anchors) -> each anchor with its left and right bytes."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for node, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                data = text.as_py()
                gram, at, lo, hi, size = (r.to_numpy() for r in found.values.flatten())
                order = np.argsort(at)
                gram, at, lo, hi = gram[order], at[order], lo[order], hi[order]
                left = [data[p - e : p] for p, e in zip(at.tolist(), hi.tolist(), strict=True)]
                right = [data[p : p + n] for p, n in zip(at.tolist(), size[order].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array([node] * len(at), pa.binary()), pa.array(at), pa.array(lo), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["gram", "node", "at", "lo", "left", "right"])

    return run


_CONTEXT = "gram long, node binary, at long, lo int, left binary, right binary"


def _runs(owner: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring offsets of an entry -> (entry, least offset, greatest offset)."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1 if len(owner) else first
    return owner[first], d[first], d[last]


def _other_side(common: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each entry of a merged array its longest common prefix with any entry of the other level,
    from those of neighbours (``common``): minima from where the level last changed."""
    n = len(side)
    out = np.zeros(n, np.int64)
    for c, s, back in ((common, side, False), (common[::-1], side[::-1], True)):
        run = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]).astype(np.int64)
        far = np.int64(1 << 32)
        least = np.minimum.accumulate(np.concatenate([[0], c]).astype(np.int64) - run * far) + run * far
        least[run == 0] = 0
        out = np.maximum(out, least[::-1] if back else least)
    return out


class SuffixFamily:
    """Levels of suffix arrays over contexts; a level holds twice as many batches as the one after it.

    An entry is (key, left bytes backwards, lo, number): the key is the anchor hash and the bytes
    from the anchor on. A string of L bytes that starts d bytes before the anchor belongs to the
    entry if ``lo <= d``, d is at most the number of left bytes, and the right bytes reach its end.
    ``found`` collects (which length, number, least d, greatest d) of strings that another entry holds too.
    """

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = lengths
        self.entries = 0
        self.merges = 0
        self.levels: list[tuple[int, list[tuple[bytes, bytes, int, int]]]] = []
        self.marks: list[list[np.ndarray]] = [[] for _ in lengths]
        self.whole: list[list[tuple[int, int, int]]] = [[] for _ in lengths]

    def add(self, grams: list[bytes], left: list[bytes], right: list[bytes], lo: list[int]) -> None:
        """A batch gets its suffix array, is scanned, and is merged with levels of its size."""
        array = sorted(zip(map(bytes.__add__, grams, right), (x[::-1] for x in left), lo, range(self.entries, self.entries + len(grams)), strict=True))
        self.entries += len(array)
        array = self._distinct(array)
        self._scan(array, None)
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            array, rank = self._merge(self.levels.pop()[1], array), rank + 1
        self.levels.append((rank, array))

    def finish(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge what is left; for each length (entry, least d, greatest d) of its repeated strings."""
        while len(self.levels) > 1:
            rank, array = self.levels.pop()
            self.levels.append((rank + 1, self._merge(self.levels.pop()[1], array)))
        out = []
        for marks, full in zip(self.marks, self.whole, strict=True):
            key = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
            found = _runs(key >> 16, key & 0xFFFF)
            more = np.array(full, np.int64).reshape(-1, 3).T
            out.append(tuple(np.concatenate([x, y]) for x, y in zip(found, more, strict=True)))
        return out

    def _merge(self, a: list, b: list) -> list:
        self.merges += 1
        second = np.zeros(self.entries, bool)
        second[[e[3] for e in b]] = True
        merged = a + b
        merged.sort()  # two sorted runs: a linear merge
        merged = self._distinct(merged)
        self._scan(merged, second)
        return merged

    def _distinct(self, array: list) -> list:
        """Of equal contexts one stays; all strings of each are repeated."""
        out: list = []
        stands = -1
        for e in array:
            if out and e[0] == out[-1][0] and e[1] == out[-1][1] and e[2] == out[-1][2]:
                for number in (e[3],) if stands == len(out) else (out[-1][3], e[3]):
                    for k, length in enumerate(self.lengths):
                        low = max(e[2], length + 8 - len(e[0]))
                        if low <= len(e[1]):
                            self.whole[k].append((number, low, len(e[1])))
                stands = len(out)
            else:
                out.append(e)
        return out

    def _scan(self, array: list, second: np.ndarray | None) -> None:
        n = len(array)
        if n < 2:
            return
        number = np.array([e[3] for e in array])
        size = np.array([len(e[0]) for e in array]) - 8
        width = int(size.max()) + 8
        keys = np.frombuffer(b"".join(e[0].ljust(width, b"\0") for e in array), np.uint8).reshape(n, width)
        differ = keys[1:] != keys[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) - 8
        common = np.minimum(common, np.minimum(size[1:], size[:-1]))
        if second is None:
            near = np.maximum(np.append(common, 0), np.append([0], common))
        else:
            near = _other_side(common, second[number])
        lo, hi = np.array([e[2] for e in array]), np.array([len(e[1]) for e in array])
        for k, length in enumerate(self.lengths):
            low = np.maximum(np.maximum(lo, length - size), length - near)
            rows = np.flatnonzero(low <= hi)
            if len(rows) > 1:
                between = np.minimum.reduceat(common[: rows[-1]], rows[:-1])
                self._same_strings(k, length, between, [array[i][1] for i in rows], low[rows], hi[rows], number[rows])

    def _same_strings(self, k: int, length: int, common: np.ndarray, left: list[bytes], low: np.ndarray, hi: np.ndarray, number: np.ndarray) -> None:
        """Strings that two of some entries hold, by offset: those of a run of common prefixes with equal
        left bytes."""
        n, most = len(number), int(hi.max())
        back = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in left), np.uint8).reshape(n, most)
        running = np.zeros(n, np.uint64)
        for at in range(0, most + 1, 32):  # offsets d in blocks of columns
            d = np.arange(at, min(at + 32, most + 1))
            terms = np.zeros((n, len(d)), np.uint64)
            real = slice(1 if at == 0 else 0, None)
            terms[:, real] = _VALUES[back[:, d[real] - 1]] * tb.powers(most + 1)[d[real]]
            sums = np.cumsum(terms, axis=1) + running[:, None]
            running = sums[:, -1].copy()
            row, col = np.nonzero((d >= low[:, None]) & (d <= hi[:, None]))
            if len(row) < 2:
                continue
            group = np.zeros((n, len(d)), np.uint64)
            np.cumsum(common[:, None] < length - d, axis=0, out=group[1:])
            key = tb.mix(tb.mix(sums[row, col]) + group[row, col] * np.uint64(0xD6E8FEB86659FD93) + d[col].astype(np.uint64))
            order = np.argsort(key)
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[order][1:] == key[order][:-1]
            hit = order[same[:-1] | same[1:]]
            self.marks[k].append(number[row[hit]] * np.int64(1 << 16) + d[col[hit]])


def _matched(lengths: tuple[int, ...], batch_entries: int):
    """A shard's contexts -> (which length, node, start, end) of repeated bytes."""

    def run(batches):
        family = SuffixFamily(lengths)
        nodes: list[pa.Array] = []
        places: list[np.ndarray] = []
        held: list[list] = [[] for _ in range(4)]

        def add() -> None:
            gram, lo, left, right = held
            family.add([g.to_bytes(8, "big", signed=True) for g in gram], left, right, lo)
            for c in held:
                c.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, batch_entries):
                part = batch.slice(i, batch_entries)
                nodes.append(part.column(1))
                places.append(part.column(2).to_numpy())
                for c, column in zip(held, (0, 3, 4, 5), strict=True):
                    c += part.column(column).to_pylist()
                if len(held[0]) >= batch_entries:
                    add()
        if not nodes:
            return
        if held[0]:
            add()
        node, at = pa.chunked_array(nodes).combine_chunks(), np.concatenate(places)
        for k, (entry, low, high) in enumerate(family.finish()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), k, np.int32)), node.take(pa.array(entry)), pa.array(at[entry] - high), pa.array(at[entry] - low + lengths[k])], names=["k", "node", "a", "b"])

    return run


def _strings(lengths: tuple[int, ...]):
    """Contexts -> a hash of each of their strings, for groups that no task should hold."""

    def run(batches):
        for batch in batches:
            _, node, at, lo, left, right = (c.to_pylist() for c in batch.columns[:6])
            for i in range(len(node)):
                data = np.frombuffer(left[i] + right[i], np.uint8)
                prefix = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_VALUES[data] * tb.powers(len(data)), out=prefix[1:])
                for k, length in enumerate(lengths):
                    d = np.arange(max(lo[i], length - len(right[i])), len(left[i]) + 1)
                    h = tb.span_hash(prefix, len(left[i]) - d, len(left[i]) - d + length)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), k, np.int32)), pa.array(h.view(np.int64)), pa.array([node[i]] * len(d), pa.binary()), pa.array(at[i] - d)], names=["k", "h", "node", "a"])

    return run


def repeated_spans(texts: DataFrame, work: Workspace, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, batch_entries: int = 1024, shard_entries: int = 16_384, group_entries: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Bytes that are covered by strings of ``lengths[k]`` bytes which start at two places or more.

    ``texts`` is (node binary, doc_id long, text binary); rows of one node have the same text; ``lengths``
    ascend. Returns (k int, node, a, b), spans that may overlap, and the table of (node, text) they were
    looked for in. A shard has about ``shard_entries`` contexts, more only if one anchor hash has, up
    to ``group_entries``.
    """
    length, reach = lengths[0], lengths[-1] - lengths[0]
    long = texts.where(F.length("text") >= length)
    found = work.keep(long.select("node", "text").mapInArrow(_scan(length, gram, reach), "gram long, node binary, at long, lo int, hi int, size int, own boolean"))
    place = F.struct("node", "at")
    common = found.where("not own").groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("gram")
    entries = work.keep(found.where("not own").join(common, "gram", "left_semi").drop("own").distinct())
    lows = F.array(*(F.greatest(F.col("lo"), F.lit(n) - F.col("size")) for n in lengths))
    own = found.where("own").select("node", "at", "hi", F.posexplode(lows).alias("k", "low")).where("low <= hi")
    own = own.select("k", "node", F.expr("at - hi").alias("a"), (F.col("at") - F.col("low") + F.element_at(F.array(*map(F.lit, lengths)), F.col("k") + 1)).alias("b"))
    # one row stands for all copies of a text: the one with the least id
    stands = long.groupBy("node").agg(F.min("doc_id").alias("least"))
    by_node = entries.groupBy("node").agg(F.collect_list(F.struct("gram", "at", "lo", "hi", "size")).alias("found")).join(own.select("node").distinct(), "node", "full").join(stands, "node").withColumnRenamed("node", "of")
    some = work.keep(long.join(by_node, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text", "found"))
    contexts = some.where("found is not null").select("node", "text", "found").mapInArrow(_contexts(), _CONTEXT)
    large = work.keep(entries.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > group_entries).select("gram"))
    many = not empty(large)
    usual = contexts.join(large, "gram", "left_anti") if many else contexts
    shards = max(1, -(-entries.count() // shard_entries))
    out = own.union(usual.repartition(shards, "gram").mapInArrow(_matched(lengths, batch_entries), "k int, node binary, a long, b long"))
    if many:
        strings = contexts.join(large, "gram", "left_semi").mapInArrow(_strings(lengths), "k int, h long, node binary, a long")
        where = F.struct("node", "a")
        twice = strings.groupBy("k", "h").agg(F.min(where).alias("x"), F.max(where).alias("y")).where("x <> y").select("k", "h")
        out = out.union(strings.join(twice, ["k", "h"]).select("k", "node", "a", (F.col("a") + F.element_at(F.array(*map(F.lit, lengths)), F.col("k") + 1)).alias("b")))
    spans = work.keep(out)
    work.drop(found, entries)
    return spans, some


def _merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(a, kind="stable")
    out: list[list[int]] = []
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _rest(lengths: int):
    """Batches of (node, text, spans) -> what is left of each text without the spans of the greatest
    length, and how much those of the least cover."""

    def run(batches):
        for batch in batches:
            rows, seen = [], set()
            for node, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                data = text.as_py()
                k, a, b = (c.to_numpy() for c in found.values.flatten())
                spans, passages = (_merged(a[k == i], b[k == i]) for i in (lengths - 1, 0))
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = [data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                rows.append((node, sum(y - x for x, y in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), "".join(k.decode("utf-8", "ignore") for k in kept), sum(y - x for x, y in passages), len(passages)))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "removed", "spans", "sha_rest", "rest", "covered", "passages"])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, passage: int | None = None, **sizes: int) -> DataFrame:
    """Remove repeated strings from every text of ``docs`` (doc_id, text).

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text
    or in another, is removed; strings are judged on the input, and matches never cross texts.
    Returns per row doc_id, n_bytes long, n_removed long, n_spans long (maximal removed runs) and
    kept_sha256 string; with ``with_text`` all columns of ``docs`` instead, the text without its removed
    bytes (a code point that loses bytes goes whole) and the rest as they were. With ``passage``, a
    length below ``length``, n_passage_bytes and n_passages (long) come too: the bytes that repeated
    strings of that length cover, in how many runs, whether removed or not. Null texts count
    as empty and stay null; texts shorter than ``length`` stay whole; of copies every one is removed.
    Rows without an id and repeated rows come back like any other; an empty table gives no rows.
    """
    if passage is not None and not gram < passage < length:
        raise ValueError(f"a passage of {passage} bytes is not between {gram} and {length}")
    work = Workspace(docs.sparkSession, "suffixes")
    raw = F.coalesce(whole(docs, "text", "string"), F.lit("")).cast("binary")
    named = docs.select(whole(docs, "doc_id", "long").alias("doc_id"), raw.alias("text")).withColumn("sha", F.sha2("text", 256)).withColumn("node", F.unhex(F.substring("sha", 1, 32)))
    rows = work.keep(named.select("doc_id", "node", "sha", F.length("text").cast("long").alias("n_bytes")))
    lengths = (length,) if passage is None else (passage, length)
    spans, some = repeated_spans(named.select("node", "doc_id", "text"), work, lengths, gram, **sizes)
    by_text = spans.groupBy("node").agg(F.collect_set(F.struct("k", "a", "b")).alias("found"))
    parts = work.keep(some.select("node", "text").join(by_text, "node").mapInArrow(_rest(len(lengths)), "node binary, removed long, spans long, sha_rest string, rest string, covered long, passages long"))
    work.drop(some, spans)
    copies = rows.where(F.col("n_bytes") >= lengths[0]).groupBy("node").agg(F.count("*").alias("copies")).where("copies > 1")
    if with_text:
        copied = rows.where(F.col("n_bytes") >= length).join(copies, "node", "left_semi").select("node").distinct().withColumn("gone", F.lit(True))
        cut = parts.join(copied, "node", "full").select("node", F.when(F.col("gone"), F.lit("")).otherwise(F.col("rest")).alias("cut"))
        own = F.unhex(F.substring(F.sha2(raw, 256), 1, 32))
        extra, key = fresh_name(docs, "cut"), fresh_name(docs, "node")
        joined = docs.withColumn(key, own).join(cut.select(F.col("node").alias(key), F.col("cut").alias(extra)), key, "left")
        return joined.withColumn("text", F.coalesce(extra, "text")).select(*docs.columns)
    out = rows.join(parts.drop("rest"), "node", "left").join(copies, "node", "left")
    copied = F.col("copies").isNotNull()
    gone = copied & (F.col("n_bytes") >= length)

    def number(name: str, whole_text: Column, when: Column) -> Column:
        return F.when(when, whole_text).otherwise(F.coalesce(name, F.lit(0))).cast("long")

    more = [number("covered", F.col("n_bytes"), copied).alias("n_passage_bytes"), number("passages", F.lit(1), copied).alias("n_passages")] if passage is not None else []
    return out.select(
        "doc_id",
        "n_bytes",
        number("removed", F.col("n_bytes"), gone).alias("n_removed"),
        number("spans", F.lit(1), gone).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha_rest", "sha")).alias("kept_sha256"),
        *more,
    )
