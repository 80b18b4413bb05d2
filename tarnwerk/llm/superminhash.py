"""MinHash near-dedup by SuperMinHash signatures, banding, verification and union-find.

The parts, in order:

1. Each text becomes its set of distinct word shingles (64-bit hashes). Rows with equal sets form
   one class, found by a digest of the set; the class's smallest id stands for it from here on.
2. A class gets a SuperMinHash signature: the shingle's random ranks are spread over the slots by
   one permutation per shingle, so slots are negatively correlated (lower variance than
   independent minima), and a text stops as soon as all its slots are below the next rank.
3. Bands of the signature are bucket keys; only keys of two or more classes go on.
4. Links are verified on the full sets, but buckets are not expanded into all pairs. First each bucket
   gives a spanning set of pairs: a star in small ones; large ones are dealt into parts twice, by
   independent hashes, and each part gives a forest of its most similar signatures. Buckets whose members
   then are in one component go. In the others pairs of different components are tried: members outside a
   bucket's largest component meet all others, in parts of bounded size. Both make rows in proportion
   to the bucket. Where more members are outside than a part holds, the members of all such buckets are
   grouped anew, by the rarest shingles of their sets: linked sets share one of them (prefix filter), and what
   is left behind the first one they share bounds the overlap (positional filter). Both lose no link. Small groups
   give their pairs, larger ones go on as buckets do, and what then still is too large is tried in all pairs of
   parts.
5. Components of the verified links are contracted by distributed union-find.

Probabilities: with 42 bands of 6 slots a pair at similarity 0.8 shares no band in 3 of a million
cases; the estimate over 252 slots falls below 0.7 for such a pair in about 3 of a hundred thousand. In
what is grouped by rarest shingles pairs are verified from 0.6 on, which is eight deviations away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import connected
from .workspace import Workspace, digest, empty, whole

#: Elements that the signature step works on at a time; each needs one byte a slot.
_ELEMENTS = 1 << 15


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct hashes, offsets) by block: shingles of ``words`` words after
    lower-casing A-Z; with fewer words the whole sequence; without words the empty set."""
    inside, values = tb.word_bytes(), tb.byte_values(1, True)
    odd = tb.mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for block in tb.blocks(column):
        starts, ends, text = tb.spans(block, inside)
        word = tb.span_hash(block.prefix(values), starts, ends)
        n = np.bincount(text, minlength=len(block))
        m = max(0, len(word) - words + 1)
        full = np.zeros(m, dtype=np.uint64)
        for i in range(words):
            full += word[i : i + m] * odd[i]
        within = text[:m] == text[len(text) - m :] if m else np.zeros(0, bool)
        full, owner = tb.mix(full[within]), text[:m][within]
        short = np.flatnonzero((n > 0) & (n < words))
        at = np.concatenate([[0], np.cumsum(n)])
        extra = [int(tb.mix(np.array([np.sum(word[at[i] : at[i + 1]] * odd[: n[i]]) + np.uint64(n[i])], dtype=np.uint64))[0]) for i in short]
        full, owner = np.concatenate([full, np.array(extra, dtype=np.uint64)]), np.concatenate([owner, short])
        order = np.lexsort((full, owner))
        full, owner = full[order], owner[order]
        first = np.ones(len(full), dtype=bool)
        first[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
        full, owner = full[first], owner[first]
        yield block.first, full, np.searchsorted(owner, np.arange(len(block) + 1))


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set ``elements[offsets[i]:offsets[i + 1]]``: (sets, slots) float64,
    infinite for the empty set. ``slots`` must be at most 256."""
    out = np.full((len(offsets) - 1, slots), np.inf)
    at = 0
    while at < len(out):
        to = min(len(out), max(at + 1, int(np.searchsorted(offsets, offsets[at] + _ELEMENTS, side="right")) - 1))
        # a very long text is folded in by slices: minima over slices are minima over the whole
        for lo in range(offsets[at], max(offsets[to], offsets[at] + 1), _ELEMENTS * 2):
            hi = min(offsets[to], lo + _ELEMENTS * 2)
            if hi > lo:
                cut = np.clip(offsets[at : to + 1], lo, hi)
                _fold(out[at:to], elements[lo:hi], np.repeat(np.arange(to - at), np.diff(cut)))
        at = to
    return out


def _fold(h: np.ndarray, x: np.ndarray, owner: np.ndarray) -> None:
    slots = h.shape[1]
    flat = h.reshape(-1)
    place: np.ndarray | None = None
    for j in range(slots):
        rank = tb.mix(x + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & tb._MASK))
        k = j + ((rank & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        value = (rank >> np.uint64(32)).astype(np.float64) / 2.0**32 + j
        if place is None:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = place[rows, k].astype(np.int64)
            place[rows, k] = place[rows, j]
        np.minimum.at(flat, owner * slots + slot, value)
        going = (h.max(axis=1) >= j + 1)[owner]
        if not going.any():
            return
        if place is None:
            x, owner, k = x[going], owner[going], k[going]
            place = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(x), slots)).copy()
            place[np.arange(len(x)), k] = 0
        elif going.mean() < 0.7:
            x, owner, place = x[going], owner[going], place[going]


def _signed(words: int, bands: int, rows: int):
    """Batches of (doc_id, text, maybe digest) -> doc_id, n_shingles, node, sig, bands, digest. The node is 64 bits of the
    set's digest, null for the empty set."""
    slots = bands * rows
    odd = tb.mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for first, sets, offsets in shingle_sets(batch.column(1), words):
                n = np.diff(offsets)
                sig = signatures(sets, offsets, slots)
                bits = sig.view(np.uint64)
                small = (tb.mix(bits) >> np.uint64(56)).astype(np.uint8)
                keys = tb.mix((bits.reshape(len(n), bands, rows) * odd).sum(axis=2) + tb.mix(np.arange(bands, dtype=np.uint64))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                own = [batch.column(k).slice(first, len(n)) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(_nodes(sets, offsets), pa.int64()), pa.array([r.tobytes() for r in small], pa.binary()), lists, *own],
                    names=["doc_id", "n_shingles", "node", "sig", "bands", "digest"][: 5 + len(own)],
                )

    return run


def _nodes(sets: np.ndarray, offsets: np.ndarray) -> list[int | None]:
    data = memoryview(sets).cast("B")
    at = (8 * offsets).tolist()
    return [int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little", signed=True) if y > x else None for x, y in zip(at, at[1:])]


def _full_sets(words: int, bitmap: np.ndarray):
    """Batches of (doc_id, text) -> node, doc_id, grams of the rows that the bitmap lets pass. A bitmap of one
    byte of ones lets every row pass."""
    mask = np.int64(8 * len(bitmap) - 1)

    def run(batches):
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            for first, sets, offsets in shingle_sets(batch.column(1), words):
                nodes = _nodes(sets, offsets)
                key = (np.array([x or 0 for x in nodes], np.int64) ^ ids[first : first + len(nodes)]) & mask
                passing = np.flatnonzero((bitmap[key >> 3] >> (key & 7).astype(np.uint8)) & 1 & np.array([x is not None for x in nodes]))
                data = memoryview(sets).cast("B")
                grams = [bytes(data[8 * offsets[i] : 8 * offsets[i + 1]]) for i in passing]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in passing], pa.int64()), batch.column(0).take(pa.array(first + passing)), pa.array(grams, pa.binary())], names=["node", "doc_id", "grams"])

    return run


def _sets_of(texts: DataFrame, wanted: DataFrame, words: int, most_bits: int) -> DataFrame:
    """The full sets of the rows ``wanted`` (node, doc_id), and of a few more: eight bits for each go to tasks as
    a bitmap of at most 2 ** ``most_bits`` bits; beyond that, rows are found by a join on their ids."""
    bits = max(18, int(wanted.count() * 8).bit_length())
    if bits <= most_bits:
        return texts.mapInArrow(_full_sets(words, _bitmap(wanted, bits)), "node long, doc_id long, grams binary")
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    some = texts.join(ids, texts.doc_id.eqNullSafe(ids.wanted_id), "left_semi")
    return some.mapInArrow(_full_sets(words, np.full(1, 255, np.uint8)), "node long, doc_id long, grams binary")


def _bitmap(wanted: DataFrame, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, those of (node, doc_id) set."""
    key = F.col("node").bitwiseXOR(F.coalesce("doc_id", F.lit(0))).bitwiseAND(F.lit((1 << bits) - 1))
    rows = wanted.select(key.alias("k")).groupBy(F.shiftright("k", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["chunk"] * 4096 : (r["chunk"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Are two sorted sets of hashes similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    """Batches of (a, b, grams_a, grams_b) -> the pairs that are linked on their full sets."""

    def run(batches):
        for batch in batches:
            keep = [_link(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _similar(sig: np.ndarray, size: np.ndarray, r: int, least: float, percent: int) -> np.ndarray:
    """Shares of slots that agree with member r; 0 where sizes or signatures allow no link."""
    out = (sig == sig[r]).mean(axis=1)
    out[(out < least) | (np.minimum(size, size[r]) * 100 < np.maximum(size, size[r]) * percent)] = 0
    return out


def _slots(frame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), -1)


def _pairs(a: list[int], b: list[int]):
    import pandas as pd

    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _forest(least: float, percent: int):
    """Members of two parts of a bucket -> a spanning forest of the most similar pairs (Prim's algorithm,
    one tree after the other)."""

    def run(frame):
        sig, node, size = _slots(frame), frame["node"].to_numpy(), frame["n_shingles"].to_numpy()
        best, near, todo = np.zeros(len(node)), np.full(len(node), -1), np.ones(len(node), bool)
        a, b = [], []
        while todo.any():
            r = int(np.where(todo, best, -1).argmax())
            todo[r] = False
            if near[r] >= 0:
                a.append(node[near[r]])
                b.append(node[r])
            s = _similar(sig, size, r, least, percent)
            closer = todo & (s > best)
            best[closer], near[closer] = s[closer], r
        return _pairs(a, b)

    return run


def _merging(least: float, percent: int):
    """Members of a part -> links that join their components, verified on the full sets. Members of side 0
    are tried with those of side 1, and with each other where ``inner`` says so; components that were
    joined here count as one. At most the ``rest`` of a set's shingles can be in the other."""

    def run(frame):
        sig, node, size = _slots(frame), frame["node"].to_numpy(), frame["n_shingles"].to_numpy()
        side, inner, comp = frame["side"].to_numpy(), bool(frame["inner"].iloc[0]), np.unique(frame["comp"].to_numpy(), return_inverse=True)[1]
        grams = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        rest = frame["rest"].to_numpy()
        at = np.arange(len(node))
        a, b = [], []
        for r in np.flatnonzero(side == 0):
            tried = np.flatnonzero((comp != comp[r]) & ((side == 1) | (inner & (at > r))) & (np.minimum(rest, rest[r]) * (100 + percent) >= (size + size[r]) * percent))
            if not len(tried):
                continue
            hits = tried[(sig[tried] == sig[r]).mean(axis=1) >= least]
            for j in hits:
                if comp[j] != comp[r] and _link(grams[r], grams[j], percent):
                    a.append(node[r])
                    b.append(node[j])
                    comp[comp == comp[j]] = comp[r]
        return _pairs(a, b)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, block: int = 2048, digests: bool = False, bitmap_bits: int = 29) -> DataFrame:
    """Near-duplicate classes of all rows of ``docs`` (doc_id, text).

    Returns doc_id long, n_shingles long, component_id long (the smallest doc_id reachable over
    links, the row's own included), kept boolean (doc_id = component_id). Two rows are linked if
    ``100 * |A and B| >= percent * |A or B|`` on their full shingle sets. Null or wordless texts have
    the empty set and are linked with nothing. Every row comes back, repeated ones too; a row without
    a doc_id takes part in links but never names a component, and is kept only if nothing in its
    component has an id. With ``digests`` the text's digest and root long, the component itself (null for
    the empty set), come too: rows of different components may share an id. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "minhash")
    texts = docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").alias("text"))
    own = ["digest"] if digests else []
    hashed = texts.withColumn("digest", digest(texts)) if digests else texts
    signed = work.keep(hashed.mapInArrow(_signed(words, bands, rows), "doc_id long, n_shingles long, node long, sig binary, bands array<long>" + (", digest string" if digests else "")))
    classes = work.keep(signed.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_shingles", "sig", "bands")).alias("c")).select("node", "c.*"))
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    state = work.keep(keyed.join(shared, "key", "left_semi").select("key", "node", F.col("node").alias("comp")))
    comps = work.spark.createDataFrame([], "node long, root long")
    used: list[DataFrame] = []
    if not empty(state):
        wanted = work.keep(classes.join(state.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "n_shingles", "sig"))
        sets = work.keep(_sets_of(texts, wanted, words, bitmap_bits))
        used += [wanted, sets, state]
        pairs = _spanning(state, wanted, block, percent)
        comps = _joined(comps, work.keep(_verified(_close(pairs, wanted, percent), sets, percent)), work)
        now = state.drop("comp").join(comps, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        state = work.keep(now.join(mixed, "key", "left_semi"))
        if not empty(state):
            comps = _joined(comps, work.keep(_remaining(state, wanted, sets, block // 2, percent, work)), work)
    rooted = classes.select("node", "doc_id").join(comps, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = work.keep(rooted.join(least, "root").select("node", "root", "component_id", F.col("doc_id").alias("rep")))
    rows_out = work.keep(signed.select("doc_id", "n_shingles", "node", *own))
    work.drop(signed, classes, state, *used)
    component = F.coalesce("component_id", "doc_id")
    return rows_out.join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), *own, *(["root"] if digests else []))


def _joined(comps: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """Components after more links."""
    one, two = (comps.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    over = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    higher = connected(over, work)
    up = higher.select(F.col("node").alias("root"), F.col("root").alias("up"))
    moved = comps.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return work.keep(moved.union(higher.join(comps, "node", "left_anti").select("node", "root")))


def _close(pairs: DataFrame, classes: DataFrame, percent: int, slack: float = 0.1) -> DataFrame:
    """Pairs whose sizes and signatures allow a link, with the ids of the rows that hold their texts."""
    one, two = (classes.select(F.col("node").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    fits = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return fits.select("a", "b", "da", "db", "sa", "sb").mapInArrow(_estimated(percent / 100 - slack), "a long, b long, da long, db long")


def _estimated(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
                mask = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in range(4)], names=["a", "b", "da", "db"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs, by the full sets of the rows that stand for their classes."""
    one, two = (sets.select(F.col("node").alias(f"n{x}"), F.col("doc_id").alias(f"i{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
    first = pairs.join(one, (F.col("a") == F.col("na")) & F.col("da").eqNullSafe(F.col("ia"))).select("a", "b", "db", "ga")
    both = first.join(two, (F.col("b") == F.col("nb")) & F.col("db").eqNullSafe(F.col("ib"))).select("a", "b", "ga", "gb")
    return both.mapInArrow(_confirmed(percent), "a long, b long")


#: Bytes of full sets that a part has at most, roughly.
_PART_BYTES = 64 << 20


def _parts(block: int) -> Column:
    return F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / _PART_BYTES)).cast("int")


def _spanning(state: DataFrame, classes: DataFrame, block: int, percent: int) -> DataFrame:
    """Pairs that span what is alike in each bucket: a star in small ones, forests of parts in large ones."""
    sized = state.join(classes.select("node", (8 * F.col("n_shingles")).alias("b")), "node")
    counts = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"), F.min("node").alias("first"))
    counted = state.join(counts, "key")
    stars = counted.where("n <= 16 and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    large = counted.where("n > 16").withColumn("parts", _parts(block))
    twice = large.withColumn("deal", F.explode(F.when(F.col("parts") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dealt = twice.select("key", "deal", F.pmod(F.xxhash64("node", "deal"), F.col("parts")).cast("int").alias("part"), "node")
    forests = dealt.join(classes.select("node", "n_shingles", "sig"), "node").groupBy("key", "deal", "part").applyInPandas(_forest(percent / 100 - 0.1, percent), "a long, b long")
    return stars.union(forests).distinct()


def _sized(state: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Of each bucket: members n, their bytes, parts, its largest component ``main``, and whether all members
    outside of that fit into one part."""
    sized = state.join(classes.select("node", (8 * F.col("n_shingles")).alias("b")), "node")
    by_comp = sized.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))
    sums = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    fits = (F.col("n") - F.col("top.n") <= block) & (F.col("bytes") - F.col("top.bytes") <= _PART_BYTES)
    return sums.select("key", "n", "bytes", _parts(block).alias("parts"), F.col("top.comp").alias("main"), (fits | (_parts(block) == 1)).alias("fits"))


_PART = ("key", "i", "j", "node", "comp", "side", "inner", "rest")


def _rest(state: DataFrame) -> Column:
    return whole(state, "rest", "long").alias("rest")


def _beside_main(state: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members outside of a bucket's largest component in each of its parts, the others in one: at most about
    twice the bucket's rows."""
    placed = state.join(sizes.where("fits"), "key").withColumn("minor", F.col("comp") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = placed.withColumn("i", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    return dealt.select("key", "i", F.col("i").alias("j"), "node", "comp", F.when(F.col("minor"), 0).otherwise(1).alias("side"), (F.col("i") == 0).alias("inner"), _rest(state))


def _all_parts(state: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members once for each pair of parts (i, j) that theirs belongs to."""
    placed = state.join(sizes.where("not fits"), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return dealt.select("key", "i", "j", "node", "comp", F.when(F.col("part") == F.col("i"), 0).otherwise(1).alias("side"), (F.col("i") == F.col("j")).alias("inner"), _rest(state))


#: Bits of the counters' index that order shingles by how rare they are.
_COUNTER_BITS = 21
#: Members of a group whose pairs are listed.
_FEW = 16


def _counters(bits: int):
    """Batches of (node, comp, grams) -> how many shingles of this task have a counter."""

    def run(batches):
        out = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for g in batch.column(2):
                np.add.at(out, (np.frombuffer(g.as_py(), np.uint64) >> np.uint64(64 - bits)).astype(np.int64), 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["counter", "n"])

    return run


def _prefixes(percent: int, counts: np.ndarray):
    """Batches of (node, comp, grams) -> key, node, comp, rest: the rarest shingles of a set, so many that a linked
    one must have one of them among its own, and how many of the set follow, the shingle included. What only
    one set has is left out."""
    shift = np.uint64(65 - len(counts).bit_length())

    def run(batches):
        for batch in batches:
            keys, n, rest = [], [], []
            for g in batch.column(2):
                x = np.frombuffer(g.as_py(), np.uint64)
                c = counts[(x >> shift).astype(np.int64)]
                first = np.lexsort((x, c))[: len(x) + percent * len(x) // -100 + 1]
                at = np.flatnonzero(c[first] > 1)
                keys.append(x[first[at]])
                n.append(len(at))
                rest.append(len(x) - at)
            if sum(n):
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(rest).astype(np.int64))], names=["key", "node", "comp", "rest"])

    return run


def _by_rarest(members: DataFrame, bits: int, percent: int) -> DataFrame:
    """Groups of ``members`` (node, comp, grams) of different components that share one of their rarest shingles.
    Counters are shared by shingles: any order gives every link, and a closer one smaller groups."""
    found = members.mapInArrow(_counters(bits), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.uint32)
    counts[found.column("counter").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 32) - 1)
    out = members.mapInArrow(_prefixes(percent, counts), "key long, node long, comp long, rest long")
    mixed = out.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return out.join(mixed, "key", "left_semi")


def _remaining(state: DataFrame, classes: DataFrame, sets: DataFrame, block: int, percent: int, work: Workspace) -> DataFrame:
    """Links between components in what is left of the buckets. The smallest buckets are joined with
    themselves, the others verified part by part; members of those that have too many outside of their
    largest component are grouped by their rarest shingles."""
    sizes = work.keep(_sized(state, classes, block))
    few = state.join(sizes.where("n <= 3").select("key"), "key", "left_semi")
    left, right = (few.select("key", F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    named = classes.select("node", "doc_id", "n_shingles", "sig")
    own = sets.join(named, (sets.node == named.node) & sets.doc_id.eqNullSafe(named.doc_id)).select(named.node, "n_shingles", "sig", "grams")
    found = _found(_beside_main(state, sizes.where("n > 3")), own, percent / 100 - 0.1, percent)
    out = _verified(_close(pairs, classes, percent), sets, percent).union(found)
    if empty(sizes.where("not fits")):
        return out
    crowded = state.join(sizes.where("not fits").select("key"), "key", "left_semi").select("node", "comp").distinct()
    members = work.keep(own.join(crowded, "node").groupBy("node").agg(F.first("comp").alias("comp"), F.first("grams").alias("grams")))
    total = classes.join(crowded, "node", "left_semi").agg(F.sum("n_shingles")).first()[0]
    groups = work.keep(_by_rarest(members, min(_COUNTER_BITS, max(12, int(4 * total).bit_length())), percent))
    sizes = work.keep(_sized(groups, classes, block))
    counted = groups.join(sizes.where(F.col("n") <= _FEW).select("key"), "key", "left_semi").join(classes.select("node", "n_shingles"), "node")
    left, right = (counted.select("key", F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("rest").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    listed = left.join(right, "key").where("a < b and ca <> cb").where(F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b").distinct()
    many = sizes.where(F.col("n") > _FEW)
    found = _found(_beside_main(groups, many).union(_all_parts(groups, many)), own, percent / 100 - 0.2, percent)
    return out.union(_verified(_close(listed, classes, percent, 0.2), sets, percent)).union(found)


def _found(dealt: DataFrame, own: DataFrame, least: float, percent: int) -> DataFrame:
    """Links in parts; where ``rest`` is null, all shingles of a set can be in others."""
    members = dealt.select(*_PART).join(own, "node").withColumn("rest", F.coalesce("rest", "n_shingles"))
    return members.groupBy("key", "i", "j").applyInPandas(_merging(least, percent), "a long, b long")
