import hashlib
from collections import Counter

import numpy as np
import pytest

from tarnwerk.llm import suffixes

from .helpers import SCHEMA, clashing, odd_rows, prose


def brute(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for doc_id, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(x)))
        rest = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((str(doc_id), len(x), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def planted(length):
    passage, other = prose(77, 60), prose(78, 60)
    out = []
    for i in range(12):
        cut = passage[i * 7 : i * 7 + length + 5 * i]
        out.append((100 + i, prose(200 + i, 30) + " " + cut + " " + prose(300 + i, 20) + (other if i % 3 == 0 else ""), "en", "a", 1))
    out += [(200, "ab" * 300, "en", "a", 1), (201, "b" + "ab" * 200, "en", "a", 1), (202, "line of text\n" * 60, "en", "a", 1), (203, "x" * (length - 1), "en", "a", 1), (204, "x" * length, "en", "a", 1), (205, "y" * (length + 1), "en", "a", 1)]
    return out


@pytest.mark.parametrize("length, gram, sizes", [(120, 40, {}), (120, 40, {"batch_entries": 5, "group_entries": 1000}), (120, 40, {"batch_entries": 4, "group_entries": 3}), (60, 20, {"batch_entries": 16, "group_entries": 8}), (60, 20, {"batch_entries": 2, "shard_entries": 8})])
def test_equals_brute_force(spark, length, gram, sizes):
    rows = planted(length) + [r for r in odd_rows() if r[0] != 7]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(suffixes.cut_repeats(clashing(df), length, gram, **sizes)) == brute(rows, length)


def test_empty_table_and_text_output(spark):
    df = spark.createDataFrame(planted(120), SCHEMA)
    assert suffixes.cut_repeats(df.limit(0)).count() == 0
    cut = suffixes.cut_repeats(clashing(df), 120, 40, with_text=True)
    assert cut.columns == clashing(df).columns
    sha = {r["doc_id"]: r["kept_sha256"] for r in suffixes.cut_repeats(df, 120, 40).collect()}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut.collect()} == sha


def test_cut_code_points_go_whole(spark):
    shared = "é" * 200
    rows = [(1, "a" + shared + "end one", "fr", "a", 1), (2, "b" + shared + "two", "fr", "a", 1), (3, None, "fr", "a", 1)]
    got = {r["doc_id"]: r["text"] for r in suffixes.cut_repeats(spark.createDataFrame(rows, SCHEMA), 101, 30, with_text=True).collect()}
    assert got == {1: "aend one", 2: "btwo", 3: None}


def covered(rows, length):
    return {r[0]: (r[2], r[3]) for r in brute(rows, length)}


@pytest.mark.parametrize("sizes", [{}, {"batch_entries": 5}, {"batch_entries": 4, "group_entries": 3}])
def test_two_lengths_each_equal_brute_force(spark, sizes):
    rows = planted(120) + [r for r in odd_rows() if r[0] != 7] + [(300, "shared head " * 9, "en", "a", 1), (301, "shared head " * 9, "en", "a", 1)]
    got = suffixes.cut_repeats(spark.createDataFrame(rows, SCHEMA), 120, 20, passage=70, **sizes).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows, 120)
    assert {str(r["doc_id"]): (r["n_passage_bytes"], r["n_passages"]) for r in got} == covered(rows, 70)


def test_slices_of_long_texts_keep_both_lengths(spark, monkeypatch):
    import pyarrow as pa

    shared = prose(6, 3000)
    texts = pa.array([shared, prose(7, 10) + shared[:20000]])

    def anchors_found():
        batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b"]), texts], names=["node", "text"])
        out = pa.Table.from_batches(list(suffixes._scan(240, 80, 160)(iter([batch]))))
        starts = {}
        for r in out.to_pylist():
            for p in range(r["at"] - r["hi"], r["at"] - r["lo"] + 1):
                assert (r["node"], p, r["own"]) not in starts
                starts[r["node"], p, r["own"]] = (r["at"], p + 400 <= r["at"] + r["size"])
        return starts

    once = anchors_found()
    monkeypatch.setattr(suffixes, "_SLICE", 5000)
    assert anchors_found() == once
    assert {p for n, p, own in once if n == b"a" and not own} == set(range(len(shared.encode()) - 239))


def test_family_levels_double():
    f = suffixes.SuffixFamily((50,))
    rng = np.random.default_rng(1)
    for _ in range(7):
        f.add([b"12345678"] * 4, [b""] * 4, [rng.bytes(50) for _ in range(4)], [0] * 4)
    assert [(rank, len(x)) for rank, x in f.levels] == [(2, 16), (1, 8), (0, 4)] and f.merges == 4
    assert not len(f.finish()[0][0])


def test_family_equals_pairs_of_contexts():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, 200).astype(np.uint8).tobytes()
    entries = []
    for _ in range(120):
        hi, n = int(rng.integers(0, 20)), int(rng.integers(45, 60))
        body = bytearray(base[40 - hi : 40 + n])
        body[int(rng.integers(0, len(body)))] ^= int(rng.integers(0, 2))
        entries.append((bytes(body[:hi]), bytes(body[hi:]), int(rng.integers(0, 5))))
    f = suffixes.SuffixFamily((40, 55))
    for i in range(0, len(entries), 7):
        left, right, lo = zip(*entries[i : i + 7], strict=True)
        f.add([b"12345678"] * len(left), list(left), list(right), list(lo))
    for length, (entry, low, high) in zip((40, 55), f.finish(), strict=True):
        strings = {}
        for i, (left, right, lo) in enumerate(entries):
            for d in range(max(lo, length - len(right)), len(left) + 1):
                strings.setdefault((d, (left + right)[len(left) - d : len(left) - d + length]), set()).add(i)
        want = {(i, d) for (d, _), who in strings.items() if len(who) > 1 for i in who}
        assert want and {(i, d) for i, a, b in zip(entry.tolist(), low.tolist(), high.tolist(), strict=True) for d in range(a, b + 1)} == want


def test_levels_merge_on_the_documents_table(monkeypatch):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    if not os.path.isfile("/root/testdata/sf0.01/documents.parquet"):
        pytest.skip("no test tables here")
    texts = sorted({t.as_py() or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"]})
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(len(texts))]), pa.array(texts)], names=["node", "text"])
    found = [r for b in suffixes._scan(240, 80, 160)(iter([batch])) for r in b.to_pylist() if not r["own"]]
    count = Counter(r["gram"] for r in found)
    by_node = {}
    for r in found:
        if count[r["gram"]] > 1:
            by_node.setdefault(r["node"], []).append({k: r[k] for k in ("gram", "at", "lo", "hi", "size")})
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("size", pa.int32())]))
    rows = pa.RecordBatch.from_arrays([pa.array(list(by_node)), pa.array([texts[int(n)].encode() for n in by_node]), pa.array(list(by_node.values()), kind)], names=["node", "text", "found"])
    families = []

    class Counted(suffixes.SuffixFamily):
        def __init__(self, lengths):
            super().__init__(lengths)
            families.append(self)

    monkeypatch.setattr(suffixes, "SuffixFamily", Counted)
    spans = [b for b in suffixes._matched((240, 400), 1024)(suffixes._contexts()(iter([rows])))]
    assert len(families) == 1 and families[0].merges > 1 and sum(b.num_rows for b in spans) > 500
