from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnwerk.llm import superminhash
from tarnwerk.llm.components import connected
from tarnwerk.llm.workspace import Workspace

from .helpers import SCHEMA, clashing, odd_rows, prose


def brute(rows, k, percent=80):
    sets, ids = [], []
    for doc_id, text, *_ in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
        ids.append(doc_id)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    least = {r: min((ids[i] for i in m if ids[i] is not None), default=None) for r, m in members.items()}
    return sorted((str(ids[i]), len(sets[i]), str(least[root(i)])) for i in range(len(rows)))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def family(seed, n, words=80):
    rng = np.random.default_rng(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[at] = f"new{seed}x{i}x{at}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, block", [(4, 512), (5, 8)])
def test_equals_brute_force(spark, k, block):
    rows = [(100 + i, t, "en", "a", 1) for i, t in enumerate(family(1, 40) + family(2, 25) + [prose(50 + j, 40) for j in range(20)])] + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = superminhash.near_duplicates(df, words=k, block=block)
    assert found(got) == brute(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.where("doc_id is not null").collect())


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    assert found(superminhash.near_duplicates(clashing(df))) == found(superminhash.near_duplicates(df))
    assert found(superminhash.near_duplicates(df, bitmap_bits=4)) == found(superminhash.near_duplicates(df))
    assert superminhash.near_duplicates(df.limit(0)).count() == 0
    assert superminhash.near_duplicates(df.select("doc_id")).count() == len(odd_rows())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sig = superminhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 252)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.08
    assert np.isinf(superminhash.signatures(np.zeros(0, np.uint64), np.array([0, 0]), 252)).all()


def test_signature_of_slices_is_that_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    one = superminhash.signatures(x, np.array([0, len(x)]), 252)
    monkeypatch.setattr(superminhash, "_ELEMENTS", 500)
    assert (superminhash.signatures(x, np.array([0, len(x)]), 252) == one).all()


def test_shingle_sets_of_short_texts():
    got = {}
    for first, sets, offsets in superminhash.shingle_sets(pa.array(["A b", "a  B", None, "", "a b c d e"]), 4):
        for i in range(len(offsets) - 1):
            got[first + i] = set(sets[offsets[i] : offsets[i + 1]].tolist())
    assert got[0] == got[1] and len(got[0]) == 1 and got[2] == got[3] == set() and len(got[4]) == 2


def test_union_find_on_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (5, 4), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200
    assert connected(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def boilerplate(n):
    """Texts that share most of their words without being near copies, some of them in near pairs."""
    shared, out = prose(900, 70), []
    for i in range(n):
        text = shared + " " + prose(1000 + i, 50 if i % 2 else 25)
        out += [text, text + " end"] if i % 5 == 0 else [text]
    return out


@pytest.mark.parametrize("block", [4, 10, 2048])
def test_large_buckets_without_a_main_component(spark, block):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(boilerplate(60) + family(3, 30))]
    assert found(superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4, block=block)) == brute(rows, 4)


def test_rows_are_linear_in_the_size_of_a_bucket(spark):
    for n in (500, 1000, 2000):
        # one bucket, of which all but 40 members are in one component
        state = spark.range(n).selectExpr("1L as key", "id as node", "if(id < 40, id, 40L) as comp")
        classes = spark.range(n).selectExpr("id as node", "id as doc_id", "100L as n_shingles", "cast('x' as binary) as sig")
        sizes = superminhash._sized(state, classes, 50)
        assert sizes.first()["fits"]
        dealt = superminhash._beside_main(state, sizes).collect()
        assert len(dealt) <= 2 * n and max(np.bincount([r["i"] for r in dealt])) < 150
        # every pair of different components meets
        parts = defaultdict(lambda: (set(), set()))
        for r in dealt:
            parts[r["i"]][r["side"]].add(r["node"])
        assert {(a, b) for minor, main in parts.values() for a in minor for b in main} == {(a, b) for a in range(40) for b in range(40, n)}
        assert sum(r["inner"] and r["side"] == 0 for r in dealt) == 40


def test_forests_of_a_large_bucket_are_linear(spark):
    sizes = []
    for n in (300, 600):
        state = spark.range(n).selectExpr("1L as key", "id as node")
        classes = spark.range(n).selectExpr("id as node", "id as doc_id", "100L as n_shingles", "cast(repeat('x', 252) as binary) as sig")
        pairs = superminhash._spanning(state, classes, 50, 80)
        sizes.append(pairs.count())
        linked = {r["node"]: r["root"] for r in connected(pairs, Workspace(spark, "t")).collect()}
        assert len(linked) == n and set(linked.values()) == {0}
    assert sizes[1] <= 2.2 * sizes[0] and sizes[0] < 600


@pytest.mark.parametrize("block, few", [(8, 16), (8, 2), (40, 2)])
def test_links_of_members_that_share_one_large_bucket_only(spark, monkeypatch, block, few):
    monkeypatch.setattr(superminhash, "_FEW", few, raising=False)
    rows = [(i, t) for i, t in enumerate(boilerplate(60) + family(3, 30) + [prose(4, 3), prose(4, 5)])]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    signed = texts.mapInArrow(superminhash._signed(4, 42, 6), "doc_id long, n_shingles long, node long, sig binary, bands array<long>").dropDuplicates(["node"]).cache()
    state = signed.selectExpr("1L as key", "node", "node as comp")
    work = Workspace(spark, "t")
    links = superminhash._remaining(state, signed, superminhash._sets_of(texts, signed, 4, 29), block, 80, work)
    root = {r["node"]: r["root"] for r in connected(links, work).collect()}
    own = {r["doc_id"]: root.get(r["node"], r["node"]) for r in signed.collect()}
    first = {}
    for i in sorted(own):
        first.setdefault(own[i], i)
    kept = [r for r in rows if r[0] in own]
    assert len(first) < len(kept) - 20
    assert sorted((str(i), str(first[own[i]])) for i in own) == [(i, c) for i, _, c in brute(kept, 4)]


def test_linked_sets_share_one_of_their_rarest_shingles(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 400).astype(np.uint64) << np.uint64(1)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(150, 400)), False), rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(60)]
    members = spark.createDataFrame([(i, i, s.tobytes()) for i, s in enumerate(sets)], "node long, comp long, grams binary")
    linked = {(i, j) for j in range(60) for i in range(j) if superminhash._link(sets[i], sets[j], 80)}
    assert linked
    for bits in (2, 16):
        by_key = defaultdict(list)
        for r in superminhash._by_rarest(members, bits, 80).collect():
            by_key[r["key"]].append((r["node"], r["rest"]))
        meet = {(a, b) for g in by_key.values() for a, ra in g for b, rb in g if a < b and 180 * min(ra, rb) >= 80 * (len(sets[a]) + len(sets[b]))}
        assert linked <= meet
