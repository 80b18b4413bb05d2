import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tarnwerk.llm import packing  # noqa: E402
from tarnwerk.llm import textbatch as tb  # noqa: E402
from tarnwerk.llm.wordpieces import word_encoder  # noqa: E402

from .helpers import SCHEMA, clashing, odd_rows, prose  # noqa: E402


@pytest.fixture(scope="module")
def path():
    return P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_ids_are_the_library_s(path, library):
    rng = random.Random(3)
    alphabet = [*"abzABZ 019.,!'’\"\t\n\r\x0b\x0c\x1c\x85\xa0 éÉïİıſßÿŸ×÷ñŒŁłŽžʼnΑΣσς中ー각가́̈‍😀🏽½²٣\x00\x01_-", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    encoder = word_encoder(path)()
    for block in tb.blocks(pa.array(texts)):
        ids, cut = encoder.block(block)
        for i in range(len(block)):
            assert ids[cut[i] : cut[i + 1]].tolist() == library.encode(texts[block.first + i], add_special_tokens=False).ids


def test_added_tokens_are_the_plain_call_s(path, library):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>é", "'s<|endoftext|>'s 12<|endoftext|>34", "<|endoftext|", "a <|endoftext|>"]
    encoder = word_encoder(path)()
    for block in tb.blocks(pa.array(texts)):
        ids, cut = encoder.block(block)
        for i, text in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert library.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]


def test_cache_may_overflow(path):
    from tarnwerk.llm.wordcache import PieceEncoder

    e = word_encoder(path)()
    small = PieceEncoder(e.cut, e.encode, cache_pieces=5)
    texts = pa.array([prose(i, 30) for i in range(10)])
    for a, b in zip(tb.blocks(texts, 400), tb.blocks(texts, 400), strict=True):
        assert (small.block(a)[0] == e.block(b)[0]).all()


def check_plan(counts, capacity):
    steps = packing.plan(counts, capacity)
    used = Counter()
    for s in steps:
        assert s.times > 0 and sum(s.lengths) <= capacity
        for x in s.lengths:
            used[x] += s.times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(s.times for s in steps), len(steps)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(100, rng.gamma(1.0 + seed, 15, 3000).astype(int) + 1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    n, _ = check_plan(counts, 100)
    assert n <= -(-int(lengths.sum()) // 100) + max(3, int((lengths > 50).sum() * 2 - len(lengths)))


def test_plan_size_does_not_follow_counts():
    small, large = {i: 1 + i % 7 for i in range(1, 101)}, {i: (1 + i % 7) * 10**9 for i in range(1, 101)}
    assert check_plan(large, 100)[1] <= 3 * 100 and check_plan(small, 100)[1] <= 3 * 100
    assert check_plan({}, 10) == (0, 0) and check_plan({10: 5, 1: 3}, 10) == (6, 2)
    with pytest.raises(ValueError, match="outside"):
        packing.plan({11: 1}, 10)


@pytest.mark.parametrize("capacity, salt", [(2048, 20_000), (64, 3)])
def test_packed_rows(spark, path, library, capacity, salt):
    rows = odd_rows() + [(100 + i, prose(i, 5 + i), "en", "a", 1) for i in range(60)] + [(300, prose(9, 12), "en", "a", 1)] * 20
    got = packing.pack(clashing(spark.createDataFrame(rows, SCHEMA)), word_encoder(path), capacity=capacity, rows_a_salt=salt).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.02 * total / capacity + 2


def test_repeated_rows_are_spread(spark, path):
    rows = [(1, prose(9, 12), "en", "a", 1)] * 400
    pieces = packing.tokenize_pieces(spark.createDataFrame(rows, SCHEMA).repartition(3), word_encoder(path))
    assert pieces.select("number").distinct().count() >= 100
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), word_encoder(path), rows_a_salt=20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 400


def test_plans_of_lengths_that_fill_nothing_are_fast():
    import time

    began = time.perf_counter()
    counts = {i: 3 for i in range(700, 2048, 2) if i % 6 == 2}
    check_plan(counts, 2047)
    check_plan({i: 1 for i in range(1, 2049)}, 2048)
    assert time.perf_counter() - began < 20


def test_empty_table(spark, path):
    assert packing.pack(spark.createDataFrame([], SCHEMA), word_encoder(path)).count() == 0
