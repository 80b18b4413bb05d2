import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

P = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402

from tarnwerk.llm import sentencepieces as sp  # noqa: E402
from tarnwerk.llm import textbatch as tb  # noqa: E402

from .helpers import SCHEMA, clashing, odd_rows  # noqa: E402

ALPHABET = [*"abzABZ   019.,!'\"\t\n\r\x00\x1c\xa0éÉïİıſß中文ー각😀👍½²_-", "▁", "<s>", "</s>", "<unk>", "<0x41>", "  ", "the ", " of"]


@pytest.fixture(scope="module")
def path():
    return P.path("piece_bpe_32k.model")


def test_parity_and_round_trip(path):
    rng = random.Random(8)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "  a  "]
    c, library = sp.coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert c.by_pieces
    for block in tb.blocks(pc.replace_substring(pa.array(texts), sp.MARK, " ")):
        ids, cut = c.encode_block(block)
        decoded = c.decode_block(ids, cut)
        for i in range(len(block)):
            text, own = texts[block.first + i], ids[cut[i] : cut[i + 1]].tolist()
            assert own == library.encode(text), text
            assert decoded[i] == text.replace(sp.MARK, " ") == library.decode(own)
    assert not c.differing


def test_differences_are_told(spark, path, monkeypatch):
    c = sp.Coder(path)
    own = c.library

    class Other:
        def encode(self, texts, **more):
            out = own.encode(texts, **more)
            return [[7] if t == "odd" else ids for t, ids in zip(texts, out, strict=True)] if isinstance(texts, list) else out

        def __getattr__(self, name):
            return getattr(own, name)

    c.library = Other()
    block = next(tb.blocks(pa.array(["odd one", "one", "", "an odd", "oddly"])))
    c.encode_block(block)
    assert c.pieces_agree(block).tolist() == [False, True, True, False, True]


def test_rows(spark, path):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = sp.encoded(clashing(df), path, whole_one_in=1).collect()
    assert len(got) == len(odd_rows()) and all(r["parity"] for r in got)
    assert sorted(r["decoded"] for r in got) == sorted(r[1] or "" for r in odd_rows())
    assert sp.encoded(df.limit(0), path).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def test_unigram_models_are_rebuilt():
    pieces = [("<unk>", 0.0, sp.UNKNOWN), ("▁", -3.0, sp.NORMAL), ("▁ab", -1.0, sp.NORMAL), ("a", -4.0, sp.NORMAL), ("b", -4.0, sp.NORMAL), ("c", -2.5, sp.NORMAL), ("bc", -2.0, sp.NORMAL)]
    data = message(*((1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces), (2, message((3, sp.UNIGRAM), (40, 0))), (3, message((3, 1), (4, 1))))
    model = sp.Model.parse(data)
    assert [p for p, _, _ in model.pieces] == [p for p, _, _ in pieces] and model.kind == sp.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    t = sp.tokenizer(model)
    for text in ("ab", " ab  abc ", "cab bc", "abcabc"):
        ids = t.encode(text, add_special_tokens=False).ids
        assert t.decode(ids) == " ".join(text.split())
        assert ids == library.encode(text)
    with pytest.raises(ValueError, match="kind"):
        sp.tokenizer(sp.Model(pieces=[("<unk>", 0.0, sp.UNKNOWN)], kind=4))


def test_query_compares_every_row(spark, tmp_path):
    from tarnwerk.llm import queries

    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(odd_rows()) and all(r["parity"] is True for r in got)


def test_markers_of_a_text_are_compared_as_they_stand(spark, path):
    texts = [f"a{sp.MARK}b", sp.MARK, f"{sp.MARK}{sp.MARK}x {sp.MARK}", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sp.encoded(df, path, whole_one_in=1 << 30).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t) and got[i]["parity"] is True


def test_whole_texts_that_differ_are_told(path):
    texts = [f"text {i} of some words" for i in range(40)] + ["", None]
    c = sp.Coder(path, compare_cuts=False)
    own = c.library

    class Other:
        def encode(self, texts, **more):
            return [[7] if t.startswith("text 3 ") else ids for t, ids in zip(texts, own.encode(texts, **more), strict=True)]

        def decode(self, ids, **more):
            return ["?" if t.startswith("text 5 ") else t for t in own.decode(ids, **more)]

        def __getattr__(self, name):
            return getattr(own, name)

    c.library = Other()
    block = next(tb.blocks(pa.array(texts)))
    ids, cut = c.encode_block(block)
    agree = c.texts_agree([t or "" for t in texts], ids, cut, c.decode_block(ids, cut))
    assert np.flatnonzero(~agree).tolist() == [3, 5] and len(agree) == len(texts)


def test_query_asks_the_library_for_every_whole_text(spark, path):
    calls = []
    own = sp.Coder(path, compare_cuts=False)
    agree = own.texts_agree

    def counted(texts, *more):
        calls.extend(texts)
        return agree(texts, *more)

    class Docs:
        """Runs the operator's batches here."""

        columns = ["doc_id", "text"]

        def __getitem__(self, name):
            return spark.range(1).selectExpr("id as doc_id", "'' as text")[name]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]))

    texts = [f"words of {i}" for i in range(200)] + [None, ""]
    own.texts_agree = counted
    sp._coders[path, False] = own
    try:
        out = sp.encoded(Docs(), path)
    finally:
        del sp._coders[path, False]
    assert calls == [t or "" for t in texts]
    assert all(p is True for b in out for p in b.column(3).to_pylist())


def test_empty_texts_among_others(path):
    c, library = sp.coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    some = ["", " ", "a", " a ", "a  ", "  b", None]
    for texts in ([a, b, d] for a in some for b in some for d in some):
        (block,) = tb.blocks(pa.array(texts, pa.string()))
        ids, cut = c.encode_block(block)
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [library.encode(t or "") for t in texts], texts
        assert c.decode_block(ids, cut) == [t or "" for t in texts]


def test_no_index_for_each_byte(path):
    import tracemalloc

    c = sp.Coder(path, compare_cuts=False)
    (block,) = tb.blocks(pa.array(["internationalization of administrative responsibilities "] * 4000))
    ids, cut = c.encode_block(block)
    c.decode_block(ids, cut)
    for work in (lambda: sp._prefixed(block), lambda: c.decode_block(ids, cut)):
        tracemalloc.start()
        try:
            work()
            assert tracemalloc.get_traced_memory()[1] < 8 * len(block.data)
        finally:
            tracemalloc.stop()
