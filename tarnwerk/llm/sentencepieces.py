"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; normaliser, white-space marker, merges or unigram scores, and
byte fallback are rebuilt as a tokenizers pipeline, which encodes and decodes in multithreaded batches.
Where no piece of the vocabulary crosses a place at which the marker follows another sign, texts are cut
there, and a batch holds each distinct cut once; other models get whole texts. What the pipeline says is
compared with the sentencepiece library on every whole text, ids and decoding; where a caller has whole
texts compared by a checksum only, every distinct cut is compared as well.
"""

from __future__ import annotations

import operator
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textbatch as tb
from .wordcache import CACHE_PIECES, ENCODE_BYTES, PieceEncoder, Spans
from .workspace import whole

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_coders: dict[tuple[str, bool], Coder] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; 32- and 64-bit values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((text, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 40:
                        out.unk_id = v
                    elif n == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n == 3:
                        out.dummy_prefix = bool(v)
                    elif n == 4:
                        out.squeeze_spaces = bool(v)
        return out


def tokenizer(model: Model):
    """The tokenizers pipeline of a model of kind unigram or BPE."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = model.pieces[model.unk_id][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        usable = {p: s for p, s, k in model.pieces if k in (NORMAL, USER_DEFINED)}
        merges = []
        for piece, score in usable.items():
            for i in range(1, len(piece)):
                if piece[:i] in usable and piece[i:] in usable:
                    merges.append((-score, vocab[piece], i, piece[:i], piece[i:]))
        core = models.BPE(vocab, [(a, b) for _, _, _, a, b in sorted(merges)], unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} can't be rebuilt")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Coder:
    """Encodes and decodes with one model file, on ``threads`` threads. Distinct cuts are compared with the
    library unless ``compare_cuts`` is false."""

    def __init__(self, path: str, threads: int = 2, compare_cuts: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.whole = tokenizer(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.compare_cuts = compare_cuts
        plain = not (self.model.charsmap or self.model.squeeze_spaces) and self.model.dummy_prefix
        crossing = any(MARK in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER_DEFINED))
        #: Texts may be cut before markers.
        self.by_pieces = plain and not crossing and self.model.kind == BPE and not any(k == USER_DEFINED for _, _, k in self.model.pieces)
        self.pieces = PieceEncoder(self._cut, self._encode_pieces)
        #: Cuts on which the sentencepiece library differs; none is known.
        self.differing: set[bytes] = set()
        self._texts: dict[bytes, bytes] = {}
        self._leads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self._tails = np.array([p.endswith(MARK) for p, _, _ in self.model.pieces])

    def _encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of cuts, which begin with the space that becomes their marker; a text gets that one as its
        prefix, and the empty text gets none."""
        texts = [p[1:].decode() for p in pieces]
        out = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        for i, text in enumerate(texts):
            if not text:
                out[i] = [t.id for t in self.whole.model.tokenize(MARK)]
        if self.compare_cuts:
            theirs = self.library.encode(texts, num_threads=self.threads)
            for i, text in enumerate(texts):
                if out[i] != (theirs[i] if text else [self.library.piece_to_id(MARK)]):
                    self.differing.add(pieces[i])
        return out

    @staticmethod
    def _cut(block: tb.Block) -> Spans:
        """Spans of pieces in a block that has a space before each text: spaces and what follows."""
        space = block.data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[block.ends] = False
        begins[block.starts[block.ends > block.starts]] = True
        starts = np.flatnonzero(begins)
        text = np.searchsorted(block.starts, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(block.data)), block.ends[text])
        return starts, ends, text

    def encode_block(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block's texts; the empty text has no ids."""
        if self.by_pieces:
            return self.pieces.block(_prefixed(block))
        raw = block.data.tobytes()
        found = self.whole.encode_batch_fast([raw[a:b].decode() for a, b in zip(block.starts, block.ends, strict=True)], add_special_tokens=False)
        ids = [e.ids for e in found]
        return np.array([i for x in ids for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def decode_block(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of ids[offsets[i]:offsets[i + 1]]. Where texts may be cut, so may ids: before a marker that no
        marker precedes; each distinct cut is decoded once."""
        starts, ends = offsets[:-1], offsets[1:]
        filled = np.flatnonzero(ends > starts)
        if not self.by_pieces or not self._leads[ids[starts[filled]]].all():
            return self.decode([ids[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        if not len(filled):
            return [""] * len(starts)
        first = self._leads[ids]
        first[1:] &= ~self._tails[ids[:-1]]
        first[starts[filled]] = True
        at = np.flatnonzero(first)
        cuts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(ids)) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, np.uint32))])
        coded = pc.dictionary_encode(cuts)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._texts
        new = [x for x in distinct if x not in known]
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = distinct
        # a cut's marker is the prefix that decoding takes away
        for x, text in zip(new, self.decode([array("I", x).tolist() for x in new]), strict=True):
            known[x] = b" " + text.encode()
        got = pa.array([known[x] for x in distinct], pa.large_binary()).take(coded.indices)
        data = got.buffers()[2].to_pybytes()
        bounds = np.frombuffer(got.buffers()[1], np.int64)[np.searchsorted(at, offsets)]
        return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def texts_agree(self, texts: list[str], ids: np.ndarray, offsets: np.ndarray, decoded: list[str]) -> np.ndarray:
        """Which whole texts have the library's ids ``ids[offsets[i]:offsets[i + 1]]``, and its decoding of these."""
        own = [ids[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out = np.fromiter(map(operator.eq, own, self.library.encode(texts, num_threads=self.threads)), bool, len(own))
        filled = [i for i, x in enumerate(own) if x]
        theirs = [""] * len(own)
        for i, text in zip(filled, self.library.decode([own[i] for i in filled], num_threads=self.threads) if filled else [], strict=True):
            theirs[i] = text
        return out & np.fromiter(map(operator.eq, decoded, theirs), bool, len(own))

    def pieces_agree(self, block: tb.Block) -> np.ndarray:
        """Which texts of an encoded block have no cut on which the libraries differ."""
        out = np.ones(len(block), bool)
        if self.differing:
            block = _prefixed(block)
            starts, ends, text = self._cut(block)
            raw = block.data.tobytes()
            for a, b, i in zip(starts.tolist(), ends.tolist(), text.tolist(), strict=True):
                out[i] &= raw[a:b] not in self.differing
        return out


def _prefixed(block: tb.Block) -> tb.Block:
    """The block with a space before each text that has any bytes: the separator of the text before."""
    data = np.empty(len(block.data) + 1, np.uint8)
    data[0], data[1:] = tb.SEPARATOR, block.data
    return tb.Block(block.first, data, block.starts, block.ends + (block.ends > block.starts))


def coder(path: str, compare_cuts: bool = True) -> Coder:
    """One coder, with its cache, for each worker and model file."""
    if (path, compare_cuts) not in _coders:
        _coders[path, compare_cuts] = Coder(path, compare_cuts=compare_cuts)
    return _coders[path, compare_cuts]


def encoded(docs: DataFrame, path: str, whole_one_in: int = 1) -> DataFrame:
    """The ids of every row's whole text, and what they decode to.

    Returns doc_id, ids array<int>, decoded string, parity boolean. Null and empty texts have no ids and
    decode to the empty text. ``parity`` says of every text whether the sentencepiece library has the same
    ids for the whole text and decodes them to the same. With ``whole_one_in`` above 1, whole texts are compared
    only if they hold a marker of their own, can't be cut, or are one of so many by a checksum, and of the others
    the ids of each cut. Rows without an id and repeated rows come back like any other; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, whole_one_in > 1)
        for batch in batches:
            # a marker in a text is what a space becomes
            texts = pc.replace_substring(batch.column(1), MARK, " ") if c.by_pieces else batch.column(1)
            for block in tb.blocks(texts, ENCODE_BYTES):
                ids, cut = c.encode_block(block)
                decoded = c.decode_block(ids, cut)
                given = pc.fill_null(batch.column(1).slice(block.first, len(block)), "")
                if whole_one_in == 1 or not c.by_pieces:
                    parity = c.texts_agree(given.to_pylist(), ids, cut, decoded)
                else:
                    raw = block.data.tobytes()
                    marked = pc.match_substring(given, MARK).to_numpy(zero_copy_only=False)
                    parity = c.pieces_agree(block)
                    some = [zlib.crc32(raw[a:b]) % whole_one_in == 0 for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True)]
                    for i in np.flatnonzero(marked | np.array(some, bool)).tolist():
                        parity[i] &= c.texts_agree([given[i].as_py()], ids[cut[i] : cut[i + 1]], np.array([0, cut[i + 1] - cut[i]]), [decoded[i]])[0]
                arrays = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), arrays, pa.array(decoded, pa.string()), pa.array(parity, pa.bool_())], names=["doc_id", "ids", "decoded", "parity"])

    return docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string, parity boolean")
