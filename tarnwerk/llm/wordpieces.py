"""An encoder for word-wise BPE files of the tokenizers library.

The file's pre-tokenizer is: letters, single digits, runs of other signs, and a few English
contractions, after NFC and lower-casing; white space only separates. Pieces of ASCII and of Latin
letters up to U+017F are cut here by arrays of byte classes and given to the library's model as
they are; every other white-space-separated piece goes through the library's whole pipeline, and so
does one with the string of an added token, which the library takes for that token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from . import textbatch as tb
from .wordcache import PieceEncoder, Spans

SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
_plain = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_encoders: dict[str, PieceEncoder] = {}


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = SIGN
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = LETTER
    out[ord("'")] = OTHER  # may start a contraction
    return out


def cut(block: tb.Block, added: tuple[bytes, ...] = ()) -> Spans:
    """Spans of pre-tokens; a piece with a byte of class OTHER or one of the ``added`` strings is one span."""
    data = block.data
    kind = _classes()[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & (data[1:] >= 0x80) & (data[1:] < 0xC0))
    first, second = data[lead], data[lead + 1]
    good = lead[~(((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0)))]
    kind[good] = LETTER
    kind[good + 1] = LETTER
    for token in added:
        at = np.flatnonzero(data[: max(0, len(data) - len(token) + 1)] == token[0])
        for k, byte in enumerate(token):
            at = at[data[at + k] == byte]
        kind[at] = OTHER
    if (kind == OTHER).any():
        piece = np.cumsum(kind == SPACE)
        odd = np.zeros(int(piece[-1]) + 1, bool)
        odd[piece[kind == OTHER]] = True
        kind[odd[piece] & (kind != SPACE)] = OTHER
    begins = np.empty(len(kind), bool)
    begins[0] = True
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(begins)
    to = np.append(at[1:], len(kind))
    real = kind[at] != SPACE
    starts, ends = at[real], to[real]
    return starts, ends, np.searchsorted(block.starts, starts, side="right") - 1


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_encoder(path: str) -> Callable[[], PieceEncoder]:
    """A factory for tasks: one encoder, with its cache, for each worker and file."""

    def make() -> PieceEncoder:
        if path not in _encoders:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            model, letters = t.model, _byte_letters()
            added = tuple(x.content.encode() for x in t.get_added_tokens_decoder().values())
            if any(len(x.split()) != 1 or x != x.strip() for x in added):
                raise ValueError("an added token holds white space")

            def encode(pieces: list[bytes]) -> list[list[int]]:
                out, odd = [], []
                for i, piece in enumerate(pieces):
                    if any(x in piece for x in added):
                        odd.append(i)
                        out.append([])
                    elif piece.isalpha():
                        out.append([x.id for x in model.tokenize(piece.lower().decode())])
                    elif _plain.fullmatch(piece):
                        out.append([x.id for x in model.tokenize(piece.decode().lower().encode().decode("latin-1").translate(letters))])
                    else:
                        odd.append(i)
                        out.append([])
                for i, e in zip(odd, t.encode_batch_fast([pieces[i].decode() for i in odd], add_special_tokens=False), strict=True):
                    out[i] = e.ids
                return out

            _encoders[path] = PieceEncoder(lambda block: cut(block, added), encode)
        return _encoders[path]

    return make
