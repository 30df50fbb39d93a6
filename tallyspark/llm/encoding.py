"""Token ids by the ``tokenizers`` library, with pieces of text encoded once per worker.

The vocabularies used here split text in front of white space, and behind the
letters of a word where a mark follows, before they merge, so a text's
ids are the ids of its pieces one after another. Texts are cut as bytes, and
each piece of a batch is looked up once, however often it stands there. Most
pieces repeat; each worker keeps the ids of those it has met. New words are
encoded as one text, in which names of ids show where each ends; other new
pieces are held apart by a special token. Both cost far less than one call each. A
vocabulary that makes no difference between capitals and small letters, or
between white space, gets them folded first, so that fewer pieces are new. A
reserved token that stands in a text has its own id, as in the library's
default; it is neither cut nor folded, and pieces that hold one go through
``direct``, which encodes without any of this.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tallyspark.llm.common import KEPT

#: White space in ASCII, and in the sense of Unicode, the class \\s of the vocabularies' patterns.
BLANKS = "\t\n\x0b\x0c\r "
WHITE = BLANKS + "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that both patterns end a word after, when an ASCII mark follows.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: What both patterns take as one word, of ids that do not depend on its neighbours if they are such words as well.
WORD = re.compile(f" [{LETTERS}]+")
#: The space in names of byte-level vocabularies.
SPACE = "\u0120"
#: New words encoded as one text, and other pieces.
WORDS_AT_ONCE = 256
PIECES_AT_ONCE = 4096
#: Pieces of a generation, of so many characters. A worker keeps two: a full one becomes the older, whose pieces are
#: taken over when they are met again, and the older before it goes. About 160 bytes a piece.
KEPT_PIECES = 400_000
KEPT_CHARS = 12_000_000
#: Kinds of bytes: ASCII white space, letters, capitals too, and marks; bytes of other characters. Digits have none.
_BLANK, _LETTER, _MARK, _CAPITAL, _HIGH = 1, 2, 4, 8, 16


def _kind(sign: str) -> int:
    if not sign.isascii():
        return _HIGH
    if sign.isalpha():
        return _LETTER | _CAPITAL * sign.isupper()
    return _BLANK if sign in BLANKS else _MARK * (not sign.isdigit())


_KINDS = bytes(_kind(chr(byte)) for byte in range(256))
_SPACED = bytes(32 if kind == _BLANK else byte for byte, kind in enumerate(_KINDS))
#: The last three bytes of other white space, as one number; two where it has two.
_WIDE = [int.from_bytes(c.encode()) for c in map(chr, range(128, 0x3001)) if re.match(f"[{WHITE}]", c)]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file by name; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary(name)
        self.plain = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.plain.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = max(special) if special else (None, None)
        self.reserved = [text.lower() for _, text in special]
        self.whole = [text.encode().lower() for _, text in special]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.folds = self._folds()
        # a word has one id of a name that ends it, or else one that begins with its space
        suffix, names = getattr(self.plain.model, "end_of_word_suffix", None), self.plain.get_vocab()
        self.closing = bool(suffix)
        self.borders = np.zeros(1 + max(names.values()), bool)
        self.borders[[i for x, i in names.items() if (x.endswith(suffix) if suffix else x[:1] == SPACE)]] = True

    def direct(self, texts: list[str]) -> list[bytes]:
        found = self.plain.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _folds(self) -> bool:
        """Whether capitals count as small letters and any white space as a space."""
        signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        apart = [sign + blank for sign in signs for blank in "\t\n\x0b\x0c\r "]
        one, other = self.direct(["".join(apart), " ".join(x[0] for x in apart).lower() + " "])
        return one == other

    def _cut(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Where pieces start in texts that start at ``starts``, and the texts, folded if the vocabulary does."""
        signs, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KINDS), np.uint8)
        kind, before = kinds[1:], kinds[:-1].copy()
        high = np.flatnonzero((before == _HIGH) & (kind & (_BLANK | _MARK) != 0))
        # no character of another length ends in the bytes of white space or of a letter of two bytes
        ends = signs[np.maximum(high[:, None] - [2, 1, 0], 0)].astype(np.int64) @ [1 << 16, 1 << 8, 1]
        white = np.isin(ends, _WIDE) | np.isin(ends & 0xFFFF, _WIDE)
        letter = (ends >> 8 & 255 == 0xC3) & (ends & 255 != 0x97) & (ends & 255 != 0xB7)
        before[high] = white * _BLANK + letter * _LETTER
        cut = np.ones(len(signs), bool)
        cut[1:] = (kind & ~before & _BLANK | kind & before << 1 & _MARK) != 0
        folded = None
        if self.folds:
            low = (kinds & _CAPITAL) << 2
            # a mark that follows may join a capital or its small letter, not always both
            low[:-1][kind == _HIGH] = 0
            folded = np.frombuffer(data.translate(_SPACED), np.uint8) | low
        small = data.lower()
        for text in self.whole:
            found = small.find(text)
            while found >= 0:
                end = found + len(text)
                cut[found + 1 : end] = False
                if folded is not None:
                    folded[found:end] = signs[found:end]
                found = small.find(text, found + 1)
        cut[starts] = True
        return np.flatnonzero(cut), data if folded is None else folded.tobytes()

    def _learn(self, pieces: list[str]) -> None:
        every = "\0".join(pieces).lower()
        reserved = [r for r in self.reserved if r in every]
        odd = [p for p in pieces if any(r in p.lower() for r in reserved)] if reserved else []
        self.chars += sum(map(len, pieces))
        if odd or self.mark is None:
            apart = set(odd) if self.mark is not None else set(pieces)
            self.kept.update(zip(apart, self.direct(list(apart)), strict=True))
            pieces = [p for p in pieces if p not in apart]
        words, others = [], []
        for piece in pieces:
            (words if WORD.fullmatch(piece) else others).append(piece)
        for first in range(0, len(words), WORDS_AT_ONCE):
            part = words[first : first + WORDS_AT_ONCE]
            found = self.plain.encode_batch_fast(["".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.borders[ids]) + self.closing
            ends = ends if self.closing else np.append(ends[1:], len(ids))
            if len(ends) == len(part):
                self._keep(part, ids, ends, 0)
            else:
                others += part
        for first in range(0, len(others), PIECES_AT_ONCE):
            part = others[first : first + PIECES_AT_ONCE]
            joined = self.mark.join(part) + self.mark
            found = self.plain.encode_batch_fast([joined], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            self._keep(part, ids, np.flatnonzero(ids == self.mark_id), 1)

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray, skipped: int) -> None:
        packed, start = ids.tobytes(), 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            self.kept[piece] = packed[4 * start : 4 * end]
            start = end + skipped

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT_PIECES or self.chars > KEPT_CHARS:
            self.older, self.kept, self.chars = self.kept, {}, 0
        coded = [text.encode() for text in texts]
        bounds = np.cumsum([0, *map(len, coded)])
        data = b"".join(coded)
        if not data:
            return [b""] * len(texts)
        starts, data = self._cut(data, bounds[:-1][bounds[:-1] < bounds[1:]])
        buffers = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        cut = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
        pieces = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        kept, older = self.kept, self.older
        found = list(map(kept.get, pieces))
        new = [piece for piece, ids in zip(pieces, found, strict=True) if ids is None]
        if older and new:
            again = [piece for piece in new if piece in older]
            kept.update((piece, older[piece]) for piece in again)
            self.chars += sum(map(len, again))
            new = [piece for piece in new if piece not in kept]
        if new:
            self._learn(new)
        packed = np.empty(len(pieces), object)
        packed[:] = [kept[piece] if ids is None else ids for piece, ids in zip(pieces, found, strict=True)]
        row = packed[cut.indices.to_numpy()].tolist()
        ends = np.searchsorted(starts, bounds).tolist()
        return [b"".join(row[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary, loaded when first asked for."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
