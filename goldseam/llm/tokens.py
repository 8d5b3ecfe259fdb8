"""Token ids of texts by a byte-level BPE of the tokenizers library, with a word cache.

The tokenizer splits a text before it merges bytes, and always splits before a single blank
between two characters that are no white space.  Texts are therefore cut there, and each distinct
piece is encoded by the library once as long as the cache holds it.  The ids are the library's.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np

#: Pieces a Python process keeps, about 100 MB; any further piece is encoded each time it comes.
CACHE_PIECES = 500_000

_CUT = re.compile(r"(?<=\S)(?= \S)")
_STOPS = frozenset(".,;:!?")


def vocabulary_path() -> str:
    """The public byte-level BPE that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary_path() -> str:
    """The public piece vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _WhiteSpace(Exception):
    """A piece that begins or ends with white space can't be encoded on its own."""


class _Pieces(dict):
    """Ids by piece, filled by the library as pieces are asked for.

    A piece stands without the blank before it; \\0 marks one that has none.  Words, a stop after
    a word and single line ends are encoded on their own, as the tokenizer splits there too: words
    by its model, all else by the whole tokenizer.
    """

    def __init__(self, library, code: str, limit: int):
        super().__init__()
        self._library, self._code, self._limit = library, code, limit
        self._word = library.model.tokenize
        self["\0\n"] = self.whole("\0\n")

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            word = "\u0120" + (piece if piece.isascii() else _as_bytes(piece))
            ids = [token.id for token in self._word(word)]
        elif piece[:-1].isalpha() and piece[-1] in _STOPS:
            found = self[piece[:-1]] + self["\0" + piece[-1]]
            if len(self) < self._limit:
                self[piece] = found
            return found
        elif piece[:1] == "\0" and piece[1:].isalpha():
            ids = [token.id for token in self._word(_as_bytes(piece[1:]))]
        else:
            return self._parted(piece)
        found = array(self._code, ids).tobytes()
        if len(self) < self._limit:
            self[piece] = found
        return found

    def whole(self, piece: str) -> bytes:
        """The ids of a piece as the library gives them."""
        text = piece[1:] if piece[:1] == "\0" else " " + piece
        return array(self._code, self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _parted(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _WhiteSpace
        lines = piece.split("\n")
        if len(lines) > 1 and all(line.split() == [line] for line in lines):
            first, *rest = lines
            found = self[first] + b"".join([self["\0\n"] + self["\0" + line] for line in rest])
        elif piece[:1] == "\0" and piece[1:-1].isalpha() and piece[-1] in _STOPS:
            found = self[piece[:-1]] + self["\0" + piece[-1]]
        else:
            found = self.whole(piece)
        if len(self) < self._limit:
            self[piece] = found
        return found


class Encoder:
    """Encodes texts to little-endian ids of ``dtype``; strings of special tokens are plain text."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        wide = library.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self._code = "I" if wide else "H"
        self._pieces = _Pieces(library, self._code, cache_pieces)

    def one(self, number: int) -> bytes:
        """A single id as it stands in encoded texts."""
        return array(self._code, [number]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        known = self._pieces
        if "\0" in text:
            return known.whole("\0" + text)
        pieces = text.split(" ")
        pieces[0] = "\0" + pieces[0]
        try:
            return b"".join(map(known.__getitem__, pieces))
        except _WhiteSpace:  # a blank beside other white space: cut at single blanks only
            first, *rest = _CUT.split(text)
            return known.whole("\0" + first) + b"".join([known.whole(piece[1:]) for piece in rest])


def _as_bytes(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


def byte_letters() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (byte for byte in range(256) if byte not in plain)
    return {byte: 256 + at for at, byte in enumerate(rest)}


_LETTERS = byte_letters()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, whose cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc32_of(ids: np.ndarray, before: int = 0) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes(), before)
