"""Sets of word shingles as sorted 64-bit hashes, made for many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_CHARS = 250_000  # characters hashed at a time; each takes about 35 bytes

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_draw = np.random.default_rng(20_11)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_PLACE = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    values = np.full(n, base, np.uint64)
    values[:1] = 1
    return np.cumprod(values)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a buffer that ends with white space."""
    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.cumsum(_BYTE[codes] * _powers(_BASE, len(codes)))
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    values = (sums[ends - 1] - before) * _powers(_INVERSE, len(codes))[starts]
    return starts, _mixed(values + (ends - starts).astype(np.uint64))


def _combined(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """One hash of ``width`` neighbouring words from each start on."""
    values = np.full(len(starts), np.uint64(width), np.uint64)
    for at in range(width):
        values += hashes[starts + at] * _PLACE[8 * width + at if width < WORDS else at]
    return _mixed(values)


def _some_sets(texts: list[str]) -> list[np.ndarray]:
    given = [text.encode("utf-8", "replace").translate(_LOWER) for text in texts]
    offsets = np.cumsum([0, *(len(d) + 1 for d in given)])
    places, hashes = _word_hashes(b"\n".join(given) + b"\n")
    bounds = np.searchsorted(places, offsets)
    found = []
    last = max(0, len(hashes) - WORDS + 1)
    whole = _combined(hashes, np.arange(last), WORDS)
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = end - first
        if n >= WORDS:
            found.append(np.unique(whole[first : end - WORDS + 1]))
        elif n:
            found.append(_combined(hashes, np.array([first]), n))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each text.

    Words are ASCII-lower-cased and stand between ASCII white space.  With fewer than ``WORDS``
    words the whole text is one shingle, without words there is none.
    """
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= _CHARS or at == len(texts) - 1:
            with np.errstate(over="ignore"):
                yield from _some_sets(texts[start : at + 1])
            start, size = at + 1, 0


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def band_keys(hashes: np.ndarray, turns: int, bands: int, rows: int) -> np.ndarray:
    """Keys of bands of min-hashes; sets agree in a band the likelier, the more similar they are.

    One permutation serves all bands of a turn: a shingle belongs to one of ``bands * rows`` bins,
    and the smallest of a bin is its min-hash.
    """
    bins = bands * rows
    keys = []
    with np.errstate(over="ignore"):
        weights = _powers(_BASE, rows)
        for turn in range(turns):
            spread = _mixed(hashes + _PLACE[turn])
            least = np.full(bins, np.iinfo(np.uint64).max)
            np.minimum.at(least, (spread % np.uint64(bins)).astype(np.int64), spread)
            sums = (_mixed(least).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)
            keys.append(_mixed(sums))
    return np.concatenate(keys)
