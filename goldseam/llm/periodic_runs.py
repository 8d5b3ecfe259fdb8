"""Periodic runs of words in texts, found by block convolution.

A run of period q repeats what it begins with, so some aligned block of B words occurs again q
words on, if q >= 2B - 1.  At every dyadic scale B the aligned blocks are convolved with the words
that follow at the distances 2B - 1 to 4B - 2: an exact number-theoretic transform gives, modulo a
prime, the sum of squared differences between the numbers of the words at every distance at once.
It is 0 wherever the block occurs without a mismatch, and such a distance is the seed of a run:
the words are compared from there to both sides as far as they agree.  A sum that is 0 modulo the
prime only gives a seed that fails this comparison, so none is missed and none is made up.

A block is left out if some word of it doesn't come again soon enough, or if all it could find is a
run known from a smaller scale.  Many texts are worked on at a time, as one sequence in which texts
share no numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import text_of

LEAST = 12  # words of a run
GROUP_WORDS = 400_000  # words of texts worked on at a time; a longer text is a group of its own
POINTS = 1 << 18  # numbers transformed at a time, unless a single block needs more
BYTES = 1 << 20  # of a text, split into words at a time

# 15 * 2**27 + 1 is prime, and 31 generates its multiplicative group.
PRIME = 2013265921
GENERATOR = 31

FOUND = "n_words long, runs array<struct<start: long, period: long, length: long>>, collapsed string"
_RUNS = pa.list_(
    pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
)
_P = np.uint64(PRIME)
_NEVER = np.iinfo(np.int64).max


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``2 * half``."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(half, np.uint64)
    known = 1
    while known < half:
        step = np.uint64(pow(root, known, PRIME))
        powers[known : 2 * known] = powers[:known] * step % _P
        known *= 2
    return powers


def transform(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of every row, in bit-reversed order; lengths are powers of 2."""
    count, size = rows.shape
    values, half = rows.copy(), size // 2
    while half:
        pairs = values.reshape(count, -1, 2, half)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        sums = (left + right) % _P
        pairs[:, :, 1] = (left + (_P - right)) * _powers(half, False) % _P
        pairs[:, :, 0] = sums
        half //= 2
    return values


def inverse(rows: np.ndarray) -> np.ndarray:
    """What ``transform`` made, as it was before."""
    count, size = rows.shape
    values, half = rows.copy(), 1
    while half < size:
        pairs = values.reshape(count, -1, 2, half)
        left = pairs[:, :, 0].copy()
        right = pairs[:, :, 1] * _powers(half, True) % _P
        pairs[:, :, 0] = (left + right) % _P
        pairs[:, :, 1] = (left + (_P - right)) % _P
        half *= 2
    return values * np.uint64(pow(size, -1, PRIME)) % _P


def squared_differences(
    words: np.ndarray, blocks: np.ndarray, size: int, first: int, last: int
) -> np.ndarray:
    """Row per block, column per distance from ``first`` to ``last``: sums modulo the prime.

    ``words`` holds numbers below 2**32 and goes on for ``last + size`` words after the last block.
    """
    width = last - first + 1
    points = 1 << (width + size - 2).bit_length()
    block = words[blocks[:, None] + np.arange(size)].astype(np.uint64) % _P
    window = words[blocks[:, None] + np.arange(first, last + size)].astype(np.uint64) % _P
    left = np.zeros((len(blocks), points), np.uint64)
    right = left.copy()
    left[:, :size] = block[:, ::-1]
    right[:, : width + size - 1] = window
    # What wraps around falls before the place of the first distance.
    products = inverse(transform(left) * transform(right) % _P)[:, size - 1 : size - 1 + width]
    squares = np.zeros((len(blocks), width + size), np.uint64)
    squares[:, 1:] = np.cumsum(window * window % _P, axis=1)
    own = (block * block % _P).sum(axis=1, keepdims=True)
    there = squares[:, size:] - squares[:, :-size]
    return (own + there + (_P - products) * np.uint64(2)) % _P


class Texts:
    """Words of several texts as one sequence of numbers; every text has numbers of its own."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.n = words, len(words)
        self._ends = np.append(starts[1:], self.n)
        self._longest = int((self._ends - starts).max(initial=0))
        self._runs: dict[tuple[int, int], int] = {}
        # Of the known runs over a place, the one that reaches farthest.
        self._reach, self._period = np.zeros(self.n, np.int64), np.ones(self.n, np.int64)
        # How far on the same word comes again.
        self._gap = np.full(self.n, _NEVER)
        order = np.argsort(words, kind="stable")
        again = words[order[1:]] == words[order[:-1]]
        self._gap[order[:-1][again]] = (order[1:] - order[:-1])[again]

    def runs(self) -> list[tuple[int, int, int]]:
        """All runs as (start, period, length), sorted."""
        size, first = 2, 1
        gaps = self._gap[: self.n // 2 * 2].reshape(-1, 2).max(axis=1)
        while 2 * first <= self._longest:
            last = 4 * size - 2
            seeds = self._seeds(gaps, size, first, last)
            if len(seeds):
                self._extend(seeds)
            size, first = 2 * size, last + 1
            gaps = gaps[: len(gaps) // 2 * 2].reshape(-1, 2).max(axis=1)
        return sorted((start, q, end - start) for (start, end), q in self._runs.items())

    def _seeds(self, gaps: np.ndarray, size: int, first: int, last: int) -> np.ndarray:
        """(distance, block) wherever a block occurs again, sorted."""
        blocks = np.flatnonzero(gaps <= last) * size
        known = (self._reach[blocks] >= blocks + last + size) & (self._period[blocks] <= size)
        blocks = blocks[~known]
        step = max(1, POINTS // (4 * size))
        found = []
        for at in range(0, len(blocks), step):
            some = blocks[at : at + step]
            need = int(some[-1]) + last + size
            words = self.words
            if need > self.n:  # 0 is no word
                words = np.concatenate([words[some[0] :], np.zeros(need - self.n, words.dtype)])
                sums = squared_differences(words, some - some[0], size, first, last)
            else:
                sums = squared_differences(words, some, size, first, last)
            row, column = np.nonzero(sums == 0)
            found.append(np.stack([column + first, some[row]], 1))
        if not found:
            return np.zeros((0, 2), np.int64)
        seeds = np.concatenate(found)
        distance, block = seeds[:, 0], seeds[:, 1]
        known = (self._reach[block] >= block + distance + size) & (distance % self._period[block] == 0)
        seeds = seeds[~known]
        return seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]

    def _extend(self, seeds: np.ndarray) -> None:
        """Compare from each seed to both sides; keep what is long enough."""
        before, begin, end = 0, 0, 0
        for distance, block in seeds.tolist():
            if distance == before and begin <= block < end:
                continue
            before = distance
            begin, end = self._back(block, distance), self._on(block, distance)
            length = end - begin + distance
            if length >= LEAST and end - begin >= distance:
                key = (begin, begin + length)
                if key not in self._runs:  # a multiple of the smallest period comes after it
                    self._runs[key] = distance
                    part = slice(begin, begin + length)
                    farther = self._reach[part] < begin + length
                    self._reach[part][farther] = begin + length
                    self._period[part][farther] = distance

    def _on(self, at: int, distance: int) -> int:
        """The first place from ``at`` on whose word isn't the one at the distance."""
        words, stop, step = self.words, self.n - distance, 64
        while at < stop:
            end = min(at + step, stop)
            other = words[at:end] != words[at + distance : end + distance]
            if other.any():
                return at + int(other.argmax())
            at, step = end, 2 * step
        return at

    def _back(self, at: int, distance: int) -> int:
        """The first place of the agreeing words that end before ``at``."""
        words, step = self.words, 64
        while at > 0:
            begin = max(0, at - step)
            other = words[begin:at] != words[begin + distance : at + distance]
            if other.any():
                return at - int(other[::-1].argmax())
            at, step = begin, 2 * step
        return at


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words between ASCII white space, some at a time."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > BYTES:
            found = (data.find(space, at + BYTES) for space in (b" ", b"\n", b"\t"))
            end = min((f for f in found if f >= 0), default=end)
        yield data[at:end].split()
        at = end


class Group:
    """Texts that are worked on together."""

    def __init__(self):
        self._texts: list[tuple[bytes, list[bytes] | None]] = []
        self._numbers: list[np.ndarray] = []
        self._used = 1
        self.words = 0

    def add(self, data: bytes) -> None:
        known: dict[bytes, int] = {}
        number, base = known.setdefault, self._used
        numbers, lists, last = [], 0, None
        for last in _word_lists(data):
            lists += 1
            numbers.append(np.array([number(w, base + len(known)) for w in last], np.uint32))
        # The words of a long text are split again later instead of being kept.
        self._texts.append((data, None) if lists > 1 else (b"", last or []))
        self._numbers.append(np.concatenate(numbers) if numbers else np.zeros(0, np.uint32))
        self._used += len(known)
        self.words += len(self._numbers[-1])

    def results(self) -> Iterator[tuple[int, list[dict], bytes]]:
        """Of every text: its words, its runs, and the text without repetitions."""
        sizes = np.array([len(numbers) for numbers in self._numbers])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        runs = Texts(np.concatenate(self._numbers), starts).runs()
        owners = np.searchsorted(ends, [start for start, _, _ in runs], "right").tolist()
        of_text: dict[int, list[tuple[int, int, int]]] = {}
        for owner, (start, period, length) in zip(owners, runs, strict=True):
            of_text.setdefault(owner, []).append((start - int(starts[owner]), period, length))
        for at, (data, words) in enumerate(self._texts):
            mine = of_text.get(at, [])
            said = [{"start": a, "period": q, "length": n} for a, q, n in mine]
            lists = _word_lists(data) if words is None else [words]
            yield int(sizes[at]), said, _collapsed(lists, mine, int(sizes[at]))


def _collapsed(
    lists: Iterator[list[bytes]], runs: list[tuple[int, int, int]], n: int
) -> bytes:
    """The words that no run holds behind its first period, joined by blanks."""
    if not runs:
        return b" ".join([b" ".join(words) for words in lists if words])
    marks = np.zeros(n + 1, np.int64)
    for start, period, length in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    keep, at, parts = np.cumsum(marks)[:n] == 0, 0, []
    for words in lists:
        kept = [w for w, k in zip(words, keep[at : at + len(words)].tolist(), strict=True) if k]
        if kept:
            parts.append(b" ".join(kept))
        at += len(words)
    return b" ".join(parts)


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_words: int = GROUP_WORDS
) -> DataFrame:
    """One row per row of the input: doc_id, n_words, runs, collapsed.

    A run is a stretch of words, at least ``LEAST`` and twice its smallest period, that no
    neighbouring word extends with this period; ``runs`` has all of them as (start, period,
    length), sorted, start and the others counting words.  ``collapsed`` is the text without the
    words that some run holds behind its first period, joined by single blanks.

    Words stand between ASCII white space.  Null and empty texts have no words, no runs and an
    empty ``collapsed``; texts are read whole, however long; repeated rows give repeated rows, an
    empty table none.  Other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids = Group(), []
        kind = None

        def made() -> pa.RecordBatch:
            n_words, runs, texts = zip(*group.results(), strict=True)
            columns = [
                pa.array(ids, kind),
                pa.array(n_words, pa.int64()),
                pa.array(runs, _RUNS),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            kind = batch.column("doc_id").type
            texts = batch.column("text").cast(pa.binary())
            for i, data in zip(batch.column("doc_id"), texts, strict=True):
                ids.append(i.as_py())
                group.add(data.as_py())
                if group.words >= group_words:
                    yield made()
                    group, ids = Group(), []
        if ids:
            yield made()

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(
        find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}"
    )


# Of one document in ten, the words from a place on as repetitions of the first ones there.  The
# words are bound to a name first, so that the text is split once and not for each of its words.
_REPEATED = r"""
element_at(transform(
    transform(array(named_struct('words', regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0),
                                 'g', {hash} div 10)),
              s -> named_struct('words', s.words, 'g', s.g, 'a', pmod(s.g, nullif(size(s.words), 0)))),
    s -> array_join(transform(s.words, (w, i) -> IF(
            i < s.a, w,
            s.words[CAST(s.a + (i - s.a) % (1 + (size(s.words) - s.a) div (3 + s.g % 8)) AS int)])), ' ')
), 1)
"""


def with_repetitions(docs: DataFrame) -> DataFrame:
    """doc_id and text; documents whose crc32(doc_id) is a multiple of ten repeat some words.

    A null doc_id has no hash and its text stays, as an empty one does.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_of("text").alias("text"), hashed.alias("hash"))
    said = F.expr(_REPEATED.format(text="text", hash="hash"))
    return rows.select("doc_id", F.when(F.col("hash") % 10 == 0, said).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run, and digests of all runs and of the collapsed text."""
    longest = F.expr(
        "array_min(transform(runs, r -> named_struct('less', -r.length, 'start', r.start, "
        "'period', r.period)))"
    )
    lines = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"
    rows = found.select("*", longest.alias("top"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("-1000 * top.less div top.period").alias("exponent_milli"),
        F.sha2(F.expr(f"CAST(array_join({lines}, '') AS binary)"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
