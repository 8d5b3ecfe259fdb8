"""Scores of texts by a hidden Markov language model, and by a unigram model as a base.

Word counts are taken over all training texts.  The ``FREQUENT`` commonest words are symbols of
their own; any other word, known or not, belongs to one of ``RARE`` symbols by its hash, and counts
divide a symbol's probability among its words.  So what is broadcast has a fixed size, and the
counts of all other words are joined to the texts that hold them.  Hidden states are trained by
Baum-Welch: every task runs the forward-backward recursion over its texts and sends expected counts
of starts, transitions and emissions, which are added up across tasks.  A score is the exact
likelihood of the whole text by the scaled forward recursion.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import in_crc32_fold, stored, text_of

FOLDS, HELD_OUT = 7, 2
STATES = 4
ROUNDS = 3
FREQUENT = 20_000
RARE = 64
SEGMENT = 256  # training reads texts in segments of so many tokens; scoring reads them whole
SMOOTHING = 0.01  # expected emissions that every state has of every symbol
SEED = 7

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b""  # the end of a text, which no word equals
_CHARS = 1_000_000  # characters cut into words at a time
_CELLS = 400_000  # tokens, with padding, that a recursion handles at a time
_COUNTED = 300_000  # distinct words after which a task sends its counts
_REMEMBERED = 300_000  # words whose symbols a task keeps


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def _slices(texts: list[str]) -> Iterator[range]:
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= _CHARS or at == len(texts) - 1:
            yield range(start, at + 1)
            start, size = at + 1, 0


def word_counts(texts: DataFrame) -> DataFrame:
    """Count of every word of a ``text`` column, and of the end under the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "n"],
            )
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                seen.update(words_of(text.as_py()))
                seen[_END] += 1
                if len(seen) > _COUNTED:
                    yield send()
        yield send()

    return (
        texts.select("text")
        .mapInArrow(count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


class _Symbols(dict):
    """The symbol of a word: 0 the end, then frequent words, then the classes of rare ones."""

    def __init__(self, frequent: list[bytes], rare: int):
        super().__init__({word: 1 + at for at, word in enumerate(frequent)})
        self[_END] = 0
        self._first, self._rare = 1 + len(frequent), rare

    def __missing__(self, word: bytes) -> int:
        symbol = self._first + zlib.crc32(word) % self._rare
        if len(self) < _REMEMBERED:
            self[word] = symbol
        return symbol


@dataclass
class Vocabulary:
    """The frequent words with their counts, and the totals; its size has a fixed bound."""

    frequent: list[bytes]
    counts: np.ndarray  # by symbol: the end, then the frequent words
    rare_mass: np.ndarray  # by class: sum of (count + 1) over its words, and 1 for any other word
    tokens: int
    distinct: int

    def __len__(self) -> int:
        return len(self.counts) + len(self.rare_mass)

    def symbols(self) -> _Symbols:
        return _Symbols(self.frequent, len(self.rare_mass))

    @property
    def dtype(self) -> np.dtype:
        """The type in which sequences of symbols are stored."""
        return np.dtype("<u2" if len(self) <= 1 << 16 else "<i4")


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, rare: int = RARE) -> Vocabulary:
    sums = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    words = counts.where(F.length("word") > 0)
    top = words.orderBy(F.desc("n"), "word").limit(frequent).collect()
    mass = np.ones(rare)
    classes = words.groupBy((F.crc32("word") % rare).alias("k")).agg(F.sum(F.col("n") + 1).alias("m"))
    for row in classes.collect():  # a row per class
        mass[row["k"]] += row["m"]
    known = [bytes(row["word"]) for row in top]
    for row in top:
        mass[zlib.crc32(bytes(row["word"])) % rare] -= row["n"] + 1
    own = np.array([sums[2] or 0, *(row["n"] for row in top)], np.float64)
    return Vocabulary(known, own, mass, sums[0] or 0, sums[1])


@dataclass
class Model:
    """Probabilities: of the first state, of state after state, of symbols in a state; and of the
    state in the middle of a text, with which a segment that is not a text's first begins."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state
    middle: np.ndarray


def first_model(words: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
    """Sticky states, whose symbols are those of all texts with random weights."""
    draw = np.random.default_rng(seed)
    share = np.concatenate([words.counts + SMOOTHING, words.rare_mass])
    emit = share[:, None] * draw.uniform(0.5, 1.5, (len(words), states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, move, emit / emit.sum(axis=0), even)


def _padded(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences side by side, longest first: their numbers, the symbols by step, the lengths."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        some = order[at : at + max(1, _CELLS // max(1, longest))]
        at += len(some)
        lengths = np.array([len(sequences[i]) for i in some])
        symbols = np.zeros((longest, len(some)), np.int32)
        for column, i in enumerate(some):
            symbols[: lengths[column], column] = sequences[i]
        yield some, symbols, lengths


def log10_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """The exact log10 probability of each sequence of symbols, by the scaled forward recursion."""
    found = np.zeros(len(sequences))
    for some, symbols, lengths in _padded(sequences):
        total = np.zeros(len(some))
        active = np.searchsorted(-lengths, -np.arange(len(symbols)), side="left")
        state = np.tile(model.start, (len(some), 1))
        for step, n in enumerate(active):
            state = state[:n] * model.emit[symbols[step, :n]]
            scale = state @ np.ones(state.shape[1])
            total[:n] += np.log10(scale)
            state = (state / scale[:, None]) @ model.move
        found[some] = total
    return found


def expected_counts(
    sequences: list[np.ndarray], first: np.ndarray, model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (symbol by state) over sequences; ``first`` tells which
    of them begin a text."""
    states, size = model.move.shape[0], len(model.emit)
    starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
    for some, symbols, lengths in _padded(sequences):
        steps, n = symbols.shape
        begins = first[some]
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        alpha = np.zeros((steps, n, states))
        scales = np.ones((steps, n))
        state = np.where(begins[:, None], model.start, model.middle)
        for step in range(steps):
            k = active[step]
            state = state[:k] * model.emit[symbols[step, :k]]
            scale = state @ np.ones(states)
            state /= scale[:, None]
            alpha[step, :k], scales[step, :k] = state, scale
            state = state @ model.move
        beta = np.ones((n, states))
        gamma = alpha  # becomes the state's probability, from the last step on
        for step in range(steps - 1, -1, -1):
            k = active[step]
            if step + 1 < steps and (m := active[step + 1]):
                ahead = model.emit[symbols[step + 1, :m]] * beta[:m] / scales[step + 1, :m, None]
                moves += model.move * (alpha[step, :m].T @ ahead)
                beta[:m] = ahead @ model.move.T
            gamma[step, :k] = alpha[step, :k] * beta[:k]
        starts += gamma[0][begins].sum(axis=0)
        inside = np.arange(steps)[:, None] < lengths[None, :]
        seen = symbols[inside]
        for s in range(states):
            emissions[:, s] += np.bincount(seen, weights=gamma[:, :, s][inside], minlength=size)
    return starts, moves, emissions


def _segments(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence[at : at + SEGMENT] for at in range(0, len(sequence), SEGMENT)]


def _stored_sequences(batch: pa.RecordBatch, dtype: np.dtype) -> Iterator[list[np.ndarray]]:
    """The sequences of a batch, some at a time."""
    some, size = [], 0
    for value in batch.column("symbols"):
        some.append(np.frombuffer(value.as_buffer(), dtype))
        size += len(some[-1])
        if size >= _CELLS:
            yield some
            some, size = [], 0
    if some:
        yield some


def baum_welch(sequences: DataFrame, words: Vocabulary, model: Model) -> Model:
    """One round of training over a ``symbols`` column; counts are added up across the tasks."""
    states, size, dtype = model.move.shape[0], len(words), words.dtype

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states))]
        for batch in batches:
            for some in _stored_sequences(batch, dtype):
                pieces, first = [], []
                for sequence in some:
                    own = _segments(sequence)
                    pieces += own
                    first += [k == 0 for k in range(len(own))]
                more = expected_counts(pieces, np.array(first, bool), model)
                sums = [a + b for a, b in zip(sums, more, strict=True)]
        flat = np.concatenate([x.reshape(-1) for x in sums])
        places = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), pa.array(flat[places])], names=["place", "expected"]
        )

    sums = (
        sequences.select("symbols")
        .mapInArrow(expect, "place long, expected double")
        .groupBy("place")
        .agg(F.sum("expected").alias("expected"))
        .toArrow()  # at most one row per parameter of the model
    )
    flat = np.zeros(states + states * states + size * states)
    flat[sums.column("place").to_numpy()] = sums.column("expected").to_numpy()
    starts, moves, emissions = np.split(flat, [states, states + states * states])
    emissions = emissions.reshape(size, states) + SMOOTHING
    moves = moves.reshape(states, states) + SMOOTHING
    occupied = emissions.sum(axis=0)
    return Model(
        (starts + SMOOTHING) / (starts + SMOOTHING).sum(),
        moves / moves.sum(axis=1, keepdims=True),
        emissions / occupied,
        occupied / occupied.sum(),
    )


_READ = (
    "row long, doc_id {id}, held_out boolean, n_tokens long, known long, base double, rare double"
)
_OTHERS = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))


def read_texts(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """Each text as its sequence of ``symbols``; what frequent words give to the scores; and its
    other words with how often they occur (``others``)."""
    share, mass = np.log10(words.counts + 1), np.log10(words.rare_mass)
    rare_from, dtype = len(words.counts), words.dtype

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = words.symbols()
        for batch in batches:
            given = batch.column("text").to_pylist()
            for part in _slices(given):
                out = [[] for _ in range(6)]
                for at in part:
                    said = words_of(given[at])
                    sequence = np.array([*map(symbols.__getitem__, said), 0], dtype)
                    rare = sequence >= rare_from
                    own = sequence[~rare]
                    others = Counter([said[k] for k in np.flatnonzero(rare).tolist()])
                    values = (
                        len(sequence),
                        int((words.counts[own] > 0).sum()),
                        float(share[own].sum()),
                        float(mass[sequence[rare].astype(np.int64) - rare_from].sum()),
                        sequence.tobytes(),
                        [{"word": w, "times": n} for w, n in others.items()],
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), _OTHERS)
                rows = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(name) for name in ("row", "doc_id", "held_out")),
                        *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare",
                           "symbols", "others"],
                )

    schema = _READ.format(id=rows.schema["doc_id"].dataType.simpleString())
    return rows.mapInArrow(
        read, schema + ", symbols binary, others array<struct<word: binary, times: long>>"
    )


def _scored(read: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """The texts with ``forward``, the log10 likelihood of their symbols, in place of these."""
    columns, dtype = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare"], words.dtype

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [log10_likelihoods(some, model) for some in _stored_sequences(batch, dtype)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(np.concatenate([np.zeros(0), *found]))],
                names=[*columns, "forward"],
            )

    schema = _READ.format(id=read.schema["doc_id"].dataType.simpleString())
    return read.select(*columns, "symbols").mapInArrow(score, schema + ", forward double")


def lm_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    states: int = STATES,
    rounds: int = ROUNDS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(doc_id as text) does not leave ``held_out`` modulo
    ``folds``; a null doc_id is never held out.  Tokens are ASCII-lower-cased words between ASCII
    white space, and one end.  ``score`` is the model's log10 probability of the text, the end
    included; ``base_score`` that of the add-one unigram model.  Null texts count as empty and have
    the end alone.  Repeated rows are trained on and scored as separate texts.  An empty table
    gives no rows; without training texts every word is unknown.  Other columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        in_crc32_fold(doc_id, folds, held_out).alias("held_out"),
        text_of(text).alias("text"),
    )
    counts = stored(word_counts(rows.where("NOT held_out")), "words")
    words = vocabulary(counts, frequent)
    read = stored(read_texts(rows, words), "read")
    model = first_model(words, states)
    for _ in range(rounds if words.tokens else 0):
        model = baum_welch(read.where("NOT held_out"), words, model)
    others = read.select("row", F.inline("others")).join(counts, "word")
    more = others.groupBy("row").agg(
        F.sum("times").alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"),
    )
    more_score = F.coalesce("more", F.lit(0.0))
    each = float(np.log10(words.tokens + words.distinct + 1))
    return _scored(read, words, model).join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more_score - F.col("n_tokens") * each).alias("base_score"),
        (F.col("forward") - F.col("rare") + more_score).alias("score"),
    )
