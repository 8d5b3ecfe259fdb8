"""Documents packed into sequences by best fit and a swap-based local search.

Documents become pieces of token ids; only those longer than a sequence are cut.  Pieces of full
length are sequences already.  The others are dealt out to groups of bounded size, and each group
is packed on its own: best fit in decreasing order, then a local search between underfull bins.
Every exchange moves one piece, or swaps one or two pieces of an emptier bin for one smaller piece
of a fuller one, so that the sum of squared fills grows, until bins run empty.  The emptiest bins
of ``FAN_IN`` groups then meet in a next group, which packs their pieces again, up to one last
group; each round works on a small part of the round before.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import in_small_batches, stored, text_of
from goldseam.llm.tokens import crc32_of, encoder

CAPACITY = 2048
SEPARATOR_ID = 0
GROUP = 16_384  # pieces of a group, on average
FAN_IN = 8
STEP = 256  # documents encoded at a time

PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator_id: int = SEPARATOR_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and their ``ids``.

    A document's ids end with ``separator_id``.  The last pieces have full length, so the first
    may be shorter.  ``ids`` are little-endian, two bytes each where the vocabulary allows it.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        end = tokens.one(separator_id)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = {name: [] for name in ("row", "piece", "start", "length", "crc", "ids")}
                for row, said in enumerate(batch.column("text").slice(at, STEP)):
                    ids = np.frombuffer(tokens.encode(said.as_py()) + end, tokens.dtype)
                    first = len(ids) % capacity or capacity
                    starts = [0, *range(first, len(ids), capacity)]
                    for number, start in enumerate(starts):
                        part = ids[start : starts[number + 1] if number + 1 < len(starts) else None]
                        out["row"].append(at + row)
                        out["piece"].append(number)
                        out["start"].append(start)
                        out["length"].append(len(part))
                        out["crc"].append(crc32_of(part))
                        if keep_ids:
                            out["ids"].append(part.tobytes())
                columns = [
                    batch.column("doc_id").take(pa.array(out["row"])),
                    pa.array(out["piece"], pa.int32()),
                    *(pa.array(out[name], pa.int64()) for name in ("start", "length", "crc")),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(out["ids"], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    spaces: list[int] = []  # free spaces that occur, ascending
    for i in order:
        need = lengths[i]
        at = bisect.bisect_left(spaces, need)
        if at == len(spaces):
            number, left = len(bins), capacity
            bins.append([])
        else:
            left = spaces[at]
            number = room[left].pop()
            if not room[left]:
                spaces.pop(at)
        bins[number].append(i)
        left -= need
        if left:
            if not room[left]:
                bisect.insort(spaces, left)
            room[left].append(number)
    return bins


class Exchange:
    """The state of the local search: the pieces of every bin and, by bin, what is free."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = np.array(lengths, np.int64), capacity
        self.bin_of = np.zeros(len(lengths), np.int64)
        for number, members in enumerate(bins):
            self.bin_of[members] = number
        self.bins = [set(members) for members in bins]
        self.free = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int64)

    def _move(self, piece: int, target: int) -> None:
        source, length = int(self.bin_of[piece]), int(self.lengths[piece])
        self.bins[source].remove(piece)
        self.bins[target].add(piece)
        self.bin_of[piece] = target
        self.free[source] += length
        self.free[target] -= length

    def _given(self, held: list[int]) -> list[tuple[int, tuple[int, ...]]]:
        """Groups of one or two pieces, by total length: one of every total, single pieces first."""
        alike: dict[int, list[int]] = {}
        for piece in held:
            some = alike.setdefault(int(self.lengths[piece]), [])
            if len(some) < 2:
                some.append(piece)
        groups = {length: (some[0],) for length, some in alike.items()}
        lengths = list(alike)
        for k, a in enumerate(lengths):
            if len(alike[a]) > 1:
                groups.setdefault(2 * a, (alike[a][0], alike[a][1]))
            for b in lengths[k + 1 :]:
                groups.setdefault(a + b, (alike[a][0], alike[b][0]))
        return list(groups.items())

    def improve(self, source: int) -> bool:
        """The exchange that gives most of a bin's load to a fuller bin; false if there is none."""
        held = sorted(self.bins[source], key=lambda i: -self.lengths[i])
        if not held:
            return False
        fill = self.capacity - int(self.free[source])
        fuller = (self.free > 0) & (self.free <= self.free[source]) & (self.free < self.capacity)
        fuller[source] = False
        most = int(self.free[fuller].max(initial=0))
        for piece in held:  # move: into the fullest bin that takes it
            if self.lengths[piece] <= most:
                fits = np.where(fuller & (self.free >= self.lengths[piece]), self.free, 1 << 40)
                self._move(piece, int(fits.argmin()))
                return True
        # Swap one or two pieces for one: the gain is what the fuller bin gets more.  Pieces of equal
        # length are alike, so one group for each choice of lengths is enough.
        others = np.flatnonzero(fuller[self.bin_of])
        free, lengths = self.free[self.bin_of[others]], self.lengths[others]
        limit = np.minimum(free, fill)
        best, chosen = 0, None
        for given, group in self._given(held):
            gain = given - lengths
            gain = np.where((gain > 0) & (gain <= limit), gain, 0)
            if len(gain) and gain[at := int(gain.argmax())] > best:
                best, chosen = int(gain[at]), (group, int(others[at]))
        if chosen is None:
            return False
        group, piece = chosen
        target = int(self.bin_of[piece])
        self._move(piece, source)
        for i in group:
            self._move(i, target)
        return True

    def run(self) -> list[list[int]]:
        """Exchange until the bins are as few as their load allows, or no exchange is left."""
        load = int(self.lengths.sum())
        least = -(-load // self.capacity)
        used = int((self.free < self.capacity).sum())
        stuck = np.zeros(len(self.bins), bool)
        while used > least:
            open_ = np.where(stuck | (self.free == self.capacity) | (self.free == 0), -1, self.free)
            source = int(open_.argmax())
            if open_[source] < 0:
                break
            if not self.improve(source):
                stuck[source] = True
                continue
            stuck[:] = False  # the exchange may have made others possible
            used -= int(self.free[source] == self.capacity)
        return [sorted(b) for b in self.bins if b]


def packed_bins(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers; every piece is in one of them."""
    return Exchange(best_fit(lengths, capacity), lengths, capacity).run()


def _fill(level: int, last: bool, capacity: int, share: float):
    """Packs one group; the emptiest bins, up to a share of its pieces, go on to the next level."""

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].tolist()
        bins = packed_bins(lengths, capacity)
        fills = [sum(lengths[i] for i in members) for members in bins]
        onward: set[int] = set()
        left = 0 if last else len(lengths) * share
        for number in sorted(range(len(bins)), key=fills.__getitem__):
            left -= len(bins[number])
            if fills[number] == capacity or left < 0:
                break
            onward.add(number)
        sequence, offset, goes = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i] = (level << 56) + (int(key[0]) << 24) + number
                offset[i], goes[i] = at, number in onward
                at += lengths[i]
        return pdf.assign(sequence_id=sequence, offset=offset, goes=goes)

    return fill


def pack(
    rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN
) -> DataFrame:
    """Places for pieces (``uid`` long, ``length`` long): uid, sequence_id, offset."""
    places = ("uid", "sequence_id", "offset")
    full = F.col("length") >= capacity
    placed = rows.where(full).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    open_ = rows.where(~full).select("uid", "length")
    groups = max(1, -(-open_.count() // group))
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    schema = "uid long, length long, part int, sequence_id long, offset long, goes boolean"
    level = 0
    while True:
        fill = _fill(level, groups == 1, capacity, 1 / fan_in)
        filled = stored(open_.groupBy("part").applyInPandas(fill, schema), "bins")
        placed = placed.unionByName(filled.where("NOT goes").select(*places))
        if groups == 1:
            return placed
        groups, level = -(-groups // fan_in), level + 1
        part = F.floor(F.col("part") / fan_in).cast("int").alias("part")
        open_ = filled.where("goes").select("uid", "length", part)


def packed(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator_id: int = SEPARATOR_ID,
    keep_ids: bool = True,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: what ``pieces`` has, its sequence_id and its offset there.

    Null texts count as empty and are a piece of one id, the separator; empty ones too.  Repeated
    rows, also with the same or a null doc_id, are packed as separate documents.  Offsets of a
    sequence are gapless from 0.  An empty table gives no rows.  Other columns are not read.
    """
    cut = stored(
        pieces(docs, vocabulary, doc_id, text, capacity, separator_id, keep_ids).withColumn(
            "uid", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    return cut.join(pack(cut, capacity, group), "uid").drop("uid")
