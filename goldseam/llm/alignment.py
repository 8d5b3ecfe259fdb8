"""Tokens of two tokenizers aligned by the bytes they stand for.

Texts are encoded by a byte-level BPE (A) and by a piece vocabulary with byte fallback (B), both
with one blank before the text.  The tokens of many texts make two tables of places, and two
``merge_asof``, keyed by document, find for every token start the token of the other side that
covers it.  Both directions together are all overlaps; where starts meet, the tokens before end
together, and a new group begins.  All tokens A and B of a group are linked.

How often ids are linked is counted over the corpus by documents; the counts go back to the
documents in blocks of a bounded size, so that neither links nor documents are shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import stored, text_of
from goldseam.llm.tokens import byte_letters, encoder

BATCH_TOKENS = 100_000  # tokens of a side aligned at a time
KEPT_PIECES = 250_000  # pieces B that a Python process keeps with their ids, some 40 MB
BATCH_TEXTS = 20_000
GROUP_LINKS = 1 << 20  # links of a group from which on ids are made distinct before pairing
BLOCK_PAIRS = 2_000_000  # pairs of ids that a task holds with their counts, some 40 MB
BITS = 20  # of an id in a pair of ids

FOUND = (
    "n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups string, "
    "pairs array<long>, links array<long>"
)


class PieceEncoder:
    """Ids by a sentencepiece vocabulary, with those of pieces between blanks kept.

    No piece of such a vocabulary holds a blank behind another character, so no piece reaches over
    the place before a blank that follows another character, and texts may be cut there.  If a
    vocabulary has such pieces, or changes texts before it cuts them, texts are encoded whole.
    """

    def __init__(self, path: str, cache_pieces: int = KEPT_PIECES):
        from sentencepiece import SentencePieceProcessor

        self._library = library = SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(len(library))]
        plain = b"identity" in library.serialized_model_proto()[-4096:]
        self._cuts = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self._known = _Pieces(self, cache_pieces)

    def whole(self, text: str) -> np.ndarray:
        """The ids that the library gives a text, with a blank before it."""
        return np.array(self._library.encode(text), self.dtype)

    def said(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of a text with a blank before it; None if they stand for other bytes."""
        if self._cuts:
            parts = text.split(" ")
            if "" in parts:
                parts = _with_blanks(parts)
            ids = np.frombuffer(b"".join(map(self._known.__getitem__, parts)), self.dtype)
            if not self._known.odd:
                return ids
            self._known.odd = False
        ids = self.whole(text)
        return ids if self.said(ids) == (" " + text).encode("utf-8", "surrogatepass") else None


class _Pieces(dict):
    """Ids by piece; ``odd`` tells that a piece came up whose ids stand for other bytes."""

    def __init__(self, library: PieceEncoder, limit: int):
        super().__init__()
        self._library, self._limit, self.odd = library, limit, False

    def __missing__(self, piece: str) -> bytes:
        ids = self._library.whole(piece)
        if self._library.said(ids) != (" " + piece).encode("utf-8", "surrogatepass"):
            self.odd = True
            return b""
        found = ids.tobytes()
        if len(self) < self._limit:
            self[piece] = found
        return found


def _with_blanks(parts: list[str]) -> list[str]:
    """Parts between single blanks as pieces that hold further blanks before them, the last behind."""
    pieces, blanks = [], 0
    for part in parts:
        if part:
            pieces.append(" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    if not pieces:
        return [" " * (blanks - 1)]
    pieces[-1] += " " * blanks
    return pieces


class Tokenizers:
    """Both sides: ids of a text, the bytes of every id, and how groups are written down."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        self._a, self._b = encoder(path_a), PieceEncoder(path_b)
        letters = byte_letters()
        byte_of = {chr(letters.get(byte, byte)): byte for byte in range(256)}
        library = Tokenizer.from_file(path_a)
        names = {i: name for name, i in library.get_vocab().items()}
        self._lossless = library.normalizer is None and set(byte_of) <= set(names.values())
        self.size_a, self.size_b = max(names) + 1, len(self._b.bytes)
        if max(self.size_a, self.size_b) > 1 << BITS:
            raise ValueError(f"more than {1 << BITS} ids")
        self._bytes_a = [
            bytes(byte_of.get(c, 0) for c in names.get(i, "")) for i in range(self.size_a)
        ]
        self.lengths_a = np.array([len(b) for b in self._bytes_a])
        self.lengths_b = np.array([len(b) for b in self._b.bytes])
        self.marks = [
            b"%d%b" % (i, mark)
            for size, marks in ((self.size_a, b",|"), (self.size_b, b",;"))
            for mark in (marks[:1], marks[1:])
            for i in range(size)
        ]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none if either doesn't stand for the text's own bytes."""
        none = np.zeros(0, np.int64)
        b = self._b.encode(text) if text else None
        if b is None:
            return none, none
        a = np.frombuffer(self._a.encode(" " + text), self._a.dtype)
        # A vocabulary with all bytes changes none; any other is held against the text.
        if not self._lossless and b"".join(map(self._bytes_a.__getitem__, a.tolist())) != (
            " " + text
        ).encode("utf-8", "surrogatepass"):
            return none, none
        return a.astype(np.int64), b.astype(np.int64)


_made: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers of this Python process, whose caches serve all its tasks."""
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Tokenizers(path_a, path_b)
    return _made[path_a, path_b]


class Part:
    """Tokens of a text, or of a part of it that ends where tokens of both sides do."""

    def __init__(self, text: int, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.text, self.a, self.b, self.ends_a, self.ends_b = text, a, b, ends_a, ends_b


def parts_of(text: int, a: np.ndarray, b: np.ndarray, both: Tokenizers, limit: int) -> Iterator[Part]:
    """The tokens of a text in parts of about ``limit`` tokens A; no group is cut."""
    ends_a, ends_b = np.cumsum(both.lengths_a[a]), np.cumsum(both.lengths_b[b])
    at_a = at_b = base = 0
    while at_a < len(a):
        size, to_a, to_b = limit, len(a), len(b)
        while at_a + size < len(a):
            most = int(np.searchsorted(ends_b, ends_a[at_a + size - 1], "right"))
            common = np.intersect1d(ends_a[at_a : at_a + size], ends_b[at_b:most])
            if len(common):
                to_a, to_b = (int(np.searchsorted(e, common[-1])) + 1 for e in (ends_a, ends_b))
                break
            size *= 2
        yield Part(text, a[at_a:to_a], b[at_b:to_b], ends_a[at_a:to_a] - base, ends_b[at_b:to_b] - base)
        at_a, at_b, base = to_a, to_b, int(ends_a[to_a - 1])


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """For every token start of one table the token of the other that covers it, in both directions.

    Tables (doc, at, token) are sorted by ``at``, the place of the start in all texts together.
    """
    on_a = pd.merge_asof(
        a, b.assign(other_at=b["at"]), on="at", by="doc", suffixes=("", "_other")
    )
    on_b = pd.merge_asof(
        b, a.assign(other_at=a["at"]), on="at", by="doc", suffixes=("", "_other")
    )
    return on_a, on_b


class Aligned:
    """What the alignment of some parts gives, with groups numbered over all of them."""

    def __init__(self, parts: list[Part]):
        bases = np.cumsum([0, *(int(p.ends_a[-1]) for p in parts)])[:-1].tolist()
        self.a, self.b = (np.concatenate([getattr(p, side) for p in parts]) for side in "ab")
        self.doc_a = np.repeat(np.arange(len(parts)), [len(p.a) for p in parts])
        self.doc_b = np.repeat(np.arange(len(parts)), [len(p.b) for p in parts])
        starts_a = np.concatenate(
            [base + np.concatenate([[0], p.ends_a[:-1]]) for p, base in zip(parts, bases, strict=True)]
        )
        starts_b = np.concatenate(
            [base + np.concatenate([[0], p.ends_b[:-1]]) for p, base in zip(parts, bases, strict=True)]
        )
        on_a, on_b = overlaps(
            pd.DataFrame({"doc": self.doc_a, "at": starts_a, "token": np.arange(len(self.a))}),
            pd.DataFrame({"doc": self.doc_b, "at": starts_b, "token": np.arange(len(self.b))}),
        )
        meet_a = on_a["at"].to_numpy() == on_a["other_at"].to_numpy()
        meet_b = on_b["at"].to_numpy() == on_b["other_at"].to_numpy()
        # An overlap is found from the later start; where starts meet, from both.
        n = len(parts)
        self.n_overlaps = np.bincount(self.doc_a, minlength=n) + np.bincount(self.doc_b[~meet_b], minlength=n)
        self.group_a, self.group_b = np.cumsum(meet_a) - 1, np.cumsum(meet_b) - 1
        self.size_a, self.size_b = np.bincount(self.group_a), np.bincount(self.group_b)
        self.first_a = np.cumsum(self.size_a) - self.size_a
        self.first_b = np.cumsum(self.size_b) - self.size_b
        self.doc = self.doc_a[self.first_a]  # of a group
        self.n = n

    def written(self, both: Tokenizers) -> list[bytes]:
        """The groups of every part: ids A, a bar, ids B, and a semicolon behind each group."""
        marks = np.empty(len(self.a) + len(self.b), np.int64)
        last_a = np.arange(len(self.a)) == (self.first_a + self.size_a - 1)[self.group_a]
        last_b = np.arange(len(self.b)) == (self.first_b + self.size_b - 1)[self.group_b]
        places_a = np.arange(len(self.a)) + self.first_b[self.group_a]
        places_b = np.arange(len(self.b)) + (self.first_a + self.size_a)[self.group_b]
        marks[places_a] = self.a + last_a * both.size_a
        marks[places_b] = 2 * both.size_a + self.b + last_b * both.size_b
        sizes = np.bincount(self.doc_a, minlength=self.n) + np.bincount(self.doc_b, minlength=self.n)
        ends = np.cumsum(sizes)
        get = both.marks.__getitem__
        return [
            b"".join(map(get, marks[a:b].tolist()))
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)
        ]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(part, pair of ids, links): distinct within each result, sorted by part."""
        links = self.size_a * self.size_b
        large = links >= GROUP_LINKS
        some = np.flatnonzero(~large[self.group_a])  # tokens A of the other groups
        at = 0
        ends = np.cumsum(self.size_b[self.group_a[some]])
        while at < len(some):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + 4 * GROUP_LINKS)))
            mine = some[at:to]
            groups = self.group_a[mine]
            sizes = self.size_b[groups]
            first = self.first_b[groups] - np.cumsum(sizes) + sizes
            b = self.b[np.repeat(first, sizes) + np.arange(sizes.sum())]
            keys = self.doc_a[mine] << (2 * BITS) | self.a[mine] << BITS
            keys, counts = np.unique(np.repeat(keys, sizes) | b, return_counts=True)
            yield keys >> (2 * BITS), keys & ((1 << 2 * BITS) - 1), counts
            at = to
        for group in np.flatnonzero(large).tolist():
            a, n_a = np.unique(self._members("a", group), return_counts=True)
            b, n_b = np.unique(self._members("b", group), return_counts=True)
            step = max(1, GROUP_LINKS // len(b))
            for at in range(0, len(a), step):
                pairs = (a[at : at + step, None] << BITS | b).ravel()
                yield np.full(len(pairs), self.doc[group]), pairs, (n_a[at : at + step, None] * n_b).ravel()

    def _members(self, side: str, group: int) -> np.ndarray:
        first = int(getattr(self, f"first_{side}")[group])
        return getattr(self, side)[first : first + int(getattr(self, f"size_{side}")[group])]


class Batch:
    """Texts aligned together; a long one part by part."""

    def __init__(self, both: Tokenizers, limit: int = BATCH_TOKENS):
        self._both, self._limit = both, limit
        self._parts: list[Part] = []
        self._counts: list[np.ndarray] = []
        self._written: list[list[bytes]] = []
        self._pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = self.tokens = 0

    def add(self, text: str) -> None:
        a, b = self._both.encode(text)
        number = len(self._counts)
        self._counts.append(np.array([len(a), len(b), 0, 0, 0]))
        self._written.append([])
        self.tokens += len(a)
        for part in parts_of(number, a, b, self._both, self._limit):
            self._parts.append(part)
            self._waiting += len(part.a)
            if self._waiting >= self._limit:
                self._align()

    def _align(self) -> None:
        if not self._parts:
            return
        found = Aligned(self._parts)
        texts = np.array([p.text for p in self._parts])
        links = np.zeros(found.n, np.int64)
        np.add.at(links, found.doc, found.size_a * found.size_b)
        sums = np.stack([np.bincount(found.doc, minlength=found.n), found.n_overlaps, links], 1)
        for text, written, more in zip(texts.tolist(), found.written(self._both), sums, strict=True):
            self._written[text].append(written)
            self._counts[text][2:] += more
        self._pairs += [(texts[part], pairs, counts) for part, pairs, counts in found.pairs()]
        self._parts, self._waiting = [], 0

    def results(self) -> list[pa.Array]:
        """The columns of FOUND."""
        self._align()
        columns = [pa.array(column, pa.int64()) for column in np.stack(self._counts, 1)]
        written = [b"".join(parts)[:-1] for parts in self._written]
        if self._pairs:
            text, pairs, links = (np.concatenate(c) for c in zip(*self._pairs, strict=True))
            keys, of = np.unique(text << (2 * BITS) | pairs, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, of, links)
            text, pairs = keys >> (2 * BITS), keys & ((1 << 2 * BITS) - 1)
        else:
            text = pairs = total = np.zeros(0, np.int64)
        offsets = np.searchsorted(text, np.arange(len(written) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (pairs, total)]
        return [*columns, pa.array(written, pa.binary()).cast(pa.string()), *lists]


def alignments(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    doc_id: str = "doc_id",
    text: str = "text",
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups, pairs, links.

    ``path_a`` is a byte-level BPE of the tokenizers library, ``path_b`` a sentencepiece model.
    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``; ``n_overlaps`` counts pairs of tokens that
    share a byte, ``n_links`` all pairs of tokens of one group.  ``pairs`` are the distinct pairs of
    linked ids, ``a << 20 | b`` in ascending order, and ``links`` how many links each has.

    Tokens have no more than 2**20 ids.  Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros, an empty
    ``groups`` and no pairs.  Texts are read whole, however long; repeated rows give repeated rows,
    an empty table none.  Other columns are not read.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        batch, ids, kind = Batch(both, batch_tokens), [], None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *batch.results()], names=["doc_id", *names])

        for given in batches:
            kind = given.column("doc_id").type
            for i, said in zip(given.column("doc_id"), given.column("text"), strict=True):
                ids.append(i.as_py())
                batch.add(said.as_py())
                if batch.tokens >= batch_tokens or len(ids) >= BATCH_TEXTS:
                    yield made()
                    batch, ids = Batch(both, batch_tokens), []
        if ids:
            yield made()

    names = [column.split()[0] for column in FOUND.split(", ")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(align, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def with_digests(found: DataFrame) -> DataFrame:
    """``alignments`` with the digest of the groups, empty where there are none, in their place."""
    digest = F.sha2(F.col("groups").cast("binary"), 256)
    said = F.when(F.col("n_a") > 0, digest).otherwise(F.lit(""))
    return found.withColumn("groups_sha256", said).drop("groups")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair of ids linked; best if none of its id A has more."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", BITS))  # as many rows as there are ids B, at most
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _add(rows: DataFrame, block: pa.Table) -> DataFrame:
    """n_best and count_sum of every row, with what a block of pairs adds to them."""
    order = np.argsort(block["pair"].to_numpy())
    pairs, n = block["pair"].to_numpy()[order], block["n"].to_numpy()[order]
    best = block["best"].to_numpy()[order].astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            mine = lists.flatten().to_numpy()
            links = batch.column("links").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
            links = np.where(pairs[at] == mine, links, 0) if len(pairs) else links * 0
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            changed = {}
            for name, values in (("n_best", best), ("count_sum", n)):
                sums = np.concatenate([[0], np.cumsum(links * values[at] if len(pairs) else links)])
                old = batch.column(name).to_numpy()
                changed[name] = pa.array(old + sums[ends[1:]] - sums[ends[:-1]], pa.int64())
            columns = [changed.get(name, batch.column(name)) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(add, rows.schema)


def with_counts(aligned: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``alignments``, stored before, with n_best and count_sum instead of pairs and links.

    ``count_sum`` adds up, over all links of a document, how many documents of the table hold the
    ids linked; ``n_best`` counts the links whose ids are linked in as many documents as any other
    pair with the same id A.  Repeated rows count as documents of their own.
    """
    counts = pair_counts(aligned)
    counts = stored(counts, "pairs")
    blocks = max(1, -(-counts.count() // block_pairs))
    zero = F.lit(0).cast("long")
    rows = aligned.withColumns({"n_best": zero, "count_sum": zero})
    for block in range(blocks):
        mine = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block)
        rows = _add(rows, mine.toArrow())
        if block < blocks - 1:
            rows = stored(rows, "counts")
    return rows.drop("pairs", "links")
