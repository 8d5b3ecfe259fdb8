"""Benchmark passages in documents, found by suffix arrays over shards of the documents.

A task makes shards of its documents: the words that benchmark items use become numbers, every run
of such words that is long enough for a window goes in, and the shard's suffixes are sorted by
prefix doubling as far as an item is long.  Runs that hold a foreign word, or too few words, can't
be part of a window, so a shard holds every suffix that could match.  Every suffix of the items is
then searched by bisection, one word at a time and all suffixes at once; the words found before
the interval is empty are its longest verbatim match, and the interval at the width of a window
tells all places where the window occurs.

The benchmark goes to the tasks in blocks of a bounded number of words, one pass over the
documents for each; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import back, renamed, stored, text_of

WINDOW = 10
SHARD_WORDS = 1_000_000  # words of benchmark vocabulary in a shard
SHARD_DOCS = 20_000
BLOCK_WORDS = 500_000  # benchmark words that a task holds at a time, some 30 MB
PIECE_WORDS = 1_000  # longer benchmark texts are cut, with all but one word of a window repeated
BYTES = 1 << 20  # of a text, split into words at a time

# A-Z lower-cased; every other ASCII character but digits and letters stands between words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

FOUND = (
    "n_words long, n_hit long, hits array<struct<start: long, end: long>>, "
    "items array<string>, longest long, longest_at long"
)
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BYTES) if len(data) - at > BYTES else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Passages:
    """A block of the benchmark: numbered words and the suffixes that hold a whole window."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.items = sorted({item for item, _ in pieces})
        number = {item: at for at, item in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        ids, starts, left, widths, items = [], [], [], [], []
        for item, words in pieces:
            width = min(window, len(words))
            for at in range(len(words) - width + 1):
                starts.append(len(ids) + at)
                left.append(len(words) - at)
                widths.append(width)
                items.append(number[item])
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        self.ids = np.array([*ids, *[0] * window], np.int32)
        self.starts, self.left = np.array(starts, np.int64), np.array(left, np.int64)
        self.widths = np.array(widths, np.int64)
        self.least, self.longest = int(self.widths.min()), int(self.left.max())
        # Equal windows are one kind, whichever items they are from.
        at = np.arange(window)
        kinds = np.where(at < self.widths[:, None], self.ids[self.starts[:, None] + at], 0)
        self.kinds = np.unique(kinds, axis=0, return_inverse=True)[1].reshape(-1)
        pairs = np.unique(np.stack([self.kinds, np.array(items, np.int64)], 1), axis=0)
        self._of_kind, self._item = pairs[:, 0], pairs[:, 1]

    def items_of(self, kinds: np.ndarray) -> list[str]:
        """The items that have any of the windows."""
        first = np.searchsorted(self._of_kind, kinds)
        end = np.searchsorted(self._of_kind, kinds, "right")
        found = [self._item[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        return [self.items[i] for i in np.unique(np.concatenate(found)).tolist()] if found else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of what follows them, as far as ``depth`` words at least."""
    n = len(ids)
    rank = ids.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        keys = rank * (n + int(ids.max(initial=0)) + 2) + behind
        order = np.argsort(keys, kind="stable")
        steps = np.diff(keys[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        width *= 2
        if steps.all():
            break
    return order


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the given intervals, one interval after another."""
    sizes = hi - lo
    return np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Shard:
    """Runs of benchmark words of some documents, and their suffix array."""

    def __init__(self, runs: list[tuple[int, int, np.ndarray]], passages: Passages):
        self.passages = passages
        sizes = np.array([len(ids) + 1 for _, _, ids in runs])
        self._first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self._owner = np.array([owner for owner, _, _ in runs], np.int64)
        self._start = np.array([start for _, start, _ in runs], np.int64)
        gap = np.zeros(1, np.int32)
        self.ids = np.concatenate([part for _, _, ids in runs for part in (ids, gap)])
        self.order = suffix_array(self.ids, passages.longest)
        self._padded = np.concatenate([self.ids, np.zeros(passages.longest, np.int32)])

    def _bound(self, lo, hi, depth: int, words, right: bool) -> np.ndarray:
        """For each interval of equal beginnings, where words below (or up to) the given one end."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            seen = self._padded[self.order[mid] + depth]
            below = seen <= words[open_] if right else seen < words[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    def search(self) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """(width, kinds, lo, hi) of windows that occur, and the longest match at every suffix."""
        given, n = self.passages, len(self.ids)
        suffixes = np.arange(len(given.starts))
        lo, hi = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), n, np.int64)
        longest, windows = np.zeros(n, np.int64), []
        for depth in range(given.longest):
            going = given.left[suffixes] > depth
            suffixes, lo, hi = suffixes[going], lo[going], hi[going]
            words = given.ids[given.starts[suffixes] + depth]
            lo, hi = self._bound(lo, hi, depth, words, False), self._bound(lo, hi, depth, words, True)
            going = lo < hi
            suffixes, lo, hi = suffixes[going], lo[going], hi[going]
            if not len(suffixes):
                break
            whole = given.widths[suffixes] <= depth + 1
            first, one = np.unique(lo[whole], return_index=True)  # intervals are equal or apart
            longest[_ranges(first, hi[whole][one])] = depth + 1
            new = given.widths[suffixes] == depth + 1
            if new.any():
                kinds, one = np.unique(given.kinds[suffixes[new]], return_index=True)
                windows.append((depth + 1, kinds, lo[new][one], hi[new][one]))
        return windows, longest

    def matches(self) -> Iterator[tuple[int, str, tuple]]:
        """(owner, "hits" | "kinds" | "longest", value) for every document with a window."""
        windows, longest = self.search()
        marks, seen = np.zeros(len(self.ids) + 1, np.int64), []
        for width, kinds, lo, hi in windows:
            sizes = hi - lo
            places = self.order[_ranges(lo, hi)]  # windows of one width and different kinds share no place
            marks[places] += 1
            marks[places + width] -= 1
            run = np.searchsorted(self._first, places, "right") - 1
            seen.append(np.stack([self._owner[run], np.repeat(kinds, sizes)], 1))
        if not seen:
            return
        hit = np.diff(np.concatenate([[0], np.cumsum(marks) > 0, [0]]).astype(np.int8))
        starts, ends = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)
        run = np.searchsorted(self._first, starts, "right") - 1
        shift = self._start[run] - self._first[run]
        for owner, a, b in zip(
            self._owner[run].tolist(), (starts + shift).tolist(), (ends + shift).tolist(), strict=True
        ):
            yield owner, "hits", (a, b)
        pairs = np.unique(np.concatenate(seen), axis=0)
        owners, first = np.unique(pairs[:, 0], return_index=True)
        for owner, kinds in zip(owners.tolist(), np.split(pairs[:, 1], first[1:]), strict=True):
            yield owner, "kinds", kinds
        places = np.flatnonzero(longest)
        run = np.searchsorted(self._first, self.order[places], "right") - 1
        at = self.order[places] + self._start[run] - self._first[run]
        best = np.lexsort((at, -longest[places], self._owner[run]))
        owners, first = np.unique(self._owner[run][best], return_index=True)
        for owner, k in zip(owners.tolist(), best[first].tolist(), strict=True):
            yield owner, "longest", (-int(longest[places[k]]), int(at[k]))


class Finder:
    """Takes texts one after another and gives what was found of each, a shard at a time."""

    def __init__(self, passages: Passages, shard_words: int = SHARD_WORDS):
        self._passages, self._limit = passages, shard_words
        self._runs: list[tuple[int, int, np.ndarray]] = []
        self._words = 0
        self.texts: list[dict] = []

    def _add_run(self, owner: int, start: int, ids: np.ndarray) -> None:
        """A run in parts that fit a shard and share all but one word of the longest item."""
        shared = self._passages.longest - 1
        size = max(self._limit, 2 * shared + 1)
        for at in range(0, max(1, len(ids) - shared), size - shared):
            part = ids[at : at + size]
            if self._words and self._words + len(part) > size:
                self.search()
            self._runs.append((owner, start + at, part))
            self._words += len(part)

    def add(self, text: str) -> None:
        least, number = self._passages.least, self._passages.vocabulary.get
        owner, n = len(self.texts), 0
        self.texts.append({"n_words": 0, "hits": [], "kinds": [], "longest": []})
        rest = np.zeros(0, np.int32)  # the run that the words so far end with
        for words in word_lists(text):
            ids = np.concatenate([rest, np.array([number(w, 0) for w in words], np.int32)])
            begin, n = n - len(rest), n + len(words)
            edges = np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8))
            starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
            rest = np.zeros(0, np.int32)
            if len(ends) and ends[-1] == len(ids):
                rest, starts, ends = ids[starts[-1] :], starts[:-1], ends[:-1]
            long = ends - starts >= least
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                self._add_run(owner, begin + a, ids[a:b])
        if len(rest) >= least:
            self._add_run(owner, n - len(rest), rest)
        self.texts[owner]["n_words"] = n

    def search(self) -> None:
        if self._runs:
            for owner, what, value in Shard(self._runs, self._passages).matches():
                self.texts[owner][what].append(value)
            self._runs, self._words = [], 0

    def full(self) -> bool:
        return self._words >= self._limit or len(self.texts) >= SHARD_DOCS

    def results(self) -> list[tuple]:
        """What was found of the texts so far, in their order."""
        self.search()
        found = []
        for text in self.texts:
            hits: list[list[int]] = []
            for a, b in sorted(text["hits"]):
                if hits and a <= hits[-1][1]:
                    hits[-1][1] = max(hits[-1][1], b)
                else:
                    hits.append([a, b])
            kinds = np.unique(np.concatenate(text["kinds"])) if hits else np.zeros(0, np.int64)
            longest, at = min(text["longest"], default=(0, None))
            found.append(
                (
                    text["n_words"],
                    sum(b - a for a, b in hits),
                    [{"start": a, "end": b} for a, b in hits],
                    self._passages.items_of(kinds),
                    -longest,
                    at,
                )
            )
        self.texts = []
        return found


def benchmark_pieces(
    benchmark: DataFrame, item_id: str, text: str, window: int, piece_words: int = PIECE_WORDS
) -> DataFrame:
    """Distinct (item string, words binary, n long); words are blank-separated, none are cut."""
    step = max(1, piece_words - window + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, given in zip(batch.column("item"), batch.column("text"), strict=True):
                words: list[bytes] = []
                first = True
                for some in word_lists(given.as_py()):
                    words += some
                    while len(words) > piece_words:
                        yield one(item, words[:piece_words])
                        words, first = words[step:], False
                if words and (first or len(words) >= window):
                    yield one(item, words)

    def one(item: pa.Scalar, words: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array([item.as_py()], pa.string()), pa.array([b" ".join(words)], pa.binary())]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([len(words)], pa.int64())], names=["item", "words", "n"]
        )

    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), text_of(text).alias("text")
    )
    return rows.mapInArrow(split, "item string, words binary, n long").distinct()


def _find(rows: DataFrame, passages: Passages | None, shard_words: int) -> DataFrame:
    """``rows`` (key, text) with what one block of the benchmark has in common with each text."""
    key = rows.schema["key"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, keys = Finder(passages, shard_words), []

        def made() -> pa.RecordBatch:
            columns = list(zip(*finder.results(), strict=True))
            arrays = [pa.array(keys, key_type)]
            kinds = [pa.int64(), pa.int64(), _HITS, pa.list_(pa.string()), pa.int64(), pa.int64()]
            arrays += [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            keys.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", *names])

        for batch in batches:
            key_type = batch.column("key").type
            for at, text in enumerate(batch.column("text")):
                keys.append(batch.column("key")[at].as_py())
                finder.add(text.as_py())
                if finder.full():
                    yield made()
        if keys:
            yield made()

    names = ["n_words", "n_hit", "hits", "items", "longest", "longest_at"]
    return rows.mapInArrow(find, f"key {key}, {FOUND}")


def _no_passages(window: int) -> Passages:
    """A block that no text has anything in common with."""
    return Passages([("", [b"\0"])], window)


# Spans of several blocks, sorted, as those that neither overlap nor touch.
_MERGED = """
aggregate(array_sort(flatten(collect_list(hits))), CAST(array() AS array<struct<start: bigint, end: bigint>>),
          (done, h) -> IF(size(done) > 0 AND h.start <= element_at(done, -1).end,
                          concat(slice(done, 1, size(done) - 1),
                                 array(named_struct('start', element_at(done, -1).start,
                                                    'end', greatest(element_at(done, -1).end, h.end)))),
                          concat(done, array(h))))
"""


def _passages_of(
    rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str,
    window: int, block_words: int, shard_words: int,
) -> DataFrame:
    """``rows`` (key, text) with what the whole benchmark has in common with each text.

    With more than one block of benchmark words the rows are read once for each, and keys must
    tell them apart.
    """
    pieces = stored(benchmark_pieces(benchmark, item_id, item_text, window), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    found = []
    for block in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
        if mine:
            passages = Passages([(r["item"], bytes(r["words"]).split()) for r in mine], window)
            one = _find(rows, passages, shard_words)
            found.append(stored(one, "passages") if blocks > 1 else one)
    if not found:
        return _find(rows, _no_passages(window), shard_words)
    if len(found) == 1:
        return found[0]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    best = F.min(F.struct((-F.col("longest")).alias("less"), F.col("longest_at").alias("at")))
    merged = every.groupBy("key").agg(
        F.first("n_words").alias("n_words"),
        F.expr(_MERGED).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        best.alias("best"),
    )
    return merged.select(
        "key",
        "n_words",
        F.expr("aggregate(hits, 0L, (n, h) -> n + h.end - h.start)").alias("n_hit"),
        "hits",
        "items",
        (-F.col("best.less")).alias("longest"),
        F.when(F.col("best.less") < 0, F.col("best.at")).alias("longest_at"),
    )


def benchmark_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, hits, items, longest, longest_at.

    ``hits`` are the spans of words (from 0, end exclusive) inside occurrences of a window, i.e. of
    ``window`` consecutive words of an item, or of a whole item of fewer; ``items`` the identifiers
    of items with such windows as sorted strings (a null one is ''); ``longest`` the words of the
    longest verbatim match that holds a window, and ``longest_at`` the first word of its first
    place (null if there is none).  Items longer than ``PIECE_WORDS`` are matched piecewise, so a
    longest match may end where a piece does; windows are all found.

    Null and empty texts, of documents or items, have no words; an item without words has no
    window.  Repeated rows give repeated rows, an empty table of documents none, an empty benchmark
    no hits.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    sizes = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    if sizes // 2 < block_words:  # at least two characters a word: one block
        found = _passages_of(
            rows.withColumnRenamed("doc_id", "key"), benchmark, item_id, item_text,
            window, max(block_words, sizes), shard_words,
        )
        return found.withColumnRenamed("key", "doc_id")
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "documents")
    found = _passages_of(
        rows.select("key", "text"), benchmark, item_id, item_text, window, block_words, shard_words
    )
    return rows.select("key", "doc_id").join(found, "key").drop("key")


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents that hold no window of any benchmark item, with all their columns."""
    inner, names = renamed(docs)
    rows = stored(inner.withColumn("key", F.monotonically_increasing_id()), "documents")
    texts = rows.select("key", text_of(names[text]).alias("text"))
    found = _passages_of(texts, benchmark, item_id, item_text, window, block_words, SHARD_WORDS)
    affected = found.where("n_hit > 0").select("key")
    return rows.join(affected, "key", "left_anti").select(*back(names))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``benchmark_passages`` gives."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
        "longest_at",
    )
