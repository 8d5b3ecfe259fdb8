"""Token ids as Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id, so that shard k holds documents before those of shard
k + 1.  A shard is an Arrow IPC file of record batches with two columns, ``ids`` and ``mask``, both
fixed-size lists of ``length`` items: sequence i is slice i of a flat buffer, and a reader that maps
the file copies nothing.  Documents follow one another without gaps; only a shard's last sequence
is padded, where ``mask`` is false.  Beside each shard lies an index file of its documents (doc_id,
start in the shard, n_tokens).  A task writes under a name of its own and then moves the file to
its place, so repeated and speculative tasks leave the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import stored, text_of
from goldseam.llm.tokens import crc32_of, encoder

END_ID = 2
LENGTH = 2048
BATCH = 256  # sequences in a record batch

STEP = 256  # documents encoded at a time


def _place(folder: str, name: str):
    """The file system of a folder and the path of a file in it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, f"{path}/{name}"


class _Draft:
    """An Arrow file that comes to its name when it is complete."""

    def __init__(self, folder: str, name: str, schema: pa.Schema, attempt: int):
        self._system, self._path = _place(folder, name)
        self._system.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._draft, self._schema = f"{self._path}.{attempt}", schema
        self._stream = self._system.open_output_stream(self._draft)
        self._writer = pa.ipc.new_file(self._stream, schema)

    def write(self, columns: list[pa.Array]) -> None:
        self._writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))

    def close(self) -> None:
        self._writer.close()
        self._stream.close()
        self._system.move(self._draft, self._path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.arrow"


def index_name(shard: int) -> str:
    return f"shard-{shard:06d}.index.arrow"


class ShardWriter:
    """Writes ids, as they come, in sequences of equal length; all batches but the last are full."""

    def __init__(
        self, folder: str, shard: int, id_type: pa.DataType, dtype: np.dtype, length: int, attempt: int
    ):
        kind = pa.from_numpy_dtype(dtype)
        columns = [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))]
        index = [("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())]
        self._ids = _Draft(folder, shard_name(shard), pa.schema(columns), attempt)
        self._index = _Draft(folder, index_name(shard), pa.schema(index), attempt)
        self._length, self._dtype, self._rest = length, dtype, b""
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        """Documents that follow the ones before."""
        counts = np.array([len(e) for e in encoded], np.int64) // self._dtype.itemsize
        starts = self.n_tokens + np.cumsum(counts) - counts
        self._index.write([doc_ids, pa.array(starts), pa.array(counts)])
        self.n_docs += len(encoded)
        self.n_tokens += int(counts.sum())
        ids = np.frombuffer(b"".join([self._rest, *encoded]), self._dtype)
        step = BATCH * self._length
        full = len(ids) // step * step
        for at in range(0, full, step):
            self._put(ids[at : at + step], step)
        self._rest = ids[full:].tobytes()

    def _put(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self._dtype)
        padded[: len(ids)] = ids
        mask = np.arange(size) < len(ids)
        self._ids.write(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (padded, mask)]
        )

    def close(self) -> None:
        if self._rest:
            ids = np.frombuffer(self._rest, self._dtype)
            self._put(ids, -(-len(ids) // self._length) * self._length)
        self._ids.close()
        self._index.close()


class ShardReader:
    """Random access to a shard by number of sequence or of id; local files are mapped, not copied."""

    def __init__(self, folder: str, shard: int):
        self._file, self._index = (
            _opened(folder, name(shard)) for name in (shard_name, index_name)
        )
        kind = self._file.schema.field("ids").type
        self.length, self.sequences = kind.list_size, 0
        if batches := self._file.num_record_batches:
            last = self._file.get_batch(batches - 1).num_rows
            self.sequences = (batches - 1) * BATCH + last

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence, a view of the file, and its mask."""
        batch, row = self._file.get_batch(number // BATCH), number % BATCH
        at = slice(row * self.length, (row + 1) * self.length)
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[at]
        mask = batch.column("mask").flatten()[at].to_numpy(zero_copy_only=False)
        return ids, mask

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """``count`` ids from a place on, in parts that are views of the file."""
        step = BATCH * self.length
        while count:
            batch, at = divmod(start, step)
            flat = self._file.get_batch(batch).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = flat[at : at + count]
            yield part
            start, count = start + len(part), count - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """The index: doc_id, start in the shard, n_tokens."""
        for number in range(self._index.num_record_batches):
            yield self._index.get_batch(number)


def _opened(folder: str, name: str):
    from pyarrow import fs

    system, path = _place(folder, name)
    local = isinstance(system, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))


def write_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    length: int = LENGTH,
) -> DataFrame:
    """Write the files; one row per shard: shard, n_docs, n_tokens and the place of its first id.

    Documents stand in ascending order of doc_id (null first; equal ones in any order), each with
    ``end_id`` after its ids.  Null texts count as empty and have the end id alone.  Texts are
    encoded whole.  An empty table writes no file and gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, shard = TaskContext.get(), encoder(vocabulary), None
        end = tokens.one(end_id)
        for batch in batches:
            ids = batch.column("doc_id")
            if shard is None:
                shard = ShardWriter(
                    folder, task.partitionId(), ids.type, tokens.dtype, length, task.taskAttemptId()
                )
            for at in range(0, len(ids), STEP):
                some = batch.column("text").slice(at, STEP)
                shard.add(ids.slice(at, STEP), [tokens.encode(t.as_py()) + end for t in some])
        if shard is not None:
            shard.close()
            values = [[task.partitionId()], [shard.n_docs], [shard.n_tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int64(), pa.int64()))],
                names=["shard", "n_docs", "n_tokens"],
            )

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = stored(ordered.mapInArrow(write, "shard int, n_docs long, n_tokens long"), "shards")
    first, placed = 0, []
    for shard, n_docs, n_tokens in sorted(map(tuple, shards.collect())):  # a row per task
        placed.append((shard, n_docs, n_tokens, first))
        first += n_tokens
    return docs.sparkSession.createDataFrame(
        placed, "shard int, n_docs long, n_tokens long, first long"
    )


def read_files(shards: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, shards.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(folder, row["shard"])
                for found in shard.documents():
                    starts = found.column("start").to_numpy()
                    counts = found.column("n_tokens").to_numpy()
                    sums = []
                    for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
                        value = 0
                        for part in shard.ids(start, count):
                            value = crc32_of(part, value)
                        sums.append(value)
                    yield pa.RecordBatch.from_arrays(
                        [found.column("doc_id"), pa.array(starts + row["first"]), pa.array(counts),
                         pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One shard to a task.
    return shards.repartitionByRange(n, "shard").mapInArrow(
        read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    )
