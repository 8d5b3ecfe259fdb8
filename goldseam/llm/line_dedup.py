"""Removal of repeated multi-line passages by content-defined chunks of lines.

A document is cut after every line at which a rolling hash over the last ``WINDOW`` line hashes is
a multiple of ``DIVISOR``.  Boundaries depend on nearby lines only, so a passage that moves to
another place in another document is cut at the same lines.  Chunks of two or more lines that
occur more than once anywhere are removed except for their first occurrence.  Chunks are grouped
by digest and bytes together: the grouping itself compares the bytes, and a digest shared by
different texts removes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import back, renamed, text_of

WINDOW = 2
DIVISOR = 3
HASH_DIGITS = 7  # hexadecimal digits of a line's MD5 that make its hash
BASE = 1_000_003
MODULUS = 2_147_483_647

_ID, _TEXT = "_dedup_id", "_dedup_text"


def _rolling(hashes: str, at: Column, window: int) -> Column:
    """Polynomial hash of the ``window`` line hashes that end at the 1-based place ``at``."""
    value = F.lit(0).cast("long")
    for back in range(window - 1, -1, -1):
        line = F.when(at > back, F.element_at(F.col(hashes), F.greatest(at - back, F.lit(1))))
        value = (value * BASE + F.coalesce(line, F.lit(0))) % MODULUS
    return value


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that they are computed once and not in each use."""
    (name, column), *rest = columns.items()
    df = df.select("*", F.explode(F.array(column)).alias(name))
    return _once(df, **dict(rest)) if rest else df


def chunked(
    df: DataFrame, text: str, window: int = WINDOW, divisor: int = DIVISOR
) -> DataFrame:
    """Add ``_chunks``, the document's chunks as arrays of lines, in order."""
    n = F.size("_lines")

    def piece(end: Column, at: Column) -> Column:
        start = F.when(at == 0, 0).otherwise(F.element_at("_ends", F.greatest(at, F.lit(1))))
        return F.slice("_lines", start + 1, end - start)

    df = _once(df, _lines=F.split(F.col(text), "\n", -1))
    df = _once(
        df,
        _hashes=F.transform(
            "_lines",
            lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, HASH_DIGITS), 16, 10).cast(
                "long"
            ),
        ),
    )
    df = _once(
        df,
        _ends=F.filter(
            F.sequence(F.lit(1), n),
            lambda at: (at == n) | (_rolling("_hashes", at, window) % divisor == 0),
        ),
    )
    return _once(
        df,
        _chunks=F.transform("_ends", piece),
    ).drop("_lines", "_hashes", "_ends")


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Add a key of the document, from its identifier and its text, and the text without null."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    return docs.select(
        "*",
        F.md5(F.concat_ws(" ", name, text_of(text)).cast("binary")).alias(_ID),
        text_of(text).alias(_TEXT),
    )


def removals(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
) -> DataFrame:
    """The places, from 0, of the chunks to remove: one row (_dedup_id, _removed) per document."""
    pieces = chunked(
        _identified(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), _ID, _TEXT),
        _TEXT, window, divisor,
    )
    rows = pieces.select("doc_id", _ID, F.posexplode("_chunks").alias("_at", "_chunk")).where(
        F.size("_chunk") > 1
    )
    rows = rows.select(
        F.struct(
            F.col("doc_id").isNull().alias("nameless"),
            F.col("doc_id").alias("doc_id"),
            F.col(_ID).alias("id"),
            F.col("_at").alias("at"),
        ).alias("_place"),
        F.array_join("_chunk", "\n").alias("_chunk"),
    ).where(F.col("_chunk").rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("_digest", F.md5(F.col("_chunk").cast("binary")))
    same_bytes = rows.groupBy("_digest", "_chunk").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n")
    )
    repeated = (
        same_bytes.drop("_chunk")
        .groupBy("_digest")
        .agg(F.count("*").alias("_texts"), F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
        .where("_texts = 1 AND _n > 1")
        .select("_digest", "_first")
    )
    return (
        rows.select("_place", "_digest")
        .join(repeated, "_digest")
        .where("_place != _first")
        .groupBy(F.col("_place.id").alias(_ID))
        .agg(F.collect_set("_place.at").alias("_removed"))
    )


def line_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
    counts: bool = False,
) -> DataFrame:
    """The documents with every repeated multi-line chunk removed but its first occurrence.

    First is the smallest doc_id (null last), then the place in the document.  Lines are what
    stands between "\\n"; chunks of white space alone stay.  A null text stays null, an empty one
    empty, and a document that loses all its chunks stays with an empty text.  Rows equal in
    doc_id and text are one document: they lose the same chunks.  All columns are kept, whatever
    their names; ``counts`` adds n_lines and n_removed.  An empty table gives an empty table.
    """
    plain, names = renamed(docs)
    doc_id, text = names[doc_id], names[text]
    removed = removals(plain, doc_id, text, window, divisor)
    joined = chunked(
        _identified(plain, doc_id, text).join(removed, _ID, "left"), _TEXT, window, divisor
    )
    gone = F.coalesce("_removed", F.array().cast("array<int>"))
    joined = _once(
        joined, _kept=F.filter("_chunks", lambda chunk, at: ~F.array_contains(gone, at))
    )
    cleaned = F.when(F.col(text).isNull() | F.col("_removed").isNull(), F.col(text)).otherwise(
        F.array_join(F.flatten("_kept"), "\n")
    )
    columns = back(names, **{text: cleaned})
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.flatten("_chunks")))
        left = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.flatten("_kept")))
        columns += [n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed")]
    return joined.select(*columns)
