"""Small tables with the cases that every operator must take."""

from __future__ import annotations

from collections import Counter

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None, langs=None):
    """A table of documents with the given texts, numbered from 0 unless told otherwise."""
    n = len(texts)
    ids = ids if ids is not None else range(n)
    rows = [
        (i, t, (langs or ["en"] * n)[k], (sources or ["s"] * n)[k], len(t or ""))
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def saved(df, folder) -> str:
    """The folder as an input of a registered query."""
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id") -> dict:
    found = {r[key]: r for r in rows(df)}
    return found


def differences(df, sql: str, sf_dir: str) -> list:
    """Rows that only one of query and SQL has."""
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    theirs = Counter(cursor.fetchall())
    ours = Counter(tuple(r) for r in df.select(*names).collect())
    return [*(ours - theirs), *(theirs - ours)]
