"""Language of a text by compression with one dictionary per language.

Each language has a raw-content dictionary: text of a bounded sample of its labelled rows.  A text
is lower-cased, reduced to its letters and encoded in blocks with every dictionary; the language
whose encoding is smallest is chosen, and the choice is rejected when the runner-up is as good
within ``MIN_MARGIN``.  Blocks keep the dictionary near, so that a long text doesn't become its
own dictionary.  All dictionaries end with the same primer, and each block starts with it: it costs
next to nothing and lets the encoder shorten even a text of a few letters.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import in_crc32_fold, in_small_batches

UNKNOWN = "und"
MIN_MARGIN = 0.002  # part of the runner-up's size
FOLDS, HELD_OUT = 3, 1

# The bounds of the sample: texts per language, characters of each, and bytes of a dictionary.
SAMPLE_TEXTS = 120
SAMPLE_CHARS = 1_000
DICTIONARY_BYTES = 32_768

BLOCK = 1_024
PRIMER = bytes(random.Random(9).choices(b"0123456789#%&*+<>=@^|~", k=64))

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters of a text, everything else one blank; nothing of a text without a letter."""
    if not any(map(str.isalpha, text)):  # fractions and the like are word characters, too
        return b""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass
class Languages:
    """The dictionaries by language, in the order in which ties are resolved."""

    dictionaries: dict[str, bytes]
    _encoders: dict[str, zstandard.ZstdCompressor] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_encoders": {}}

    def _encoder(self, language: str) -> zstandard.ZstdCompressor:
        if language not in self._encoders:
            settings = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, target_length=32,
                window_log=17, hash_log=15, chain_log=16,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            content = zstandard.ZstdCompressionDict(
                self.dictionaries[language] + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(compression_params=settings)
            self._encoders[language] = zstandard.ZstdCompressor(
                dict_data=content, compression_params=settings
            )
        return self._encoders[language]

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and the margin to the runner-up."""
        data = letters(text or "")
        if not data or not self.dictionaries:
            return UNKNOWN, 0.0, 0.0
        blocks = [PRIMER + data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = {}
        for language in self.dictionaries:
            encode = self._encoder(language).compress
            sizes[language] = sum([len(encode(block)) for block in blocks])
        best = min(sizes, key=sizes.__getitem__)
        others = [size for language, size in sizes.items() if language != best]
        runner_up = min(others, default=2 * sizes[best])
        weight = sum(math.exp(sizes[best] - size) for size in others)
        return best, 1 / (1 + weight), (runner_up - sizes[best]) / runner_up


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Dictionaries from a sample, even over the texts, of the labelled rows given.

    Rows without text or label teach nothing; copies of a text count once.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    distinct = labelled.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.count("*").alias("n"))
    sizes = distinct.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    counts = {r["lang"]: r["n"] for r in sizes}
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], min(1.0, 2 * SAMPLE_TEXTS / r["texts"])).otherwise(rate)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    sample = (
        labelled.withColumn("place", place)
        .where(F.col("place") < rate)
        .select("lang", "place", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        .distinct()
        .orderBy("place", "lang", "text")
        .limit(4 * SAMPLE_TEXTS * max(1, len(counts)))
        .collect()
    )
    dictionaries = {}
    for name in sorted(counts, key=lambda k: (-counts[k], k)):
        own = [letters(r["text"]) for r in sample if r["lang"] == name][:SAMPLE_TEXTS]
        if content := b" ".join(t for t in own if t)[:DICTIONARY_BYTES]:
            dictionaries[name] = content
    return Languages(dictionaries)


def identified(text: Column, languages: Languages) -> Column:
    """A struct of lang_pred, score, margin and accepted for a text column."""

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = [languages.identify(text) for text in series]
            yield pd.DataFrame(
                [(a, b, c, a != UNKNOWN and c >= MIN_MARGIN) for a, b, c in found],
                columns=["lang_pred", "score", "margin", "accepted"],
            )

    kind = "lang_pred string, score double, margin double, accepted boolean"
    return F.pandas_udf(predict, kind).asNondeterministic()(text)


def language_id(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score, margin, accepted.

    Languages are learned from rows outside the held-out fold, those whose crc32(doc_id as text)
    leaves ``held_out`` modulo ``folds``; a null doc_id is never held out.  A prediction looks at
    the text alone, whole.  A null text or one without a letter is ``und`` with score 0 and not
    accepted, as is every text if nothing could be learned.  Ties go to the language with more
    labelled rows and are not accepted.  With one language only, it is predicted with score 1.
    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    held = in_crc32_fold(doc_id, folds, held_out)
    languages = learn(docs.where(~held), text, lang)
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    found = rows.withColumn("found", identified(F.col("text"), languages))
    return found.select("doc_id", "held_out", "found.*")


def in_known_language(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The documents whose language is accepted, with their own columns."""
    held = in_crc32_fold(doc_id, FOLDS, HELD_OUT)
    languages = learn(docs.where(~held), text, lang)
    in_small_batches(docs.sparkSession)
    inner = [f"_in{at}" for at in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    found = plain.withColumn("_found", identified(F.col(inner[docs.columns.index(text)]), languages))
    return found.where("_found.accepted").select(*inner).toDF(*docs.columns)
