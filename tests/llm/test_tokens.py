"""Token ids, token files and packed sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from goldseam.llm import packing, queries, token_files
from goldseam.llm.common import documents as read
from goldseam.llm.tokens import Encoder, vocabulary_path
from tests.llm.tables import documents, empty, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(vocabulary_path())
    found.encode_special_tokens = True
    return found


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("limit", [0, 40, 10_000])
def test_cached_ids_are_the_librarys(library, limit):
    parts = [
        "a", "Word", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "é", " ", "　",
        "\x1c", "12", "²", "_", "<|endoftext|>", "𝄞", "\0", "ſ", "-", "\r\n", "中文", "I'll", "x.\nY",
    ]
    encoder, draw = Encoder(vocabulary_path(), limit), random.Random(limit)
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == plain(library, text)


def test_files_give_back_every_document(spark, library):
    texts = {r["doc_id"]: r["text"] for r in rows(read(spark, SMALL))}
    found = rows(queries.registered()["op8_token_files"](spark, SMALL))
    at = 0
    for row in sorted(found, key=lambda r: r["doc_id"]):
        ids = [*plain(library, texts.pop(row["doc_id"])), 2]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not texts


def test_sequences_have_equal_length_and_masks(spark, library, tmp_path):
    texts = [None, "", "word " * 5000, "two words", "two words"]
    docs = documents(spark, texts, ids=[None, 4, 9, 11, 11]).selectExpr("*", "1 AS shard")
    folder = f"file://{tmp_path}/files"
    shards = token_files.write_files(docs, folder, vocabulary_path(), length=7)
    ids = []
    for row in sorted(rows(shards), key=lambda r: r["shard"]):
        shard = token_files.ShardReader(folder, row["shard"])
        pairs = [shard.sequence(i) for i in range(shard.sequences)]
        assert all(len(x) == len(mask) == 7 for x, mask in pairs)
        own = [int(x) for values, mask in pairs for x in values[mask]]
        assert len(own) == row["n_tokens"] and row["first"] == len(ids)
        assert [i for part in shard.ids(0, len(own)) for i in part.tolist()] == own
        ids += own
    assert ids == [i for text in texts for i in [*plain(library, text), 2]]
    back = rows(token_files.read_files(shards, folder))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in back)[:2] == [(0, 1), (4, 1)]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_files_of_documents_with_other_identifiers(spark, library, tmp_path, kind):
    docs = documents(spark, ["one text", None, "another"], ids=[7, 21, 9]).withColumn(
        "doc_id", F.col("doc_id").cast(kind)
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = rows(queries.registered()["op8_token_files"](spark, str(tmp_path)))
    order = sorted([7, 21, 9], key=int if kind == "int" else str)
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == [
        i if kind == "int" else str(i) for i in order
    ]
    assert {int(r["doc_id"]): r["n_tokens"] for r in found}[21] == 1


def test_no_documents_no_files(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    shards = token_files.write_files(empty(spark), folder, vocabulary_path())
    assert shards.collect() == [] and token_files.read_files(shards, folder).collect() == []


def check_bins(lengths, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in bins)


def next_fit(lengths, capacity):
    bins, left = [], 0
    for i, length in enumerate(lengths):
        if length > left:
            bins.append([])
            left = capacity
        bins[-1].append(i)
        left -= length
    return bins


def test_local_search_empties_bins_of_a_poor_start():
    draw = random.Random(5)
    for _ in range(60):
        lengths = [draw.randint(1, 60) for _ in range(draw.randint(40, 90))]
        first = next_fit(lengths, 100)
        bins = packing.Exchange(first, lengths, 100).run()
        check_bins(lengths, bins, 100)
        least = -(-sum(lengths) // 100)
        assert len(bins) < len(first) and len(bins) <= least + 2
        assert len(packing.packed_bins(lengths, 100)) <= len(packing.best_fit(lengths, 100))
    for lengths in ([], [100], [100, 100, 1]):
        check_bins(lengths, packing.packed_bins(lengths, 100), 100)


def test_an_exchange_empties_a_bin():
    lengths = [60, 40, 30, 70, 50, 50]
    state = packing.Exchange([[0, 2], [1, 4], [3], [5]], lengths, 100)
    squares = int(((100 - state.free) ** 2).sum())
    bins = state.run()
    check_bins(lengths, bins, 100)
    assert len(bins) == 3 and int(((100 - state.free) ** 2).sum()) > squares


@pytest.mark.parametrize(("low", "high", "n", "most"), [(300, 420, 900, 161), (200, 260, 900, 102), (140, 160, 1500, 111)])
def test_search_of_similar_lengths_ends_without_an_exchange_left(low, high, n, most):
    for seed in (1, 2):
        draw = random.Random(seed)
        lengths = [draw.randint(low, high) for _ in range(n)]
        state = packing.Exchange(packing.best_fit(lengths, 2048), lengths, 2048)
        bins = state.run()
        check_bins(lengths, bins, 2048)
        assert len(bins) <= most
        if len(bins) > -(-sum(lengths) // 2048):
            assert not any(state.improve(number) for number in range(len(state.bins)) if state.free[number])


def test_every_pair_of_pieces_is_tried():
    lengths = [*range(30, 18, -1), 38, 2009]  # only the two shortest fit for the 38: 19 + 20
    state = packing.Exchange([list(range(12)), [12, 13]], lengths, 2048)
    assert state.improve(0)
    assert sorted(lengths[i] for i in state.bins[1]) == [19, 20, 2009]


def check_packed(found, expected):
    """Sequences are gapless and at most full; pieces are those of the documents."""
    sequences, per_doc = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, ids in expected.items():
        at = 0
        for number, r in enumerate(sorted(per_doc.pop(doc_id), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (number, at)
            assert r["length"] == 2048 or number == 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert not per_doc
    total = sum(map(len, expected.values()))
    return len(sequences), -(-total // 2048)


def test_query_packs_the_whole_table(spark, library):
    expected = {r["doc_id"]: [*plain(library, r["text"]), 0] for r in rows(read(spark, SMALL))}
    used, least = check_packed(
        rows(queries.registered()["op4_best_fit_packing"](spark, SMALL)), expected
    )
    assert used <= least * 1.01 + 1


def test_groups_that_meet_again_lose_nothing(spark, library):
    draw = random.Random(2)
    texts = ["word " * draw.randint(0, 1500) for _ in range(300)]
    docs = documents(spark, texts)
    found = rows(packing.packed(docs, vocabulary_path(), group=40))
    expected = {i: [*plain(library, t), 0] for i, t in enumerate(texts)}
    used, least = check_packed(found, expected)
    assert used <= least * 1.15 + 1
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
        assert ids == expected[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_packing_takes_nulls_and_repeated_rows(spark):
    docs = documents(spark, [None, "", "a", "a", "b " * 3000], ids=[None, 1, 2, 2, None])
    found = rows(packing.packed(docs.selectExpr("*", "1 AS uid", "2 AS part"), vocabulary_path()))
    assert len(found) == 6 and len({(r["sequence_id"], r["offset"]) for r in found}) == 6
    assert packing.packed(empty(spark), vocabulary_path()).collect() == []
