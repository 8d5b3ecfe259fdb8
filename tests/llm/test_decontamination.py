import hashlib
import random
import re

import numpy as np
import pytest

from goldseam.llm import decontamination
from goldseam.llm.decontamination import (
    Finder,
    Passages,
    benchmark_passages,
    decontaminated,
    digests,
    suffix_array,
)
from tests.llm.tables import by_id, documents, empty, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, window=10):
    """(n_words, n_hit, hits, items, longest, longest_at) of one text."""
    words = words_of(text)
    marks, found, best = [False] * len(words), set(), (0, None)
    for item, said in items:
        given = words_of(said)
        width = min(window, len(given))
        for j in range(len(given) - width + 1 if width else 0):
            for i in range(len(words) - width + 1):
                if words[i : i + width] == given[j : j + width]:
                    marks[i : i + width] = [True] * width
                    found.add("" if item is None else str(item))
                    n = width
                    while i + n < len(words) and j + n < len(given) and words[i + n] == given[j + n]:
                        n += 1
                    best = min(best, (-n, i))
    hits = []
    for at, mark in enumerate(marks):
        if mark and at and marks[at - 1]:
            hits[-1]["end"] = at + 1
        elif mark:
            hits.append({"start": at, "end": at + 1})
    return len(words), sum(marks), hits, sorted(found), -best[0], best[1]


def bench(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "item_id long, text string")


def drawn(seed, n_docs, n_items, letters="abc"):
    draw = random.Random(seed)
    some = lambda n: " ".join(draw.choices(letters, k=n))
    items = [(i, some(draw.choice([0, 1, 3, 10, 11, 14, 30]))) for i in range(n_items)]
    items = [(i, t) for i, t in items if len(t) != 1 and len(t) != 5] or [(0, some(12))]
    texts = []
    for _ in range(n_docs):
        text = some(draw.randint(0, 40))
        for _ in range(draw.randint(0, 2)):
            text += draw.choice([" ", ", Z ", " É "]) + draw.choice(items)[1].upper()
        texts.append(text + some(draw.randint(0, 5)))
    return texts, items


@pytest.mark.parametrize("shard_words", [1, 40, 10_000])
@pytest.mark.parametrize("letters", ["abc", "abcdefghijkl"])
def test_finder_against_brute_force(shard_words, letters, monkeypatch):
    monkeypatch.setattr(decontamination, "BYTES", 17)
    for seed in range(15):
        texts, items = drawn(seed, 12, 6, letters)
        pieces = [(str(i), [w.encode() for w in words_of(t)]) for i, t in items if words_of(t)]
        finder = Finder(Passages(pieces), shard_words)
        for text in texts:
            finder.add(text)
        found = finder.results()
        assert found == [brute(t, items) for t in texts]


def test_suffix_array_sorts_as_deep_as_asked():
    draw = random.Random(1)
    for depth in (1, 2, 5, 9):
        ids = np.array(draw.choices([0, 1, 2], k=200), np.int32)
        order = suffix_array(ids, depth)
        assert sorted(order.tolist()) == list(range(200))
        said = [ids[i : i + depth].tolist() for i in order]
        assert said == sorted(said)


def test_blocks_of_the_benchmark_add_up(spark):
    texts, items = drawn(3, 60, 12)
    docs = documents(spark, texts + [None, ""], ids=[1] * 3 + list(range(3, len(texts))) + [None, 900])
    table = bench(spark, [t for _, t in items], [i for i, _ in items])
    key = lambda r: tuple(map(str, r))
    expected = sorted([brute(t, items) for t in [*texts, None, ""]], key=key)
    for block_words in (500_000, 40):
        found = rows(benchmark_passages(docs, table, block_words=block_words, shard_words=100))
        said = [(r["n_words"], r["n_hit"], r["hits"], r["items"], r["longest"], r["longest_at"]) for r in found]
        assert sorted(said, key=key) == expected


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(2_500)]
    table = bench(spark, [" ".join(words), " ".join(words[:9])], [None, 7])
    docs = documents(spark, ["x " + " ".join(words), "w994 " + " ".join(words[995:1005]), "w1 w2"])
    found = by_id(benchmark_passages(docs, table))
    assert found[0]["hits"] == [{"start": 1, "end": 2_501}] and found[0]["items"] == ["", "7"]
    assert found[0]["longest"] == decontamination.PIECE_WORDS and found[0]["longest_at"] == 1
    assert found[1]["hits"] == [{"start": 0, "end": 11}] and found[1]["items"] == [""]
    assert found[2]["n_hit"] == 0 and found[2]["longest_at"] is None


def test_odd_tables_and_clashing_names(spark):
    texts = [None, "", "a b c", "one two three four five six seven eight nine ten", "... !"]
    docs = documents(spark, texts, ids=[None, 1, 1, 2, 3]).selectExpr("*", "1 AS key", "2 AS hits", "3 AS n")
    table = bench(spark, ["ONE two, three four five six seven eight nine ten", None, "", "b"], [5, 6, 7, None])
    found = rows(digests(benchmark_passages(docs, table.selectExpr("*", "1 AS key", "2 AS n"))))
    said = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in found)
    assert said == [("1", 0, 0, 0), ("1", 3, 1, 1), ("2", 10, 10, 1), ("3", 0, 0, 0), ("None", 0, 0, 0)]
    kept = decontaminated(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r["text"]) for r in rows(kept)) == ["", "... !", "None"]
    nothing = bench(spark, ["", None])
    assert {r["items_sha256"] for r in rows(digests(benchmark_passages(docs, nothing)))} == {
        hashlib.sha256(b"").hexdigest()
    }
    assert decontaminated(docs, nothing).count() == 5
    assert benchmark_passages(empty(spark), table).collect() == []
    assert decontaminated(empty(spark), table).collect() == []


def test_very_long_text_and_many_copies(spark):
    item = " ".join(f"q{i}" for i in range(12))
    long = "filler " * 300_000 + item + " q0 q1 " + "q3 q4 " * 50_000
    docs = documents(spark, [long] + ["so " + item] * 200)
    found = by_id(benchmark_passages(docs, bench(spark, [item] * 3), shard_words=30_000))
    assert found[0]["n_words"] == 400_014 and found[0]["hits"] == [{"start": 300_000, "end": 300_012}]
    assert all(r["items"] == ["0", "1", "2"] and r["longest"] == 12 for r in found.values())
