import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from goldseam.llm import lm_score, queries
from goldseam.llm.common import documents as read_documents
from tests.llm.tables import by_id, documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lower), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_base(found, texts):
    counts = Counter(t for i, text in texts.items() if not held(i) for t in tokens(text))
    n, v = counts.total(), len(counts)
    for i, text in texts.items():
        said, row = tokens(text), found[i]
        assert row["held_out"] == held(i) and row["train_tokens"] == n
        assert row["n_tokens"] == len(said)
        assert row["n_known"] == sum(counts[t] > 0 for t in said)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in said)
        assert row["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in rows(read_documents(spark, sf_dir))}
    found = by_id(queries.registered()["op9_lm_scoring"](spark, sf_dir))
    assert found.keys() == texts.keys()
    check_base(found, texts)
    fresh = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_counts_don_t_depend_on_what_is_frequent(spark, frequent):
    draw = np.random.default_rng(4)
    words = ["a", "B", "c c", "É", " x", "d\te", "", "f g"]
    texts = {i: " ".join(draw.choice(words, draw.integers(0, 30))) for i in range(60)}
    docs = documents(spark, list(texts.values()))
    check_base(by_id(lm_score.lm_scores(docs, frequent=frequent, rounds=1)), texts)


def test_forward_recursion_sums_over_all_paths():
    draw = np.random.default_rng(0)
    states, size = 3, 5
    model = lm_score.Model(
        draw.dirichlet(np.ones(states)),
        draw.dirichlet(np.ones(states), states),
        draw.dirichlet(np.ones(size), states).T,
        draw.dirichlet(np.ones(states)),
    )
    sequences = [draw.integers(0, size, n).astype(np.int32) for n in (1, 4, 6, 2, 6)]
    expected, starts, moves, emissions = [], np.zeros(states), np.zeros((states,) * 2), np.zeros((size, states))
    first = np.array([True, False, True, True, False])
    for sequence, begins in zip(sequences, first, strict=True):
        weights = {}
        for path in itertools.product(range(states), repeat=len(sequence)):
            p = (model.start if begins else model.middle)[path[0]]
            for k, s in enumerate(path):
                p *= model.emit[sequence[k], s] * (model.move[path[k - 1], s] if k else 1)
            weights[path] = p
        total = sum(weights.values())
        if begins:
            expected.append(math.log10(total))
        for path, p in weights.items():
            if begins:
                starts[path[0]] += p / total
            for k, s in enumerate(path):
                emissions[sequence[k], s] += p / total
                if k:
                    moves[path[k - 1], s] += p / total
    found = lm_score.log10_likelihoods([s for s, b in zip(sequences, first, strict=True) if b], model)
    assert np.allclose(found, expected)
    for mine, brute in zip(lm_score.expected_counts(sequences, first, model), (starts, moves, emissions), strict=True):
        assert np.allclose(mine, brute)


def test_training_raises_the_likelihood(spark):
    draw = np.random.default_rng(1)
    texts = []
    for _ in range(80):
        one, two = ["sea", "ship", "wave"], ["wood", "tree", "leaf"]
        own = one if draw.random() < 0.5 else two
        texts.append(" ".join(draw.choice(own, 20)))
    docs = documents(spark, texts)
    totals = []
    for rounds in (1, 2, 8):
        found = rows(lm_score.lm_scores(docs, rounds=rounds, states=2))
        totals.append(sum(r["score"] for r in found if not r["held_out"]))
    assert totals[0] < totals[1] < totals[2]


def test_probabilities_of_all_words_sum_to_one(spark):
    docs = documents(spark, ["a a b", "b c", "d d d e"])
    counts = lm_score.word_counts(docs)
    words = lm_score.vocabulary(counts, frequent=2, rare=4)
    given = docs.selectExpr("doc_id AS row", "doc_id", "false AS held_out", "text")
    read = lm_score.read_texts(given, words)
    model = lm_score.baum_welch(read, words, lm_score.first_model(words))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    known = {bytes(r["word"]): r["n"] for r in rows(counts)}
    assert known == {b"a": 2, b"b": 2, b"c": 1, b"d": 3, b"e": 1, b"": 3}
    assert (words.tokens, words.distinct, words.counts.tolist()) == (12, 6, [3, 3, 2])
    # Within its class a word has (count + 1) of the mass, and any unknown word has 1.
    assert words.rare_mass.sum() == 4 + sum(known[w] + 1 for w in (b"b", b"c", b"e"))


def test_odd_rows(spark):
    texts = [None, "", "same text", "same text", "long " * 60_000, "new"]
    docs = documents(spark, texts, ids=[None, 1, 5, 5, 6, 7]).selectExpr("*", "1 AS row", "2 AS word")
    found = rows(lm_score.lm_scores(docs))
    assert sorted(r["n_tokens"] for r in found) == [1, 1, 2, 3, 3, 60_001]
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in found)
    assert lm_score.lm_scores(empty(spark)).collect() == []


def test_without_training_texts(spark):
    ids = [i for i in range(60) if held(i)][:3]
    found = rows(lm_score.lm_scores(documents(spark, ["a b", None, "c"], ids=ids)))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in found)
