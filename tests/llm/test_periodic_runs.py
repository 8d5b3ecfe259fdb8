import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from goldseam.llm import periodic_runs, queries
from goldseam.llm.common import documents as read
from goldseam.llm.periodic_runs import (
    Group,
    digests,
    inverse,
    squared_differences,
    transform,
    with_repetitions,
)
from tests.llm.tables import by_id, documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs (start, period, length) by comparing at every distance."""
    n, found = len(words), {}
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    array = np.array([numbers[w] for w in words])
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], array[:-q] == array[q:], [0]]).astype(np.int8)
        edges = np.diff(same)
        for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True):
            if b - a >= q and b - a + q >= 12:
                found.setdefault((int(a), int(b + q)), q)
    return sorted((a, q, b - a) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def of_group(texts):
    group = Group()
    for text in texts:
        group.add(text.encode())
    return [
        (n, [(r["start"], r["period"], r["length"]) for r in runs], said.decode())
        for n, runs, said in group.results()
    ]


def expected(texts):
    found = []
    for text in texts:
        words = WORD.findall(text)
        runs = brute(words)
        found.append((len(words), runs, collapsed(words, runs)))
    return found


def test_transform_and_its_inverse():
    draw = np.random.default_rng(1)
    for size in (2, 8, 64):
        given = draw.integers(0, periodic_runs.PRIME, (3, size)).astype(np.uint64)
        assert (inverse(transform(given)) == given).all()


@pytest.mark.parametrize(("size", "first", "last"), [(2, 1, 6), (4, 7, 14), (16, 31, 62)])
def test_squared_differences_are_exact(size, first, last):
    draw = np.random.default_rng(size)
    words = draw.integers(1, 400_000, 300).astype(np.uint32)
    blocks = np.arange(0, 200, size)
    sums = squared_differences(words, blocks, size, first, last)
    for row, block in enumerate(blocks.tolist()):
        for d in range(first, last + 1):
            pairs = zip(words[block : block + size], words[block + d : block + d + size], strict=True)
            assert sums[row, d - first] == sum((int(a) - int(b)) ** 2 for a, b in pairs) % periodic_runs.PRIME


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_random_texts(letters, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BYTES", 50)
    draw = random.Random(len(letters))
    for _ in range(25):
        texts = []
        for _ in range(draw.randint(1, 8)):
            words = draw.choices(letters, k=draw.randint(0, 70))
            for _ in range(draw.randint(0, 3)):
                part = draw.choices(letters, k=draw.randint(1, 25))
                at = draw.randint(0, len(words))
                words[at:at] = (part * 6)[: draw.randint(1, 6 * len(part))]
            texts.append(" ".join(words) + draw.choice(["", " ", "\n"]))
        assert of_group(texts) == expected(texts)


def test_known_sequences():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    powers = ["a"]
    for letter in "bcdefgh":
        powers.append(powers[-1] + powers[-1] + letter)
    texts = [fibonacci[-1], powers[-1] * 3, "a" * 5_000, "ab" * 700 + "a" * 40, "abc" * 4, "abc" * 3 + "ab"]
    texts = [" ".join(t) for t in texts]
    assert of_group(texts) == expected(texts)


def test_a_long_run_takes_few_steps():
    words = ["x"] * 300_000
    (found,) = of_group([" ".join(words)])
    assert found == (300_000, [(0, 1, 300_000)], "x")


def test_planted_repetitions(spark):
    texts = ["one two three four five six seven eight nine ten"] * 60 + [None, "", " \n"]
    found = by_id(with_repetitions(documents(spark, texts)))
    changed = 0
    for i, text in enumerate(texts):
        assert WORD.findall(found[i]["text"]) == planted(i, text or "")
        changed += found[i]["text"] != (text or "")
    assert changed > 0
    nameless = documents(spark, ["a b a b"], ids=[None])
    assert rows(with_repetitions(nameless))[0]["text"] == "a b a b"


def planted(i, text):
    words, h = WORD.findall(text), zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def sha(said):
    return hashlib.sha256(said.encode()).hexdigest()


def test_odd_tables_and_clashing_names(spark):
    long = "y\u00e9s\u2028no " * 120_000
    docs = documents(spark, [None, "", "a b" * 30, "x " * 30, long, long], ids=[None, 1, 2, 3, 4, 4])
    found = rows(periodic_runs.periodic_runs(docs.selectExpr("*", "1 AS runs", "2 AS collapsed"), group_words=50))
    said = sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), len(r["collapsed"])) for r in found)
    assert said == [
        ("1", 0, 0, 0), ("2", 31, 1, 6), ("3", 30, 1, 1), ("4", 120_000, 1, 6), ("4", 120_000, 1, 6),
        ("None", 0, 0, 0),
    ]
    assert periodic_runs.periodic_runs(empty(spark)).collect() == []
    nothing = rows(digests(periodic_runs.periodic_runs(docs.where("doc_id = 1"))))[0]
    assert nothing["runs_sha256"] == nothing["collapsed_sha256"] == sha("")
    assert [nothing[c] for c in ("start", "length", "period", "exponent_milli")] == [None] * 4


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_over_the_whole_table(spark, scale):
    sf_dir = f"/root/testdata/{scale}"
    found = by_id(queries.registered()["op11_periodic_runs"](spark, sf_dir))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(read(spark, sf_dir))}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        words = planted(i, text)
        runs = brute(words)
        top = min(((-n, a, q) for a, q, n in runs), default=None)
        row = found[i]
        assert row["n_runs"] == len(runs)
        values = (row["length"], row["start"], row["period"], row["exponent_milli"])
        assert values == ((-top[0], top[1], top[2], -1000 * top[0] // top[2]) if top else (None,) * 4)
        assert row["runs_sha256"] == sha("".join(f"{a},{n},{q}\n" for a, q, n in runs))
        assert row["collapsed_sha256"] == sha(collapsed(words, runs))
