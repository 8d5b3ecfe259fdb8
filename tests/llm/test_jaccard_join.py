import random
import re
from collections import defaultdict

import numpy as np
import pytest

from goldseam.llm import jaccard_join, queries
from goldseam.llm.common import documents as read
from goldseam.llm.shingles import shingle_sets
from tests.llm.tables import by_id, documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    """doc_id -> (n_shingles, component_id), comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, common in shared.items():
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def check(found, texts):
    expected = brute(texts)
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()}
    assert {i: (got[i], expected[i]) for i in texts if got[i] != expected[i]} == {}


def test_hashes_tell_shingles_apart():
    draw, names = random.Random(1), {}
    words = ["a", "A", "b", "ab", "ba", "é", "É", " x", "longer-word", "aa", "aaa"]
    texts = [
        "".join(draw.choice(words) + draw.choice([" ", "\n", "\t ", " "]) for _ in range(draw.randint(0, 9)))
        for _ in range(3000)
    ]
    for text, hashes in zip(texts, shingle_sets(texts), strict=True):
        own = shingles(text)
        assert len(own) == len(hashes)
        if len(own) == 1:
            assert names.setdefault(next(iter(own)), hashes[0]) == hashes[0]
    assert len(set(names.values())) == len(names)


def test_prefixes_of_linked_sets_meet():
    draw = np.random.default_rng(3)
    frequent = np.unique(draw.integers(0, 400, 60, dtype=np.uint64))
    draw.shuffle(frequent)
    ranks = np.argsort(frequent)
    ordered = frequent[ranks]
    met = 0
    for _ in range(4000):
        a = np.unique(draw.integers(0, 400, draw.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.93], draw.integers(0, 400, 3, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 180 * common >= 80 * (len(a) + len(b)):
            met += 1
            assert common >= jaccard_join.least_overlap(len(a), len(b))
            first, second = (set(jaccard_join.prefix(x, ordered, ranks).tolist()) for x in (a, b))
            assert first & second
    assert met > 500


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        at = draw.randrange(len(words))
        words[at : at + draw.randint(0, 1)] = [f"new{draw.randrange(10**6)}"] * draw.randint(0, 2)
    return " ".join(words)


@pytest.mark.parametrize("frequent", [0, 50, 100_000])
def test_groups_equal_brute_force(spark, frequent):
    draw = random.Random(frequent)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = draw.choices(vocabulary, k=70)
    texts = []
    for group in range(12):
        base = draw.choices(vocabulary, k=draw.randint(4, 160))
        texts += [edited(draw, base, draw.randint(0, 7)) for _ in range(draw.choice([1, 2, 9, 40]))]
    texts += [" ".join(passage + draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(60)]
    texts += ["x y z", "X  y\nz", "x y", "", " ", None, "a b c d e", "a b c d e f"]
    draw.shuffle(texts)
    docs = documents(spark, texts).repartition(5)
    check(by_id(jaccard_join.jaccard_groups(docs, frequent=frequent)), dict(enumerate(texts)))


def test_chains_link_through_others(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[at : at + 200]) for at in range(0, 200, 15)]
    texts += [" ".join(words[at : at + 100]) for at in range(0, 300, 14)]
    draw = random.Random(0)
    draw.shuffle(texts)
    check(by_id(jaccard_join.jaccard_groups(documents(spark, texts))), dict(enumerate(texts)))


def test_blocks_and_lookups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    draw = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [edited(draw, base, draw.randint(0, 5)) for _ in range(120)]
    check(by_id(jaccard_join.jaccard_groups(documents(spark, texts))), dict(enumerate(texts)))


def joined_rows(plan):
    """The rows that each join of a plan that ran has made."""
    name, found = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if "QueryStage" in name:
        return joined_rows(plan.plan())
    if "Join" in name and plan.metrics().contains("numOutputRows"):
        found.append(plan.metrics().apply("numOutputRows").value())
    children = plan.children()
    return found + [n for k in range(children.size()) for n in joined_rows(children.apply(k))]


def test_a_pair_of_trees_meets_once_not_in_each_shared_list(spark, monkeypatch):
    draw = random.Random(4)
    base = [f"w{k}" for k in range(240)]
    texts = [edited(draw, base, 14) for _ in range(70)]  # similar, but most not linked
    passage = [f"p{k}" for k in range(60)]  # a quarter of its documents
    texts += [" ".join([*passage, *(f"o{draw.randrange(10**9)}" for _ in range(180))]) for _ in range(70)]
    real, made = jaccard_join.stored, []

    def counted(df, label):
        if label in ("met", "roots"):
            df.collect()
            made.extend(joined_rows(df._jdf.queryExecution().executedPlan()))
        return real(df, label)

    monkeypatch.setattr(jaccard_join, "stored", counted)
    check(by_id(jaccard_join.jaccard_groups(documents(spark, texts), frequent=0)), dict(enumerate(texts)))
    assert 0 < max(made) <= 3 * (70 * 69 // 2)  # pairs of the similar ones; each shares dozens of lists


def test_sizes_at_the_ends_of_links(spark):
    draw, texts = random.Random(6), []
    for size in range(5, 75):
        words = [f"{size}-{k}" for k in range(size + 4)]
        for part in (80, 81, 90, 99):  # a beginning, the whole of which is shared
            texts.append(" ".join(words[: max(5, -(-size * part // 100) + 4)]))
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words, *"xyz"])]
    draw.shuffle(texts)
    check(by_id(jaccard_join.jaccard_groups(documents(spark, texts), frequent=40)), dict(enumerate(texts)))


def test_trees_of_many_lists_are_compared_without_counting(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LISTS", 10)
    draw = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = [edited(draw, base, draw.randint(0, 9)) for _ in range(90)]
    check(by_id(jaccard_join.jaccard_groups(documents(spark, texts))), dict(enumerate(texts)))


def test_odd_rows(spark):
    same = "one two three four five six"
    docs = documents(
        spark, [same, same, same, None, "", "long " * 50_000, same], ids=[9, 9, None, None, 4, 5, 2]
    ).selectExpr("*", "1 AS uid", "2 AS n", "3 AS key")
    found = rows(jaccard_join.jaccard_groups(docs))
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in found) == sorted(
        [(2, 2)] * 4 + [(0, -1), (0, 4), (1, 5)]
    )
    assert jaccard_join.jaccard_groups(empty(spark)).collect() == []


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in rows(read(spark, sf_dir))}
    found = by_id(queries.registered()["op3_jaccard_join"](spark, sf_dir))
    assert found.keys() == texts.keys()
    check(found, texts)


def brute_links(texts):
    """doc_id -> (class_id, n_links), comparing all pairs."""
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    found = {}
    for i, a in sets.items():
        linked = sum(
            100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items() if j != i and a and b
        )
        found[i] = (first[a] if a else i, linked)
    return found


@pytest.mark.parametrize("block", [4, 30, 256])
def test_links_are_counted_inside_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    draw = random.Random(block)
    base = [f"w{k}" for k in range(90)]
    texts = [edited(draw, base, draw.randint(0, 9)) for _ in range(150)] + [" ".join(base)] * 5
    words = [f"v{k}" for k in range(900)]
    texts += [" ".join(words[: 40 + k * 9]) for k in range(90)]
    texts += ["x y z", "X  y\nz", "x y", "", " ", None]
    draw.shuffle(texts)
    texts = dict(enumerate(texts))
    found = by_id(jaccard_join.jaccard_links(documents(spark, list(texts.values())).repartition(3)))
    check(found, texts)
    expected = brute_links(texts)
    assert max(n for _, n in expected.values()) > 20
    assert {i: (r["class_id"], r["n_links"]) for i, r in found.items()} == expected


def test_links_of_odd_rows(spark):
    same, near = "one two three four five six", " ".join(f"w{k}" for k in range(60))
    docs = documents(
        spark, [same, same, same, None, near, near + " x", near], ids=[9, 9, None, None, 4, 5, 4]
    )
    found = rows(jaccard_join.jaccard_links(docs))
    assert sorted((r["class_id"] or -1, r["n_links"]) for r in found) == sorted(
        [(9, 2)] * 3 + [(-1, 0)] + [(4, 2)] * 2 + [(5, 2)]
    )
    assert jaccard_join.jaccard_links(empty(spark)).collect() == []
