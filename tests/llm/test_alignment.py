import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from goldseam.llm import alignment, queries
from goldseam.llm.alignment import Batch, PieceEncoder, alignments, tokenizers, with_counts
from goldseam.llm.common import documents as read, stored
from goldseam.llm.tokens import byte_letters, piece_vocabulary_path, vocabulary_path
from tests.llm.tables import by_id, documents, empty, rows

A, B = vocabulary_path(), piece_vocabulary_path()
BITS = alignment.BITS


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of the tokens of a text, by the libraries alone."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    names = {i: name for name, i in library.get_vocab().items()}
    letters = byte_letters()
    byte_of = {chr(letters.get(b, b)): b for b in range(256)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)

    def encode(text):
        if not text:
            return [], []
        a = library.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(byte_of[c] for c in names[i])) for i in a]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            said = bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
            b.append((i, said))
        data = (" " + text).encode()
        if any(b"".join(said for _, said in side) != data for side in (a, b)):
            return [], []
        return a, b

    return encode


def grouped(a, b):
    """Groups of (ids A, ids B), by walking over both sides."""
    groups, i, j = [], 0, 0
    while i < len(a):
        group, end_a, end_b = ([a[i][0]], [b[j][0]]), len(a[i][1]), len(b[j][1])
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                group[0].append(a[i][0])
                end_a, i = end_a + len(a[i][1]), i + 1
            else:
                group[1].append(b[j][0])
                end_b, j = end_b + len(b[j][1]), j + 1
        groups.append(group)
    return groups


def n_overlaps(a, b):
    found, i, j, end_a, end_b = 0, 0, 0, len(a[0][1]) if a else 0, len(b[0][1]) if b else 0
    while i < len(a):
        found += 1
        step = end_a - end_b
        if step <= 0:
            i += 1
            end_a += len(a[i][1]) if i < len(a) else 0
        if step >= 0:
            j += 1
            end_b += len(b[j][1]) if j < len(b) else 0
    return found


def expected(texts, plain):
    """The result row of every text, but for doc_id."""
    every, found = [], []
    for text in texts:
        a, b = plain(text)
        groups = grouped(a, b)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        every.append((len(a), len(b), groups, n_overlaps(a, b), links))
    documents_with = Counter(pair for *_, links in every for pair in links)
    highest = defaultdict(int)
    for (x, _), n in documents_with.items():
        highest[x] = max(highest[x], n)
    for n_a, n_b, groups, over, links in every:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        found.append(
            {
                "n_a": n_a,
                "n_b": n_b,
                "n_groups": len(groups),
                "n_overlaps": over,
                "n_links": sum(links.values()),
                "n_best": sum(n for p, n in links.items() if documents_with[p] == highest[p[0]]),
                "count_sum": sum(n * documents_with[p] for p, n in links.items()),
                "groups": said,
                "links": links,
            }
        )
    return found


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "  a   b ", "x\ty\n z\r\n\n  w", "\x00 a\x00b", "▁a b", "a▁",
    "<s> </s> <unk> <0x41> <|endoftext|>", "é ü   　x  ", "日本語 のテキスト 𝄞𝄞 😀😀😀", "a" * 500,
    "ﬁ ½ ①", "é ﻿", " " * 70 + "x" + " " * 33, "don't we'll 3.14 --- ... http://x.y/z?q=1",
]


def test_pieces_are_those_of_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=B), PieceEncoder(B, cache_pieces=50)
    assert own._cuts
    draw = random.Random(5)
    parts = [" ", "  ", "\n", "ab", "the", "Ünd", "日", "▁", "😀", "x", "'s", "\t", "0x41", "<s>", "\x00"]
    texts = [t for t in ODD if t] + ["".join(draw.choices(parts, k=draw.randint(1, 20))) for _ in range(2_000)]
    for text in texts:
        ids, found = library.encode(text), own.encode(text)
        same = own.said(np.array(ids)) == (" " + text).encode()
        assert (found.tolist() if same else found) == (ids if same else None), repr(text)


@pytest.mark.parametrize("limit", [1, 7, 100_000])
def test_batches_against_walking(plain, limit, monkeypatch):
    draw = random.Random(limit)
    parts = ["the ", "internationalization ", "zxq", "😀", "日本", " ", "\n", "aaaaaaa", "don't ", "3.1415 "]
    texts = [t or "" for t in ODD] + ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(60)]
    for group_links in (1 << 20, 2):
        monkeypatch.setattr(alignment, "GROUP_LINKS", group_links)
        batch = Batch(tokenizers(A, B), limit)
        for text in texts:
            batch.add(text)
        columns = [c.to_pylist() for c in batch.results()]
        for text, want, row in zip(texts, expected(texts, plain), zip(*columns, strict=True), strict=True):
            n_a, n_b, n_groups, over, n_links, groups, pairs, links = row
            assert (n_a, n_b, n_groups, over, n_links) == tuple(
                want[k] for k in ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
            ), repr(text)
            assert groups == want["groups"] and pairs == sorted(pairs)
            found = {(p >> BITS, p & ((1 << BITS) - 1)): n for p, n in zip(pairs, links, strict=True)}
            assert found == dict(want["links"])


def test_odd_tables_blocks_and_clashing_names(spark, plain):
    texts = ODD + ["the same text", "the same text", "the other text " * 3000]
    ids = [*range(len(texts) - 2), 7, None]
    docs = documents(spark, texts, ids=ids).selectExpr("*", "1 AS pairs", "2 AS n", "3 AS groups")
    found = stored(alignments(docs, A, B, batch_tokens=100), "alignments")
    want = sorted(map(str, values(expected(texts, plain))))
    for block_pairs in (2_000_000, 60):
        given = rows(with_counts(found, block_pairs))
        assert sorted(map(str, values(given))) == want
        assert sorted(str(r["doc_id"]) for r in given) == sorted(map(str, ids))
    nothing = alignments(empty(spark), A, B)
    assert nothing.collect() == [] and with_counts(stored(nothing, "alignments")).collect() == []
    bare = stored(alignments(documents(spark, [None, ""]), A, B), "alignments")
    assert {r["count_sum"] for r in rows(with_counts(bare))} == {0}


def values(given):
    names = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups", "n_best", "count_sum")
    return [tuple(r[k] for k in names) for r in given]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_over_the_whole_table(spark, plain, scale):
    sf_dir = f"/root/testdata/{scale}"
    found = by_id(queries.registered()["op12_alignment"](spark, sf_dir))
    texts = {r["doc_id"]: r["text"] for r in rows(read(spark, sf_dir))}
    assert found.keys() == texts.keys()
    for i, want in zip(texts, expected(texts.values(), plain), strict=True):
        del want["links"]
        groups = want.pop("groups")
        want["groups_sha256"] = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert found[i] == want | {"doc_id": i}
