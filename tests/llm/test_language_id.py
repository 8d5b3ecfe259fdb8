import zlib

from goldseam.llm import language_id, queries
from goldseam.llm.common import documents as read
from tests.llm.tables import by_id, documents, empty, rows

ENGLISH = "the ship and the shore were seen by those who had been there before with others "
GERMAN = "das schiff und die küste wurden von denen gesehen die zuvor schon dort gewesen waren "
FRENCH = "le bateau et la côte ont été vus par ceux qui avaient déjà été là avec les autres "


def labelled(spark, extra):
    said = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH}
    texts = [f"{said[name]} {k} {said[name][k:]}" for name in said for k in range(20)]
    langs = [name for name in said for _ in range(20)]
    return documents(spark, texts + extra, langs=langs + [None] * len(extra))


def test_short_and_long_texts(spark):
    extra = ["They were there with the others", "Die Küste und das Schiff", ENGLISH * 3000, FRENCH]
    found = by_id(language_id.language_id(labelled(spark, extra)))
    assert [found[60 + k]["lang_pred"] for k in range(4)] == ["en", "de", "en", "fr"]
    assert all(found[60 + k]["accepted"] and 0.5 < found[60 + k]["score"] <= 1 for k in range(4))
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_copies_do_not_thin_the_sample(spark):
    words = [f"{GERMAN} {chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + k % 7)}q" for k in range(150)]
    docs = documents(spark, words, langs=["de"] * 150)
    copies = documents(spark, [GERMAN], langs=["de"]).crossJoin(spark.range(200_000)).drop("id")
    learned = language_id.learn(docs.unionByName(copies)).dictionaries
    own = [w.rsplit(" ", 1)[1].encode() for w in words]
    assert sum(w in learned["de"] for w in own) >= 100


def test_texts_without_letters_are_unknown(spark):
    found = by_id(language_id.language_id(labelled(spark, [None, "", "12 + 3 = 15 %%", "q"])))
    for k in range(3):
        r = found[60 + k]
        assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    assert found[63]["lang_pred"] in ("en", "de", "fr")


def test_numbers_that_are_word_characters_are_no_letters():
    found = language_id.Languages({"de": b"der die das und", "en": b"the and of"})
    assert [found.identify(t)[0] for t in ("\u00bd \u2461", "\u2167 \u00b2_", "42 \u0665")] == ["und"] * 3
    assert found.identify("\u2167 der und")[0] == "de"


def test_nothing_learned_and_empty_tables(spark):
    docs = documents(spark, ["some text", None], langs=[None, "en"])
    assert {r["lang_pred"] for r in rows(language_id.language_id(docs))} == {"und"}
    assert language_id.language_id(empty(spark)).collect() == []
    one = documents(spark, [ENGLISH] * 4, ids=[None, None, 3, 3])
    found = rows(language_id.language_id(one))
    assert len(found) == 4 and {r["lang_pred"] for r in found} == {"en"}


def test_prediction_ignores_the_other_columns(spark):
    docs = labelled(spark, []).where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1")
    wrong = labelled(spark, []).unionByName(docs.selectExpr(
        "doc_id", "text", "'fr' AS lang", "'x' AS source", "n_chars"))
    found = rows(language_id.language_id(wrong))
    said = {}
    for r in found:
        said.setdefault(r["doc_id"], set()).add(r["lang_pred"])
    assert all(len(v) == 1 for v in said.values())


def test_filter_keeps_accepted_rows_with_their_columns(spark):
    docs = labelled(spark, [None, "%%%"]).selectExpr("*", "1 AS accepted", "2 AS `_found`")
    kept = language_id.in_known_language(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows(kept)) == list(range(60))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in rows(read(spark, sf_dir))}
    found = by_id(queries.registered()["op5_language_id"](spark, sf_dir))
    assert found.keys() == truth.keys()
    held = [i for i, r in found.items() if r["held_out"]]
    right = [found[i]["lang_pred"] == truth[i]["lang"] for i in held]
    assert len(held) > 250 and sum(right) / len(right) > 0.95
    assert sum(r["accepted"] for r in found.values()) > 0.97 * len(found)
