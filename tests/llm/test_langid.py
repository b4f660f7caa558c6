import random

import numpy as np

from scriptorium.llm import langid as L

ALPHABET = {"aa": "abcdeo", "bb": "vwxyzu", "cc": "ñéôßäü"}


def text(lang, words, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(ALPHABET[lang]) for _ in range(r.randint(2, 7))) for _ in range(words))


def test_languages_and_mixtures(spark):
    rows = [(i, text(lang, 30, i), lang, "s", 1) for i in range(300) for lang in [list(ALPHABET)[i % 3]]]
    rows += [(1000, None, "aa", None, 1), (1001, "", None, None, 1), (1002, "12 34 !", "bb", None, 1), (None, text("cc", 5, 7), None, None, None)]
    rows += [(1003, text("aa", 60, 8) + " " + text("bb", 20, 9), "aa", "s", 1), (1004, text("bb", 40_000, 5), None, None, 1), (5, rows[5][1], "cc", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    model = L.learn_languages(frame)
    assert model.languages == list(ALPHABET)
    got = {r["doc_id"]: r for r in L.identify_languages(frame, model).collect()}
    assert all(got[i]["lang_pred"] == list(ALPHABET)[i % 3] for i in range(300))
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[None]["lang_pred"] == "cc" and got[1004]["lang_pred"] == "bb"
    mixed = got[1003]
    assert mixed["lang_pred"] == "aa" and set(mixed["shares"]) == {"aa", "bb"} and abs(mixed["score"] - 0.75) < 0.05
    assert set(got[0]["shares"]) == {"aa"}


def test_nothing_to_learn_from(spark, docs, none):
    model = L.learn_languages(none)
    assert {r["lang_pred"] for r in L.identify_languages(docs, model).collect()} == {"und"}
    assert L.identify_languages(none, model).count() == 0
    assert L.learn_languages(docs, max_rows=2).languages is not None


def test_letters_are_those_of_unicode():
    assert L.WORD.findall("½ ² Ⅷ ⑨ 12 _ 五 é² xⅧy") == ["五", "é", "x", "y"]


def test_numbers_alone_have_no_language(spark):
    rows = [(i, text("aa", 20, i), "aa") for i in range(20)] + [(100, "½ ² Ⅷ", None), (101, "½ abcde ²", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(frame, L.learn_languages(frame)).collect()}
    assert got[100] == "und" and got[101] == "aa"


def many(k):
    """Languages of letters of their own."""
    return {f"l{i:02d}": "".join(chr(0x100 + 8 * i + j) for j in range(8)) for i in range(k)}


def test_a_document_of_seven_languages(spark, monkeypatch):
    for name, letters in many(12).items():
        monkeypatch.setitem(ALPHABET, name, letters)
    rows = [(i, text(f"l{i % 12:02d}", 40, i), f"l{i % 12:02d}") for i in range(240)]
    rows.append((1000, " ".join(text(f"l{k:02d}", 60, 500 + k) for k in range(7)), None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn_languages(frame)
    assert len(model.languages) == 12
    got = {r["doc_id"]: r for r in L.identify_languages(frame, model).collect()}
    assert set(got[1000]["shares"]) == {f"l{k:02d}" for k in range(7)}
    assert all(abs(s - 1 / 7) < 0.05 for s in got[1000]["shares"].values())
    fewer = L.learn_languages(frame, all_grams=120)
    assert len(fewer.languages) == 12 and len(fewer.gain) <= 120


def test_sparse_likelihoods_equal_a_dense_table(spark):
    rows = [(i, text(lang, 30, i), lang) for i in range(60) for lang in [list(ALPHABET)[i % 3]]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn_languages(frame)
    words = sorted({w for _, t, _ in rows[:9] for w in t.split()} | {"zzz", "q"})
    dense = np.tile(model.unseen, (len(model.grams) + 1, 1))
    for g in range(len(model.grams)):
        for k in range(model.ends[g], model.ends[g + 1]):
            dense[g, model.where[k]] += model.gain[k]
    want = np.array([sum(dense[model.grams.get(g, len(model.grams))] for g in L.trigrams(w)) for w in words])
    assert np.allclose(model.likelihoods(words), np.exp(np.maximum(want - want.max(axis=1, keepdims=True), -30)))
