import math
from collections import Counter

from pyspark.sql import functions as F

from recontact.llm import langid
from recontact.llm.common import fold


def test_held_out_accuracy(documents):
    model = langid.train(documents.where(fold(F.col("doc_id"), 4) != 2).select("lang", "text"))
    rows = langid.predict(documents.where(fold(F.col("doc_id"), 4) == 2), model).collect()
    letters = [r for r in rows if any(c.isalpha() for c in r.text)]
    assert sum(r.lang_pred == r.lang for r in letters) >= 0.97 * len(letters)
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_come_first_then_shorter_grams(spark):
    rows = [("aa", "mela mela pera zzz"), ("bb", "melk melk peer")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    # Known words: log((n + 1/2) / (all + 1/2 (kinds + 1))), the larger number of kinds for all languages.
    assert math.isclose(model.word_scores[model.words["mela"], 0], math.log(2.5 / (4 + 0.5 * 4)))
    assert math.isclose(model.word_scores[model.words["mela"], 1], math.log(0.5 / (3 + 0.5 * 4)))
    # "^mel" is known at four characters; at five only "^mela" and "^melk" are.
    unseen = model.unseen("melo")
    assert math.isclose(unseen[0], sum(model.gram_scores[model.grams[g], 0] for g in ("^mel",)) / 1)
    assert model.unseen("qqq") is None
    assert model.predict("mela")[0] == "aa" and model.predict("melk peer")[0] == "bb"


def test_undetermined_ties_and_odd_rows(spark, odd, nothing):
    model = langid.train(odd.select("lang", "text"))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    tied = langid.train(spark.createDataFrame([("b", "x"), ("a", "x")], "lang string, text string"))
    assert tied.predict("x") == ("a", 0.5)
    empty = langid.train(nothing.select("lang", "text"))
    assert empty.predict("words") == ("und", 0.0)
    assert langid.predict(nothing, model).collect() == []


def test_a_text_is_all_that_counts(documents):
    model = langid.train(documents.select("lang", "text"))
    changed = documents.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents, model).collect()}
    b = {-r.doc_id: (r.lang_pred, r.score) for r in langid.predict(changed, model).collect()}
    assert a == b


def score_of(counts, kinds, totals, grams, text):
    """The definition, word by word, over plain dictionaries: langs -> log score."""
    total = dict.fromkeys(totals, 0.0)
    for word in langid.words_in(text):
        if any(word in counts[lang] for lang in counts):
            for lang in totals:
                total[lang] += math.log((counts[lang].get(word, 0) + 0.5) / (totals[lang] + 0.5 * (kinds + 1)))
            continue
        for n in langid.ORDERS:
            known = [g for g in langid.grams_of(word, n) if any(g in grams[lang][n] for lang in grams)]
            if known:
                most = max(len(grams[lang][n]) for lang in grams)
                for lang in totals:
                    below = sum(grams[lang][n].values()) + 0.5 * (most + 1)
                    total[lang] += sum(math.log((grams[lang][n].get(g, 0) + 0.5) / below) for g in known) / len(known)
                break
    return total


def test_against_the_definition_whatever_the_tasks_hold(documents):
    rows = [(r.lang, r.text) for r in documents.collect()]
    learned = rows[:150]
    langs = sorted({lang for lang, _ in learned})
    counts = {lang: Counter(w for x, t in learned if x == lang for w in langid.words_in(t)) for lang in langs}
    grams = {lang: {n: Counter() for n in langid.ORDERS} for lang in langs}
    for lang in langs:
        for word, times in counts[lang].items():
            for n in langid.ORDERS:
                for gram in langid.grams_of(word, n):
                    grams[lang][n][gram] += times
    totals, kinds = {lang: sum(counts[lang].values()) for lang in langs}, max(len(c) for c in counts.values())
    spark = documents.sparkSession
    table = spark.createDataFrame(learned, "lang string, text string")
    for bound in (langid.MAX_WORDS, 100, 1):
        model = langid.train(table, max_words=bound, max_grams=1_000_000)
        for r in langid.predict(documents, model).collect():
            scores = score_of(counts, kinds, totals, grams, r.text)
            if not langid.words_in(r.text):
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            best = max(scores, key=lambda x: (scores[x], [-ord(c) for c in x]))
            assert r.lang_pred == best and math.isclose(r.score, 1 / sum(math.exp(v - scores[best]) for v in scores.values()), rel_tol=1e-6)


def test_words_seen_once_are_known_beyond_the_bound(spark):
    rows = [("aa", " ".join(f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(400))), ("bb", "other words")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), max_words=100)
    assert 40 <= sum(w.startswith("w") for w in model.words) <= 180
    found = langid.predict(spark.createDataFrame([(i, w) for i, w in enumerate(rows[0][1].split())], "i int, text string"), model).collect()
    assert len({round(r.score, 8) for r in found}) == 1 and {r.lang_pred for r in found} == {"aa"}


def test_letters_and_their_marks(spark):
    assert langid.words_in("हिन्दी e\u0301te ½ ² 3rd 𐐀𐐁 _x_") == ["हिन्दी", "e\u0301te", "rd", "𐐨𐐩", "x"]
    model = langid.train(spark.createDataFrame([("de", "ein wort"), ("hi", "हिन्दी")], "lang string, text string"))
    docs = spark.createDataFrame([(1, "½ ²"), (2, "\u0301"), (3, "हिन्दी"), (4, "wort"), (5, "12 _ ٣")], "base int, text string")
    rows = {r.base: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert rows[1] == rows[2] == rows[5] == ("und", 0.0) and rows[3][0] == "hi" and rows[4][0] == "de"


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    import pytest
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(str(i), "a") for i in range(3)], "lang string, text string"))
