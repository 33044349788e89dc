import zlib

from pyspark.sql import functions as F

from rankloom.llm import langid


def words_model():
    import numpy as np
    return langid.LanguageModel(["de", "en"], {"und": 0, "the": 1}, {"3ing": 2, "1x": 3},
                                np.array([[-0.1, -3.0], [-3.0, -0.1], [-2.0, -0.2], [-0.3, -1.5]]))


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(200).select("id", langid.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_known_words_first_then_longest_known_ngrams():
    m = words_model()
    assert m.word_score("the")[1] > m.word_score("the")[0]
    assert m.word_score("sing").tolist() == [-2.0, -0.2]        # 3-gram "ing"
    assert m.word_score("xy").tolist() == [-0.3, -1.5]          # nothing longer is known
    assert m.word_score("qqq").tolist() == [0.0, 0.0]


def test_grams_see_the_words_ends():
    assert langid.grams_of("ab", 3) == ["^ab", "ab$"]
    assert langid.grams_of("ab", 1) == ["a", "b"]
    assert langid.grams_of("ab", 5) == []


def test_predict_defined_cases(docs_of):
    rows = [(1, None, None, None), (2, "", None, None), (3, "12 ## !", None, None), (4, "und UND", None, None),
            (5, "the " * 30000, None, None), (None, "the", "en", "s"), (4, "und UND", None, None), (6, "qqq", None, None)]
    got = langid.predict(docs_of(rows), words_model(), ["doc_id"]).collect()
    by = [(r.doc_id, r.lang_pred) for r in got]
    assert by == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (None, "en"), (4, "de"), (6, "de")]
    assert [r.score for r in got[:3]] == [0, 0, 0] and [r.known for r in got[:3]] == [0, 0, 0]
    assert got[3].known == (2 + 2.5) / (2 + 5) and got[-1].known == 2.5 / 6
    assert all(0 <= r.score <= 1 for r in got) and got[-1].score == 0.5


def test_nothing_to_learn_from(docs_of, spark):
    assert [(r.lang_pred, r.score) for r in langid.identify(docs_of([(1, "abc", None, None)])).collect()] == [("und", 0.0)]
    assert langid.identify(docs_of([])).collect() == []


def test_accuracy_on_held_out_rows(table):
    docs = table("documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.97


def test_labels_are_no_input_of_a_prediction(table):
    docs = table("documents")
    hidden = docs.withColumn("lang", F.when(langid.fold("doc_id") != 0, F.col("lang"))).withColumn("source", F.lit("x"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(docs).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(hidden).collect()}
    assert a == b


def plain_prediction(docs, folds=5):
    """Counts, tables and predictions of whole texts in plain Python, from every row outside the fold (tables
    small enough that the sample and the vocabularies are whole)."""
    import collections
    import math
    counts = collections.defaultdict(collections.Counter)
    for doc_id, text, lang in docs:
        if lang is None or zlib.crc32(str(doc_id).encode()) % folds == 0:
            continue
        for w in langid.words_of(text or ""):
            counts[lang, "0"][w] += 1
            for n in langid.LENGTHS:
                counts[lang, str(n)].update(langid.grams_of(w, n))
    langs = sorted({lang for lang, _ in counts})
    kinds = {(x, n): (sum(counts[x, n].values()), len(counts[x, n])) for x in langs for n in "054321"}

    def logs(n, g):
        if not any(g in counts[x, n] for x in langs):
            return None
        raw = [math.log(counts[x, n][g] + langid.SMOOTHING) - math.log(kinds[x, n][0] + langid.SMOOTHING * (kinds[x, n][1] + 1)) for x in langs]
        z = math.log(sum(math.exp(r) for r in raw))
        return [r - z for r in raw]

    out = {}
    for doc_id, text, _ in docs:
        words = langid.words_of(text or "")
        total = [0.0] * len(langs)
        for w in words:
            found = [x for x in [logs("0", w)] if x]
            for n in langid.LENGTHS if not found else ():
                found = [x for g in langid.grams_of(w, n) if (x := logs(str(n), g))]
                if found:
                    break
            total = [t + sum(f[i] for f in found) / max(1, len(found)) for i, t in enumerate(total)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        score = 1 / sum(math.exp(t - total[best]) for t in total)
        out[doc_id] = (langs[best], score) if words else ("und", 0.0)
    return out


def test_predictions_equal_a_plain_computation(docs_of, table):
    rows = [(r.doc_id, r.text[:400], r.lang) for r in table("documents").select("doc_id", "text", "lang").limit(60).collect()]
    rows += [(1000, "", "en"), (1001, "zzzqq", None)]
    want = plain_prediction(rows)
    for r in langid.identify(docs_of([(i, t, x, "s") for i, t, x in rows])).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3, r


def test_words_hold_marks_and_end_at_numerals():
    assert langid.words_of("km² नमस्ते x1y a_b É\u0301t") == ["km", "नमस्ते", "x", "y", "a", "b", "é\u0301t"]


def test_many_languages_fit_a_bounded_model(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 4 * 300 * 300 * 80)
    monkeypatch.setattr(langid, "NUMBERS", 1 << 14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, j: "".join(letters[(k * 7 + j * 11 + i * (k % 5 + 1)) % 26] for i in range(5)) + letters[k % 26] + letters[k // 26]
    rows = [(1000 * k + j, " ".join(word(k, x % 9) for x in range(40)), f"l{k:03d}", "s") for k in range(300) for j in range(3)]
    docs = docs_of(rows)
    model = langid.learn(docs)
    assert model.table.nbytes <= langid.MODEL_BYTES and len(model.langs) >= 290
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows if lang in model.langs) > 0.9 * len(rows)
    monkeypatch.setattr(langid, "MODEL_BYTES", 1 << 20)
    try:
        langid.learn(docs)
        raise AssertionError("too many languages must be refused")
    except ValueError as e:
        assert "languages" in str(e)


def test_long_texts_go_piece_by_piece(docs_of, monkeypatch):
    rows = [(1, "the und " * 5000, None, None), (2, None, None, None), (3, "und the the", None, None), (4, "the " * 3000, None, None)]
    want = [tuple(r) for r in langid.predict(docs_of(rows), words_model(), ["doc_id"]).collect()]
    monkeypatch.setattr(langid, "NUMBERS", 600)
    assert [tuple(r) for r in langid.predict(docs_of(rows), words_model(), ["doc_id"]).collect()] == want
