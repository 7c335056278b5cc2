import itertools

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language
from tests.llm.corpus import SCHEMA


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark):
    df = documents(spark)
    out = language.language_id(df).join(df.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.count() > 150
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert out.where("score < 0 or score > 1").count() == 0
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)).count() == 0


def test_mixed_text_is_split(spark):
    df = documents(spark)
    model = language.train(df)
    text = {r.lang: r.text for r in df.where("n_chars > 1500").collect()}
    one, two = text["en"][:900].rpartition(" ")[0], text["fr"][:700].rpartition(" ")[0]
    lang, score, spans = next(model.predict([one + " " + two]))
    assert lang == "en" and 0.4 < score < 0.75
    parts = [x.split(":") for x in spans.split(",")]
    assert [p[2] for p in parts] == ["en", "fr"] and abs(int(parts[1][0]) - len(one)) < 60


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(40):
        many = [rng.normal(size=(n, 3)) * 3 for n in (6, 6, 5, 3, 1)]
        p = float(rng.uniform(0, 5))
        m = language.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), p)
        for s, one, other in zip(many, language.viterbi(many, p), m.labels(many)):

            def value(path):
                return sum(s[i, k] for i, k in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))

            best = max(itertools.product(range(3), repeat=len(s)), key=value)
            assert abs(value(best) - value(one)) < 1e-9
            assert abs(value(best) - value(other)) < 1e-9


def test_scripts_and_edges(spark):
    rows = [(i, t, lang, "s", 1, "x", "k", "n", "s", "p", 7, 8) for i, (t, lang) in enumerate([("die katze schläft im haus", "de"), ("кошка спит в доме", "ru"), ("the cat sleeps in the house", "en")] * 40)]
    rows += [(1000, None, "de", *rows[0][3:]), (1001, "", None, *rows[0][3:]), (1002, "12 !! ##", "en", *rows[0][3:]), (1003, "дом и кошка 語", None, *rows[0][3:]), (None, "the house", "en", *rows[0][3:])]
    rows += [(1004, "語" * 4000, "de", *rows[0][3:])]
    out = {r.doc_id: r for r in language.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 1000, 1001, 1002, 1003, None)] == ["de", "ru", "en", "und", "und", "und", "ru", "en"]
    assert out[1000].score == 0 and out[1002].spans == "" and out[1004].lang_pred in ("de", "ru", "en")
    empty = language.language_id(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    nothing = language.language_id(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_held_out_rows_are_never_learned(spark):
    df = documents(spark).limit(300)
    swapped = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language.train(swapped).langs == language.train(df).langs
    assert np.array_equal(language.train(swapped).weight, language.train(df).weight)


def test_shortcut_when_the_best_path_never_uses_the_best_language():
    m = language.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), 14.0)
    assert [list(x) for x in m.labels([np.array([[13.0, -20, 0], [-20, 13, 0]])])] == [[0, 1]]
    rng = np.random.default_rng(7)
    for _ in range(400):  # three languages that rival each other in stretches
        n, p = int(rng.integers(2, 7)), 14.0
        s = rng.choice([13.0, 6.0, 0.0, -7.0, -20.0], (n, 3))
        s[:, 2] = rng.choice([0.0, 1.0], n)

        def value(path):
            return sum(s[i, k] for i, k in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))

        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert abs(best - value(m.labels([s])[0])) < 1e-9
