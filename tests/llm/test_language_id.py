"""Held-out accuracy, the ladder of n-grams, and what the predictions look at."""

import math
import unicodedata

from pyspark.sql import functions as F

from mailsieve.llm import language_id as L
from mailsieve.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_language_id"](spark, sf).join(docs, "doc_id").filter("held_out")
    assert out.count() > 150
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def toy(spark):
    rows = [(i, "the house and the garden", "en") for i in range(9)] + [(10 + i, "das haus und der garten", "de") for i in range(9)]
    return spark.createDataFrame([*rows, (50, None, "en"), (51, "rien", None)], "doc_id long, text string, lang string")


def test_ladder(spark):
    model = L.fit(toy(spark), docs_per_lang=10_000)
    assert model.langs == ["de", "en"]
    assert model.predict("The GARDEN")[0] == "en" and model.predict("und haus")[0] == "de"
    # An unseen word goes by its longest known n-grams, one without any by chance.
    assert "hausen" not in model.tables[0] and model.predict("hausen")[0] == "de"
    assert 0.45 < model.predict("żżż")[1] < 0.55


def test_edges(spark):
    df = toy(spark)
    model = L.fit(df)
    rows = [(1, None), (2, ""), (3, "12 !? _"), (4, "garden " * 50_000), (4, "garden"), (None, "haus")]
    out = L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "en", "de"]
    assert all(0 <= r.score <= 1 for r in out)
    nothing = L.fit(df.filter("lang IS NULL"))
    assert L.predict(df, nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    assert L.predict(df.limit(0), model).count() == 0


def test_only_the_text_is_looked_at(spark):
    model = L.fit(toy(spark))
    df = toy(spark)
    a = L.predict(df, model).collect()
    b = L.predict(df.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(9)), model).collect()
    assert a == b


def plain_predict(model, text):
    """Words character by character, scores language by language."""
    found, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        else:
            if any(unicodedata.category(x)[0] == "L" for x in word):
                found.append(word)
            word = ""
    if not found:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for w in found:
        for k in range(len(model.langs)):
            if w in model.tables[0]:
                total[k] += model.scores[0][model.tables[0][w], k]
                continue
            for n in range(5, 0, -1):
                padded = L.EDGE + w + L.EDGE
                rows = [model.tables[n][padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in model.tables[n]]
                if rows:
                    total[k] += sum(model.scores[n][r, k] for r in rows) / len(rows)
                    break
    odds = [math.exp(t - max(total)) for t in total]
    best = odds.index(max(odds))
    return model.langs[best], odds[best] / sum(odds)


def test_predict_against_plain_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs)
    texts = ["½", "②Ⅷ", "１２", "́", "áb", "हिन्दी में", "naïve x² Größe", "l'été 3e", None, "", "́ ́a", "ﬀ İstanbul"]
    texts += [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    for text in texts:
        lang, score = model.predict(text)
        want = plain_predict(model, text)
        assert lang == want[0] and math.isclose(score, want[1], rel_tol=1e-9, abs_tol=1e-12), text
    assert [model.predict(t)[0] for t in texts[:4]] == ["und"] * 4


def test_learning_and_prediction_part_words_alike(spark):
    texts = ["हिन्दी में ½ x", "áb ́ ć", "l'été n°3 ﬀ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    java = df.select(F.regexp_extract_all(F.lower("t"), F.lit(L.WORD), F.lit(0)).alias("w")).collect()
    assert [r.w for r in java] == [L.words_in(t.lower()) for t in texts]
