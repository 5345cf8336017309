"""Model functions with doubles in place of models."""

import pytest

from vociflow.operators import models


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string").coalesce(1)


def test_sentiment_gives_the_distribution_and_survives_a_batch(spark):
    def make_sentiment():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError
            assert all(len(t) <= 2000 for t in texts)
            return [{"POSITIVE": 0.15, "NEUTRAL": 0.80004, "NEGATIVE": 0.05}] * len(texts)

        return model

    df = texts(spark, ["fine", None, "x" * 5000, *["word"] * 47, "boom", "with it"])
    got = {r["id"]: r["sentiment"] for r in models.sentiment(df, make_sentiment).collect()}
    assert got[0].asDict() == {"label": "neutral", "score": 0.8, "positive": 0.15, "neutral": 0.8, "negative": 0.05, "method": "model"} == got[2].asDict()
    assert got[50]["method"] == got[51]["method"] == "fallback_error" and got[50]["score"] == 0.5 and got[49]["method"] == "model"


def test_lemmas_take_the_first_parse(spark):
    make = lambda: lambda w: [w.lower().rstrip("s"), "other"]
    assert [r["lemmas"] for r in models.lemmas(texts(spark, ["Cats  dogs", "", None]), make).collect()] == [["cat", "dog"], [], []]


def test_vectors_and_their_cosine(spark):
    make = lambda: lambda ts: [[float(len(t)), 1.0] for t in ts]
    assert [r["vector"] for r in models.embeddings(texts(spark, ["ab"]), make).collect()] == [[2.0, 1.0]]
    pairs = spark.createDataFrame([("ab", "abcd"), ("a", "a")], "a string, b string")
    found = models.similarity(pairs, make)
    assert found.columns == ["a", "b", "similarity"]
    assert [r["similarity"] for r in found.collect()] == [round(9 / (5 * 17) ** 0.5, 4), 1.0]
    broken = lambda: lambda ts: 1 / 0
    assert models.embeddings(texts(spark, ["x"]), broken).first()["vector"] == []
    with pytest.raises(Exception, match="ZeroDivisionError"):
        models.lemmas(texts(spark, ["x"]), broken).collect()


def test_entities_and_languages(spark):
    names = lambda: lambda ts: [[("PER", 0, 3)] if t.startswith("Ann") else [] for t in ts]
    got = [r["entities"] for r in models.entities(texts(spark, ["Ann went", "no"]), names).collect()]
    assert [tuple(e) for e in got[0]] == [("Ann", "PER", 0, 3)] and got[1] == []

    def detect():
        def one(t):
            if not t:
                raise ValueError
            return [("ru", 0.99996), ("bg", 0.1)]

        return one

    got = [tuple(r["language"]) for r in models.language(texts(spark, ["да", None]), detect).collect()]
    assert got == [("ru", 1.0), ("unknown", 0.0)]
    assert models.language(texts(spark, ["a"]).limit(0), detect).count() == 0
