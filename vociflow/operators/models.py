"""Model-backed functions over texts (N5-N8): Arrow batches go to a callable that the caller gives, as no model is here.

A model is made once in a task by a factory without arguments, so that what it loads is not sent to executors, and gets
lists of texts of bounded length. Each function gives a DataFrame with its result beside the other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Texts that a model gets at once, and characters of a text that the sentiment model reads.
BATCH, SENTIMENT_CHARS = 50, 2000
#: The classes of the sentiment model.
LABELS = ("positive", "neutral", "negative")
SENTIMENT = "struct<label: string, score: double, positive: double, neutral: double, negative: double, method: string>"
ENTITIES = "array<struct<text: string, type: string, start: int, end: int>>"
LANGUAGE = "struct<language: string, confidence: double>"


def apply_model(df: DataFrame, text: str, result: str, kind: str, make: Callable[[], Callable[[list[str]], list]], failed=None, batch: int = BATCH) -> DataFrame:
    """df with a column of what a model gives for each text; null texts are empty ones.

    failed(text) stands for the results of a whole batch whose call raises; without it the error is raised.
    """
    of = _parse_datatype_string(kind)
    schema, arrow = StructType([*df.schema.fields, StructField(result, of)]), to_arrow_type(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                try:
                    found = list(model(texts))
                    if len(found) != len(texts):
                        raise ValueError(f"{len(found)} results for {len(texts)} texts")
                except Exception:
                    if failed is None:
                        raise
                    found = [failed(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], [*part.schema.names, result])

    return df.mapInArrow(run, schema)


def _distribution(scores: dict[str, float]) -> dict:
    found = {k.lower(): v for k, v in scores.items()}
    top = max(found, key=found.get)
    return {"label": top, "score": round(found[top], 4), **{k: round(found.get(k, 0.0), 4) for k in LABELS}, "method": "model"}


def sentiment(df: DataFrame, make: Callable, text: str = "text", result: str = "sentiment") -> DataFrame:
    """Label, score and whole distribution, to four digits (N5): the model gets the first SENTIMENT_CHARS characters of each
    text and gives a score for each class. A batch whose call fails is neutral with score 0.5 and method fallback_error (N11).
    """
    lost = {"label": "neutral", "score": 0.5, "positive": 0.0, "neutral": 0.5, "negative": 0.0, "method": "fallback_error"}

    def cut():
        model = make()
        return lambda texts: [_distribution(s) for s in model([t[:SENTIMENT_CHARS] for t in texts])]

    return apply_model(df, text, result, SENTIMENT, cut, lambda _: lost)


def lemmas(df: DataFrame, make: Callable, text: str = "text", result: str = "lemmas") -> DataFrame:
    """The normal form of each word between white space (N6): the model gives the parses of a word, of which the first counts."""

    def each():
        model = make()
        return lambda texts: [[model(w)[0] for w in t.split()] for t in texts]

    return apply_model(df, text, result, "array<string>", each)


def embeddings(df: DataFrame, make: Callable, text: str = "text", result: str = "vector") -> DataFrame:
    """A vector for each text (N7); empty where a batch fails."""
    return apply_model(df, text, result, "array<float>", make, lambda _: [])


def similarity(pairs: DataFrame, make: Callable, a: str = "a", b: str = "b", result: str = "similarity") -> DataFrame:
    """The cosine of the vectors of two texts, to four digits."""
    both = embeddings(embeddings(pairs, make, a, "__a"), make, b, "__b")
    return both.withColumn(result, F.round(cosine(F.col("__a"), F.col("__b")), 4)).drop("__a", "__b")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, -1 to 1; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def entities(df: DataFrame, make: Callable, text: str = "text", result: str = "entities") -> DataFrame:
    """Named entities with their type and place (N8): the model gives (type, start, end) for each."""

    def named():
        model = make()
        return lambda texts: [[{"text": t[a:b], "type": k, "start": a, "end": b} for k, a, b in spans] for t, spans in zip(texts, model(texts), strict=True)]

    return apply_model(df, text, result, ENTITIES, named)


def language(df: DataFrame, make: Callable, text: str = "text", result: str = "language") -> DataFrame:
    """The likeliest language and its probability, to four digits (N8); unknown with 0 where the model raises or finds none.

    The model gives (language, probability) pairs of one text, likeliest first.
    """

    def first():
        model = make()

        def one(t: str) -> dict:
            try:
                found = model(t)
            except Exception:  # such a model raises for texts without letters
                found = []
            return {"language": found[0][0], "confidence": round(found[0][1], 4)} if found else {"language": "unknown", "confidence": 0.0}

        return lambda texts: [one(t) for t in texts]

    return apply_model(df, text, result, LANGUAGE, first)
