"""Language identification with hyperdimensional profiles (operator 9).

Every letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors, rotated by their places
and multiplied; a text's vector is the bundle (sum) of its trigrams; a language's prototype is the bundle of its
training texts. A text takes the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import hold, slices, texts_of, tidy

#: Dimensions of the vectors, and the seed of the letters' random vectors.
DIMENSIONS, SEED = 1024, 20241
#: Texts that are read together, and distinct trigrams whose vectors are made together: bounds memory in any script.
TEXTS, CODES = 400, 16_384
#: Languages that may be learnt: bounds the model, of languages x DIMENSIONS numbers, on the driver and in tasks.
MAX_LANGUAGES = 1000
#: Predicted for texts without letters.
UNKNOWN = "und"
#: Cosine under which the filter rejects a text as no known language, if it has so many trigrams or more; the fewer it has,
#: the more its cosine is left to chance, and the bound falls with the root of their number.
MIN_SCORE, MIN_TRIGRAMS = 0.22, 250

_space = np.uint32(32)


class _Letters:
    """What a worker keeps: which characters are letters, and the vectors of those seen."""

    def __init__(self):
        self.alphabetic = np.array([chr(i).isalpha() for i in range(0x10000)])
        self.vectors: dict[tuple[int, int], np.ndarray] = {}


def _is_letter(points: np.ndarray) -> np.ndarray:
    low = points < 0x10000
    table = hold("letters", _Letters).alphabetic
    found = table[np.where(low, points, 0)]
    if not low.all():
        found[~low] = [chr(p).isalpha() for p in points[~low]]
    return found


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of a lower-cased text, where any run of other characters is one space."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(points)
    points = np.where(letter, points, _space)
    points = points[letter | np.concatenate([[True], letter[:-1]])].astype(np.int64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _letter_vector(point: int, dimensions: int) -> np.ndarray:
    vectors, key = hold("letters", _Letters).vectors, (point, dimensions)
    if key not in vectors:
        if len(vectors) > 20_000:
            vectors.clear()
        vectors[key] = (np.random.default_rng([SEED, point]).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
    return vectors[key]


def bind(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A vector for each trigram code: its letters' vectors, rotated by two, one and no places, multiplied."""
    out = np.ones((len(codes), dimensions), np.int8)
    for shift, roll in ((42, 2), (21, 1), (0, 0)):
        points, inverse = np.unique(codes >> shift & 0x1FFFFF, return_inverse=True)
        if len(points):
            vectors = np.stack([np.roll(_letter_vector(int(p), dimensions), roll) for p in points])
            out *= vectors[inverse]
    return out


def bundle(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and its number of trigrams."""
    each = [np.unique(trigrams(t), return_counts=True) for t in texts]
    codes = np.unique(np.concatenate([c for c, _ in each])) if each else np.empty(0, np.int64)
    out = np.zeros((len(texts), dimensions), np.float32)
    for a in range(0, len(codes), CODES):
        some = codes[a : a + CODES]
        vectors = bind(some, dimensions)
        for i, (own, counts) in enumerate(each):
            lo, hi = (0, len(own)) if len(codes) <= CODES else np.searchsorted(own, (some[0], some[-1] + 1))
            if hi > lo:
                out[i] += counts[lo:hi].astype(np.float32) @ vectors[np.searchsorted(some, own[lo:hi])].astype(np.float32)
    return out, np.array([int(n.sum()) for _, n in each], np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: the sum of its texts' vectors, a row for each dimension; sums are whole numbers."""
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, TEXTS):
        each = [trigrams(t) for t in batch["text"].to_pylist()]
        langs = batch["lang"].to_pylist()
        numbers = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        owner = np.repeat([numbers[x] for x in langs], [len(c) for c in each])
        codes, inverse = np.unique(np.concatenate(each), return_inverse=True)
        for a in range(0, len(codes), CODES):
            own = (inverse >= a) & (inverse < a + CODES)
            size = min(CODES, len(codes) - a)
            counts = np.bincount(owner[own] * size + inverse[own] - a, minlength=len(numbers) * size).reshape(-1, size)
            # Whole numbers below 2^24 are exact in this type.
            found = counts.astype(np.float32) @ bind(codes[a : a + size]).astype(np.float32)
            for lang, total in zip(numbers, found, strict=True):
                sums[lang] = sums.get(lang, 0) + total.astype(np.int64)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(range(len(total)), pa.int32()), pa.array(total)], ["lang", "dim", "value"])


def learn_prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all rows (text, lang) with a language.

    Tasks send sums of DIMENSIONS numbers for each language, however many texts they read.
    """
    rows = texts_of(labelled).where("lang is not null and text is not null").select("text", "lang")
    sums = rows.mapInArrow(tidy(_learn), "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found = sums.limit(MAX_LANGUAGES * DIMENSIONS + 1).toPandas()
    if len(found) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not len(found):
        return [], np.zeros((0, DIMENSIONS), np.float32)
    wide = found.pivot(index="lang", columns="dim", values="value").sort_index().astype(float)
    norms = np.linalg.norm(wide.to_numpy(), axis=1, keepdims=True)
    return list(wide.index), (wide.to_numpy() / np.maximum(norms, 1e-12)).astype(np.float32)


def classify(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine (0 to 1) and number of trigrams of each text; UNKNOWN and 0 for texts without letters or without a model."""
    vectors, sizes = bundle(texts)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), sizes
    cosines = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)) @ prototypes.T
    best = cosines.argmax(axis=1) if len(texts) else np.empty(0, int)
    score = np.clip(cosines.max(axis=1, initial=0.0), 0, 1).astype(float)
    return [langs[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0), sizes


def predict_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs.

    Null, empty or letterless texts are UNKNOWN with score 0, equal cosines take the first language by name, repeated
    rows are all returned, and other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            found, score, _ = classify(batch["text"].to_pylist(), langs, prototypes)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return texts_of(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {id_type}, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is known: not UNKNOWN, and with a cosine of min_score at least, less for short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            found, score, sizes = classify(batch["text"].to_pylist(), langs, prototypes)
            least = min_score * np.sqrt(np.minimum(1, sizes / MIN_TRIGRAMS))
            yield batch.filter(pa.array([f != UNKNOWN and s >= m for f, s, m in zip(found, score, least, strict=True)], pa.bool_()))

    return texts_of(docs).mapInArrow(tidy(run), docs.schema)
