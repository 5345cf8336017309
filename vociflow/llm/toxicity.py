"""Toxicity with a subsequence string kernel, Nystrom landmarks and a support vector machine (operator 3).

Two words are similar by the letter triples that they have in common as subsequences: a triple counts less the more
letters it spans, so that gaps and inserted characters cost something but do not hide a word. A word's similarities to
landmark words are its place in the kernel space (Nystrom), in which a linear support vector machine is trained on
labelled texts. Labels tell that a toxic text has a toxic word at least, and a clean one none (multiple instances): each
text is represented by the word that the machine finds most toxic in it, and the machine learns again from these words,
so that company does not hide an insult and no word is labelled by itself. As the kernel's features are explicit, the
machine folds into one weight for each triple. A text scores as its most toxic word; labels calibrate that to a
probability.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import hold, raw_texts, slices, stage_table, texts_of, tidy

#: Labelled rows of each kind to learn from: the bound of the sample, taken by a hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Landmarks: words that go with toxic labels, and words by a hash. Toxic texts that hold a landmark of the first kind, at least.
MARKED, OTHERS, LEAST_TEXTS = 96, 96, 2
#: Times that the machine chooses each text's word and is trained again.
ROUNDS = 4
#: Letter classes; the decay of a subsequence with its span, the widest span, and the longest piece of a word.
CLASSES, DECAY, SPAN, PIECE = 48, 0.6, 7, 20
#: Words whose scores, and whose counts, a worker keeps; texts scored together.
CACHE_WORDS, COUNTED_WORDS, TEXTS = 200_000, 200_000, 500
#: Digits that stand for letters inside a word.
LEET = str.maketrans("013457", "oieast")

_ascii = bytes(ord(chr(i).lower()) - 96 if chr(i).isascii() and chr(i).isalpha() else 0 for i in range(256))
_drop = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalpha())


def classes(word: bytes) -> bytes:
    """A word's letters as classes 1 to CLASSES - 1: accents go, digits among letters count as letters, others go."""
    if word.isalpha():
        return word.translate(_ascii)
    text = unicodedata.normalize("NFKD", word.decode().lower())
    if any(c.isalpha() for c in text):
        text = text.translate(LEET)
    return bytes(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (CLASSES - 27) for c in text if c.isalpha())


def pieces(letters: bytes) -> list[bytes]:
    """A word, or the overlapping pieces of a long one."""
    if len(letters) <= PIECE:
        return [letters]
    return [letters[i : i + PIECE] for i in range(0, len(letters) - PIECE // 2, PIECE // 2)]


def _places(length: int) -> list[tuple[int, int, int]]:
    return [t for t in combinations(range(length), 3) if t[2] - t[0] < SPAN]


def _norm(length: int) -> float:
    return max(1e-9, sum(DECAY ** (2 * (k - i + 1)) for i, _, k in _places(length)) ** 0.5)


def features(letters: bytes) -> dict[int, float]:
    """The kernel's features of a piece: triples of letters by their class numbers, weighted by span and length."""
    out: dict[int, float] = {}
    for i, j, k in _places(len(letters)):
        triple = (letters[i] * CLASSES + letters[j]) * CLASSES + letters[k]
        out[triple] = out.get(triple, 0.0) + DECAY ** (k - i + 1)
    norm = _norm(len(letters))
    return {t: v / norm for t, v in out.items()}


def kernel(a: dict[int, float], b: dict[int, float]) -> float:
    """The subsequence kernel of two pieces, from their features."""
    if len(a) > len(b):
        a, b = b, a
    return sum(v * b[t] for t, v in a.items() if t in b)


@dataclass
class Model:
    """Weights of letter triples and a bias, as the machine's, and the calibration of a text's largest value."""

    weights: np.ndarray
    bias: float
    slope: float = 4.0
    offset: float = 0.0

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30)))


def decide(model: Model, words: list[bytes]) -> np.ndarray:
    """The machine's value for each word (as classes): that of its most toxic piece."""
    owner, parts = [], []
    for k, word in enumerate(words):
        for part in pieces(word):
            owner.append(k)
            parts.append(part)
    out = np.full(len(words), -np.inf)
    owner = np.array(owner, np.int64)
    lengths = np.array([len(p) for p in parts], np.int64)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        letters = np.frombuffer(b"".join(parts[k] for k in own), np.uint8).reshape(len(own), length).astype(np.int32)
        value = np.zeros(len(own), np.float64)
        for i, j, k in _places(int(length)):
            value += DECAY ** (k - i + 1) * model.weights[(letters[:, i] * CLASSES + letters[:, j]) * CLASSES + letters[:, k]]
        np.maximum.at(out, owner[own], value / _norm(int(length)) + model.bias)
    return out


def text_words(text: bytes | None) -> set[bytes]:
    """Distinct words of a text, and the words that three or more single letters in a row spell."""
    if not text:
        return set()
    split = text.lower().split()
    words = set(split)
    if sum(len(w) == 1 for w in words) > 2:
        run: list[bytes] = []
        for w in [*split, b""]:
            if len(w) == 1 and w.isalpha():
                run.append(w)
            else:
                if len(run) > 2:
                    words.add(b"".join(run))
                run = []
    return words


class Scorer:
    """Scores texts with a bounded cache of words."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def _seen(self, texts: list[bytes | None]) -> list[set[bytes]]:
        sets = [text_words(t) for t in texts]
        new = list(set().union(*sets) - self.cache.keys()) if sets else []
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = list(set().union(*sets))
        self.cache.update(zip(new, decide(self.model, [classes(w) for w in new]).tolist(), strict=True))
        return sets

    def values(self, texts: list[bytes | None]) -> np.ndarray:
        """The largest value of each text's words; the bias for texts without words."""
        sets, get = self._seen(texts), self.cache.__getitem__
        return np.array([max(map(get, s), default=self.model.bias) for s in sets])

    def words(self, texts: list[bytes | None]) -> list[bytes]:
        """The most toxic piece of each text, as classes; empty for texts without words."""
        sets, get = self._seen(texts), self.cache.__getitem__
        words = [classes(max(sorted(s), key=get, default=b"")) for s in sets]
        parts = [pieces(w) for w in words]
        return [p[int(decide(self.model, p).argmax())] if len(p) > 1 else w for p, w in zip(parts, words, strict=True)]


def held_scorer(model: Model) -> Scorer:
    """The worker's scorer for a model, kept between tasks; that of another model goes first."""
    return hold(("toxicity", model.bias, model.slope, float(model.weights.sum())), lambda: Scorer(model))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: each word (as classes) with the toxic and clean texts that hold it."""
    counts: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

    def flush() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        sides = [pa.array([c.get(w, 0) for w in words], pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *sides], ["word", "clean", "toxic"])

    for batch in batches:
        for text, label in zip(raw_texts(batch["text"]), batch["toxic"].to_pylist(), strict=True):
            own = counts[label]
            for word in {p for w in text_words(text) for p in pieces(classes(w))}:
                own[word] = own.get(word, 0) + 1
        if len(counts[0]) + len(counts[1]) > COUNTED_WORDS:
            yield flush()
            counts[0].clear(), counts[1].clear()
    yield flush()


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton's method, with a constant feature for the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ w + c * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        own = x[active] * weight[active, None]
        best = np.linalg.solve(np.eye(len(w)) + 2 * c * own.T @ x[active], 2 * c * own.T @ y[active])
        step = 1.0
        while step > 1e-6 and loss(w + step * (best - w)) > loss(w):
            step /= 2
        w = w + step * (best - w)
        before, active = active, y * (x @ w) < 1
        if (before == active).all():
            break
    return w[:-1], float(w[-1])


class Space:
    """The kernel space that landmarks span: similarities to landmarks turn into coordinates."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = [features(w) for w in landmarks]
        values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in self.landmarks] for a in self.landmarks]))
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])  # K^-1/2 up to a rotation
        self.known: dict[bytes, np.ndarray] = {}

    def place(self, words: list[bytes]) -> np.ndarray:
        """Coordinates of words (as classes)."""
        for w in words:
            if w not in self.known:
                own = features(w)
                self.known[w] = np.array([kernel(own, f) for f in self.landmarks]) @ self.root
        return np.array([self.known[w] for w in words])

    def fold(self, beta: np.ndarray, bias: float) -> Model:
        """A machine in this space as weights of letter triples."""
        weights = np.zeros(CLASSES**3)
        for gamma, f in zip(beta, self.landmarks, strict=True):
            for triple, v in f.items():
                weights[triple] += gamma * v
        return Model(weights, bias)

    def train(self, toxic: list[bytes], clean: list[bytes]) -> Model:
        """A machine from the words that stand for toxic and for clean texts."""
        y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
        weight = np.where(y > 0, max(1.0, len(clean) / max(1, len(toxic)) / 2), 1.0)
        beta, bias = _svm(self.place(toxic + clean), y, weight)
        return self.fold(self.root @ beta, bias)


def calibrate(model: Model, value: np.ndarray, label: np.ndarray) -> Model:
    """A logistic curve over the largest values of labelled texts, by Newton's method with a little shrinkage."""
    if len(set(label.tolist())) < 2:
        return model
    value = np.clip(value, -5, 5)
    a, b = 4.0, 0.0
    x = np.stack([value, np.ones(len(value))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        gradient = x.T @ (p - label) + np.array([0.02 * (a - 4.0), 0.02 * b])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return Model(model.weights, model.bias, max(0.1, float(a)), float(b))


#: The model of a corpus without labels of both kinds: nothing is toxic.
NOTHING = Model(np.zeros(CLASSES**3), -1.0)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Learn from labelled rows where allowed (a condition on doc_id) holds.

    A bounded sample of labelled rows is used, SAMPLE_TOXIC and SAMPLE_CLEAN at most, chosen by a hash of doc_id; of a
    doc_id with several labels the largest counts. Only doc_id, text and toxic are read. The driver gets the landmarks
    and a word of each text of the sample.
    """
    known = labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = stage_table(taken[0].unionAll(taken[1]), "labels")
    # Kept for the reads that follow: the sample's words, and the words that stand for its texts in each round.
    texts = stage_table(texts_of(docs).select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")
    counts = texts.mapInArrow(tidy(_word_counts), "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stage_table(counts.where(F.octet_length("word") >= 3), "words")
    sides = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sides.get(1) or not sides.get(0):
        return NOTHING
    share = sides[1] / (sides[1] + sides[0])
    # How much more often toxic texts hold a word than by chance: landmarks are placed where labels differ, and at random.
    surprise = F.col("toxic") * F.log(F.col("toxic") / (F.col("toxic") + F.col("clean")) / share)
    top = counts.where(f"toxic >= {LEAST_TEXTS}").select("word", surprise.alias("s")).orderBy(F.desc("s"), "word").limit(MARKED)
    marked = {bytes(r["word"]): max(r["s"], 0.0) for r in top.collect()}
    others = [bytes(r["word"]) for r in counts.orderBy(F.xxhash64("word"), "word").limit(OTHERS).collect()]
    if not marked:
        return NOTHING
    space = Space([*marked, *(w for w in others if w not in marked)])

    def judged(model: Model, column: str, kind: str, of) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = held_scorer(model)
            for batch in slices(batches, TEXTS):
                yield pa.RecordBatch.from_arrays([pa.array(of(scorer, raw_texts(batch["text"]))), batch["toxic"]], [column, "toxic"])

        return texts.mapInArrow(tidy(run), f"{column} {kind}, toxic int").toPandas()

    # At first the word that is most similar to landmarks of the marked kind, by their surprise, stands for its text.
    model = space.fold(np.array([*marked.values(), *[0.0] * (len(space.landmarks) - len(marked))]), 0.0)
    clean: set[bytes] = set(others)
    for _ in range(ROUNDS):
        found = judged(model, "word", "binary", Scorer.words)
        words = [bytes(w) for w in found["word"]]
        toxic = [w for w, t in zip(words, found["toxic"], strict=True) if t and w]
        clean |= {w for w, t in zip(words, found["toxic"], strict=True) if not t and w}  # what was found before still counts
        if not toxic:
            return NOTHING
        model = space.train(toxic, sorted(clean))
    found = judged(model, "value", "double", Scorer.values)
    return calibrate(model, found["value"].to_numpy(), found["toxic"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every row of docs, from whole texts alone.

    Null and empty texts have no toxic word and score low; repeated rows and equal texts score alike; empty tables
    give no rows; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held_scorer(shared.value)
        for batch in slices(batches, TEXTS):
            score = scorer.model.probability(scorer.values(raw_texts(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts_of(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {id_type}, score double, predicted int")
