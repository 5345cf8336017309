"""The rule ensemble: statistics, rules and scores against plain versions, and accuracy on texts held out."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vociflow.llm import rules
from vociflow.llm.common import crc_fold

SPACES = " \t\n\x0b\f\r"


def plain(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    n, chars = len(words), sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    count = lambda test: sum(map(test, text))
    return dict(zip(rules.NAMES, (
        math.log1p(n), share(chars, n), share(sum(len(w) <= 3 for w in words), n), share(sum(len(w) > 12 for w in words), n), share(len(set(words)), n), share(n, len(lines)),
        share(len(lines) - len(set(lines)), len(lines)), share(count(lambda c: c in "#*$%&|<>{}\\^~_=+@[]/"), n), share(count(lambda c: c in "!?"), n), share(count(lambda c: c in ".,;:"), n),
        share(count(str.isupper), chars), share(count(lambda c: c in "0123456789"), chars), share(count(lambda c: ord(c) > 127), chars),
    ), strict=True))


TEXTS = [None, "", " \n\t ", "one", "a B ç", "|| ## x=1 {y} [z] \\ / ~", "Line one.\nLine one.\n\n  \nother!? 12", "WÖRD " * 40_000, "averyveryverylongword short", "tab\tand\x0bfeed\fend\r\n", "日本語 テキスト。", "a b a b a b"]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "m", 2.0, 3) for r in rows], "doc_id long, text string, score double, m string, words double, quality int")


def test_statistics_equal_plain_ones(spark):
    found = {r["doc_id"]: r for r in rules.measure(documents(spark, list(enumerate(TEXTS)))).collect()}
    for k, text in enumerate(TEXTS):
        own = plain(text)
        assert {c: found[k][c] for c in rules.NAMES} == pytest.approx(own, abs=1e-12), text


def corpus(n, seed):
    """Good texts of many words; bad ones repeat themselves, shout or are full of symbols. A few labels are wrong."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 10)))) for _ in range(900)]
    rows = []
    for k in range(n):
        own, bad = [words[i] for i in rng.integers(0, 900, int(rng.integers(20, 120)))], k % 4 == 0
        if bad:
            own = [own[:3] * 20, [f"{w} |" for w in own], [f"{w.upper()}!!" for w in own]][k % 3]
        rows.append((k, " ".join(own), int(bad == (rng.random() < 0.02))))
    return rows


def learnt(spark, rows, allowed=None):
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 9) for i, _, q in rows], "doc_id long, quality int, toxic int")
    measured = rules.measure(docs)
    return measured, rules.learn(measured, labels, F.lit(True) if allowed is None else allowed)


@pytest.fixture(scope="module")
def model(spark):
    return learnt(spark, corpus(1500, 1), crc_fold(F.col("doc_id"), 5) != 0)


def test_texts_held_out_are_told_apart(model):
    measured, ensemble = model
    held = measured.where(crc_fold(F.col("doc_id"), 5) == 0)
    found = [(r["predicted"], int(r["doc_id"] % 4 != 0)) for r in rules.score_quality(held, ensemble).collect()]
    assert len(found) > 200 and sum(a == b for a, b in found) >= 0.98 * len(found)


def test_compiled_scores_equal_the_rules(model):
    measured, ensemble = model
    assert 0 < len(ensemble.rules) < 60 and str(ensemble.rules[0][0])
    rows = {r["doc_id"]: r.asDict() for r in measured.collect()}
    for r in rules.score_quality(measured, ensemble).collect():
        total = ensemble.constant + sum(w for rule, w in ensemble.rules if rule.holds(rows[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_the_lasso_is_at_its_optimum(spark, monkeypatch):
    """No change of a weight makes the penalised loss smaller: the lasso's own conditions, over all rules of the forest."""
    seen = {}
    stage = rules.stage_table
    monkeypatch.setattr(rules, "stage_table", lambda df, tag: seen.setdefault(tag, stage(df, tag)))
    _, ensemble = learnt(spark, corpus(400, 4))
    fired = seen["fired"].toPandas()
    x, y, weight = np.array([v.toArray() for v in fired["at"]]), fired["quality"].to_numpy(), fired["weight"].to_numpy()

    def loss(b, w):
        margin = x @ w + b
        return (weight * (np.logaddexp(0, margin) - y * margin)).sum() / weight.sum() + rules.PENALTY * np.abs(w).sum()

    # A plain proximal descent over the same rules ends no lower.
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(30_000):
        off = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / weight.sum()
        w, b = w - 0.02 * (x.T @ off), b - 0.02 * off.sum()
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.02 * rules.PENALTY)
    probability = np.array([r["score"] for r in rules.score_quality(seen["sample"].drop("quality"), ensemble).collect()])
    own = [r["quality"] for r in seen["sample"].collect()]
    margin = np.log(probability / (1 - probability))
    found = (weight.mean() * (np.logaddexp(0, margin) - np.array(own) * margin)).mean() / weight.mean() + rules.PENALTY * sum(abs(w) for _, w in ensemble.rules)
    assert found <= loss(b, w) + 0.01


def test_paths_of_trees():
    text = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 4 <= 0.5)
     If (feature 7 <= 1.0E-3)
      Predict: 1.0
     Else (feature 7 > 1.0E-3)
      Predict: 0.0
    Else (feature 4 > 0.5)
     If (feature 4 <= 0.75)
      Predict: 1.0
     Else (feature 4 > 0.75)
      Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    d, s = rules.NAMES[4], rules.NAMES[7]
    assert [r.bounds for r in rules.tree_rules(text)] == [
        ((d, None, 0.5),), ((d, None, 0.5), (s, None, 1e-3)), ((d, None, 0.5), (s, 1e-3, None)), ((d, 0.5, None),), ((d, 0.5, 0.75),), ((d, 0.75, None),),
    ]


def test_awkward_tables(spark, model):
    measured = rules.measure(documents(spark, [(None, None), (1, ""), (1, ""), (2, "x " * 100_000)]))
    rows = rules.score_quality(measured, model[1]).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] in (None, 1)}) == 1
    assert rules.score_quality(rules.measure(documents(spark, [])), model[1]).collect() == []
    none = learnt(spark, [(k, "some text", 3) for k in range(4)])[1]
    one = learnt(spark, [(k, "some text", 1) for k in range(8)] + [(3, "again", 0), (None, "x", 0), (9, None, None)])[1]
    assert none == rules.Ensemble(0.0) and one == rules.Ensemble(math.log(9))
    assert [round(r["score"], 6) for r in rules.score_quality(measured, one).collect()] == [0.9] * 4
    same = learnt(spark, [(k, "same", k % 2) for k in range(20)])[1]
    assert [r["score"] for r in rules.score_quality(measured, same).collect()] == pytest.approx([0.5] * 4)
