"""Quality of texts by a sparse ensemble of rules (operator 12).

Statistics of each text are columns, made by built-in functions in one pass. A forest of shallow trees is grown on the
statistics of labelled texts; every path from a root to a node of a tree is a rule, a conjunction of bounds on
statistics. A logistic model with a lasso penalty weighs the rules, and leaves few. These compile into one column
expression over the statistics, so that scoring is a projection.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import stage_table

#: Labelled rows of each kind to learn from: the bound of the sample, taken by a hash of doc_id.
SAMPLE_EACH = 10_000
#: Trees and their depth; the lasso's penalty; the smallest weight of a rule that is kept.
TREES, DEPTH, PENALTY, LEAST_WEIGHT = 24, 3, 0.0005, 1e-3
#: A score from which a text is predicted to be good.
GOOD = 0.3
#: The seed of the trees' choice of statistics.
SEED = 7

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Characters that are counted, as patterns.
_KINDS = {"symbols": "[#*$%&|<>{}\\\\^~_=+@\\[\\]/]", "upper": "\\p{Lu}", "digits": "[0-9]", "marks": "[!?]", "stops": "[.,;:]", "other": "[^\\x00-\\x7F]"}
NAMES = (
    "log_words", "word_chars", "short_words", "long_words", "distinct_words", "line_words", "dup_lines", "symbol_rate", "mark_rate", "stop_rate", "upper_share", "digit_share", "other_share",
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def statistics(text: Column) -> Column:
    """A struct of a text's statistics, doubles named NAMES; a null text counts as empty, and shares of nothing are 0."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.trim(F.regexp_replace(whole, _SPACE, " "))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != "")
    size = lambda x: F.size(x).cast("double")
    counts = _let(
        words,
        lambda w: _let(
            lines,
            lambda x: F.struct(
                size(w).alias("words"), F.length(F.array_join(w, "")).cast("double").alias("chars"), size(F.filter(w, lambda v: F.length(v) <= 3)).alias("short"),
                size(F.filter(w, lambda v: F.length(v) > 12)).alias("long"), size(F.array_distinct(w)).alias("distinct"), size(x).alias("lines"), size(F.array_distinct(x)).alias("own_lines"),
                *[(F.length(whole) - F.length(F.regexp_replace(whole, p, ""))).cast("double").alias(k) for k, p in _KINDS.items()],
            ),
        ),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return _let(
        counts,
        lambda c: F.struct(*[
            v.alias(k)
            for k, v in zip(NAMES, (
                F.log1p(c["words"]), share(c["chars"], c["words"]), share(c["short"], c["words"]), share(c["long"], c["words"]), share(c["distinct"], c["words"]), share(c["words"], c["lines"]),
                share(c["lines"] - c["own_lines"], c["lines"]), share(c["symbols"], c["words"]), share(c["marks"], c["words"]), share(c["stops"], c["words"]), share(c["upper"], c["chars"]),
                share(c["digits"], c["chars"]), share(c["other"], c["chars"]),
            ), strict=True)
        ]),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction: each named statistic above low (if any) and up to high (if any)."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        """The rule as a condition on columns of statistics."""
        out = F.lit(True)
        for name, low, high in self.bounds:
            out = out if low is None else out & (F.col(name) > low)
            out = out if high is None else out & (F.col(name) <= high)
        return out

    def holds(self, row: dict[str, float]) -> bool:
        """Whether the rule holds for one row of statistics."""
        return all((low is None or row[name] > low) and (high is None or row[name] <= high) for name, low, high in self.bounds)

    def __str__(self) -> str:
        return " and ".join(" ".join([f"{low:.4g} <" if low is not None else "", name, f"<= {high:.4g}" if high is not None else ""]).strip() for name, low, high in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and a constant."""

    constant: float
    rules: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self) -> Column:
        """The probability of a good text, compiled to one column over statistics."""
        total = F.lit(self.constant)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(text: str) -> Iterator[Rule]:
    """The paths from the root to every other node of trees, from their description by Spark; bounds on one statistic are put together."""
    path: list[tuple[int, str, float]] = []
    for line in text.splitlines():
        if found := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line):
            depth = len(found[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, f"{found[3]}{found[2]}", float(found[4])))
            bounds: dict[int, list] = {}
            for _, key, at in path:
                own = bounds.setdefault(int(key.lstrip("<=>")), [None, None])
                if key[0] == ">":
                    own[0] = at if own[0] is None else max(own[0], at)
                else:
                    own[1] = at if own[1] is None else min(own[1], at)
            yield Rule(tuple((NAMES[k], *own) for k, own in sorted(bounds.items())))
        elif re.match(r"\s*Tree \d+", line):
            path = []


def learn(measured: DataFrame, labels: DataFrame, allowed: Column) -> Ensemble:
    """Learn from labelled rows where allowed (a condition on doc_id) holds; measured has doc_id and the statistics.

    A bounded sample of labelled rows is used, SAMPLE_EACH of each kind at most, chosen by a hash of doc_id; rows are
    weighed so that kinds keep their shares. Of a doc_id with several labels the largest counts, and of several rows the
    smallest. Without labels of both kinds every text scores their share of good ones, with one of each kind added.
    """
    known = labels.where(allowed & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    known = stage_table(known, "known")
    counts = {int(r["quality"]): r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    taken = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH) for q in (0, 1)]
    sample = measured.join(F.broadcast(taken[0].unionAll(taken[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*NAMES)).alias("m"))
    rows = stage_table(sample.select("doc_id", "quality", "m.*"), "sample")
    found = {int(r["quality"]): r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        good, bad = (counts.get(q, 0) + 1 for q in (1, 0))
        return Ensemble(math.log(good / bad))
    total = sum(counts.values())
    weight = F.when(F.col("quality") == 1, F.lit(counts[1] / total / found[1])).otherwise(F.lit(counts[0] / total / found[0])) * sum(found.values())
    held = VectorAssembler(inputCols=list(NAMES), outputCol="at").transform(rows.withColumn("weight", weight))
    # Trees differ by the statistics that each node may split on, not by their rows, so that partitions do not matter.
    forest = RandomForestClassifier(
        featuresCol="at", labelCol="quality", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", bootstrap=False, subsamplingRate=1.0, seed=SEED, maxBins=256
    )
    rules = sorted(set(tree_rules(forest.fit(held).toDebugString)), key=str)
    if not rules:
        return Ensemble(math.log(counts[1] / counts[0]))
    fired = rows.select("quality", weight.alias("weight"), array_to_vector(F.array(*[F.when(r.column(), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules])).alias("at"))
    fired = stage_table(fired.select("quality", "weight", "at"), "fired")
    lasso = LogisticRegression(featuresCol="at", labelCol="quality", weightCol="weight", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=100, tol=1e-5)
    fitted = lasso.fit(fired)
    weights = fitted.coefficients.toArray().tolist()
    return Ensemble(float(fitted.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) >= LEAST_WEIGHT))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row's whole text; written, as learning and scoring both read them."""
    return stage_table(docs.select("doc_id", statistics(F.col("text")).alias("m")).select("doc_id", "m.*"), "statistics")


def score_quality(measured: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= GOOD) of every measured row.

    Null and empty texts have statistics of 0 and score by the rules that hold for these; equal texts score alike;
    repeated rows stay; empty tables give no rows; other columns were left behind when texts were measured.
    """
    return measured.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
