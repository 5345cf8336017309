"""Sufficiency, session quality and evaluation."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vociflow.params import DEFAULT, SENSITIVITY, Params

#: Indicators with pass and borderline limits; negative ones are upper limits.
INDICATORS = (
    ("completeness", 0.95, 0.80, True),
    ("topic_quality", 0.75, 0.50, True),
    ("comment_coverage", 0.60, 0.40, True),
    ("reliability", None, None, True),
    ("dedup_efficiency", 0.90, 0.70, False),
    ("ci_width", -0.20, -0.35, False),
    ("closed_ratio", -0.10, -0.25, False),
    ("api_retry", -0.05, -0.15, False),
    ("sentiment_fallback", -0.02, -0.10, True),
    ("semantic_pass", 1.0, 1.0, True),
)


def sufficiency(posts: Column, comments: Column, width: Column, p: Params = DEFAULT) -> Column:
    """RELIABLE, PRELIMINARY or UNRELIABLE (Q1)."""
    poor = (posts < p.min_topic_posts[0]) | (comments < p.min_comments[0]) | F.coalesce(width > p.max_ci_width[0], F.lit(False))
    good = (posts >= p.min_topic_posts[1]) & (comments >= p.min_comments[1]) & (width.isNull() | (width <= p.max_ci_width[1]))
    return F.when(poor, "UNRELIABLE").when(good, "RELIABLE").otherwise("PRELIMINARY")


def status(value: Column, passed: float, borderline: float) -> Column:
    """PASSED, BORDERLINE or FAILED by two limits; negative limits are upper ones (Q2)."""
    reach = lambda x: value >= x if x >= 0 else value <= -x
    return F.when(reach(passed), "PASSED").when(reach(borderline), "BORDERLINE").otherwise("FAILED")


def indicators(inputs: DataFrame) -> DataFrame:
    """Long rows (name, value, status, is_primary) from one row of inputs with reliable_ratio and unreliable_ratio (Q2)."""
    rows = []
    for name, passed, borderline, primary in INDICATORS:
        if passed is None:
            value = F.col("reliable_ratio")
            state = (
                F.when((value >= 0.50) & (F.col("unreliable_ratio") <= 0.20), "PASSED").when((value >= 0.30) & (F.col("unreliable_ratio") <= 0.35), "BORDERLINE").otherwise("FAILED")
            )
        else:
            value, state = F.col(name), status(F.col(name), passed, borderline)
        rows.append(F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), state.alias("status"), F.lit(primary).alias("is_primary")))
    return inputs.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overall(found: DataFrame) -> DataFrame:
    """Overall status by the primary indicators, and the share passed (Q3, Q4)."""
    primary = F.col("is_primary")
    every = F.bool_and(~primary | (F.col("status") == "PASSED"))
    some = F.bool_or(primary & (F.col("status") == "FAILED"))
    return found.agg(
        F.when(every, "PASSED").when(some, "FAILED").otherwise("BORDERLINE").alias("overall"), F.avg((F.col("status") == "PASSED").cast("double")).alias("quality_score")
    )


def quality_json(found: DataFrame) -> DataFrame:
    """All indicators of a session as one JSON text (Q4); there are ten."""
    return found.agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "value", "status")))).alias("quality_json"))


def quality_inputs(posts: DataFrame, comments: DataFrame, authors: DataFrame, methods: DataFrame, judged: DataFrame, p: Params = DEFAULT, api_errors: int = 0, api_requests: int = 0, semantic: bool = True) -> DataFrame:
    """One row with all inputs of the indicators (A27, A28, J14): one aggregate for each table, of one row each."""
    ratio = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    topic = F.expr("window = 'CURRENT' and relevant <=> true")
    per_post = comments.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n_c"))
    of_posts = posts.join(per_post, "id", "left").agg(
        ratio(F.count_if(F.col("combined") >= 0.5), F.count("combined"), 0.0).alias("topic_quality"),
        ratio(F.count_if(topic & (F.col("n_c") >= p.min_post_comments)), F.count_if(topic), 0.0).alias("comment_coverage"),
        ratio(F.count_if(~F.col("originality").eqNullSafe("DETECTED_COPY")), F.count("*"), 1.0).alias("dedup_efficiency"),
    )
    of_authors = authors.agg(ratio(F.count_if("is_closed"), F.count("*"), 0.0).alias("closed_ratio"))
    of_methods = methods.agg(ratio(F.count_if(F.col("method") == "fallback_error"), F.count("*"), 0.0).alias("sentiment_fallback"))
    n = F.count("*")
    of_judged = judged.agg(
        ratio(F.count_if(F.col("sufficiency") == "RELIABLE"), n, 0.0).alias("reliable_ratio"), ratio(F.count_if(F.col("sufficiency") == "UNRELIABLE"), n, 0.0).alias("unreliable_ratio"),
        F.coalesce(F.avg("ci_width"), F.lit(0.0)).alias("ci_width"),
    )
    one = F.lit(True)
    whole = of_posts.join(F.broadcast(of_authors), one).join(F.broadcast(of_methods), one).join(F.broadcast(of_judged), one)
    retry = api_errors / api_requests if api_requests else 0.0
    return whole.withColumns({"completeness": F.lit(1.0), "api_retry": F.lit(retry), "semantic_pass": F.lit(1.0 if semantic else 0.0)})


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two ratings (A29): 1 if chance agreement is 1, 0 without rows. Categories are few."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    side = lambda c, name: pairs.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(name))
    chance = side(a, "p").join(side(b, "q"), "v", "full").agg(F.coalesce(F.sum(F.coalesce("p", F.lit(0)).cast("double") * F.coalesce("q", F.lit(0))), F.lit(0.0)).alias("pq"))
    both = n.join(F.broadcast(chance), F.lit(True))
    expected = F.try_divide(F.col("pq"), F.col("n").cast("double") * F.col("n"))
    observed = F.try_divide(F.col("same").cast("double"), F.col("n"))
    return both.select(F.when(F.col("n") == 0, F.lit(0.0)).when(expected >= 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation; 0 without rows or variance."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return df.agg(F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0)).alias("r"))


def chi_square(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Chi-square of observed counts (o) against expected ones (e), rescaled to the same total."""
    both = observed.join(expected, key, "full").select(F.coalesce("o", F.lit(0)).cast("double").alias("o"), F.coalesce("e", F.lit(0)).cast("double").alias("e"))
    totals = both.agg(F.greatest(F.sum("o"), F.lit(1.0)).alias("to"), F.greatest(F.sum("e"), F.lit(1.0)).alias("te"))
    scaled = both.join(F.broadcast(totals), F.lit(True)).withColumn("x", F.col("e") * F.col("to") / F.col("te"))
    return scaled.agg(F.coalesce(F.sum(F.when(F.col("x") > 0, F.pow(F.col("o") - F.col("x"), 2) / F.col("x"))), F.lit(0.0)).alias("chi2"))


def impact(chi2: Column, delta: Column) -> Column:
    """HIGH, MEDIUM or LOW impact of a parameter (Q6)."""
    return F.when((chi2 > 10) | (F.abs(delta) > 0.2), "HIGH").when((chi2 > 5) | (F.abs(delta) > 0.1), "MEDIUM").otherwise("LOW")


def timing_regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """Stages slower than their baseline by more than the tolerance, with whole percents."""
    both = current.join(baseline.withColumnRenamed("ms", "base"), "stage").where("base > 0")
    return both.where(F.col("ms") / F.col("base") > 1 + tolerance).select("stage", "ms", "base", ((F.col("ms") / F.col("base") - 1) * 100).cast("int").alias("percent"))


def best_model(models: DataFrame, current: str, gain: float = 0.05) -> DataFrame:
    """The model with the largest score, and whether to change to it."""
    best = models.agg(F.max_by("model", F.struct("score", "model")).alias("best"), F.max("score").alias("top"), F.max(F.when(F.col("model") == current, F.col("score"))).alias("own"))
    return best.select("best", F.col("top").alias("score"), F.when(F.col("top") - F.coalesce("own", F.lit(0.0)) > gain, "SWITCH").otherwise("KEEP").alias("advice"))


def sensitivity_table(spark: SparkSession) -> DataFrame:
    """The parameters of the sensitivity analysis (Q7)."""
    return spark.createDataFrame(list(SENSITIVITY), "name string, default_value double, low double, high double, category string")


def file_gates(folder: str, names: list[str]) -> dict[str, bool]:
    """Whether each of some report files exists (Q5)."""
    return {n: os.path.exists(os.path.join(folder, n)) for n in names}


def gate_summary(gates: dict[str, bool]) -> str:
    """A line for each gate, and how many passed (Q5)."""
    lines = [f"- {'PASS' if ok else 'FAIL'}: {name}" for name, ok in gates.items()]
    return "\n".join([*lines, f"{sum(gates.values())} of {len(gates)} passed"])


def report(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """One row: a Markdown report of a small table, as markdown() makes it (Q8), by DataFrame functions."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    lines = df.agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return lines.select(F.array_join(F.array_prepend(F.col("l.line"), F.lit(head)), "\n").alias("report"))


def markdown(title: str, df: DataFrame, limit: int = 200) -> str:
    """A Markdown report of a small table (Q8)."""
    head = "| " + " | ".join(df.columns) + " |"
    rows = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(limit).collect()]
    return "\n".join([f"# {title}", "", head, "|" + "---|" * len(df.columns), *rows])
