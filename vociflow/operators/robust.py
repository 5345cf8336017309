"""Robust statistics, composites, thresholds and roles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vociflow.operators.selection import quantiles
from vociflow.stage import stage_table

#: Fixed value: makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826
#: Below a threshold by no more than this is at it: equal sums of three scores differ by rounding.
AT_THRESHOLD = 1e-12
#: Different values of a key that are one array, at most; bins of a histogram; keys whose state is broadcast, at most.
ARRAY_VALUES, BINS, BROADCAST_KEYS = 10_000, 256, 100_000


def median(x: Column) -> Column:
    """Median; 0 of nothing."""
    return F.coalesce(F.median(x), F.lit(0.0))


def quantile(x: Column, p: float) -> Column:
    """Linear (type 7) quantile."""
    return F.percentile(x, F.lit(p))


def iqr(x: Column) -> Column:
    """Interquartile range; 0 of fewer than two values."""
    return F.when(F.count(x) < 2, F.lit(0.0)).otherwise(quantile(x, 0.75) - quantile(x, 0.25))


def mad(df: DataFrame, key: str | None, value: str) -> DataFrame:
    """Scaled median absolute deviation of each key; 0 of fewer than two values (A21): a median of distances to a median."""
    keys = [key] if key else []
    rows = df.select(*keys, value) if keys else df.select(F.lit(0).alias("__all"), value)
    by = keys or ["__all"]
    centre = rows.groupBy(*by).agg(F.median(value).alias("__m"), F.count(value).alias("__n"))
    away = rows.join(centre, by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("d"), F.first("__n").alias("n"))
    return away.select(*keys, F.when(F.col("n") < 2, F.lit(0.0)).otherwise(MAD_SCALE * F.col("d")).alias("mad"))


def _middle(values: np.ndarray, times: np.ndarray) -> float:
    """The median of values that occur so many times each."""
    order = np.argsort(values)
    ends = np.cumsum(times[order])
    n = int(ends[-1])
    return float(values[order][np.searchsorted(ends, [(n - 1) // 2, n // 2], "right")].mean())


def _huber(values: np.ndarray, times: np.ndarray, k: float, tolerance: float, rounds: int) -> float:
    if not len(values):
        return 0.0
    mu = _middle(values, times)
    if times.sum() < 3:
        return mu
    reach = k * max(MAD_SCALE * _middle(np.abs(values - mu), times), 1e-10)
    for _ in range(rounds):
        away = np.abs(values - mu)
        weight = times * np.where(away <= reach, 1.0, reach / np.maximum(away, 1e-300))
        before, mu = mu, float(weight @ values / weight.sum())
        if abs(mu - before) <= tolerance * (1 + abs(before)):
            break
    return mu


def huber(values: Column, times: Column | None = None, k: float = 1.345, tolerance: float = 1e-6, rounds: int = 100) -> Column:
    """Huber's M-estimate of an array by reweighting (A22); times says how often each value occurs, once by default.

    It starts at the median with the scaled median absolute deviation as scale, and stops once converged. Arrays go to
    NumPy in Arrow batches, as their number of rounds is not known.
    """

    @F.pandas_udf("double")
    def run(values: pd.Series, times: pd.Series) -> pd.Series:
        each = lambda v, n: _huber(np.asarray(v, float), np.asarray(n, np.int64), k, tolerance, rounds)
        return pd.Series([each(v, n) for v, n in zip(values, times, strict=True)], dtype=float)

    return run(values, F.transform(values, lambda _: F.lit(1).cast("long")) if times is None else times)


def _beside(values: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """values with their key's state: broadcast after counting it, else a shuffle join that AQE may split."""
    return values.join(F.broadcast(state) if state.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else state, key)


def _medians_by(values: DataFrame, key: str) -> DataFrame:
    """key and median of finite values __v that occur __n times: rounds of histograms between a key's bounds.

    Each round keeps the bin that holds a wanted rank, from its smallest to its largest value, until these are equal; the
    bounds themselves lie in different bins, so that every round leaves fewer values. Only sums of bins are shuffled.
    """
    size = values.groupBy(key).agg(F.sum("__n").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1))
    state = stage_table(size.select(key, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high"), "bounds")
    done = state.where("low = high")
    state = state.where("low < high")
    width = F.col("high") / 2 - F.col("low") / 2
    inner = F.coalesce(F.floor(F.try_divide(F.col("__v") / 2 - F.col("low") / 2, width) * BINS), F.lit(0))
    place = F.when(F.col("__v") == F.col("high"), F.lit(BINS - 1)).otherwise(F.least(inner, F.lit(BINS - 2)))
    order = Window.partitionBy(key, "rank").orderBy("bin")
    while state.limit(1).count():
        near = _beside(values, state, key).where(F.col("__v").between(F.col("low"), F.col("high")))
        bins = near.groupBy(key, "rank", "below", place.alias("bin")).agg(F.sum("__n").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        ends = bins.withColumn("end", F.col("below") + F.sum("n").over(order))
        held = ends.where((F.col("end") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("end")))
        state = stage_table(held.select(key, "rank", (F.col("end") - F.col("n")).alias("below"), "low", "high"), "bounds")
        done = done.unionByName(state.where("low = high"))
        state = state.where("low < high")
    # An odd number of values has one rank, which is both ends of the median.
    return stage_table(done.groupBy(key).agg((F.min("low") / 2 + F.max("low") / 2).alias("median")), "medians")


def _huber_rounds(counted: DataFrame, key: str, k: float, tolerance: float, rounds: int) -> DataFrame:
    """key and mu of keys with very many different values: every round is one grouped sum, and converged keys leave."""
    finite = counted.groupBy(key).agg(F.bool_or(F.isnan("__v") | (F.abs("__v") == float("inf"))).alias("bad"))
    bad = finite.where("bad").select(key, F.lit(None).cast("double").alias("mu"))
    values = counted.join(finite.where("not bad").select(key), key)
    middle = _medians_by(values, key)
    away = _beside(values, middle, key).groupBy(key, F.abs(F.col("__v") - F.col("median")).alias("__v")).agg(F.sum("__n").alias("__n"))
    spread = _medians_by(stage_table(away, "distances"), key).withColumnRenamed("median", "mad")
    state = middle.join(spread, key).select(key, F.col("median").alias("mu"), (k * F.greatest(MAD_SCALE * F.col("mad"), F.lit(1e-10))).alias("reach"))
    done, state = bad, stage_table(state, "huber")
    distance = F.abs(F.col("__v") - F.col("mu"))
    weight = F.col("__n") * F.when(distance <= F.col("reach"), F.lit(1.0)).otherwise(F.col("reach") / distance)
    near = F.abs(F.col("new") - F.col("mu")) <= tolerance * (1 + F.abs("mu"))
    for _ in range(rounds):
        if not state.limit(1).count():
            break
        moved = _beside(values, state, key).groupBy(key, "mu", "reach").agg((F.sum(weight * F.col("__v")) / F.sum(weight)).alias("new"))
        moved = stage_table(moved.select(key, F.col("new").alias("mu"), "reach", near.alias("near")), "huber")
        done = done.unionByName(moved.where("near").select(key, "mu"))
        state = moved.where("not near").drop("near")
    return done.unionByName(state.select(key, "mu"))


def huber_by(df: DataFrame, key: str, value: str, k: float = 1.345, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """key and mu, Huber's M-estimate of each key's values (A22); equal values are counted first, and nulls left out.

    Keys of at most ARRAY_VALUES different values go to NumPy as one array each, others by rounds over all of them; of
    either, a key with more than two values that holds NaN or an infinity gets null. Both start at the median, and stop at the same tolerance.
    """
    rows = df.where(F.col(value).isNotNull())
    name, key = key, "__k"  # a struct, as null is a key too
    counted = stage_table(rows.groupBy(F.struct(F.col(name).alias("key")).alias(key), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")), "counted")
    hot = stage_table(counted.groupBy(key).agg(F.count("*").alias("d")).where(F.col("d") > ARRAY_VALUES).select(key), "hot")
    some = hot.limit(1).count() > 0
    few = counted.join(hot, key, "left_anti") if some else counted
    lists = few.groupBy(key).agg(F.collect_list(F.struct("__v", "__n")).alias("__l"))
    found = lists.select(key, huber(F.col("__l.__v"), F.col("__l.__n"), k, tolerance, rounds).alias("mu"))
    if some:
        found = found.unionByName(_huber_rounds(stage_table(_beside(counted, hot, key), "hot_values"), key, k, tolerance, rounds))
    return found.select(F.col("__k.key").alias(name), "mu")


def _scaled(c: str, middle: Column, spread: Column) -> Column:
    return F.coalesce(F.when(spread > 0, (F.col(c) - middle) / spread), F.lit(0.0))


def robust_z(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """df with z_<column> = (value - median) / IQR and null_imputed.

    Null values, an IQR of 0, and fewer than two values give 0. Over the whole table df is written first, and medians and
    quartiles are selected from it by rounds of bounded size; with by, statistics are one row for each group.
    """
    if by:
        stats = [e for c in columns for e in (F.median(c).alias(f"__m_{c}"), iqr(F.col(c)).alias(f"__q_{c}"))]
        df = df.join(df.groupBy(*by).agg(*stats), by)
        z = {f"z_{c}": _scaled(c, F.col(f"__m_{c}"), F.col(f"__q_{c}")) for c in columns}
    else:
        df = stage_table(df, "scores")
        found = quantiles(df, columns, [0.25, 0.5, 0.75])
        z = {f"z_{c}": _scaled(c, F.lit(q[1]), F.lit(q[2] - q[0] if n >= 2 else 0.0)) for c, (n, q) in found.items()}
    missing = F.lit(False)
    for c in columns:
        missing |= F.col(c).isNull()
    return df.withColumns(z | {"null_imputed": missing}).drop(*[f"__{k}_{c}" for k in "mq" for c in columns])


STRUCTURAL, TOPICAL = ("aud", "er_bg", "age"), ("top_vol", "top_focus", "reach")


def composites(scores: DataFrame) -> DataFrame:
    """Structural and topic composites: means of three robust z-scores each."""
    z = robust_z(scores, [*STRUCTURAL, *TOPICAL])
    third = F.lit(1 / 3)
    mean = lambda cs: third * F.col(f"z_{cs[0]}") + third * F.col(f"z_{cs[1]}") + third * F.col(f"z_{cs[2]}")
    return z.withColumns({"structural": mean(STRUCTURAL), "topical": mean(TOPICAL)})


def _medians(with_composites: DataFrame) -> tuple[int, float | None, float | None]:
    """The number of rows and the medians of both composites, which are never null; none of no rows."""
    found = quantiles(with_composites, ["structural", "topical"], [0.5])
    n = found["structural"][0]
    return n, *(found[c][1][0] if n else None for c in ("structural", "topical"))


def thresholds(with_composites: DataFrame) -> DataFrame:
    """One row: the medians of both composites, null of no rows."""
    _, structural, topical = _medians(with_composites)
    return with_composites.sparkSession.createDataFrame([(structural, topical)], "theta_structural double, theta_topical double")


def role(s: Column, t: Column, theta_s: Column, theta_t: Column) -> Column:
    """The quadrant role; values at a threshold count as high (R1), as do those that only rounding puts below it."""
    giant, driver = s >= theta_s - AT_THRESHOLD, t >= theta_t - AT_THRESHOLD
    return F.when(giant & driver, "AUTHORITATIVE").when(giant, "SLEEPING_GIANT").when(driver, "TOPIC_DRIVER").otherwise("BACKGROUND_AUTHOR")


def author_position(positive: Column, neutral: Column, negative: Column) -> Column:
    """An author's attitude (R2)."""
    return F.when((positive >= neutral) & (positive >= negative), "POSITIVE").when((negative >= positive) & (negative >= neutral), "NEGATIVE").otherwise("NEUTRAL")


def audience_response(positive: Column, neutral: Column, negative: Column) -> Column:
    """The audience's response; a neutral majority approves."""
    return F.when(positive > 0.5, "APPROVING").when(negative > 0.5, "CRITICAL").when(neutral > 0.5, "APPROVING").otherwise("MIXED")


def assign_roles(scores: DataFrame) -> DataFrame:
    """Scores with composites, thresholds, roles, positions and responses (R4); nothing for fewer than two authors."""
    found = composites(scores)
    n, structural, topical = _medians(found)
    theta = {"theta_structural": F.lit(structural).cast("double"), "theta_topical": F.lit(topical).cast("double")}
    out = found.withColumns(theta).where(F.lit(n >= 2))
    share = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    pos = [share("pos_positive", 0.0), share("pos_neutral", 1.0), share("pos_negative", 0.0)]
    resp = [share("resp_positive", 0.0), share("resp_neutral", 1.0), share("resp_negative", 0.0)]
    return out.withColumns({
        "role": role(F.col("structural"), F.col("topical"), F.col("theta_structural"), F.col("theta_topical")),
        "position": author_position(*pos), "response": audience_response(*resp),
    })
