"""Exact order statistics and places of rows against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vociflow import stage
from vociflow.operators import selection


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(selection, "FIT", 20)
    monkeypatch.setattr(selection, "EDGES", 5)


def test_quantiles_of_distinct_and_of_hot_values(spark, small_steps):
    rng = np.random.default_rng(1)
    distinct, hot, wide = rng.random(3001), np.where(rng.random(3001) < 0.4, 7.0, rng.integers(0, 90, 3001)), np.exp(40 * rng.standard_normal(3001))
    rows = [(float(a), float(b), float(c), None, 2.0 if k == 0 else None) for k, (a, b, c) in enumerate(zip(distinct, hot, wide, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    found = selection.quantiles(df, list("abcde"), [0.0, 0.25, 0.5, 0.75, 1.0])
    for name, own in zip("abc", (distinct, hot, wide), strict=True):
        n, got = found[name]
        assert n == 3001 and np.allclose(got, np.quantile(own, [0.0, 0.25, 0.5, 0.75, 1.0]), rtol=1e-12)
    assert found["d"] == (0, [0.0] * 5) and found["e"] == (1, [2.0] * 5)


def test_texts_and_nan_are_ordered_as_by_spark(spark, small_steps):
    texts = sorted({f"{'äöüz'[k % 4]}{k * 7919 % 1000}" for k in range(700)} | {"", "\U0001f600", "￿"}, key=lambda t: t.encode())
    found = selection.order_statistics(spark.createDataFrame([(0, t) for t in texts], "series int, value string"), lambda n: [0, 1, n // 3, n, n + 1])
    assert found == {0: (len(texts), {1: texts[0], len(texts) // 3: texts[len(texts) // 3 - 1], len(texts): texts[-1]})}
    values = spark.createDataFrame([(3, v) for v in [math.nan, 1.0, math.inf, -math.inf] * 30], "series int, value double")
    n, at = selection.order_statistics(values, lambda n: [30, 31, 90, 91])[3]
    assert n == 120 and at[30] == -math.inf and at[31] == 1.0 and at[90] == math.inf and math.isnan(at[91])


def test_intervals_that_are_picked_from_are_bounded(spark, small_steps, monkeypatch):
    picked = []
    pick = selection._pick
    monkeypatch.setattr(selection, "_pick", lambda counts, intervals: picked.extend(intervals) or pick(counts, intervals))
    df = spark.range(5000).select(F.lit(0).alias("series"), F.xxhash64("id").alias("value"))
    order = sorted(r["value"] for r in df.collect())
    assert selection.order_statistics(df, lambda n: [n // 2])[0] == (5000, {2500: order[2499]})
    assert all(i.distinct <= 20 for i in picked)


def test_rows_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(stage, "RUN_ROWS", 50)
    monkeypatch.setattr(stage, "SPAN", 3)
    rows = [(None if k % 50 == 0 else k * 37 % 101, k % 2) for k in range(1000)]
    df = stage.stage_table(spark.createDataFrame(rows, "a int, b int"), "rows")
    found = sorted(stage.number_rows(df, [F.col("a"), F.desc("b")], 1000).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(1000))
    assert [(r["a"], r["b"]) for r in found] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert stage.number_rows(df.limit(0), [F.col("a")], 0).count() == 0
