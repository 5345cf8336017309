"""Exact order statistics of whole columns, without a task that holds a column's values.

Equal values are counted first, before the shuffle. Then intervals that hold wanted ranks are narrowed in rounds: some of
an interval's distinct values, chosen by a hash, cut it into bins, sums of the counts tell which bins hold the ranks, and
these are the next round's intervals, until an interval's values are few enough to be picked from. Only sums of bins and
the values of such small intervals go to the driver, whose number depends on the columns and ranks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.stage import stage_table

#: Values that cut an interval in a round, about; distinct values of an interval that is picked from.
EDGES, FIT = 64, 500


@dataclass
class _Interval:
    """Distinct values of a series above low and up to high (None: without end), with rows below them and wanted ranks."""

    series: int
    low: Any
    high: Any
    below: int
    distinct: int
    ranks: list[int]
    edges: list = field(default_factory=list)

    def holds(self) -> Column:
        inside = F.col("series") == self.series
        if self.low is not None:
            inside &= F.col("value") > F.lit(self.low)
        return inside if self.high is None else inside & (F.col("value") <= F.lit(self.high))


def _in_order(values: Iterable) -> list:
    """Values sorted as Spark sorts them: NaN is the largest, texts go by their bytes."""
    return sorted(values, key=lambda v: (v != v, 0 if v != v else v))


def _numbered(intervals: list[_Interval]) -> Column:
    """The number of the interval that holds a row; null outside all."""
    return reduce(lambda found, k: found.when(intervals[k].holds(), F.lit(k)), range(1, len(intervals)), F.when(intervals[0].holds(), F.lit(0)))


def _pick(counts: DataFrame, intervals: list[_Interval]) -> dict[tuple[int, int], Any]:
    """The values at the ranks of small intervals."""
    rows: dict[int, list] = {}
    for r in counts.select(_numbered(intervals).alias("k"), "value", "n").where("k is not null").collect():
        rows.setdefault(r["k"], []).append(r)
    found = {}
    for k, own in enumerate(intervals):
        times = {r["value"]: r["n"] for r in rows[k]}
        end, ranks = own.below, sorted(own.ranks)
        for value in _in_order(times):
            end += times[value]
            while ranks and ranks[0] <= end:
                found[own.series, ranks.pop(0)] = value
    return found


def _narrow(counts: DataFrame, intervals: list[_Interval], seed: int) -> list[_Interval]:
    """The bins of these intervals that hold their ranks."""
    kept = counts.withColumn("k", _numbered(intervals)).where("k is not null")
    share = reduce(lambda c, k: c.when(F.col("k") == k, F.lit(min(1.0, EDGES / intervals[k].distinct))), range(len(intervals)), F.when(F.lit(False), F.lit(0.0)))
    drawn = kept.where(F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1 << 40)) < share * float(1 << 40))
    for r in drawn.select("k", "value").collect():
        intervals[r["k"]].edges.append(r["value"])
    for own in intervals:
        own.edges = _in_order(own.edges)
    # A value's bin is the number of edges below it.
    below = reduce(lambda c, k: c.when(F.col("k") == k, F.size(F.filter(F.lit(intervals[k].edges), lambda e: e < F.col("value")))), (k for k, i in enumerate(intervals) if i.edges), F.when(F.lit(False), F.lit(0)))
    bins = {(r["k"], r["bin"]): r for r in kept.groupBy("k", F.coalesce(below, F.lit(0)).alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    found = []
    for k, own in enumerate(intervals):
        start, ends = own.below, [own.low, *own.edges, own.high]
        for b in range(len(own.edges) + 1):
            if (k, b) not in bins:
                continue
            end = start + bins[k, b]["n"]
            if ranks := [r for r in own.ranks if start < r <= end]:
                found.append(_Interval(own.series, ends[b], ends[b + 1], start, bins[k, b]["d"], ranks))
            start = end
    return found


def order_statistics(values: DataFrame, wanted: Callable[[int], Iterable[int]]) -> dict[int, tuple[int, dict[int, Any]]]:
    """For each series its number of values and those at the wanted ranks (from 1, of the number), as {series: (n, {rank: value})}.

    values has series (an int, a few different ones) and value, of any type that Spark orders. Nulls do not count, and a
    series of nothing but nulls is left out; ranks outside 1 to n are ignored.
    """
    counts = stage_table(values.where("value is not null").groupBy("series", "value").agg(F.count("*").alias("n")), "values")
    out: dict[int, tuple[int, dict[int, Any]]] = {}
    open_: list[_Interval] = []
    for r in counts.groupBy("series").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        out[r["series"]] = (r["n"], {})
        if ranks := sorted({k for k in wanted(r["n"]) if 1 <= k <= r["n"]}):
            open_.append(_Interval(r["series"], None, None, 0, r["d"], ranks))
    small: list[_Interval] = []
    seed = 0
    while open_:
        small += [i for i in open_ if i.distinct <= FIT]
        if open_ := [i for i in open_ if i.distinct > FIT]:
            open_, seed = _narrow(counts, open_, seed), seed + 1
    if small:
        for (series, rank), value in _pick(counts, small).items():
            out[series][1][rank] = value
    return out


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, tuple[int, list[float]]]:
    """For each column its number of values and its linear (type 7) quantiles; of no values, 0 and quantiles of 0."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)]))
    found = order_statistics(df.select(each.alias("e")).select("e.*"), lambda n: (k for p in shares for k in (int(p * (n - 1)) + 1, int(p * (n - 1)) + 2)))

    def at(n: int, ranks: dict[int, float], p: float) -> float:
        place = p * (n - 1)
        low = ranks[int(place) + 1]
        part = place - int(place)
        return low + part * (ranks[int(place) + 2] - low) if part else low

    return {c: (found[k][0], [at(*found[k], p) for p in shares]) if k in found else (0, [0.0] * len(shares)) for k, c in enumerate(columns)}
