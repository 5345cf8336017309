"""Bootstrap confidence intervals.

Two forms give the same kind of interval. The hashed form draws by a hash of (seed, key, iteration, draw) and can be
checked value by value: means and sums in NumPy over a key's arrays, other aggregates by built-in functions alone. The NumPy form draws with a generator seeded by (seed,
author), so its results depend on neither cores nor partitions; it gets counts, not rows, wherever counts are enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vociflow.functions.text import let
from vociflow.stage import number_rows, stage_table

TAILS = (0.025, 0.975)
#: Rows of a key up to which they are collected, and rows of an array that draws pick from.
ARRAY_ROWS, LEAF_ROWS = 10_000, 4_000
#: Arrays, and bytes of them, that a task's Python gets at once, at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
#: Modulus, multipliers and strides of the hash that draws.
MODULUS, FIRST, SECOND, BY_ITERATION, BY_PLACE, BY_CHUNK = 2147483647, 48271, 69621, 1000003, 7919, 104729


def _start(seed: int, key: Column) -> Column:
    """32 bits of an MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def _mixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column of numbers below 2^31 that depend on all bits of value; step by step, so that none is computed twice."""
    df = df.withColumn(name, F.pmod(F.pmod(value, F.lit(MODULUS)) * FIRST, F.lit(MODULUS)))
    df = df.withColumn(name, F.col(name).bitwiseXOR(F.shiftright(name, 15)))
    df = df.withColumn(name, F.pmod(F.col(name) * SECOND, F.lit(MODULUS)))
    return df.withColumn(name, F.col(name).bitwiseXOR(F.shiftright(name, 13)))


def _mixed_value(value: Column) -> Column:
    """_mixed() of one value within an expression."""
    step = lambda v, by, bits: let(F.pmod(v * by, F.lit(MODULUS)), lambda x: x.bitwiseXOR(F.shiftright(x, bits)))
    return let(step(F.pmod(value, F.lit(MODULUS)), FIRST, 15), lambda x: step(x, SECOND, 13))


def _reduced(x: np.ndarray, spare: np.ndarray) -> None:
    """x modulo MODULUS, a number of 31 bits that are all set, in place; x is at least 0 and below 2^62."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, MODULUS, out=x)
        np.add(x, spare, out=x)
    np.copyto(x, 0, where=x == MODULUS)


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """_mixed() of an array, in place."""
    _reduced(x, spare)
    for by, bits in ((FIRST, 15), (SECOND, 13)):
        np.multiply(x, by, out=x)
        _reduced(x, spare)
        np.right_shift(x, bits, out=spare)
        np.bitwise_xor(x, spare, out=x)


def draw_sums(start: np.ndarray, draws: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of columns over the rows that each iteration draws; start has the iterations' hashes, draws their draws.

    Iterations go in slices, so that what they draw stays in the processor's cache.
    """
    n = len(columns[0])
    sums = [np.zeros(len(start)) for _ in columns]
    wide = int(draws.max(initial=0))
    step = max(1, 32_768 // max(1, wide))
    places = np.arange(wide, dtype=np.int64) * BY_PLACE
    for at in range(0, len(start) if wide else 0, step):
        x = start[at : at + step, None] + places
        _mix(x, spare := np.empty_like(x))
        np.multiply(x, n, out=x)
        np.right_shift(x, 31, out=x)
        here = draws[at : at + step]
        some = None if here.min() == wide else np.arange(wide) < here[:, None]
        for total, column in zip(sums, columns, strict=True):
            picked = column[x]
            total[at : at + step] = picked.sum(1) if some is None else np.where(some, picked, 0).sum(1)
    return sums


def percentiles(found: np.ndarray) -> list[float | None]:
    """Percentiles at TAILS of the numbers that are there, with linear interpolation; none without any."""
    ordered = np.sort(found[~np.isnan(found)])
    if not len(ordered):
        return [None] * len(TAILS)
    out = []
    for tail in TAILS:
        place = (len(ordered) - 1) * tail
        low, high = int(np.floor(place)), int(np.ceil(place))
        out.append(float(ordered[low] if low == high else (high - place) * ordered[low] + (place - low) * ordered[high]))
    return out


def _statistic(kind: str, total: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A mean or sum by iteration; not a number where no value was drawn."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / there if kind == "mean" else np.where(there > 0, total, np.nan)


def _in_numpy(chunks: DataFrame, key: str, kinds: dict[str, str], iterations: int, seed: int, leaf_rows: int) -> DataFrame:
    """Intervals of means and sums of the columns that kinds names, from arrays of rows.

    A key with one array is done where that lies. Of others, each array gives its sums by iteration, which are then added.
    """
    one = F.col("__n") <= leaf_rows
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long")), lambda b: _mixed_value(F.col("__s") + b * BY_ITERATION))
    own = lambda h: F.struct(_mixed_value(h + (F.col("__c") + 1) * BY_CHUNK).alias("h"), _in_chunk(h, F.col("__n"), F.col("__c"), leaf_rows).alias("m"))
    rows = chunks.withColumn("__s", _start(seed, F.col(key))).withColumn("__b", F.when(~one, F.transform(hashes, own)))
    columns = [F.col("__v")[name].alias(f"__x{k}") for k, name in enumerate(kinds)]
    rows = rows.select(key, "__s", F.size("__v").cast("long").alias("__n"), F.col("__b.h").alias("__h"), F.col("__b.m").alias("__m"), *columns)
    ends, parts = [f"{n}_{end}" for n in kinds for end in ("low", "high")], [f"__p{k}" for k in range(2 * len(kinds))]
    kind_of = chunks.schema[key].dataType
    schema = f"`{key}` {kind_of.simpleString()}, " + ", ".join(f"`{e}` double" for e in ends) + ", " + ", ".join(f"{p} array<double>" for p in parts)
    arrow = to_arrow_type(kind_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, open_ = [[] for _ in ends], [[] for _ in parts]
            for i in range(batch.num_rows):
                start, n = batch.column("__s")[i].as_py(), batch.column("__n")[i].as_py()
                values = [batch.column(f"__x{k}")[i].values for k in range(len(kinds))]
                gone = [v.is_null().to_numpy(zero_copy_only=False) for v in values]
                values = [v.to_numpy(zero_copy_only=False).astype(float) for v in values]
                columns = [np.where(g, 0, v) for v, g in zip(values, gone, strict=True)] + [(~g).astype(float) for g in gone if g.any()]
                single = not batch.column("__h")[i].is_valid
                if single:
                    h = start + np.arange(iterations, dtype=np.int64) * BY_ITERATION
                    _mix(h, np.empty_like(h))
                    m = np.full(iterations, n, np.int64)
                else:
                    h, m = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("__h", "__m"))
                sums = draw_sums(h, m, columns)
                more = iter(sums[len(kinds) :])
                there = [next(more) if g.any() else m.astype(float) for g in gone]
                for k, kind in enumerate(kinds.values()):
                    low_high = percentiles(_statistic(kind, sums[k], there[k])) if single else (None, None)
                    done[2 * k].append(low_high[0])
                    done[2 * k + 1].append(low_high[1])
                    open_[2 * k].append(None if single else sums[k])
                    open_[2 * k + 1].append(None if single else there[k])
            arrays = [pa.array(x, pa.float64()) for x in done] + [pa.array(x, pa.list_(pa.float64())) for x in open_]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(arrow), *arrays], [key, *ends, *parts])

    found = rows.mapInArrow(run, schema)
    placed = found.select(key, *ends, F.posexplode_outer(F.arrays_zip(*parts)).alias("__b", "__p")).select(key, *ends, "__b", "__p.*")
    by_iteration = placed.groupBy(key, "__b").agg(*[F.max(e).alias(e) for e in ends], *[F.sum(p).alias(p) for p in parts])
    total = lambda k, kind: F.when(F.col(f"__p{2 * k + 1}") > 0, F.col(f"__p{2 * k}") / (F.col(f"__p{2 * k + 1}") if kind == "mean" else 1.0))
    out = [
        F.coalesce(F.max(f"{n}_{end}"), F.percentile(total(k, kind), F.lit(t))).alias(f"{n}_{end}")
        for k, (n, kind) in enumerate(kinds.items()) for t, end in zip(TAILS, ("low", "high"), strict=True)
    ]
    return by_iteration.groupBy(key).agg(*out)


def _drawn(df: DataFrame) -> DataFrame:
    """df, with rows of an iteration (__h) of a key of __n rows and a place (__d), and the index from 0 that is drawn (__i)."""
    return _mixed(df, "__x", F.col("__h") + F.col("__d") * BY_PLACE).withColumn("__i", F.shiftright(F.col("__x") * F.col("__n"), 31))


def _iterations(df: DataFrame, seed: int, key: str, iterations: int) -> DataFrame:
    """df, a row for each iteration (__b), with the hash that its draws go on from (__h)."""
    rows = df.withColumn("__s", _start(seed, F.col(key))).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    return _mixed(rows, "__h", F.col("__s") + F.col("__b") * BY_ITERATION)


def _normal(u: Column) -> Column:
    """The standard normal quantile of u, between 0 and 1, to about 0.00045 (a published rational approximation)."""
    rest = lambda t: (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return let(u, lambda v: let(F.sqrt(-2 * F.log(F.least(v, 1 - v))), lambda t: F.signum(v - 0.5) * (t - rest(t))))


def _in_chunk(h: Column, n: Column, chunk: Column, rows: int) -> Column:
    """How many of n draws from n rows fall into one of the chunks of so many rows, by a binary tree over the chunks.

    Each node's draws part between its halves by a binomial number, which depends on the iteration's hash and the node
    alone, so that all chunks of a key find the same tree. Nodes hold far more than 1,000 rows: the binomial quantile is
    that of the normal distribution, with its skewness.
    """

    def left_draws(node: Column, middle: Column) -> Column:
        p = (middle - node["lo"]) * rows / (F.least(node["hi"] * rows, n) - node["lo"] * rows)
        u = (F.pmod(F.xxhash64(h, node["lo"], node["hi"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        spread = lambda p, z: node["drawn"] * p + F.sqrt(node["drawn"] * p * (1 - p)) * z + (1 - 2 * p) / 6 * (z * z - 1)
        found = let(p, lambda p: let(_normal(u), lambda z: spread(p, z)))
        return F.greatest(F.lit(0).cast("long"), F.least(node["drawn"], F.round(found).cast("long")))

    def halve(node: Column, _) -> Column:
        part = lambda lo, hi, drawn: F.struct(lo.alias("lo"), hi.alias("hi"), drawn.alias("drawn"))
        side = lambda m, left: F.when(chunk < m, part(node["lo"], m, left)).otherwise(part(m, node["hi"], node["drawn"] - left))
        split = let(F.floor((node["lo"] + node["hi"]) / 2), lambda m: let(left_draws(node, m), lambda left: side(m, left)))
        return F.when(node["hi"] - node["lo"] <= 1, node).otherwise(split)

    chunks = F.ceil(n / rows)
    root = F.struct(F.lit(0).cast("long").alias("lo"), chunks.alias("hi"), n.alias("drawn"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(chunks)).cast("int") + 1), root, halve, lambda node: node["drawn"])


def _chunks(rows: DataFrame, key: str, order: str, array_rows: int, leaf_rows: int) -> DataFrame:
    """key, __n, __c and __v: the rows of each key, which has __n, in arrays of leaf_rows, in order.

    Keys of array_rows rows or fewer are collected and cut; the rows of larger ones are numbered in one global order, so
    that they never meet in one task.
    """
    columns = [order, *[c for c in rows.columns if c not in (key, order, "__n")]]
    whole = rows.where(F.col("__n") <= array_rows).groupBy(key, "__n").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("__v"))
    cut = whole.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__n") / leaf_rows) - 1)))
    cut = cut.select(key, "__n", "__c", F.when(F.col("__n") <= leaf_rows, F.col("__v")).otherwise(F.slice("__v", F.col("__c") * leaf_rows + 1, F.lit(leaf_rows))).alias("__v"))
    large = rows.where(F.col("__n") > array_rows)
    if not large.limit(1).count():
        return cut
    large = stage_table(large, "large")
    placed = stage_table(number_rows(large, [F.col(key), F.col(order)], large.count(), "__p"), "placed")
    first = placed.groupBy(key).agg(F.min("__p").alias("__first"))  # a row for more than array_rows rows
    numbered = placed.join(first, key).withColumn("__c", F.floor((F.col("__p") - F.col("__first")) / leaf_rows))
    return cut.unionByName(numbered.groupBy(key, "__n", "__c").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("__v")))


def hashed_intervals(
    values: DataFrame, key: str, order: str, statistics: dict[str, Column | tuple[str, Column]], iterations: int, seed: int = 42, array_rows: int = ARRAY_ROWS, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Percentile intervals of statistics over resampled rows, for keys with two rows or more (B1, B2).

    statistics are pairs of mean or sum and a number of each row, or, slower, any aggregates over the columns of values, one
    kind for all; both draw the same rows. order numbers a key's rows. Rows lie in arrays of leaf_rows, from
    which draws pick in place; where a key has several, a binomial tree says how many of its draws fall to each. So no
    large group is collected, no draws are shuffled, and array_rows changes the plan alone.
    """
    kinds = {n: x[0] for n, x in statistics.items() if isinstance(x, tuple)}
    if kinds:
        if len(kinds) < len(statistics) or set(kinds.values()) - {"mean", "sum"}:
            raise ValueError("statistics are all aggregates, or all pairs of mean or sum and a column")
        values = values.select(key, order, *[x[1].cast("double").alias(n) for n, x in statistics.items()])
        # Arrays of a key's rows may be long: bounded batches.
        values.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        values.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    counted = values.groupBy(key).agg(F.count("*").alias("__n")).where("__n >= 2")
    # A number of partitions of its own: arrays are few bytes but much work, and would else be put together in few tasks.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = _chunks(values.join(counted, key), key, order, array_rows, leaf_rows).repartition(tasks, key, "__c")
    if kinds:
        return _in_numpy(chunks, key, kinds, iterations, seed, leaf_rows)
    draws = _iterations(chunks, seed, key, iterations)
    one = F.col("__n") <= leaf_rows
    draws = draws.withColumn("__m", F.when(one, F.col("__n")).otherwise(_in_chunk(F.col("__h"), F.col("__n"), F.col("__c"), leaf_rows)))
    draws = _mixed(draws, "__g", F.col("__h") + (F.col("__c") + 1) * BY_CHUNK).withColumns({"__h": F.when(one, F.col("__h")).otherwise(F.col("__g")), "__n": F.size("__v").cast("long")})
    drawn = _drawn(draws.withColumn("__d", F.explode(F.when(F.col("__m") > 0, F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)))))
    drawn = drawn.select(key, "__b", F.get("__v", F.col("__i").cast("int")).alias("__r")).select(key, "__b", "__r.*")
    stats = drawn.groupBy(key, "__b").agg(*[s.alias(n) for n, s in statistics.items()])
    out = [F.percentile(n, F.lit(t)).alias(f"{n}_{end}") for n in statistics for t, end in zip(TAILS, ("low", "high"), strict=True)]
    return stats.groupBy(key).agg(*out)


def _generator(seed: int, key) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def one_level(values: np.ndarray, times: np.ndarray, rng: np.random.Generator, iterations: int, statistic: str = "mean") -> tuple[float, float] | None:
    """The interval of a mean or sum of distinct values and how often each occurs; none for fewer than two (B1).

    Draws with replacement are places among the rows or, where few values occur often, multinomial counts of the distinct
    values; they are made in slices of bounded size.
    """
    n = int(times.sum())
    if n < 2:
        return None
    if 8 * len(values) <= n:
        step = max(1, 2_000_000 // len(values))
        sums = [rng.multinomial(n, times / n, min(step, iterations - k)) @ values for k in range(0, iterations, step)]
    else:
        rows, step = np.repeat(values, times), max(1, 2_000_000 // n)
        sums = [rows[rng.integers(0, n, (min(step, iterations - k), n))].sum(1) for k in range(0, iterations, step)]
    found = np.concatenate(sums)
    return tuple(np.quantile(found / n if statistic == "mean" else found, TAILS))


def binomial_sums(labels: np.ndarray, shares: np.ndarray, rng: np.random.Generator, times: int) -> np.ndarray:
    """As many draws for each row of labels, each the sum of binomial numbers of its labels with their shares, between 0 and 1.

    Of small rows the distribution of the sum itself is made, from its Fourier transform, and drawn from: that is one number
    a draw and not one for each share.
    """
    size = int(labels.sum(1).max(initial=0)) + 1
    if size > times * len(shares):
        return rng.binomial(labels[:, :, None], shares[:, None], (len(labels), len(shares), times)).sum(1)
    out, step = [], max(1, 1_000_000 // size)
    turns = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    each = 1 - shares[:, None] + shares[:, None] * turns
    logs = np.log(np.where(np.abs(each) < 1e-300, 1e-300, each))  # a share of a half is 0 at half a turn
    for a in range(0, len(labels), step):
        part = labels[a : a + step]
        sums = np.cumsum(np.maximum(np.fft.irfft(np.exp(part.astype(float) @ logs), size), 0), 1)
        sums /= sums[:, -1:]
        rows = np.arange(len(part))[:, None]
        found = np.searchsorted((sums + rows).ravel(), (rng.random((len(part), times)) + rows).ravel(), "right").reshape(len(part), times) - rows * size
        out.append(np.minimum(found, part.sum(1)[:, None]))
    return np.concatenate(out)


def two_level(counts: np.ndarray, times: np.ndarray, rng: np.random.Generator, outer: int, inner: int) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """Intervals of the positive and negative shares of clustered labels.

    counts has a row (positive, neutral, negative) for each kind of cluster, and times the clusters of that kind.
    Clusters are drawn, then within each drawn one as many labels as it has. Empty clusters are left out, and fewer than
    two give none.
    """
    some = counts.sum(1) > 0
    counts, times = counts[some], times[some]
    n = int(times.sum())
    if n < 2:
        return None
    sizes = counts.sum(1)
    out = []
    for label in (0, 2):  # each label's interval needs its own share alone: clusters with the same share of it draw together
        shares, kind = np.unique(counts[:, label] / sizes, return_inverse=True)
        into = np.zeros((len(sizes), len(shares)), np.int64)
        into[np.arange(len(sizes)), kind] = sizes
        some = (shares > 0) & (shares < 1)  # else there is nothing to draw
        step = max(1, 1_000_000 // (inner * len(shares)))
        found = []
        for a in range(0, outer, step):
            labels = rng.multinomial(n, times / n, min(step, outer - a)) @ into  # labels drawn with each share, by outer iteration
            drawn = binomial_sums(labels[:, some], shares[some], rng, inner) + labels[:, shares == 1].sum(1)[:, None]
            found.append((drawn / labels.sum(1)[:, None]).ravel())
        out.append(tuple(np.quantile(np.concatenate(found), TAILS)))
    return out[0], out[1]


INTERVALS = "author_id long, score string, low double, high double"


def intervals(samples: DataFrame, iterations: int = 1000, outer: int = 300, inner: int = 100, seed: int = 42) -> DataFrame:
    """Intervals of all scores (B4) from rows (author_id, score, kind, value, cluster, label).

    kind is mean, sum, label or cluster; label rows give <score>_positive and <score>_negative, as cluster rows do. Rows
    are counted before they are dealt: a task gets a score's distinct values, or its kinds of clusters by their labels.
    """
    labels = ("POSITIVE", "NEUTRAL", "NEGATIVE")
    of = [F.count_if(F.col("label") == x).alias(f"n{k}") for k, x in enumerate(labels)]
    by = ["author_id", "score", "kind"]
    none = [F.lit(0).cast("long").alias(f"n{k}") for k in range(3)]
    values = samples.where(F.col("kind").isin("mean", "sum")).groupBy(*by, "value").agg(F.count("*").alias("times")).select(*by, "value", "times", *none)
    judged = samples.where(~F.col("kind").isin("mean", "sum")).withColumn("cluster", F.when(F.col("kind") == "cluster", F.col("cluster")))
    clusters = judged.groupBy(*by, "cluster").agg(*of).groupBy(*by, "n0", "n1", "n2").agg(F.count("*").alias("times"))
    counted = values.unionByName(clusters.select(*by, F.lit(None).cast("double").alias("value"), "times", "n0", "n1", "n2"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        author, score, kind = pdf["author_id"].iloc[0], pdf["score"].iloc[0], pdf["kind"].iloc[0]
        rng = _generator(seed, f"{author}|{score}")
        pdf = pdf.sort_values(["value", "n0", "n1", "n2"], kind="stable")
        times, counts = pdf["times"].to_numpy(), pdf[["n0", "n1", "n2"]].to_numpy()
        out = []
        if kind in ("mean", "sum"):
            if found := one_level(pdf["value"].to_numpy(float), times, rng, iterations, kind):
                out.append((author, score, *found))
        elif kind == "label":
            n = counts.sum()
            if n >= 2:
                drawn = rng.multinomial(n, counts[0] / n, iterations) / n
                out += [(author, f"{score}_{x}", *np.quantile(drawn[:, k], TAILS)) for x, k in (("positive", 0), ("negative", 2))]
        elif found := two_level(counts, times, rng, outer, inner):
            out += [(author, f"{score}_{x}", *f) for x, f in zip(("positive", "negative"), found, strict=True)]
        return pd.DataFrame(out, columns=["author_id", "score", "low", "high"])

    # A number of partitions of its own: the counts are few bytes but much work, and would else be put together in few tasks.
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(tasks, "author_id", "score").groupBy("author_id", "score").applyInPandas(run, INTERVALS)


def score_samples(authors: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """The rows that intervals are drawn from, in long form."""
    from vociflow.operators.scores import BASELINE, TOPIC, comments_of_topic_posts, reactions

    followed = authors.select(F.col("vk_id").alias("author_id"), F.coalesce("followers", F.lit(0)).alias("followers"))
    rows = posts.withColumnRenamed("from_id", "author_id").join(followed, "author_id")

    def part(df: DataFrame, score: str, kind: str, value: Column, cluster: Column, label: Column) -> DataFrame:
        return df.select(
            F.col("author_id").cast("long").alias("author_id"), F.lit(score).alias("score"), F.lit(kind).alias("kind"), value.cast("double").alias("value"),
            cluster.cast("long").alias("cluster"), label.cast("string").alias("label"),
        )

    none, own = F.lit(None), F.col("id")
    topic, rate = rows.where(TOPIC), reactions() / F.col("followers")
    seen = F.when(F.coalesce("views", F.lit(0)) > 0, F.col("views")).otherwise(F.col("followers"))
    under = comments_of_topic_posts(posts, comments)
    return (
        part(rows.where(f"{BASELINE} and followers > 0"), "er_bg", "mean", rate, own, none)
        .unionAll(part(topic.where("followers > 0"), "er_top", "mean", rate, own, none))
        .unionAll(part(topic, "reach", "sum", seen, own, none))
        .unionAll(part(topic, "pos", "label", none, own, F.col("label")))
        .unionAll(part(under, "resp", "cluster", none, F.col("post_id"), F.col("comment_label")))
    )


def mean_width(found: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Mean width of each author's intervals (A26); scores whose unit differs may be left out."""
    rows = found.where(~F.col("score").isin(*exclude)) if exclude else found
    return rows.groupBy("author_id").agg(F.avg(F.col("high").cast("float") - F.col("low").cast("float")).alias("ci_width"))
