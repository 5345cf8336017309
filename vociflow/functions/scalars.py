"""Scalar rules: topic levels, sentiment vectors, vectors, dates, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vociflow.params import DEFAULT, Params


def keyword_level(primary: Column, secondary: Column, excluded: Column, p: Params = DEFAULT) -> Column:
    """min(primary + 0.3 secondary, 3) / 3 in single precision; 0 if excluded."""
    level = F.least((primary + p.secondary_weight * secondary).cast("float"), F.lit(3.0).cast("float")) / 3
    return F.when(excluded, F.lit(0.0)).otherwise(level).cast("float")


def topic_decision(level: Column, excluded: Column, semantic: Column, full: bool = True, p: Params = DEFAULT) -> Column:
    """stratum, pass, relevance and combined score of the two-pass topic filter (X11)."""

    def row(stratum: str, step: str, relevant: Column, combined: Column) -> Column:
        return F.struct(F.lit(stratum).alias("stratum"), F.lit(step).alias("filter_pass"), relevant.alias("relevant"), combined.cast("float").alias("combined"))

    yes, no = F.lit(True), F.lit(False)
    second = F.coalesce(semantic, F.lit(0.0))
    border = F.when(second >= p.semantic, row("PASS2_CONFIRMED", "L1_AND_SEMANTIC", yes, second)).otherwise(row("DISPUTED", "L1_AND_SEMANTIC", no, second))
    return (
        F.when(excluded, row("EXCLUDED", "L1_ONLY", no, F.lit(0.0)))
        .when(level < F.lit(p.l1_zero).cast("float"), row("DISPUTED", "L1_ONLY", no, level))
        .when(level >= F.lit(p.l1_confident).cast("float"), row("CONFIDENT", "L1_ONLY", yes, level))
        .otherwise(border if full else row("DISPUTED", "L1_BORDERLINE", no, level))
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, kept within 0 and 1; 0 for a zero vector or different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def within_hours(a: Column, b: Column, hours: int = DEFAULT.near_hours) -> Column:
    """Whether two times lie at most so many hours apart."""
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) <= hours * 3600


def label_to_distribution(label: Column, score: Column) -> Column:
    """Probabilities (positive, neutral, negative) for a label and its score."""
    half = score / 2

    def vector(p: Column, z: Column, n: Column) -> Column:
        return F.struct(p.cast("double").alias("positive"), z.cast("double").alias("neutral"), n.cast("double").alias("negative"))

    return (
        F.when(label == "POSITIVE", vector(0.5 + half, 0.5 - half, F.lit(0.0)))
        .when(label == "NEGATIVE", vector(F.lit(0.0), 0.5 + half, 0.5 - half))
        .otherwise(vector(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    )


def dominant(positive: Column, neutral: Column, negative: Column) -> Column:
    """The label of the largest share; ties go to positive, then negative."""
    return F.when((positive >= negative) & (positive >= neutral), "POSITIVE").when((negative >= positive) & (negative >= neutral), "NEGATIVE").otherwise("NEUTRAL")


def age_days(first_seen: Column, as_of: Column) -> Column:
    """Whole days since an author was first seen, 0 if unknown or in the future."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(first_seen)) / 86400)
    return F.greatest(F.coalesce(days, F.lit(0)), F.lit(0))


def window_name(ts: Column, as_of: Column, p: Params = DEFAULT) -> Column:
    """CURRENT or BASELINE by a time's distance from as_of in whole seconds; null outside both, and less than a second after as_of too."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    current, all_days = p.current_days * 86400, (p.current_days + p.baseline_days) * 86400
    return F.when((ts <= as_of) & (age <= current), "CURRENT").when((age > current) & (age <= all_days), "BASELINE")


def sentiment_lean(positive: Column, negative: Column) -> Column:
    """Direction and saturated strength of a sentiment balance, -1 to 1: the cube root of the magnitude."""
    lean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), positive - negative))
    return F.signum(lean) * F.pow(F.abs(lean), F.lit(1 / 3))


def scale_axis(value: Column, low: Column, high: Column) -> Column:
    """Position 0 to 1 on an axis from low to high with a tenth of padding; ranges count 0.01 at least."""
    span = F.greatest(high - low, F.lit(0.01))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - (low - 0.1 * span)) / (1.2 * span)))


def nice_max(value: Column) -> Column:
    """The least of 1, 1.5, 2, 3, 5, 7.5, 10 times a power of ten that is not below the value; 1 for 0 or less."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    steps = F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0, 3.0, 5.0, 7.5, 10.0)])
    return F.when(value > 0, F.get(F.filter(steps, lambda s: s * power >= value), F.lit(0)) * power).otherwise(F.lit(1.0))


def nice_ticks(top: Column, ticks: int = 5) -> Column:
    """Ticks from 0 to a maximum, with a step of 1, 2, 2.5, 5 or 10 times a power of ten."""
    raw = top / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    steps = F.array(*[F.lit(x) for x in (1.0, 2.0, 2.5, 5.0, 10.0)])
    step = F.get(F.filter(steps, lambda s: s * power >= raw), F.lit(0)) * power
    return F.transform(F.sequence(F.lit(0), F.floor(top / step).cast("int")), lambda k: k * step)


def clamp01(value: Column) -> Column:
    """A value kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def interval_bar(value: Column, low: Column, high: Column) -> Column:
    """low, value and high of an interval bar within 0 and 1; missing ends are the value."""
    return F.struct(clamp01(F.coalesce(low, value)).alias("low"), clamp01(value).alias("value"), clamp01(F.coalesce(high, value)).alias("high"))


def format_count(n: Column) -> Column:
    """A count as 1.2M, 3.4K or plain."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000.0)).when(n >= 1000, F.format_string("%.1fK", n / 1000.0)).otherwise(n.cast("string"))
    )


def marker_radius(engagement: Column) -> Column:
    """Radius 5 to 12 for an engagement rate up to 0.3, and 14 at most."""
    rate = F.greatest(F.lit(0.0), F.least(F.lit(0.3), F.coalesce(engagement, F.lit(0.0))))
    return F.greatest(F.lit(5.0), F.least(F.lit(14.0), 5 + rate / 0.3 * 7))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent of progress, 0 without a total."""
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(F.lit(0)).cast("int")
