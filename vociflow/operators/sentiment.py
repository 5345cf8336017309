"""Dictionary sentiment with negation and signals (N1-N4), and the cache of model results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.functions import text
from vociflow.params import DEFAULT, Lexicon, Params
from vociflow.stage import stage_table

#: Buckets of a table of cached results.
CACHE_BUCKETS = 32


def _in(word: Column, words: tuple[str, ...]) -> Column:
    return F.lower(word).isin(*words) if words else F.lit(False)


def polarity_counts(tokens: Column, lexicon: Lexicon, window: int = 3) -> Column:
    """positive and negative words and whether a negator turned one round.

    A word is turned if a negator is among the words just before it; several do not add up.
    """

    def mark(word: Column, i: Column) -> Column:
        before = F.slice(tokens, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
        turned = F.exists(before, lambda w: _in(w, lexicon.negators))
        up, down = _in(word, lexicon.positive), _in(word, lexicon.negative) & ~_in(word, lexicon.positive)
        return F.when(up, F.when(turned, -2).otherwise(1)).when(down, F.when(turned, 2).otherwise(-1)).otherwise(0)

    def counts(marks: Column) -> Column:
        count = lambda *values: F.size(F.filter(marks, lambda m: m.isin(*values)))
        return F.struct(count(1, 2).alias("positive"), count(-1, -2).alias("negative"), (count(2, -2) > 0).alias("negated"))

    return text.let(F.transform(tokens, mark), counts)


def _result(label: Column | str, score: Column, method: str, negated: Column) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), score.cast("float").alias("score"), F.lit(method).alias("method"), negated.alias("negated"))


def by_signals(tokens: Column, lexicon: Lexicon, p: Params = DEFAULT) -> Column:
    """Sentiment from signal words, exclamation and capitals."""
    count = lambda f: F.size(F.filter(tokens, f))
    bad = count(lambda w: _in(w, lexicon.negative_signals)) + count(lambda w: F.contains(w, F.lit("?!")) | F.contains(w, F.lit("!?")))
    cries = count(lambda w: F.contains(w, F.lit("!")))
    shouted = count(lambda w: (F.length(w) > 2) & (w == F.upper(w)) & w.rlike(r"\p{L}"))
    found = F.struct(
        count(lambda w: _in(w, lexicon.positive_signals)).alias("good"), bad.alias("bad"), cries.alias("cries"), count(lambda w: F.contains(w, F.lit("?"))).alias("asks"), shouted.alias("shouted")
    )

    def strength(c: Column) -> Column:
        force = F.least(c["cries"] + c["shouted"], F.lit(3))
        strong, weak = 0.2 + force * 0.05, 0.15 + force * 0.05
        return F.when(c["good"] > c["bad"], strong).when(c["good"] < c["bad"], -strong).when((force > 0) & (c["asks"] > c["cries"]), -weak).when(force > 0, weak).otherwise(F.lit(0.0))

    def judge(raw: Column) -> Column:
        label = F.when(raw > 0, "POSITIVE").otherwise("NEGATIVE")
        return F.when(F.abs(raw) < p.low_confidence, _result("NEUTRAL", F.lit(0.0), "NO_LEXICON_MATCH", F.lit(False))).otherwise(_result(label, raw, "SIGNAL", F.lit(False)))

    return text.let(text.let(found, strength), judge)


def by_dictionary(tokens: Column, lexicon: Lexicon, p: Params = DEFAULT) -> Column:
    """label, score, method and negated of a token list (N1): words first, then signals."""

    def judge(counts: Column, words: Column) -> Column:
        up, down = counts["positive"], counts["negative"]
        score = ((up - down) / (up + down + 1)).cast("float")
        weak = F.abs(score) < F.lit(p.low_confidence).cast("float")
        label = F.when(score > 0, "POSITIVE").otherwise("NEGATIVE")
        found = F.when(weak, _result("NEUTRAL", score, "LOW_CONFIDENCE", counts["negated"])).otherwise(_result(label, score, "DICTIONARY", counts["negated"]))
        empty = _result("NEUTRAL", F.lit(0.0), "NO_LEXICON_MATCH", F.lit(False))
        return F.when(F.size(words) == 0, empty).when(up + down > 0, found).otherwise(by_signals(words, lexicon, p))

    return text.let(tokens, lambda words: text.let(polarity_counts(words, lexicon, p.negation_window), lambda counts: judge(counts, words)))


def local_service(raw: Column, lexicon: Lexicon, p: Params = DEFAULT) -> Column:
    """Sentiment of a text without a model (N4): tokens of the clean text, in lower case where they are words."""
    return by_dictionary(text.tokenize(text.clean(raw)), lexicon, p)


def select_service(full: bool, model: Callable[[DataFrame], DataFrame] | None, local: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The model's function if it is there and wanted, else the local one."""
    return model if full and model is not None else local


def cached(texts: DataFrame, cache: DataFrame, version: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Results for all texts, and the rows to add to the cache.

    Each distinct text is looked up by its hash and the model's version; compute gets those that are missing, as rows
    (text_hash, text), and returns (text_hash, result).
    """
    hashed = texts.withColumn("text_hash", text.text_hash(F.col("text")))
    known = cache.where(F.col("model_version") == version).select("text_hash", "result")
    missing = hashed.select("text_hash", "text").dropDuplicates(["text_hash"]).join(known, "text_hash", "left_anti")
    new = compute(missing).withColumn("model_version", F.lit(version))
    return hashed.join(known.unionByName(new.select("text_hash", "result")), "text_hash", "left"), new


def cached_in_table(texts: DataFrame, table: str, version: str, compute: Callable[[DataFrame], DataFrame], buckets: int = CACHE_BUCKETS) -> DataFrame:
    """texts with text_hash and result, from a table that keeps the results of earlier runs.

    compute gets the distinct texts that the table lacks for this version of the model, as rows (text_hash, text), and
    returns (text_hash, result), whose results are appended before this returns, so that another run finds them. The
    table is made at first and bucketed by hash: lookups do not move its rows. A null text has no result. One run writes to a table
    at a time.
    """
    spark = texts.sparkSession
    hashed = texts.withColumn("text_hash", text.text_hash(F.col("text")))
    distinct = hashed.select("text_hash", "text").where("text_hash is not null").dropDuplicates(["text_hash"])
    known = lambda: spark.table(table).where(F.col("model_version") == version).select("text_hash", "result")
    missing = distinct.join(known(), "text_hash", "left_anti") if spark.catalog.tableExists(table) else distinct
    new = stage_table(compute(missing).withColumn("model_version", F.lit(version)).select("text_hash", "model_version", "result"), "results")
    if not spark.catalog.tableExists(table) or not new.isEmpty():
        new.write.bucketBy(buckets, "text_hash").sortBy("text_hash").format("parquet").mode("append").saveAsTable(table)
        spark.catalog.refreshTable(table)
    return hashed.join(known(), "text_hash", "left")


def fallback_label(label: Column, failed: Column) -> Column:
    """NEUTRAL with score 0.5 and method fallback_error where a model's batch failed."""
    return F.when(failed, F.struct(F.lit("NEUTRAL").alias("label"), F.lit(0.5).alias("score"), F.lit("fallback_error").alias("method"))).otherwise(
        F.struct(label.alias("label"), F.lit(1.0).alias("score"), F.lit("model").alias("method"))
    )


def methods_of_session(sentiment: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Methods of a session's posts and comments, as a bag."""
    part = lambda kind, ids: sentiment.where(F.col("entity_type") == kind).join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("method")
    return part("POST", posts).unionAll(part("COMMENT", comments))
