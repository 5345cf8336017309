"""Topic filter: two passes, summaries, votes and manual changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.functions import scalars, text
from vociflow.stage import stage_table


def score_posts(posts: DataFrame, primary: list[list[str]], secondary: list[list[str]], excluded: list[list[str]], semantic: Column, full: bool = True) -> DataFrame:
    """posts (with lemmas) with l1, stratum, filter_pass, relevant and combined."""
    spec = lambda grams: F.array(*[F.array(*map(F.lit, g)) for g in grams]) if grams else F.array().cast("array<array<string>>")
    hits = posts.withColumn("__m", text.match(F.col("lemmas"), spec(primary), spec(secondary), spec(excluded)))
    level = scalars.keyword_level(F.col("__m.primary"), F.col("__m.secondary"), F.col("__m.excluded"))
    leveled = hits.withColumns({"l1": level, "excluded": F.col("__m.excluded")}).drop("__m")
    decided = leveled.withColumn("__d", scalars.topic_decision(F.col("l1"), F.col("excluded"), semantic, full))
    return decided.select("*", "__d.*").drop("__d")


def with_processed(posts: DataFrame, processed: DataFrame, compute: Column) -> DataFrame:
    """posts with the lemmas of their processed text (post_id, lemmas as JSON), or computed ones where there is none."""
    known = processed.select(F.col("post_id").alias("id"), text.decode_list(F.col("lemmas")).alias("__known"))
    return posts.join(known, "id", "left").withColumn("lemmas", F.coalesce("__known", compute)).drop("__known")


def centroid(vectors: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean vector of each group (A37): means of single places, put together in order."""
    by = by or []
    places = vectors.select(*by, F.posexplode(column).alias("__i", "__x")).groupBy(*by, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"])
    return places.groupBy(*by).agg(whole.alias("centroid"))


def semantic_scores(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """Cosine of each vector with the mean of reference vectors; null if there is no reference."""
    centre = centroid(reference, "embedding")
    return vectors.join(F.broadcast(centre), F.lit(True), "left").withColumn("semantic", F.when(F.col("centroid").isNotNull(), scalars.cosine(F.col("embedding"), F.col("centroid")))).drop("centroid")


def summary(scored: DataFrame) -> DataFrame:
    """Counts and shares of strata (A15), in one row."""
    n = F.count("*")
    names = ("CONFIDENT", "PASS2_CONFIRMED", "DISPUTED", "EXCLUDED")
    counts = [F.count_if(F.col("stratum") == s).alias(f"n_{s.lower()}") for s in names]
    ratios = [F.when(n > 0, F.count_if(F.col("stratum") == s) / n).otherwise(F.lit(0.0)).alias(f"r_{s.lower()}") for s in names]
    return scored.agg(n.alias("total"), *counts, *ratios)


def disputed(scored: DataFrame, n: int = 30) -> DataFrame:
    """The first disputed posts in time order (T5).

    Strata are written before they are filtered: a filter takes in the expressions of its columns, and would match each
    text again wherever the stratum's cases name a level or its lemmas.
    """
    return stage_table(scored, "scored").where("stratum = 'DISPUTED'").orderBy("published_at", "id").limit(n)


def confusion(votes: DataFrame) -> DataFrame:
    """True positives, false positives and false negatives over votes."""
    both = votes.where("vote is not null")
    return both.agg(
        F.count_if(F.col("vote") & F.col("relevant").eqNullSafe(True)).alias("tp"), F.count_if(~F.col("vote") & F.col("relevant").eqNullSafe(True)).alias("fp"),
        F.count_if(F.col("vote") & ~F.col("relevant").eqNullSafe(True)).alias("fn"),
    )


def beta_posterior(alpha: Column, beta: Column) -> Column:
    """Mean and normal-approximation interval of a beta distribution, within 0 and 1."""
    mean = alpha / (alpha + beta)
    half = 1.96 * F.sqrt(alpha * beta / (F.pow(alpha + beta, 2) * (alpha + beta + 1)))
    return F.struct(mean.alias("mean"), F.greatest(F.lit(0.0), mean - half).alias("low"), F.least(F.lit(1.0), mean + half).alias("high"))


def validation(votes: DataFrame) -> DataFrame:
    """Posterior precision and recall from votes."""
    c = confusion(votes)
    return c.select("*", beta_posterior(1 + F.col("tp"), 1 + F.col("fp")).alias("precision"), beta_posterior(1 + F.col("tp"), 1 + F.col("fn")).alias("recall"))


def rethreshold(posts: DataFrame, t: float) -> DataFrame:
    """Relevance by a new threshold, where no vote stands and there is a score."""
    new = F.when(F.col("vote").isNull() & F.col("combined").isNotNull(), F.col("combined") >= t).otherwise(F.col("relevant"))
    return posts.withColumn("relevant", new)


def stop_phrase(posts: DataFrame, phrase: str) -> DataFrame:
    """Posts whose text holds the phrase, in any case, become irrelevant, even over votes."""
    return posts.withColumn("relevant", F.when(F.contains(F.lower("text"), F.lit(phrase.lower())), F.lit(False)).otherwise(F.col("relevant")))


def apply_votes(posts: DataFrame) -> DataFrame:
    """Relevance by the vote where there is one."""
    return posts.withColumn("relevant", F.coalesce("vote", "relevant"))


def display_stratum(combined: Column) -> Column:
    """The bucket that a score is shown in (F14): limits are single precision and exclusive."""
    over = lambda x: combined.cast("float") > F.lit(x).cast("float")
    return F.when(combined.isNull(), "UNSCORED").when(over(0.6), "HIGH_CONF").when(over(0.3), "BORDERLINE_POS").when(over(0.1), "BORDERLINE_NEG").otherwise("NEAR_ZERO")


def search(posts: DataFrame, needle: str, mode: str = "ALL") -> DataFrame:
    """Posts by vote state and a substring, in any case, of text, author or community (F8)."""
    states = {"UNVOTED": F.col("vote").isNull(), "VOTED": F.col("vote").isNotNull(), "RELEVANT": F.col("relevant").eqNullSafe(True), "NOT_RELEVANT": ~F.col("relevant").eqNullSafe(True)}
    out = posts.where(states[mode]) if mode in states else posts
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
    return out.where(has("text") | has("author_name") | has("community_name")) if needle else out


def search_events(events: DataFrame, needle: str, kind: str | None) -> DataFrame:
    """Log events of one type whose message or type holds a substring, in any case."""
    out = events.where(F.col("event_type") == kind) if kind else events
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
    return out.where(has("message") | has("event_type"))


def source_authors(posts: DataFrame) -> DataFrame:
    """Posts and votes of each author of each source, the largest first."""
    found = posts.groupBy("source", "author").agg(F.count("*").alias("n"), F.count("vote").alias("voted"))
    return found.orderBy("source", F.desc("n"), "author")


def source_groups(posts: DataFrame) -> DataFrame:
    """Posts grouped by source, then author, with totals and vote counts; largest first.

    Authors of a source are rows of source_authors(), as a source may have any number of them.
    """
    by_author = posts.groupBy("source", "author").agg(F.count("*").alias("n"), F.count("vote").alias("voted"))
    sums = by_author.groupBy("source").agg(F.sum("n").alias("total"), F.sum("voted").alias("voted"), F.count("*").alias("authors"))
    return sums.orderBy(F.desc("total"), "source")
