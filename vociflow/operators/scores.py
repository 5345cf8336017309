"""Author scores (A1-A14) and the joins that feed them.

Facts are aggregated by author before they meet the authors, so that a hot author's rows combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPIC = "window = 'CURRENT' and relevant <=> true"
OFF_TOPIC = "window = 'CURRENT' and not relevant <=> true"
BASELINE = "window = 'BASELINE'"


def audience(followers: Column) -> Column:
    """ln(1 + followers); unknown counts as 0 (A1)."""
    return F.log1p(F.coalesce(followers, F.lit(0)).cast("double"))


def reactions() -> Column:
    """Likes, comments and reposts of a post."""
    return F.col("likes").cast("long") + F.col("comments") + F.col("reposts")


def engagement(total: Column, posts: Column, followers: Column) -> Column:
    """Reactions per post and follower; 0 without posts or followers."""
    return F.when((posts > 0) & (followers > 0), total / (posts * followers)).otherwise(F.lit(0.0))


def focus(topic: Column, other: Column) -> Column:
    """Share of topic posts among CURRENT ones; 0 without any (A5)."""
    return F.when(topic + other > 0, topic / (topic + other)).otherwise(F.lit(0.0))


def post_facts(posts: DataFrame) -> DataFrame:
    """Per author: counts, reactions and views of baseline, topic and other posts."""
    topic, other, base = F.expr(TOPIC), F.expr(OFF_TOPIC), F.expr(BASELINE)
    seen = topic & (F.coalesce("views", F.lit(0)) > 0)
    return posts.groupBy("from_id").agg(
        F.count_if(base).alias("bg_posts"), F.coalesce(F.sum(F.when(base, reactions())), F.lit(0)).alias("bg_reactions"),
        F.count_if(topic).alias("topic_posts"), F.count_if(other).alias("other_posts"),
        F.coalesce(F.sum(F.when(topic, reactions())), F.lit(0)).alias("topic_reactions"),
        F.coalesce(F.sum(F.when(seen, F.col("views").cast("long"))), F.lit(0)).alias("viewed"), F.count_if(topic & ~seen).alias("unviewed"),
    )


def author_facts(authors: DataFrame, posts: DataFrame) -> DataFrame:
    """Open authors with at least one topic post, with their facts."""
    open_authors = authors.where("not is_closed").withColumn("followers", F.coalesce("followers", F.lit(0)))
    return open_authors.join(post_facts(posts), F.col("vk_id") == F.col("from_id")).where("topic_posts > 0").drop("from_id")


def distribution(positive: Column, neutral: Column, negative: Column, n: Column) -> Column:
    """Shares of three counts; (0, 1, 0) without any."""
    share = lambda c: F.when(n > 0, c / n)
    return F.struct(
        F.coalesce(share(positive), F.lit(0.0)).alias("positive"), F.coalesce(share(neutral), F.lit(1.0)).alias("neutral"), F.coalesce(share(negative), F.lit(0.0)).alias("negative")
    )


def label_shares(rows: DataFrame, key: str, label: Column, missing_neutral: bool) -> DataFrame:
    """Label shares of each key (A7, A9): rows without a label are left out, or count as neutral."""
    of = F.coalesce(label, F.lit("NEUTRAL")) if missing_neutral else label
    n = F.count(of)
    shares = distribution(F.count_if(of == "POSITIVE"), F.count_if(~of.isin("POSITIVE", "NEGATIVE")), F.count_if(of == "NEGATIVE"), n)
    return rows.groupBy(key).agg(shares.alias("shares"))


def soft_shares(rows: DataFrame, key: str, label: Column, missing_neutral: bool) -> DataFrame:
    """Means of probabilities where every row of a key has them, else label shares (A7, A9): columns p_positive to p_negative."""
    of = F.coalesce(label, F.lit("NEUTRAL")) if missing_neutral else label
    n = F.count(of)
    shares = distribution(F.count_if(of == "POSITIVE"), F.count_if(~of.isin("POSITIVE", "NEGATIVE")), F.count_if(of == "NEGATIVE"), n)
    means = F.struct(*[F.avg(f"p_{c}").alias(c) for c in ("positive", "neutral", "negative")])
    return rows.groupBy(key).agg(F.when(F.count("p_positive") == F.count("*"), means).otherwise(shares).alias("shares"))


def comments_of_topic_posts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments under topic posts, with the post's author."""
    return comments.join(posts.where(TOPIC).select(F.col("id").alias("post_id"), F.col("from_id").alias("author_id")), "post_id")


def with_sentiment(rows: DataFrame, sentiment: DataFrame, kind: str) -> DataFrame:
    """Rows with their sentiment label and probabilities, where there are any."""
    own = sentiment.where(F.col("entity_type") == kind).drop("entity_type").withColumnRenamed("entity_id", "id")
    return rows.join(own, "id", "left")


def normalized_age(authors: DataFrame, as_of: Column) -> DataFrame:
    """Per author: days since first seen over the largest of all authors, closed ones included; 0 if that is 0 (A2)."""
    from vociflow.functions.scalars import age_days

    days = authors.select("vk_id", age_days(F.col("first_seen_at"), as_of).alias("days"))
    longest = days.agg(F.max("days").alias("longest"))
    # one row, so the join is a broadcast of a constant
    joined = days.join(F.broadcast(longest), F.lit(True))
    return joined.select("vk_id", F.when(F.col("longest") > 0, F.col("days") / F.col("longest")).otherwise(F.lit(0.0)).alias("age"))


def author_scores(authors: DataFrame, posts: DataFrame, comments: DataFrame, as_of: Column) -> DataFrame:
    """The eleven scores and support counts of every open author with topic posts."""
    facts = author_facts(authors, posts)
    followers = F.col("followers")
    position = label_shares(posts.where(TOPIC), "from_id", F.col("label"), False).select(F.col("from_id").alias("vk_id"), F.col("shares").alias("pos"))
    under = comments_of_topic_posts(posts, comments)
    response = label_shares(under, "author_id", F.col("comment_label"), True).select(F.col("author_id").alias("vk_id"), F.col("shares").alias("resp"))
    counts = under.groupBy(F.col("author_id").alias("vk_id")).agg(F.count("*").alias("n_comments"))
    out = facts.join(normalized_age(authors, as_of), "vk_id").join(position, "vk_id", "left").join(response, "vk_id", "left").join(counts, "vk_id", "left")
    empty = distribution(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    pos, resp = F.coalesce("pos", empty), F.coalesce("resp", empty)
    return out.select(
        "vk_id", audience(followers).alias("aud"), "age", engagement(F.col("bg_reactions"), F.col("bg_posts"), followers).alias("er_bg"),
        F.col("topic_posts").alias("top_vol"), focus(F.col("topic_posts"), F.col("other_posts")).alias("top_focus"),
        (F.col("viewed") + F.col("unviewed") * followers).alias("reach"),
        pos["positive"].alias("pos_positive"), pos["neutral"].alias("pos_neutral"), pos["negative"].alias("pos_negative"),
        engagement(F.col("topic_reactions"), F.col("topic_posts"), followers).alias("er_top"),
        resp["positive"].alias("resp_positive"), resp["neutral"].alias("resp_neutral"), resp["negative"].alias("resp_negative"),
        "bg_posts", "topic_posts", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), followers.cast("long").alias("followers"),
    )
