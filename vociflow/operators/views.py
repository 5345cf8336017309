"""Views for reading results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of roles in a sorted table; others come last.
ROLE_ORDER = {"AUTHORITATIVE": 0, "TOPIC_DRIVER": 1, "SLEEPING_GIANT": 2, "BACKGROUND_AUTHOR": 3}


def session_communities(links: DataFrame, communities: DataFrame, session_id: int) -> DataFrame:
    """Communities of a session."""
    return links.where(F.col("session_id") == session_id).join(communities, "community_id").select("vk_id")


def author_name(first: Column, last: Column, author_id: Column) -> Column:
    """First and last name, or the author's number without either."""
    return F.coalesce(F.nullif(F.concat_ws(" ", first, last), F.lit("")), F.concat(F.lit("Author #"), author_id.cast("string")))


def dashboard(scores: DataFrame, authors: DataFrame, roles: DataFrame) -> DataFrame:
    """Scores with names, roles and composites; authors that are missing are left out."""
    named = authors.select("vk_id", author_name(F.col("first_name"), F.col("last_name"), F.col("vk_id")).alias("author_name"))
    return scores.join(named, "vk_id").join(roles.select("vk_id", "role", "structural", "topical", "theta_structural", "theta_topical"), "vk_id", "left")


def author_detail(scores: DataFrame, found: DataFrame, posts: DataFrame, author: int, n_posts: int = 50) -> DataFrame:
    """One author's scores, intervals as a map, and newest relevant posts."""
    own = found.where(F.col("author_id") == author).select(F.col("author_id").alias("vk_id"), F.struct("score", F.struct("low", "high")).alias("e"))
    ci = own.groupBy("vk_id").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("intervals"))
    newest = posts.where((F.col("from_id") == author) & F.col("relevant").eqNullSafe(True)).orderBy(F.desc("published_at"), "id").limit(n_posts)
    listed = newest.groupBy(F.col("from_id").alias("vk_id")).agg(F.sort_array(F.collect_list(F.struct("published_at", "id")), asc=False).alias("posts"))
    return scores.where(F.col("vk_id") == author).join(ci, "vk_id", "left").join(listed, "vk_id", "left")


def validation_rows(posts: DataFrame, authors: DataFrame, communities: DataFrame) -> DataFrame:
    """Posts with author and community names: a negative owner is a community."""
    a = authors.select(F.col("vk_id").alias("from_id"), author_name(F.col("first_name"), F.col("last_name"), F.col("vk_id")).alias("__a"))
    c = communities.select((-F.col("vk_id")).alias("owner_id"), F.col("name").alias("__c"))
    out = posts.join(a, "from_id", "left").join(c, "owner_id", "left")
    return out.withColumns({
        "author_name": F.coalesce("__a", F.concat(F.lit("Author #"), F.col("from_id").cast("string"))),
        "community_name": F.when(F.col("owner_id") < 0, F.coalesce("__c", F.concat(F.lit("Community #"), (-F.col("owner_id")).cast("string")))),
    }).drop("__a", "__c")


def scatter(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Points of a scatter plot: rows with composites."""
    return rows.select("vk_id").join(roles.select("vk_id", "structural", "topical"), "vk_id").orderBy(F.desc(F.col("structural") + F.col("topical")), "vk_id")


def sort_table(rows: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Rows by a key (T1): position and response by their balance, roles in their order, names in any case, nulls least."""
    balance = {"position": ("pos_positive", "pos_negative"), "response": ("resp_positive", "resp_negative")}
    if key in balance:
        by = F.col(balance[key][0]) - F.col(balance[key][1])
    elif key == "role":
        by = F.lit(99)
        for name, place in ROLE_ORDER.items():
            by = F.when(F.col("role") == name, place).otherwise(by)
    else:
        by = F.lower("author_name") if key == "author_name" else F.col(key)
    return rows.orderBy(by.asc_nulls_first() if ascending else by.desc_nulls_last(), "vk_id")


def newest_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions, the newest first."""
    return sessions.orderBy(F.desc("created_at"), F.desc("id"))


def by_role(rows: DataFrame, needle: str) -> DataFrame:
    """Rows whose role holds a substring, in any case."""
    return rows.where(F.contains(F.lower("role"), F.lit(needle.lower())))


def event_types(events: DataFrame) -> DataFrame:
    """Distinct event types in order."""
    return events.select("event_type").distinct().orderBy("event_type")
