"""Registered queries over the driver's tables, with the same results as SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vociflow.functions import scalars, text
from vociflow.operators import bootstrap, dedup, models, ngram_index, quality, robust, scores, sentiment, topic, views
from vociflow.params import DEFAULT, LATIN
from vociflow.plans import adapters as t
from vociflow.plans import doubles
from vociflow.sources import collection, corpus, importer, store
from vociflow.stage import new_path, stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: str = "", name: str | None = None):
    """Register a function as a query; needs names relations (a, p, c, x) to put before its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            parts = {"a": t.SQL_AUTHORS, "p": t.SQL_POSTS, "c": t.SQL_COMMENTS, "x": t.SQL_TEXTS}
            head, more = ", ".join(parts[n] for n in needs), sql.lstrip().startswith("+")
            body = sql.lstrip().removeprefix("+").lstrip()
            recursive = "RECURSIVE " if body.startswith("RECURSIVE ") else ""
            SQL[key] = (f"WITH {recursive}{head}{',' if more else ''} " if head else "") + body.removeprefix("RECURSIVE ")
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with floating-point columns rounded, so that sums in another order are equal."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c, k in df.dtypes if k in ("double", "float")})


TOPIC_SQL = "\"window\" = 'CURRENT' AND relevant IS NOT DISTINCT FROM true"

# ---- scans and filters


@query("SELECT \"window\", count(*) AS n, count(views) AS with_views FROM posts WHERE \"window\" IS NOT NULL GROUP BY 1", "p")
def window_split(s, d):
    """Posts of both windows."""
    out = store.by_window(t.posts(s, d), "CURRENT").unionByName(store.by_window(t.posts(s, d), "BASELINE"))
    return out.groupBy("window").agg(F.count("*").alias("n"), F.count("views").alias("with_views"))


@query(f"SELECT id, from_id FROM posts WHERE {TOPIC_SQL}", "p")
def topic_posts(s, d):
    """Relevant CURRENT posts (F2)."""
    return t.posts(s, d).where(scores.TOPIC).select("id", "from_id")


@query("SELECT from_id, count(*) AS n FROM posts WHERE \"window\" = 'CURRENT' AND relevant IS DISTINCT FROM true GROUP BY 1", "p")
def nontopic_current(s, d):
    """CURRENT posts that are not relevant, or unknown, by author."""
    return t.posts(s, d).where(scores.OFF_TOPIC).groupBy("from_id").agg(F.count("*").alias("n"))


@query(f"SELECT vk_id, topic_posts FROM authors JOIN (SELECT from_id, count(*) FILTER ({TOPIC_SQL}) AS topic_posts FROM posts GROUP BY 1) ON vk_id = from_id WHERE NOT is_closed AND topic_posts > 0", "ap")
def closed_author_exclusion(s, d):
    """Open authors with topic posts."""
    return scores.author_facts(t.authors(s, d), t.posts(s, d)).select("vk_id", "topic_posts")


def _sessions(s, d):
    key = F.col("c_custkey")
    return t.table(s, d, "customer").select(key.alias("id"), F.when(key % 7 == 0, F.timestamp_seconds(key * 86400)).alias("deleted_at"), (key % 5).alias("session_id"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 = 0 OR c_custkey = 1")
def soft_deleted_scan(s, d):
    """Deleted sessions, after one more is deleted."""
    more = store.soft_delete(_sessions(s, d), F.col("id") == 1, t.as_of())
    return store.deleted(more).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey = 14")
def alive_sessions(s, d):
    """Sessions that are not deleted, after one is restored."""
    return store.alive(store.restore(_sessions(s, d), F.col("id") == 14)).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 3")
def hard_delete(s, d):
    """Sessions without those deleted for good (K9)."""
    return store.hard_delete(_sessions(s, d), F.col("session_id") == 3).select("id")


@query("SELECT id, published_at FROM posts WHERE from_id = 8", "p")
def author_scan(s, d):
    """One author's posts."""
    return store.by_author(t.posts(s, d), 8).select("id", "published_at")


def _listed(s, d):
    named = t.authors(s, d).select(F.col("vk_id").alias("from_id"), F.col("first_name").alias("author_name"))
    return t.posts(s, d).withColumnsRenamed({"props": "text", "event_type": "community_name"}).join(named, "from_id", "left")


@query("SELECT id FROM posts LEFT JOIN authors ON from_id = vk_id WHERE vote IS NULL AND (contains(lower(props), '\"k\": 9') OR contains(lower(event_type), '\"k\": 9') OR contains(lower(coalesce(first_name, '')), '\"k\": 9'))", "ap")
def search_filter(s, d):
    """Posts without a vote that hold some text (F8)."""
    return topic.search(_listed(s, d), '"K": 9', "UNVOTED").select("id")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND contains(props, '7')")
def event_log_filter(s, d):
    """Log events of a type with some text."""
    log = t.table(s, d, "events").withColumnRenamed("props", "message")
    return topic.search_events(log, "7", "error").select("event_id")


@query("SELECT id, CASE WHEN vote IS NULL AND combined IS NOT NULL THEN combined >= 0.4 ELSE relevant END AS relevant FROM posts", "p")
def threshold_relabel(s, d):
    """Relevance by a new threshold."""
    return topic.rethreshold(t.posts(s, d), 0.4).select("id", "relevant")


@query("SELECT id, CASE WHEN contains(lower(props), '\"k\": 1') THEN false ELSE relevant END AS relevant FROM posts", "p")
def stop_phrase_relabel(s, d):
    """Relevance after a stop phrase."""
    return topic.stop_phrase(t.posts(s, d).withColumnRenamed("props", "text"), '"K": 1').select("id", "relevant")


@query("SELECT id, coalesce(vote, relevant) AS relevant FROM posts", "p")
def vote_override(s, d):
    """Relevance with votes applied."""
    return topic.apply_votes(t.posts(s, d)).select("id", "relevant")


@query("""SELECT CASE WHEN combined IS NULL THEN 'UNSCORED' WHEN combined::FLOAT > 0.6::FLOAT THEN 'HIGH_CONF' WHEN combined::FLOAT > 0.3::FLOAT THEN 'BORDERLINE_POS'
  WHEN combined::FLOAT > 0.1::FLOAT THEN 'BORDERLINE_NEG' ELSE 'NEAR_ZERO' END AS bucket, count(*) AS n FROM posts GROUP BY 1""", "p")  # fmt: skip
def stratum_buckets(s, d):
    """Posts by display bucket."""
    return t.posts(s, d).groupBy(topic.display_stratum(F.col("combined")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT id, min(published_at) AS published_at FROM (SELECT first_value(id) OVER (PARTITION BY vk_post, owner_id ORDER BY published_at, id) AS id, published_at FROM posts) GROUP BY id", "p")
def first_seen_distinct(s, d):
    """First post of each key in time order."""
    return dedup.first_seen(t.posts(s, d).withColumnRenamed("vk_post", "vk_id")).select("id", "published_at")


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '\\S')")
def nonblank_texts(s, d):
    """Texts that are not blank."""
    return t.table(s, d, "documents").where(importer.blank_to_null(F.col("text")).isNotNull()).select(F.col("doc_id").alias("id"))


# ---- joins


@query("SELECT n_nationkey AS vk_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 2")
def session_community_join(s, d):
    """Communities of a session."""
    links = t.table(s, d, "supplier").select((F.col("s_suppkey") % 5).alias("session_id"), F.col("s_nationkey").alias("community_id"))
    communities = t.table(s, d, "nation").select(F.col("n_nationkey").alias("community_id"), F.col("n_nationkey").alias("vk_id"))
    return views.session_communities(links, communities, 2)


_FACTS = f"""facts AS (SELECT from_id, count(*) FILTER ("window" = 'BASELINE') AS bg_posts, coalesce(sum(likes + comments + reposts) FILTER ("window" = 'BASELINE'), 0)::BIGINT AS bg_reactions,
  count(*) FILTER ({TOPIC_SQL}) AS topic_posts, count(*) FILTER ("window" = 'CURRENT' AND relevant IS DISTINCT FROM true) AS other_posts, coalesce(sum(likes + comments + reposts) FILTER ({TOPIC_SQL}), 0)::BIGINT AS topic_reactions,
  coalesce(sum(views) FILTER ({TOPIC_SQL} AND coalesce(views, 0) > 0), 0)::BIGINT AS viewed, count(*) FILTER ({TOPIC_SQL} AND NOT coalesce(views, 0) > 0) AS unviewed FROM posts GROUP BY 1)"""


@query("+ " + _FACTS + " SELECT vk_id, bg_posts, bg_reactions, topic_posts, other_posts FROM authors JOIN facts ON vk_id = from_id", "ap")
def author_posts_join(s, d):
    """Authors with their posts' facts."""
    facts = scores.post_facts(t.posts(s, d))
    return t.authors(s, d).join(facts, F.col("vk_id") == F.col("from_id")).select("vk_id", "bg_posts", "bg_reactions", "topic_posts", "other_posts")


@query(f"SELECT p.from_id AS author_id, count(*) AS n_comments FROM comments c JOIN posts p ON c.post_id = p.id WHERE {TOPIC_SQL} GROUP BY 1", "pc")
def post_comments_join(s, d):
    """Comments under each author's topic posts."""
    return scores.comments_of_topic_posts(t.posts(s, d), t.comments(s, d)).groupBy("author_id").agg(F.count("*").alias("n_comments"))


@query("SELECT p.id, CASE WHEN p.id % 2 = 0 THEN p.label END AS found FROM posts p", "p")
def sentiment_left_join(s, d):
    """Posts with their sentiment rows, where there are any."""
    rows = t.posts(s, d).select("id", "label")
    of = rows.where("id % 2 = 0").select(F.lit("POST").alias("entity_type"), F.col("id").alias("entity_id"), F.col("label").alias("found"))
    other = rows.select(F.lit("COMMENT").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("X").alias("found"))
    return scores.with_sentiment(rows.select("id"), of.unionByName(other), "POST")


def _records(s, d):
    o = t.table(s, d, "orders")
    posts = o.select(
        F.col("o_orderkey").alias("position"), F.col("o_orderkey").cast("int").alias("vkId"), (F.col("o_custkey") % 3).cast("int").alias("ownerId"), F.col("o_custkey").cast("int").alias("fromId"),
        F.unix_timestamp("o_orderdate").alias("date"), F.col("o_orderstatus").alias("text"), F.lit(None).cast("int").alias("likes"), F.lit(1).alias("reposts"), F.lit(2).alias("comments"), F.lit(None).cast("int").alias("views"),
        F.lit(None).cast("boolean").alias("containsMedia"), F.lit(True).alias("hasCopyHistory"), F.when(F.col("o_orderkey") % 2 == 0, "BASELINE").alias("window"),
    )
    li = t.table(s, d, "lineitem")
    comments = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("vkId"), F.col("l_orderkey").cast("int").alias("postVkId"), F.lit(1).alias("postOwnerId"),
        F.col("l_suppkey").cast("int").alias("fromId"), F.unix_timestamp("l_shipdate").alias("date"), F.when(F.col("l_linestatus") == "F", " ").otherwise("x").alias("text"), F.lit(None).cast("int").alias("likes"),
    )
    return posts, comments


@query("""SELECT (l_orderkey * 10 + l_linenumber)::INTEGER AS vk_id, CASE WHEN o_orderkey % 2 = 0 THEN 'BASELINE' ELSE 'CURRENT' END AS post_window, CASE WHEN l_linestatus <> 'F' THEN 'x' END AS text
  FROM (FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_suppkey, l_linestatus) = 1) JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 = 1""")  # fmt: skip
def composite_key_import_join(s, d):
    """Imported comments that match an imported post by both keys; of those with one id the first stays."""
    posts, comments = _records(s, d)
    place = F.row_number().over(Window.partitionBy("vkId").orderBy("date", "fromId", "text"))
    return importer.import_comments(comments.withColumn("position", place), importer.import_posts(posts, 1), 1).select("vk_id", "post_window", "text")


@query("SELECT DISTINCT l_orderkey AS post_id FROM lineitem WHERE l_orderkey NOT IN (SELECT event_id FROM events)")
def orphan_comments_anti(s, d):
    """Posts that comments name but that are unknown."""
    return t.comments(s, d).join(t.posts(s, d).select(F.col("id").alias("post_id")), "post_id", "left_anti").select("post_id").distinct()


_HASH = r"sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(clean_text), '\[url]|\[user]', '', 'g'), '#[\wа-яё]+', '', 'g'), '\s+', ' ', 'g')))"
_EDGES = f"""hashed AS (SELECT id, published_at, {_HASH} AS hash FROM texts WHERE own_text_length >= 30),
  edges AS (SELECT first_value(id) OVER (PARTITION BY hash ORDER BY published_at, id) AS canonical_id, id AS duplicate_id, count(*) OVER (PARTITION BY hash) AS copies, hash FROM hashed)"""


@query("+ " + _EDGES + " SELECT texts.id, (texts.id IN (SELECT duplicate_id FROM edges WHERE duplicate_id <> canonical_id)) AS is_copy FROM texts", "x")
def copy_flag_semi(s, d):
    """Texts that are detected copies."""
    rows = t.texts(s, d).withColumns({"has_copy_history": F.lit(False), "contains_media": F.lit(False)})
    return dedup.mark_copies(rows, dedup.exact_edges(rows)).select("id", "is_copy")


def _scores(s, d):
    return scores.author_scores(t.authors(s, d), t.posts(s, d), t.comments(s, d), t.as_of())


_SHARES = """shares AS (SELECT from_id, count(label) AS n, count(*) FILTER (label = 'POSITIVE') AS p, count(*) FILTER (label = 'NEUTRAL') AS z, count(*) FILTER (label = 'NEGATIVE') AS q FROM posts WHERE %s GROUP BY 1),
  resp AS (SELECT p.from_id, count(*) AS n, count(*) FILTER (comment_label = 'POSITIVE') AS p, count(*) FILTER (coalesce(comment_label, 'NEUTRAL') = 'NEUTRAL') AS z, count(*) FILTER (comment_label = 'NEGATIVE') AS q
    FROM comments c JOIN posts p ON c.post_id = p.id WHERE %s GROUP BY 1)""" % (TOPIC_SQL, TOPIC_SQL)  # fmt: skip
_AGES = "ages AS (SELECT vk_id, date_diff('day', first_seen_at, TIMESTAMP '2024-01-31') AS days FROM authors)"
_SCORES = (
    _FACTS + ", " + _SHARES + ", " + _AGES
    + """, scores AS (SELECT vk_id, ln(1 + followers) AS aud, CASE WHEN (SELECT max(days) FROM ages) > 0 THEN days / (SELECT max(days) FROM ages) ELSE 0 END AS age,
  CASE WHEN bg_posts > 0 AND followers > 0 THEN bg_reactions / (bg_posts * followers) ELSE 0 END AS er_bg, topic_posts AS top_vol, topic_posts / (topic_posts + other_posts) AS top_focus,
  viewed + unviewed * followers AS reach, coalesce(s.p / nullif(s.n, 0), 0) AS pos_positive, coalesce(s.z / nullif(s.n, 0), 1) AS pos_neutral, coalesce(s.q / nullif(s.n, 0), 0) AS pos_negative,
  CASE WHEN topic_posts > 0 AND followers > 0 THEN topic_reactions / (topic_posts * followers) ELSE 0 END AS er_top, coalesce(r.p / r.n, 0) AS resp_positive, coalesce(r.z / r.n, 1) AS resp_neutral, coalesce(r.q / r.n, 0) AS resp_negative,
  bg_posts, topic_posts, coalesce(r.n, 0) AS n_comments, followers::BIGINT AS followers
  FROM authors JOIN facts ON vk_id = facts.from_id JOIN ages USING (vk_id) LEFT JOIN shares s ON vk_id = s.from_id LEFT JOIN resp r ON vk_id = r.from_id WHERE NOT is_closed AND topic_posts > 0)"""
)
_R = lambda *cs: ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in cs)
_SCORE_COLUMNS = _R("aud", "age", "er_bg") + ", top_vol, " + _R("top_focus") + ", reach, " + _R("pos_positive", "pos_neutral", "pos_negative", "er_top", "resp_positive", "resp_neutral", "resp_negative")


@query("+ " + _SCORES + f" SELECT vk_id, {_SCORE_COLUMNS}, bg_posts, topic_posts, n_comments, followers FROM scores", "apc")
def author_scores(s, d):
    """All eleven scores and support counts."""
    return rounded(_scores(s, d))


def _one_score(name: str, columns: list[str]) -> None:
    sql = ", ".join(c if c in ("top_vol", "reach") else _R(c) for c in columns)
    query("+ " + _SCORES + f" SELECT vk_id, {sql} FROM scores", "apc", name)(lambda s, d: rounded(_scores(s, d).select("vk_id", *columns)))


for _name, _cols in {
    "aud": ["aud"], "age_norm": ["age"], "er_bg": ["er_bg"], "er_top": ["er_top"], "top_vol": ["top_vol"], "top_focus": ["top_focus"], "reach": ["reach"],
    "position_labels": ["pos_positive", "pos_neutral", "pos_negative"], "response_labels": ["resp_positive", "resp_neutral", "resp_negative"],
}.items():
    _one_score(_name, _cols)

_SOFT = """SELECT key, round(CASE WHEN count(p_positive) = count(*) THEN avg(p_positive) ELSE coalesce(count(*) FILTER (l = 'POSITIVE') / nullif(count(l), 0), 0) END, 6) AS positive,
  round(CASE WHEN count(p_positive) = count(*) THEN avg(p_neutral) ELSE coalesce(count(*) FILTER (l NOT IN ('POSITIVE', 'NEGATIVE')) / nullif(count(l), 0), 1) END, 6) AS neutral,
  round(CASE WHEN count(p_positive) = count(*) THEN avg(p_negative) ELSE coalesce(count(*) FILTER (l = 'NEGATIVE') / nullif(count(l), 0), 0) END, 6) AS negative FROM (%s) GROUP BY key"""


@query(_SOFT % f"SELECT from_id AS key, label AS l, p_positive, p_neutral, p_negative FROM posts WHERE {TOPIC_SQL}", "p")
def position_soft(s, d):
    """Positions by probabilities, where every post has them."""
    return rounded(scores.soft_shares(t.posts(s, d).where(scores.TOPIC), "from_id", F.col("label"), False).select(F.col("from_id").alias("key"), "shares.*"))


@query(_SOFT % f"SELECT p.from_id AS key, coalesce(comment_label, 'NEUTRAL') AS l, c.p_positive, c.p_neutral, c.p_negative FROM comments c JOIN posts p ON c.post_id = p.id WHERE {TOPIC_SQL}", "pc")
def response_soft(s, d):
    """Responses by probabilities, where every comment has them."""
    rows = scores.comments_of_topic_posts(t.posts(s, d), t.comments(s, d))
    return rounded(scores.soft_shares(rows, "author_id", F.col("comment_label"), True).select(F.col("author_id").alias("key"), "shares.*"))


@query("SELECT post_id, count(*) AS n FROM comments GROUP BY 1", "c")
def comments_per_post(s, d):
    """Comments of each post that has any."""
    return t.comments(s, d).groupBy("post_id").agg(F.count("*").alias("n"))


_Z = """, stats AS (SELECT """ + ", ".join(f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS q_{c}" for c in (*robust.STRUCTURAL, *robust.TOPICAL)) + """ FROM scores),
  zed AS (SELECT scores.*, """ + ", ".join(f"coalesce(CASE WHEN q_{c} > 0 THEN ({c} - m_{c}) / q_{c} END, 0) AS z_{c}" for c in (*robust.STRUCTURAL, *robust.TOPICAL)) + """ FROM scores, stats),
  comp AS (SELECT *, (z_aud + z_er_bg + z_age) / 3 AS structural, (z_top_vol + z_top_focus + z_reach) / 3 AS topical FROM zed),
  theta AS (SELECT median(structural) AS ts, median(topical) AS tt FROM comp),
  rolled AS (SELECT *, CASE WHEN structural >= ts - 1e-12 AND topical >= tt - 1e-12 THEN 'AUTHORITATIVE' WHEN structural >= ts - 1e-12 THEN 'SLEEPING_GIANT' WHEN topical >= tt - 1e-12 THEN 'TOPIC_DRIVER' ELSE 'BACKGROUND_AUTHOR' END AS role,
    CASE WHEN pos_positive >= pos_neutral AND pos_positive >= pos_negative THEN 'POSITIVE' WHEN pos_negative >= pos_positive AND pos_negative >= pos_neutral THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS position,
    CASE WHEN resp_positive > 0.5 THEN 'APPROVING' WHEN resp_negative > 0.5 THEN 'CRITICAL' WHEN resp_neutral > 0.5 THEN 'APPROVING' ELSE 'MIXED' END AS response FROM comp, theta)"""  # fmt: skip


def _roles(s, d):
    return robust.assign_roles(_scores(s, d))


@query("+ " + _SCORES + ", named AS (SELECT scores.*, coalesce(nullif(concat_ws(' ', first_name, NULL), ''), 'Author #' || vk_id) AS author_name FROM scores JOIN authors USING (vk_id))" + _Z
       + " SELECT named.vk_id, author_name, role, round(structural, 6) AS structural FROM named JOIN rolled USING (vk_id)", "apc")
def dashboard_join(s, d):
    """Scores with names, roles and composites."""
    found = _roles(s, d)
    return rounded(views.dashboard(found.select("vk_id"), t.authors(s, d), found).select("vk_id", "author_name", "role", "structural"))


@query(f"SELECT 8::BIGINT AS vk_id, string_agg(id::VARCHAR, ' ' ORDER BY published_at DESC, id) AS post_ids FROM (SELECT id, published_at FROM posts WHERE from_id = 8 AND relevant ORDER BY published_at DESC, id LIMIT 50)", "p")
def author_detail(s, d):
    """One author's newest relevant posts, with intervals."""
    none = s.createDataFrame([], bootstrap.INTERVALS)
    found = views.author_detail(t.authors(s, d).select("vk_id"), none, t.posts(s, d), 8)
    return found.select("vk_id", F.array_join(F.transform("posts", lambda p: p["id"].cast("string")), " ").alias("post_ids"))


@query("""SELECT id, coalesce(first_name, 'Author #' || from_id) AS author_name, CASE WHEN from_id % 3 = 0 AND from_id <> 0 THEN coalesce(n_name, 'Community #' || from_id) END AS community_name
  FROM posts LEFT JOIN authors ON vk_id = from_id LEFT JOIN nation ON n_nationkey = from_id AND from_id <> 0""", "ap")  # fmt: skip
def validation_names(s, d):
    """Posts with author and community names."""
    rows = t.posts(s, d).withColumn("owner_id", F.when(F.col("from_id") % 3 == 0, -F.col("from_id")).otherwise(F.col("from_id")))
    communities = t.table(s, d, "nation").select(F.col("n_nationkey").alias("vk_id"), F.col("n_name").alias("name"))
    return views.validation_rows(rows, t.authors(s, d), communities).select("id", "author_name", "community_name")


@query("+ " + _SCORES + _Z + " SELECT vk_id, round(structural, 6) AS structural, round(topical, 6) AS topical FROM rolled", "apc")
def scatter_points(s, d):
    """Composites of all scored authors, largest first."""
    return rounded(views.scatter(_scores(s, d), _roles(s, d)))


@query("SELECT coalesce(a.s, b.s) AS status, coalesce(o, 0) AS o, coalesce(e, 0) AS e FROM (SELECT o_orderstatus AS s, count(*) AS o FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS s, count(*) AS e FROM orders GROUP BY 1) b ON a.s = b.s")
def role_full_join(s, d):
    """Two distributions side by side, with zeros for what one lacks."""
    o = t.table(s, d, "orders")
    a = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("o"))
    b = o.groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("e"))
    return a.join(b, "status", "full").select("status", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("e", F.lit(0)).alias("e"))


@query("SELECT c_custkey AS vk_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier")
def registry_upsert(s, d):
    """Authors refreshed by fetched ones, and new ones."""
    old = t.table(s, d, "customer").select(F.col("c_custkey").alias("vk_id"), F.col("c_name").alias("name"))
    new = old.where("vk_id % 2 = 0").withColumn("name", F.lit("new"))
    more = t.table(s, d, "supplier").select((1000000 + F.col("s_suppkey")).alias("vk_id"), F.col("s_name").alias("name"))
    return collection.registry_upsert(old, new.unionByName(more), "vk_id")


@query("SELECT c_custkey AS vk_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'other' FROM customer WHERE c_custkey % 2 = 1")
def insert_if_absent(s, d):
    """Known communities, and unknown ones from an import."""
    c = t.table(s, d, "customer").select(F.col("c_custkey").alias("vk_id"), F.col("c_name").alias("name"))
    return importer.insert_if_absent(c.where("vk_id % 2 = 0"), c.withColumn("name", F.lit("other")), ["vk_id"], ["name"])


@query(f"SELECT DISTINCT from_id FROM posts WHERE \"window\" = 'CURRENT' AND from_id > 0", "p")
def author_registry(s, d):
    """Authors to fetch."""
    return collection.registered_authors(t.posts(s, d))


# ---- robust statistics and roles


def _values(s, d) -> DataFrame:
    return t.posts(s, d).select("from_id", F.col("k").cast("double").alias("v"))


@query("SELECT from_id, round(median(k), 6) AS med, round(quantile_cont(k, 0.75) - quantile_cont(k, 0.25), 6) AS iqr FROM posts GROUP BY 1", "p")
def median_iqr(s, d):
    """Median and interquartile range by author."""
    return rounded(_values(s, d).groupBy("from_id").agg(robust.median(F.col("v")).alias("med"), robust.iqr(F.col("v")).alias("iqr")))


@query("SELECT from_id, round(quantile_cont(k, 0.025), 6) AS q025, round(quantile_cont(k, 0.975), 6) AS q975 FROM posts GROUP BY 1", "p")
def quantiles_type7(s, d):
    """Linear quantiles by author."""
    return rounded(_values(s, d).groupBy("from_id").agg(robust.quantile(F.col("v"), 0.025).alias("q025"), robust.quantile(F.col("v"), 0.975).alias("q975")))


@query("SELECT from_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.4826 * median(abs(k - m)) END, 6) AS mad FROM (SELECT from_id, k, median(k) OVER (PARTITION BY from_id) AS m FROM posts) GROUP BY 1", "p")
def mad(s, d):
    """Median absolute deviation by author."""
    return rounded(robust.mad(_values(s, d), "from_id", "v"))


@query("""+ RECURSIVE st AS (SELECT from_id, m, greatest(1.4826 * median(abs(k - m)), 1e-10) AS s, count(*) AS n FROM (SELECT from_id, k::DOUBLE AS k, median(k::DOUBLE) OVER (PARTITION BY from_id) AS m FROM posts) GROUP BY 1, 2),
  r AS (SELECT from_id, m AS mu, 0 AS it, n < 3 AS done FROM st UNION ALL SELECT from_id, mu2, it + 1, abs(mu2 - mu) <= 1e-6 * (1 + abs(mu)) FROM (
    SELECT from_id, any_value(mu) AS mu, any_value(it) AS it, sum(w * k) / sum(w) AS mu2 FROM (
      SELECT r.from_id, mu, it, k, CASE WHEN abs(k - mu) <= 1.345 * s THEN 1.0::DOUBLE ELSE 1.345 * s / abs(k - mu) END AS w FROM r JOIN posts USING (from_id) JOIN st USING (from_id) WHERE NOT done AND it < 100) GROUP BY 1))
  SELECT from_id, round(arg_max(mu, it), 6) AS mu FROM r GROUP BY 1""", "p")  # fmt: skip
def huber(s, d):
    """Huber's M-estimate by author."""
    return rounded(robust.huber_by(_values(s, d), "from_id", "v"))


@query("+ " + _SCORES + _Z + " SELECT vk_id, " + ", ".join(f"round(z_{c}, 6) AS z_{c}" for c in (*robust.STRUCTURAL, *robust.TOPICAL)) + " FROM zed", "apc")
def robust_z(s, d):
    """Robust z-scores."""
    cols = [*robust.STRUCTURAL, *robust.TOPICAL]
    return rounded(robust.robust_z(_scores(s, d), cols).select("vk_id", *[f"z_{c}" for c in cols]))


@query("+ " + _SCORES + _Z + " SELECT vk_id, round(structural, 6) AS structural, round(topical, 6) AS topical FROM comp", "apc")
def composites(s, d):
    """Structural and topic composites."""
    return rounded(robust.composites(_scores(s, d)).select("vk_id", "structural", "topical"))


@query("+ " + _SCORES + _Z + " SELECT round(ts, 6) AS theta_structural, round(tt, 6) AS theta_topical FROM theta", "apc")
def thresholds(s, d):
    """Medians of the composites."""
    return rounded(robust.thresholds(robust.composites(_scores(s, d))))


@query("+ " + _SCORES + _Z + " SELECT vk_id, role FROM rolled", "apc")
def roles(s, d):
    """Quadrant roles."""
    return _roles(s, d).select("vk_id", "role")


@query("+ " + _SCORES + _Z + " SELECT vk_id, position FROM rolled", "apc")
def position_attr(s, d):
    """Authors' positions (R2)."""
    return _roles(s, d).select("vk_id", "position")


@query("+ " + _SCORES + _Z + " SELECT vk_id, response FROM rolled", "apc")
def response_attr(s, d):
    """Audiences' responses."""
    return _roles(s, d).select("vk_id", "response")


# ---- texts


@query("SELECT id, substring(clean_text, 1, 15000) AS clean_text, length(clean_text) > 15000 AS truncated FROM texts", "x")
def clean_text(s, d):
    """Clean texts, cut at the longest length."""
    return t.table(s, d, "documents").select(F.col("doc_id").alias("id"), text.cleaned(F.col("text")).alias("c")).select("id", "c.clean_text", "c.truncated")


@query(r"SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain_length FROM pages")
def strip_html(s, d):
    """Lengths of pages without tags."""
    return t.table(s, d, "pages").select("page_id", F.length(F.regexp_replace("html", text.TAG, "")).alias("plain_length"))


@query(r"SELECT doc_id AS id, len(regexp_extract_all(text, '#[\wА-яёЁ]+'))::INTEGER AS hashtags_count, len(regexp_extract_all(text, 'https?://\S+'))::INTEGER AS urls_count, (len(regexp_extract_all(text, '@[\w.]+')) + len(regexp_extract_all(text, '\[id\d+\|[^]]*]')))::INTEGER AS mentions_count FROM documents")
def tag_counts(s, d):
    """Hashtags, links and mentions."""
    found = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), text.tag_counts(F.col("text")).alias("c"))
    return found.select("id", "c.hashtags_count", "c.urls_count", "c.mentions_count")


_TOKENS = r"tokens AS (SELECT id, list_filter(regexp_extract_all(clean_text, '(\[URL]|\[USER]|[а-яёА-ЯЁa-zA-Z0-9]+|[^\s])', 1), lambda w: w NOT IN ('[URL]', '[USER]')) AS w FROM texts)"
_SAY = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tokens(s, d) -> DataFrame:
    return t.texts(s, d).withColumn("tokens", text.tokenize(F.col("clean_text")))


@query("+ " + _TOKENS + " SELECT id, len(w)::INTEGER AS n, w[1] AS first, w[-1] AS last FROM tokens", "x")
def tokenize(s, d):
    """Tokens of clean texts."""
    return _tokens(s, d).select("id", F.size("tokens").alias("n"), F.get("tokens", F.lit(0)).alias("first"), F.try_element_at("tokens", F.lit(-1)).alias("last"))


@query("+ " + _TOKENS + f" SELECT id, len(list_filter(w, lambda x: lower(x) NOT IN {_SAY(LATIN.stop_words)}))::INTEGER AS n FROM tokens", "x")
def stopword_filter(s, d):
    """Tokens without stop words."""
    return _tokens(s, d).select("id", F.size(text.without_stop_words(F.col("tokens"), LATIN.stop_words)).alias("n"))


@query("+ " + _TOKENS + f""", ws AS (SELECT id, list_filter(w, lambda x: regexp_matches(x, '^[а-яёА-ЯЁa-zA-Z]')) AS w FROM tokens),
  sh AS (SELECT id, w, coalesce(len(list_filter(w, lambda x: lower(x) IN {_SAY(LATIN.frequent)})) / nullif(len(w), 0), 0) AS r FROM ws)
  SELECT id, round(r, 6) AS share, CASE WHEN len(w) = 0 THEN 'UNKNOWN' WHEN r >= 0.5 THEN 'OK' WHEN r >= 0.3 THEN 'UNCERTAIN' ELSE 'FILTERED_OUT' END AS status FROM sh""", "x")  # fmt: skip
def language_heuristic(s, d):
    """Language by the share of frequent words."""
    share = text.language_share(F.col("tokens"), LATIN.frequent)
    return rounded(_tokens(s, d).select("id", share.alias("share"), text.language_status(share, text.words_only(F.col("tokens"))).alias("status")))


PRIMARY, SECONDARY, EXCLUDED = [["the", "with"], ["der", "die"], ["la"]], [["that"], ["und", "ist"], ["que"]], [["idiot"], ["scum"]]
_HITS = lambda grams: " + ".join("CASE WHEN " + " AND ".join(f"list_contains(w, '{x}')" for x in g) + " THEN 1 ELSE 0 END" for g in grams)
_MATCH = _TOKENS + f""", low AS (SELECT id, list_transform(w, lambda x: lower(x)) AS w FROM tokens), hits AS (SELECT id, {_HITS(EXCLUDED)} > 0 AS excluded, {_HITS(PRIMARY)} AS p, {_HITS(SECONDARY)} AS q FROM low),
  m AS (SELECT id, excluded, CASE WHEN excluded THEN 0 ELSE p END AS p, CASE WHEN excluded THEN 0 ELSE q END AS q FROM hits),
  lev AS (SELECT *, CASE WHEN excluded THEN 0 ELSE least((p + 0.3 * q)::FLOAT, 3) / 3 END::FLOAT AS l1 FROM m)"""


def _matched(s, d, full=False) -> DataFrame:
    rows = _tokens(s, d).drop("relevant").withColumn("lemmas", F.transform("tokens", F.lower))
    semantic = F.when(F.col("id") % 2 == 0, F.lit(0.6)).otherwise(F.lit(0.2))
    return topic.score_posts(rows, PRIMARY, SECONDARY, EXCLUDED, semantic, full)


@query("+ " + _MATCH + " SELECT id, p::INTEGER AS primary_hits, q::INTEGER AS secondary_hits, excluded FROM m", "x")
def ngram_match(s, d):
    """Hits of primary and secondary n-grams, and exclusion."""
    spec = lambda g: text.parse_ngrams(F.lit("\n".join(" ".join(x) for x in g)))
    rows = _tokens(s, d).withColumn("lemmas", F.transform("tokens", F.lower))
    m = rows.select("id", text.match(F.col("lemmas"), spec(PRIMARY), spec(SECONDARY), spec(EXCLUDED)).alias("m"))
    return m.select("id", F.col("m.primary").alias("primary_hits"), F.col("m.secondary").alias("secondary_hits"), "m.excluded")


@query("+ " + _TOKENS + """, low AS (SELECT id, list_transform(w, lambda x: lower(x)) AS w FROM tokens), words AS (SELECT DISTINCT id, unnest(w) AS t FROM low),
  g AS (SELECT DISTINCT kind, list_sort(list_distinct(ws)) AS ws FROM (SELECT 'primary' AS kind, [w[1], w[2]] AS ws FROM low WHERE len(w) > 1 UNION ALL SELECT 'secondary', [w[-2], w[-1]] FROM low WHERE len(w) > 1
    UNION ALL SELECT * FROM (VALUES ('excluded', ['idiot']), ('excluded', ['scum'])))),
  hit AS (SELECT id, kind, ws FROM (SELECT kind, ws, unnest(ws) AS t FROM g) JOIN words USING (t) GROUP BY ALL HAVING count(*) = len(ws)),
  n AS (SELECT id, count(*) FILTER (kind = 'primary') AS p, count(*) FILTER (kind = 'secondary') AS q, count(*) FILTER (kind = 'excluded') > 0 AS x FROM hit GROUP BY 1)
  SELECT id, CASE WHEN x THEN 0 ELSE coalesce(p, 0) END::INTEGER AS primary_hits, CASE WHEN x THEN 0 ELSE coalesce(q, 0) END::INTEGER AS secondary_hits, coalesce(x, false) AS excluded FROM texts LEFT JOIN n USING (id)""", "x")  # fmt: skip
def ngram_index_match(s, d):
    """Hits of as many n-grams as there are first and last two words of texts, by their rarest words."""
    # Distinct lemmas and the ends are written; whole lists are not needed again.
    ends_of = F.when(F.size("lemmas") > 1, F.array(
        F.struct(F.lit("primary").alias("kind"), F.slice("lemmas", 1, 2).alias("words")), F.struct(F.lit("secondary").alias("kind"), F.slice("lemmas", -2, 2).alias("words")),
    ))
    rows = _tokens(s, d).select("id", F.transform("tokens", F.lower).alias("lemmas")).select("id", F.array_distinct("lemmas").alias("lemmas"), ends_of.alias("ends"))
    rows = stage_table(rows, "lemmas")
    ends = rows.select(F.explode("ends").alias("g")).select("g.kind", F.sort_array(F.array_distinct("g.words")).alias("words"))
    grams = ends.distinct().unionByName(s.createDataFrame([("excluded", g) for g in EXCLUDED], ends.schema))
    m = ngram_index.match_many(rows, grams)
    return m.select("id", F.col("primary").alias("primary_hits"), F.col("secondary").alias("secondary_hits"), "excluded")


@query("+ " + _MATCH + " SELECT id, round(l1::DOUBLE, 5) AS l1 FROM lev", "x")
def l1_score(s, d):
    """Keyword levels."""
    return rounded(_matched(s, d).select("id", "l1"), 5)


_DECIDED = _MATCH + """, dec AS (SELECT id, l1, CASE WHEN excluded THEN 'EXCLUDED' WHEN l1 < 0.01::FLOAT THEN 'DISPUTED' WHEN l1 >= 0.5::FLOAT THEN 'CONFIDENT' WHEN id % 2 = 0 THEN 'PASS2_CONFIRMED' ELSE 'DISPUTED' END AS stratum,
  CASE WHEN excluded OR l1 < 0.01::FLOAT THEN false WHEN l1 >= 0.5::FLOAT THEN true ELSE id % 2 = 0 END AS relevant FROM lev)"""


@query("+ " + _DECIDED + " SELECT id, stratum, relevant FROM dec", "x")
def topic_decision(s, d):
    """Two-pass topic decisions (X11)."""
    return _decisions(s, d)


def _decisions(s, d) -> DataFrame:
    return _matched(s, d, True).select("id", "stratum", "relevant")


@query("+ " + _DECIDED + """ SELECT count(*) AS total, count(*) FILTER (stratum = 'CONFIDENT') AS n_confident, count(*) FILTER (stratum = 'PASS2_CONFIRMED') AS n_pass2_confirmed, count(*) FILTER (stratum = 'DISPUTED') AS n_disputed, count(*) FILTER (stratum = 'EXCLUDED') AS n_excluded,
  round(count(*) FILTER (stratum = 'CONFIDENT') / count(*), 6) AS r_confident, round(count(*) FILTER (stratum = 'PASS2_CONFIRMED') / count(*), 6) AS r_pass2_confirmed, round(count(*) FILTER (stratum = 'DISPUTED') / count(*), 6) AS r_disputed, round(count(*) FILTER (stratum = 'EXCLUDED') / count(*), 6) AS r_excluded FROM dec""", "x")  # fmt: skip
def filter_summary(s, d):
    """Counts and shares of strata."""
    return rounded(topic.summary(_decisions(s, d)))


@query("+ " + _DECIDED + " SELECT id FROM dec WHERE stratum = 'DISPUTED' ORDER BY id LIMIT 30", "x")
def disputed_first(s, d):
    """The first thirty disputed posts (T5)."""
    return topic.disputed(_matched(s, d, True).select("id", "published_at", "stratum")).select("id")


@query()
def stems(s, d):
    """Stems of words by the published rules (X7): no SQL; tests hold known stems."""
    from vociflow.functions.stem import stem_tokens

    return _tokens(s, d).select("id", stem_tokens()(F.col("tokens")).alias("stems"))


# ---- vectors


@query("SELECT label, i::INTEGER AS place, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def centroid(s, d):
    """Mean vector of each label."""
    return rounded(topic.centroid(t.table(s, d, "embeddings"), "embedding", ["label"]).select("label", F.posexplode("centroid").alias("place", "mean")))


_COS = """c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE label = 0) GROUP BY i)),
  cs AS (SELECT vec_id, greatest(0, least(1, list_dot_product(embedding::DOUBLE[], c.c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(c.c, c.c)))) AS semantic FROM embeddings, c)"""


def _semantic(s, d) -> DataFrame:
    e = t.table(s, d, "embeddings")
    return topic.semantic_scores(e, e.where("label = 0"))


@query("WITH " + _COS + " SELECT vec_id, round(semantic, 5) AS semantic FROM cs")
def cosine_to_centroid(s, d):
    """Cosines with a reference centroid."""
    return rounded(_semantic(s, d).select("vec_id", "semantic"), 5)


@query("WITH " + _COS.replace("label = 0", "vec_id IN (0, 1)") + " SELECT vec_id, semantic >= 0.55 AS passed FROM cs")
def semantic_pass(s, d):
    """Which vectors pass the second filter, with two reference texts."""
    e = t.table(s, d, "embeddings")
    found = topic.semantic_scores(e, e.where("vec_id in (0, 1)"))
    return found.select("vec_id", (F.col("semantic") >= DEFAULT.semantic).alias("passed"))


@query("WITH " + _COS + " SELECT vec_id, round(semantic, 5) AS semantic FROM cs ORDER BY cs.semantic DESC, vec_id LIMIT 10")
def cosine_topk(s, d):
    """The ten vectors nearest to the centroid."""
    return rounded(store.top_by(_semantic(s, d).select("vec_id", "semantic"), [F.desc("semantic"), F.col("vec_id")], 10), 5)


# ---- duplicates


@query("+ " + _EDGES + " SELECT hash, count(*) AS copies FROM edges WHERE copies > 1 GROUP BY 1", "x")
def exact_dup_groups(s, d):
    """Groups of equal normalised texts."""
    return dedup.exact_edges(t.texts(s, d)).select("hash", "copies").distinct()


@query("+ " + _EDGES + " SELECT canonical_id, duplicate_id FROM edges WHERE canonical_id <> duplicate_id", "x")
def exact_dup_edges(s, d):
    """Links from the earliest text to its copies."""
    return dedup.exact_edges(t.texts(s, d)).select("canonical_id", "duplicate_id")


@query()
def near_dup_pairs(s, d):
    """Pairs of near duplicates within 72 hours (J7, X15, X16): SQL takes minutes; tests compare with all pairs."""
    return rounded(dedup.near_pairs(_tokens(s, d).where("own_text_length >= 100")).drop("a_at"))


@query()
def near_dup_edges(s, d):
    """The first link of each near duplicate (D3, K7)."""
    rows = _tokens(s, d).select("id", "published_at", "own_text_length", "relevant", text.dedup_key(F.col("clean_text")).alias("hash"), "tokens")
    rows = stage_table(rows, "tokens")  # clean texts are needed for their hashes alone
    return rounded(dedup.near_edges(rows, dedup.exact_edges(rows), written=True))


@query("""SELECT id, CASE WHEN k % 13 = 0 THEN 'DETECTED_COPY' WHEN has_copy_history AND own_text_length >= 30 THEN 'REPOST_WITH_COMMENT' WHEN has_copy_history THEN 'PURE_REPOST' WHEN own_text_length >= 20 THEN 'ORIGINAL'
  WHEN contains_media THEN 'MEDIA_ONLY' ELSE 'ORIGINAL' END AS originality FROM posts""", "p")  # fmt: skip
def originality(s, d):
    """Originality of posts."""
    kind = dedup.originality(F.col("k") % 13 == 0, F.col("has_copy_history"), F.col("contains_media"), F.col("own_text_length"))
    return t.posts(s, d).select("id", kind.alias("originality"))


# ---- sentiment


_POL = "+ " + _TOKENS + f""", marks AS (SELECT id, w, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN lower(w[i]) IN {_SAY(LATIN.positive)} THEN CASE WHEN lower(coalesce(w[i-1], '')) IN {_SAY(LATIN.negators)} OR (i > 2 AND lower(w[i-2]) IN {_SAY(LATIN.negators)}) OR (i > 3 AND lower(w[i-3]) IN {_SAY(LATIN.negators)}) THEN -2 ELSE 1 END
    WHEN lower(w[i]) IN {_SAY(LATIN.negative)} THEN CASE WHEN (i > 1 AND lower(w[i-1]) IN {_SAY(LATIN.negators)}) OR (i > 2 AND lower(w[i-2]) IN {_SAY(LATIN.negators)}) OR (i > 3 AND lower(w[i-3]) IN {_SAY(LATIN.negators)}) THEN 2 ELSE -1 END ELSE 0 END) AS m FROM tokens),
  pol AS (SELECT id, w, len(list_filter(m, lambda x: x IN (1, 2))) AS p, len(list_filter(m, lambda x: x IN (-1, -2))) AS n, len(list_filter(m, lambda x: x IN (2, -2))) > 0 AS negated FROM marks)"""


@query(_POL + " SELECT id, p::INTEGER AS positive, n::INTEGER AS negative, negated FROM pol", "x")
def negation_adjust(s, d):
    """Positive and negative words after negation."""
    return _tokens(s, d).select("id", sentiment.polarity_counts(F.col("tokens"), LATIN).alias("c")).select("id", "c.*")


_SIG = f""", sig AS (SELECT id, w, p, n, negated, len(list_filter(w, lambda x: lower(x) IN {_SAY(LATIN.positive_signals)})) AS g, len(list_filter(w, lambda x: lower(x) IN {_SAY(LATIN.negative_signals)} OR contains(x, '?!') OR contains(x, '!?'))) AS b,
    len(list_filter(w, lambda x: contains(x, '!'))) AS e, len(list_filter(w, lambda x: contains(x, '?'))) AS q, len(list_filter(w, lambda x: length(x) > 2 AND x = upper(x) AND regexp_matches(x, '\\p{{L}}'))) AS caps FROM pol),
  raw AS (SELECT *, CASE WHEN g > b THEN 0.2 + least(e + caps, 3) * 0.05 WHEN g < b THEN -(0.2 + least(e + caps, 3) * 0.05) WHEN e + caps > 0 AND q > e THEN -(0.15 + least(e + caps, 3) * 0.05) WHEN e + caps > 0 THEN 0.15 + least(e + caps, 3) * 0.05 ELSE 0 END AS r FROM sig)"""


@query(_POL + _SIG + " SELECT id, CASE WHEN abs(r) < 0.15 THEN 'NEUTRAL' WHEN r > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, round((CASE WHEN abs(r) < 0.15 THEN 0 ELSE r END)::FLOAT::DOUBLE, 5) AS score FROM raw", "x")
def signal_sentiment(s, d):
    """Sentiment from signals alone."""
    found = _tokens(s, d).select("id", sentiment.by_signals(F.col("tokens"), LATIN).alias("r"))
    return rounded(found.select("id", "r.label", "r.score"), 5)


@query(_POL + _SIG + """, sc AS (SELECT *, ((p - n) / (p + n + 1))::FLOAT AS v FROM raw)
  SELECT id, CASE WHEN len(w) = 0 THEN 'NEUTRAL' WHEN p + n > 0 THEN CASE WHEN abs(v) < 0.15::FLOAT THEN 'NEUTRAL' WHEN v > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END WHEN abs(r) < 0.15 THEN 'NEUTRAL' WHEN r > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
  CASE WHEN len(w) = 0 THEN 'NO_LEXICON_MATCH' WHEN p + n > 0 THEN CASE WHEN abs(v) < 0.15::FLOAT THEN 'LOW_CONFIDENCE' ELSE 'DICTIONARY' END WHEN abs(r) < 0.15 THEN 'NO_LEXICON_MATCH' ELSE 'SIGNAL' END AS method FROM sc""", "x")  # fmt: skip
def dictionary_sentiment(s, d):
    """Dictionary sentiment with fallbacks."""
    found = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), sentiment.local_service(F.col("text"), LATIN).alias("r"))
    return found.select("id", "r.label", "r.method")


@query("""SELECT id, round(CASE label WHEN 'POSITIVE' THEN 0.5 + k / 200.0 ELSE 0 END, 6) AS positive, round(CASE label WHEN 'POSITIVE' THEN 0.5 - k / 200.0 WHEN 'NEGATIVE' THEN 0.5 + k / 200.0 ELSE 1 END, 6) AS neutral,
  round(CASE label WHEN 'NEGATIVE' THEN 0.5 - k / 200.0 ELSE 0 END, 6) AS negative FROM posts""", "p")  # fmt: skip
def label_to_distribution(s, d):
    """Labels and scores as probabilities."""
    return rounded(t.posts(s, d).select("id", scalars.label_to_distribution(F.col("label"), F.col("k") / 100.0).alias("v")).select("id", "v.*"))


@query("SELECT id, CASE WHEN p_positive >= p_negative AND p_positive >= p_neutral THEN 'POSITIVE' WHEN p_negative >= p_positive AND p_negative >= p_neutral THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM posts WHERE p_positive IS NOT NULL", "p")
def dominant_label(s, d):
    """The label of the largest probability."""
    return t.posts(s, d).where("p_positive is not null").select("id", scalars.dominant(F.col("p_positive"), F.col("p_neutral"), F.col("p_negative")).alias("label"))


@query("SELECT conv_id, turn, length(text) AS result FROM conversations")
def cache_probe(s, d):
    """Results of distinct texts, from a cache or computed."""
    rows = t.table(s, d, "conversations").select("conv_id", "turn", "text")
    cache = rows.where("conv_id % 2 = 0").select(text.text_hash(F.col("text")).alias("text_hash"), F.length("text").alias("result"), F.lit("v1").alias("model_version")).distinct()
    found, _ = sentiment.cached(rows, cache, "v1", lambda m: m.select("text_hash", F.length("text").alias("result")))
    return found.select("conv_id", "turn", "result")


@query("SELECT conv_id, turn, length(text) AS result, 0::BIGINT AS computed_again FROM conversations")
def cache_write_back(s, d):
    """Results of all texts by two runs over one table of results: the second finds all that the first wrote."""
    rows, name = t.table(s, d, "conversations").select("conv_id", "turn", "text"), f"vociflow_cache_{uuid.uuid4().hex}"
    asked = []

    def compute(missing):
        asked.append(missing.count())
        return missing.select("text_hash", F.length("text").alias("result"))

    sentiment.cached_in_table(rows.where("turn % 2 = 0"), name, "v1", compute)
    sentiment.cached_in_table(rows, name, "v1", compute)
    again = sentiment.cached_in_table(rows, name, "v1", compute)
    return again.select("conv_id", "turn", "result", F.lit(asked[-1]).cast("long").alias("computed_again"))


# ---- inference

_DRAWS = """v AS (SELECT %s AS key, %s AS x, row_number() OVER (PARTITION BY %s ORDER BY %s) - 1 AS i, count(*) OVER (PARTITION BY %s) AS n FROM %s),
  y1 AS (SELECT key, n, b, (('0x' || substr(md5('42|' || key), 1, 8))::BIGINT + b * 1000003) %% 2147483647 * 48271 %% 2147483647 AS y FROM (SELECT DISTINCT key, n FROM v WHERE n >= 2), (SELECT unnest(range(0, 1000)) AS b)),
  y2 AS (SELECT key, n, b, xor(y, y >> 15) * 69621 %% 2147483647 AS y FROM y1),
  y3 AS (SELECT key, n, b, (xor(y, y >> 13) + d * 7919) %% 2147483647 * 48271 %% 2147483647 AS y FROM (SELECT *, unnest(range(0, n)) AS d FROM y2)),
  y4 AS (SELECT key, n, b, xor(y, y >> 15) * 69621 %% 2147483647 AS y FROM y3),
  draws AS (SELECT key, b, (xor(y, y >> 13) * n) >> 31 AS i FROM y4),
  st AS (SELECT key, b, %s FROM draws JOIN v USING (key, i) GROUP BY key, b)"""


@query("+ " + _DRAWS % ("from_id", "k", "from_id", "id", "from_id", "posts", "avg(x) AS m") + " SELECT key AS from_id, round(quantile_cont(m, 0.025), 9) AS mean_low, round(quantile_cont(m, 0.975), 9) AS mean_high FROM st GROUP BY 1", "p")
def boot_mean_ci(s, d):
    """Intervals of a mean by author (B1)."""
    return rounded(bootstrap.hashed_intervals(t.posts(s, d).select("id", "from_id", "k"), "from_id", "id", {"mean": ("mean", F.col("k"))}, DEFAULT.bootstrap), 9)


@query("+ " + _DRAWS % ("from_id", "k", "from_id", "id", "from_id", "posts", "sum(x) AS m") + " SELECT key AS from_id, round(quantile_cont(m, 0.025), 9) AS total_low, round(quantile_cont(m, 0.975), 9) AS total_high FROM st GROUP BY 1", "p")
def boot_sum_ci(s, d):
    """Intervals of a sum by author (B1)."""
    return rounded(bootstrap.hashed_intervals(t.posts(s, d).select("id", "from_id", "k"), "from_id", "id", {"total": ("sum", F.col("k"))}, DEFAULT.bootstrap), 9)


@query("+ lab AS (SELECT * FROM posts WHERE label IS NOT NULL), " + _DRAWS % ("from_id", "label", "from_id", "id", "from_id", "lab", "avg((x = 'POSITIVE')::INT) AS p, avg((x = 'NEGATIVE')::INT) AS q")
       + " SELECT key AS from_id, round(quantile_cont(p, 0.025), 9) AS positive_low, round(quantile_cont(p, 0.975), 9) AS positive_high, round(quantile_cont(q, 0.025), 9) AS negative_low, round(quantile_cont(q, 0.975), 9) AS negative_high FROM st GROUP BY 1", "p")
def boot_label_ci(s, d):
    """Intervals of label shares by author (B2)."""
    rows = t.posts(s, d).where("label is not null").select("id", "from_id", "label")
    share = lambda x: ("mean", (F.col("label") == x).cast("int"))
    return rounded(bootstrap.hashed_intervals(rows, "from_id", "id", {"positive": share("POSITIVE"), "negative": share("NEGATIVE")}, DEFAULT.bootstrap), 9)


def _intervals(s, d) -> DataFrame:
    samples = bootstrap.score_samples(t.authors(s, d), t.posts(s, d), t.comments(s, d))
    return bootstrap.intervals(samples, DEFAULT.bootstrap, DEFAULT.bootstrap_outer, DEFAULT.bootstrap_inner)


@query()
def boot_two_level_ci(s, d):
    """Intervals of all scores, two-level for responses."""
    return rounded(_intervals(s, d))


@query()
def ci_width(s, d):
    """Mean interval widths by author."""
    return rounded(bootstrap.mean_width(_intervals(s, d)))


# ---- quality


_JUDGED = ", lab AS (SELECT * FROM posts WHERE label IS NOT NULL), " + _DRAWS % ("from_id", "label", "from_id", "id", "from_id", "lab", "avg((x = 'POSITIVE')::INT) AS pp, avg((x = 'NEGATIVE')::INT) AS qq") + """,
  wide AS (SELECT key, round((quantile_cont(pp, 0.975) - quantile_cont(pp, 0.025) + quantile_cont(qq, 0.975) - quantile_cont(qq, 0.025)) / 2, 6) AS ci_width FROM st GROUP BY key),
  judged AS (SELECT vk_id, ci_width, topic_posts, n_comments FROM scores LEFT JOIN wide ON key = vk_id),
  suff AS (SELECT vk_id, ci_width, CASE WHEN topic_posts < 3 OR n_comments < 10 OR coalesce(ci_width > 0.5, false) THEN 'UNRELIABLE' WHEN topic_posts >= 10 AND n_comments >= 50 AND (ci_width IS NULL OR ci_width <= 0.2) THEN 'RELIABLE' ELSE 'PRELIMINARY' END AS sufficiency FROM judged)"""


def _judged(s, d) -> DataFrame:
    """Authors with the mean width of the intervals of their label shares (B2, A26), and their sufficiency (Q1)."""
    found = boot_label_ci(s, d)
    width = (F.col("positive_high") - F.col("positive_low") + F.col("negative_high") - F.col("negative_low")) / 2
    rows = _scores(s, d).join(found.select(F.col("from_id").alias("vk_id"), F.round(width, 6).alias("ci_width")), "vk_id", "left")
    return rows.select("vk_id", "ci_width", quality.sufficiency(F.col("topic_posts"), F.col("n_comments"), F.col("ci_width")).alias("sufficiency"))


@query("+ " + _SCORES + _JUDGED + " SELECT vk_id, sufficiency FROM suff", "apc")
def sufficiency(s, d):
    """Sufficiency of each author's data (Q1)."""
    return _judged(s, d).select("vk_id", "sufficiency")


_INPUTS = _SCORES + _JUDGED + f""", pc AS (SELECT post_id, count(*) AS n_c FROM comments GROUP BY 1),
  ip AS (SELECT count(*) FILTER (combined >= 0.5) / count(combined) AS topic_quality, count(*) FILTER ({TOPIC_SQL} AND n_c >= 5) / count(*) FILTER ({TOPIC_SQL}) AS comment_coverage, count(*) FILTER (k % 13 <> 0) / count(*) AS dedup_efficiency,
    count(*) FILTER (k = 50) / count(*) AS sentiment_fallback FROM posts LEFT JOIN pc ON posts.id = pc.post_id),
  ia AS (SELECT count(*) FILTER (is_closed) / count(*) AS closed_ratio FROM authors),
  ij AS (SELECT count(*) FILTER (sufficiency = 'RELIABLE') / count(*) AS reliable_ratio, count(*) FILTER (sufficiency = 'UNRELIABLE') / count(*) AS unreliable_ratio, coalesce(avg(ci_width), 0) AS ci_width FROM suff),
  inputs AS (SELECT 1.0 AS completeness, 0.0 AS api_retry, 1.0 AS semantic_pass, * FROM ip, ia, ij)"""
_NAMES = ("topic_quality", "comment_coverage", "dedup_efficiency", "closed_ratio", "sentiment_fallback", "reliable_ratio", "unreliable_ratio", "ci_width", "completeness", "api_retry", "semantic_pass")


def _inputs(s, d) -> DataFrame:
    posts = t.posts(s, d).withColumn("originality", F.when(F.col("k") % 13 == 0, "DETECTED_COPY").otherwise("ORIGINAL"))
    methods = posts.select(F.when(F.col("k") == 50, "fallback_error").otherwise("model").alias("method"))
    return quality.quality_inputs(posts, t.comments(s, d), t.authors(s, d), methods, _judged(s, d))


@query("+ " + _INPUTS + " SELECT " + _R(*_NAMES) + " FROM inputs", "apc")
def quality_inputs(s, d):
    """Inputs of the session's quality."""
    return rounded(_inputs(s, d).select(*[F.col(c).cast("double").alias(c) for c in _NAMES]))


def _state(name: str, passed: float, border: float) -> str:
    cmp = (f"{name} >= {passed}", f"{name} >= {border}") if passed >= 0 else (f"{name} <= {-passed}", f"{name} <= {-border}")
    return f"CASE WHEN {cmp[0]} THEN 'PASSED' WHEN {cmp[1]} THEN 'BORDERLINE' ELSE 'FAILED' END"


_IND = ", ind AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, {n}::DOUBLE AS value, {_state(n, p, b)} AS status, {str(m).lower()} AS is_primary FROM inputs" if p is not None else
    f"SELECT '{n}', reliable_ratio, CASE WHEN reliable_ratio >= 0.5 AND unreliable_ratio <= 0.2 THEN 'PASSED' WHEN reliable_ratio >= 0.3 AND unreliable_ratio <= 0.35 THEN 'BORDERLINE' ELSE 'FAILED' END, true FROM inputs"
    for n, p, b, m in quality.INDICATORS) + ")"


@query("+ " + _INPUTS + _IND + " SELECT name, round(value, 6) AS value, status, is_primary FROM ind", "apc")
def quality_indicators(s, d):
    """The ten indicators (Q2)."""
    return rounded(quality.indicators(_inputs(s, d)))


@query("+ " + _INPUTS + _IND + " SELECT CASE WHEN bool_and(NOT is_primary OR status = 'PASSED') THEN 'PASSED' WHEN bool_or(is_primary AND status = 'FAILED') THEN 'FAILED' ELSE 'BORDERLINE' END AS overall FROM ind", "apc")
def overall_quality(s, d):
    """Overall quality (Q3)."""
    return quality.overall(quality.indicators(_inputs(s, d))).select("overall")


@query("+ " + _INPUTS + _IND + " SELECT round(avg((status = 'PASSED')::INT), 6) AS quality_score FROM ind", "apc")
def quality_score(s, d):
    """Share of indicators passed (Q4)."""
    return rounded(quality.overall(quality.indicators(_inputs(s, d))).select("quality_score"))


@query("SELECT id, 'k' || k || ': ' || coalesce(label, 'NONE') || ' (' || printf('%.3f', k / 100.0) || ')' AS message FROM posts", "p")
def message_format(s, d):
    """Formatted indicators."""
    name, status = F.concat(F.lit("k"), F.col("k").cast("string")), F.coalesce("label", F.lit("NONE"))
    return t.posts(s, d).select("id", text.format_indicator(name, status, F.col("k") / 100.0).alias("message"))


@query("SELECT id, 'k' || k AS name, coalesce(label, 'NONE') AS status, round(k / 100.0, 3) AS value FROM posts", "p")
def message_parse(s, d):
    """Formatted indicators, read again with a decimal comma."""
    made = message_format(s, d).select("id", text.parse_indicator(F.regexp_replace("message", r"\(0\.", "(0,")).alias("m"))
    return rounded(made.select("id", "m.*"), 3)


# ---- evaluation


@query("""+ c AS (SELECT count(*) FILTER (vote AND relevant) AS tp, count(*) FILTER (NOT vote AND relevant) AS fp, count(*) FILTER (vote AND relevant IS DISTINCT FROM true) AS fn FROM posts WHERE vote IS NOT NULL)
  SELECT tp, fp, fn, round((1 + tp) / (2 + tp + fp), 6) AS mean, round(greatest(0, (1 + tp) / (2 + tp + fp) - 1.96 * sqrt((1 + tp) * (1 + fp) / (power(2 + tp + fp, 2) * (3 + tp + fp)))), 6) AS low,
  round(least(1, (1 + tp) / (2 + tp + fp) + 1.96 * sqrt((1 + tp) * (1 + fp) / (power(2 + tp + fp, 2) * (3 + tp + fp)))), 6) AS high FROM c""", "p")  # fmt: skip
def beta_posterior(s, d):
    """Precision of the filter by votes."""
    return rounded(topic.validation(t.posts(s, d)).select("tp", "fp", "fn", "precision.*"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same FROM labels), pq AS (SELECT sum(p * q)::DOUBLE AS pq FROM (SELECT quality AS v, count(*) AS p FROM labels GROUP BY 1) JOIN (SELECT toxic AS v, count(*) AS q FROM labels GROUP BY 1) USING (v))
  SELECT round((same / n - coalesce(pq, 0) / (n * n)) / (1 - coalesce(pq, 0) / (n * n)), 6) AS kappa FROM n, pq""")  # fmt: skip
def cohen_kappa(s, d):
    """Agreement of two labels."""
    return rounded(quality.cohen_kappa(t.table(s, d, "labels"), "quality", "toxic"))


@query("SELECT round(coalesce(covar_pop(n_chars::DOUBLE, quality::DOUBLE) / nullif(sqrt(var_pop(n_chars::DOUBLE) * var_pop(quality::DOUBLE)), 0), 0), 6) AS r FROM labels JOIN documents USING (doc_id)")
def pearson(s, d):
    """Correlation of length and quality."""
    rows = t.table(s, d, "labels").join(t.table(s, d, "documents"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("y"))
    return rounded(quality.pearson(rows, "x", "y"))


@query("""WITH o AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS o, count(*)::DOUBLE AS e FROM orders GROUP BY 1), x AS (SELECT o, e * (SELECT sum(o) FROM o) / (SELECT sum(e) FROM o) AS x FROM o)
  SELECT round(sum((o - x) * (o - x) / x), 6) AS chi2 FROM x""")  # fmt: skip
def chi_square_roles(s, d):
    """Chi-square of one distribution against another."""
    o = t.table(s, d, "orders")
    by = lambda df, n: df.groupBy("o_orderpriority").agg(F.count("*").alias(n))
    return rounded(quality.chi_square(by(o.where("o_orderstatus = 'F'"), "o"), by(o, "e"), "o_orderpriority"))


@query("SELECT id, CASE WHEN k / 8.0 > 10 OR abs(likes / 100.0) > 0.2 THEN 'HIGH' WHEN k / 8.0 > 5 OR abs(likes / 100.0) > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM posts", "p")
def impact_class(s, d):
    """Impact classes (Q6)."""
    return t.posts(s, d).select("id", quality.impact(F.col("k") / 8.0, F.col("likes") / 100.0).alias("impact"))


@query("SELECT r_name AS stage, (100 + r_regionkey * 20)::DOUBLE AS ms, 100.0::DOUBLE AS base, trunc(((100.0::DOUBLE + r_regionkey * 20) / 100.0 - 1) * 100)::INTEGER AS percent FROM region WHERE r_regionkey >= 2")
def timing_regression(s, d):
    """Stages slower than their baseline."""
    r = t.table(s, d, "region")
    return quality.timing_regressions(r.select(F.col("r_name").alias("stage"), (100.0 + F.col("r_regionkey") * 20).alias("ms")), r.select(F.col("r_name").alias("stage"), F.lit(100.0).alias("ms")))


@query("SELECT n_name AS best, (n_nationkey / 100.0)::DOUBLE AS score, 'SWITCH' AS advice FROM nation ORDER BY n_nationkey DESC LIMIT 1")
def best_model(s, d):
    """The best model, and whether to switch."""
    rows = t.table(s, d, "nation").select(F.col("n_name").alias("model"), (F.col("n_nationkey") / 100.0).alias("score"))
    return quality.best_model(rows, "NONE").select("best", F.col("score").cast("double").alias("score"), "advice")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, '{k}')" for n, a, b, c, k in quality.SENSITIVITY) + ") v(name, default_value, low, high, category)")
def sensitivity_parameters(s, d):
    """Parameters of the sensitivity analysis (Q7)."""
    return quality.sensitivity_table(s)


# ---- sorts, sets, collection


@query("+ " + _SCORES + " SELECT vk_id, round(pos_positive - pos_negative, 6) AS balance FROM scores ORDER BY pos_positive - pos_negative DESC, vk_id LIMIT 20", "apc")
def table_sort_nulls(s, d):
    """The table sorted by position, first twenty rows."""
    found = views.sort_table(_scores(s, d), "position", False).limit(20)
    return rounded(found.select("vk_id", (F.col("pos_positive") - F.col("pos_negative")).alias("balance")))


@query("SELECT from_id, count(*) AS n_posts FROM posts WHERE relevant AND from_id > 0 GROUP BY 1 ORDER BY n_posts DESC, from_id LIMIT 100", "p")
def top_authors(s, d):
    """Authors with the most topic posts."""
    return collection.top_authors(t.posts(s, d))


@query("SELECT id, comments FROM posts WHERE \"window\" = 'CURRENT' AND comments > 0 ORDER BY comments DESC, id LIMIT 200", "p")
def top_posts(s, d):
    """Posts with the most comments."""
    return collection.top_commented(t.posts(s, d)).select("id", "comments")


@query("SELECT id, from_id FROM posts WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY published_at DESC, id) <= 20", "p")
def posts_per_author_cap(s, d):
    """Each author's newest posts within bounds."""
    lit = lambda x: F.lit(x).cast("timestamp")
    return collection.wall_posts(t.posts(s, d), lit("2024-01-05"), lit("2024-01-25"), 20).select("id", "from_id")


@query("""SELECT 'BASELINE' AS "window", count(*) AS n FROM posts WHERE date_trunc('second', published_at) >= TIMESTAMP '2024-01-11' UNION ALL SELECT 'CURRENT', count(*) FROM posts WHERE date_trunc('second', published_at) >= TIMESTAMP '2024-01-21'""", "p")
def community_windows(s, d):
    """Posts of overlapping collection windows."""
    return collection.community_windows(t.posts(s, d), t.as_of(), 20, 10).groupBy("window").agg(F.count("*").alias("n"))


@query("SELECT user_id % 7 AS session_id, max(ts) AS updated_at, arg_max(event_id, (ts, event_id)) AS checkpoint FROM events WHERE event_type = 'click' GROUP BY 1")
def latest_checkpoint(s, d):
    """The latest checkpoint of each session."""
    e = t.table(s, d, "events")
    rows = e.select((F.col("user_id") % 7).alias("session_id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("checkpoint"), F.when(F.col("event_type") == "click", "CHECKPOINTED").otherwise("FAILED").alias("status"))
    return store.latest_checkpoint(rows)


@query("SELECT method, count(*) AS n FROM (SELECT 'post' || (event_id % 3) AS method FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'post' || (l_orderkey % 3) FROM lineitem) GROUP BY 1")
def union_methods(s, d):
    """Methods of posts and comments as a bag."""
    p, c = t.posts(s, d).select("id"), t.comments(s, d).select("id", "post_id")
    of = p.select(F.lit("POST").alias("entity_type"), F.col("id").alias("entity_id"), F.concat(F.lit("post"), (F.col("id") % 3).cast("string")).alias("method"))
    oc = c.select(F.lit("COMMENT").alias("entity_type"), F.col("id").alias("entity_id"), F.concat(F.lit("post"), (F.col("post_id") % 3).cast("string")).alias("method"))
    return sentiment.methods_of_session(of.unionByName(oc), p.where("id % 2 = 0"), c).groupBy("method").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS vk_id FROM customer EXCEPT SELECT user_id FROM events")
def except_ids(s, d):
    """Authors without posts."""
    return t.authors(s, d).select("vk_id").join(t.posts(s, d).select(F.col("from_id").alias("vk_id")), "vk_id", "left_anti")


@query("SELECT source, sum(n)::BIGINT AS total, sum(voted)::BIGINT AS voted, count(*) AS authors FROM (SELECT event_type AS source, from_id, count(*) AS n, count(vote) AS voted FROM posts GROUP BY 1, 2) GROUP BY 1", "p")
def hierarchy_groups(s, d):
    """Posts by source and author."""
    rows = t.posts(s, d).select(F.col("event_type").alias("source"), F.col("from_id").alias("author"), "vote")
    return topic.source_groups(rows)


@query("SELECT event_type AS source, from_id AS author, count(*) AS n, count(vote) AS voted FROM posts GROUP BY 1, 2", "p")
def hierarchy_authors(s, d):
    """Posts of each author of each source."""
    rows = t.posts(s, d).select(F.col("event_type").alias("source"), F.col("from_id").alias("author"), "vote")
    return topic.source_authors(rows)


@query("SELECT TIMESTAMP '2024-01-01' + to_days(i::INTEGER * 7) AS start, least(TIMESTAMP '2024-01-01' + to_days(i::INTEGER * 7 + 7), TIMESTAMP '2024-01-31') AS \"end\" FROM range(0, 5) r(i)")
def time_segments(s, d):
    """Segments of a search period."""
    return collection.time_segments(s, F.lit("2024-01-01").cast("timestamp"), t.as_of(), 7)


@query("""+ w AS (SELECT *, floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', published_at)) / 604800) AS week, floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', published_at)) / 86400) AS dy FROM posts WHERE published_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'),
  n AS (SELECT week, count(*) AS n FROM w GROUP BY 1)
  SELECT TIMESTAMP '2024-01-01' + to_days(CASE WHEN n >= 2000 THEN dy ELSE week * 7 END::INTEGER) AS segment_start, CASE WHEN n >= 2000 THEN 1 ELSE 7 END AS days, count(*) AS n_posts FROM w JOIN n USING (week) GROUP BY 1, 2""", "p")  # fmt: skip
def search_segments(s, d):
    """Posts of search segments; full ones are split by day."""
    return collection.search_segments(t.posts(s, d), F.lit("2024-01-01").cast("timestamp"), t.as_of(), 2000)


@query("SELECT c_custkey, 'club' || c_custkey AS entry, 'ID' AS kind, c_custkey::INTEGER AS id, NULL::VARCHAR AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'https://vk.com/id' || c_custkey, 'NAME', -1, 'id' || c_custkey FROM customer WHERE c_custkey % 2 = 1")
def community_identifiers(s, d):
    """Community identifiers in free text."""
    key = F.col("c_custkey").cast("string")
    rows = t.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("club"), key)).otherwise(F.concat(F.lit("https://vk.com/id"), key)).alias("entry"))
    found = collection.community_ids(rows, "entry")
    return rows.join(found, "entry").select("c_custkey", "entry", "kind", F.coalesce("id", F.lit(-1)).alias("id"), "name")


@query("SELECT event_id AS vk_id, (event_id % 5)::INTEGER AS likes, 0::INTEGER AS reposts, CASE WHEN event_id % 3 = 0 THEN 9 ELSE -1 END AS views, event_id % 2 = 0 AS contains_media, false AS has_copy_history FROM events WHERE event_id <> 0")
def remote_flattening(s, d):
    """Rows of remote posts."""
    i, none = F.col("event_id"), F.lit(None)
    count = lambda c: F.struct(c.cast("int").alias("count"))
    media = F.when(i % 2 == 0, F.array(F.struct(F.lit("photo").alias("type"))))
    rows = t.table(s, d, "events").select(
        i.alias("id"), i.alias("owner_id"), i.alias("from_id"), F.unix_timestamp("ts").alias("date"), F.col("event_type").alias("text"), count(i % 5).alias("likes"), none.cast("struct<count:int>").alias("reposts"),
        count(F.lit(1)).alias("comments"), F.when(i % 3 == 0, count(F.lit(9))).alias("views"), media.alias("attachments"), none.cast("array<struct<id:int>>").alias("copy_history"),
    )
    return collection.flatten_remote(rows).select("vk_id", "likes", "reposts", F.coalesce("views", F.lit(-1)).alias("views"), "contains_media", "has_copy_history")


@query("SELECT DISTINCT event_type FROM events")
def event_types(s, d):
    """Distinct event types."""
    return views.event_types(t.table(s, d, "events"))


@query("""SELECT 'UNKNOWN_AUTHOR' AS rule, id FROM posts WHERE from_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'NO_GROUND_TRUTH', id FROM posts WHERE label IS NULL
  UNION ALL SELECT 'ROLE_OF_UNKNOWN', p_partkey FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""", "p")  # fmt: skip
def corpus_violations(s, d):
    """What is wrong with a corpus: customers as authors, events as posts, parts as authors with roles."""
    a = t.table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    p = t.posts(s, d).select("id", "from_id", F.col("label").alias("ground_truth"))
    r = t.table(s, d, "part").select(F.col("p_partkey").alias("author_id"))
    return corpus.violations(a, p, r)


@query("SELECT (1000 + i)::INTEGER AS id, ((i - 1) % 50 + 1)::INTEGER AS from_id, (5 + i % 100)::INTEGER AS likes, i % 5 <= 1 AS topical FROM range(1, 501) r(i)")
def synthetic_posts(s, d):
    """Posts of the synthetic corpus."""
    return corpus.generate_posts(s).select("id", "from_id", "likes", F.col("ground_truth.is_topic_relevant").alias("topical"))


# ---- scalar display rules


@query("SELECT id, round(CASE WHEN p_positive >= p_negative THEN 1 ELSE -1 END * CASE WHEN p_positive = p_negative THEN 0 ELSE power(abs(p_positive - p_negative), 1 / 3.0) END, 5) AS lean FROM posts WHERE p_positive IS NOT NULL", "p")
def sentiment_lean(s, d):
    """Saturated sentiment balances."""
    return rounded(t.posts(s, d).where("p_positive is not null").select("id", scalars.sentiment_lean(F.col("p_positive"), F.col("p_negative")).alias("lean")), 5)


@query("SELECT c_custkey, CASE WHEN b >= 1000000 THEN printf('%.1fM', b / 1000000.0) WHEN b >= 1000 THEN printf('%.1fK', b / 1000.0) ELSE b::VARCHAR END AS shown FROM (SELECT c_custkey, c_custkey * 100 + 7 AS b FROM customer)")
def compact_counts(s, d):
    """Compact counts."""
    return t.table(s, d, "customer").select("c_custkey", scalars.format_count(F.col("c_custkey") * 100 + 7).alias("shown"))


@query("SELECT id, round(greatest(5, least(14, 5 + greatest(0, least(0.3, likes / 100.0)) / 0.3 * 7)), 6) AS radius, CASE WHEN k > 0 THEN floor(100 * likes / k) ELSE 0 END::INTEGER AS percent, round(greatest(0, least(1, combined)), 6) AS bar FROM posts WHERE combined IS NOT NULL", "p")
def display_scalars(s, d):
    """Marker radii, percents and interval bars."""
    bar = scalars.interval_bar(F.col("combined"), F.lit(None).cast("double"), F.lit(None).cast("double"))["low"]
    rows = t.posts(s, d).where("combined is not null")
    return rounded(rows.select("id", scalars.marker_radius(F.col("likes") / 100.0).alias("radius"), scalars.percent_done(F.col("likes"), F.col("k")).alias("percent"), bar.alias("bar")))


@query("SELECT id, round(greatest(0, least(1, (combined - (lo - 0.1 * sp)) / (1.2 * sp))), 6) AS x FROM (SELECT id, combined, lo, greatest(hi - lo, 0.01) AS sp FROM posts, (SELECT min(combined) AS lo, max(combined) AS hi FROM posts)) WHERE combined IS NOT NULL", "p")
def axis_positions(s, d):
    """Positions on a padded axis."""
    rows = t.posts(s, d).where("combined is not null")
    ends = rows.agg(F.min("combined").alias("lo"), F.max("combined").alias("hi"))
    return rounded(rows.join(F.broadcast(ends), F.lit(True)).select("id", scalars.scale_axis(F.col("combined"), F.col("lo"), F.col("hi")).alias("x")))


@query("""WITH v AS (SELECT n_nationkey, n_nationkey * 13.0::DOUBLE AS v FROM nation), tops AS (SELECT n_nationkey, CASE WHEN v > 0 THEN (SELECT min(f) FROM (SELECT unnest([1, 1.5, 2, 3, 5, 7.5, 10]::DOUBLE[]) AS f) WHERE f * pow(10, floor(log10(v))) >= v) * pow(10, floor(log10(v))) ELSE 1 END AS top FROM v),
  steps AS (SELECT n_nationkey, top, (SELECT min(f) FROM (SELECT unnest([1, 2, 2.5, 5, 10]::DOUBLE[]) AS f) WHERE f * pow(10, floor(log10(top / 5))) >= top / 5) * pow(10, floor(log10(top / 5))) AS step FROM tops)
  SELECT n_nationkey, round(top, 6) AS top, array_to_string(list_transform(range(0, floor(top / step)::BIGINT + 1), lambda k: printf('%.4f', k * step)), ' ') AS ticks FROM steps""")  # fmt: skip
def axis_ticks(s, d):
    """Axis maxima and ticks."""
    top = scalars.nice_max(F.col("n_nationkey").cast("double") * 13)
    shown = F.array_join(F.transform(scalars.nice_ticks(top), lambda x: F.format_string("%.4f", x)), " ")
    return rounded(t.table(s, d, "nation").select("n_nationkey", top.alias("top"), shown.alias("ticks")))


# ---- exports


def _export(s, d) -> DataFrame:
    return _roles(s, d).withColumns({"sufficiency": F.lit("PRELIMINARY"), "comments": F.col("n_comments")})


@query("+ " + _SCORES + _Z + " SELECT sha256('salt' || vk_id) AS author_hash, printf('%.4f', aud::DOUBLE) AS aud, top_vol::VARCHAR AS top_vol, role FROM rolled", "apc")
def safe_export(s, d):
    """Rows of a safe export."""
    return store.safe_rows(_export(s, d), b"salt").select("author_hash", "aud", "top_vol", "role")


@query("+ " + _SCORES + _Z + " SELECT vk_id::VARCHAR AS vk_id, first_name AS author_name, printf('%.4f', aud::DOUBLE) AS aud, role FROM rolled JOIN (SELECT vk_id, first_name FROM authors) USING (vk_id)", "apc")
def raw_export(s, d):
    """Rows of a raw export (K2)."""
    names = t.authors(s, d).select("vk_id", F.col("first_name").alias("author_name"))
    return store.raw_rows(_export(s, d).join(names, "vk_id")).select("vk_id", "author_name", "aud", "role")


_JSON = " || ',' || chr(10) || ".join(
    f"""'    "{c}" : "' || """ + {"sufficiency": "'PRELIMINARY'", "comments": "n_comments", "role": "role", "top_vol": "top_vol", "topic_posts": "topic_posts"}.get(c, f"printf('%.4f', round({c}::DOUBLE, 4))") + """ || '"'"""
    for c in store.EXPORT_COLUMNS
)


@query("+ " + _SCORES + _Z + """, rows AS (SELECT sha256('salt' || vk_id) AS h, '{' || chr(10) || '    "authorHash" : "' || sha256('salt' || vk_id) || '",' || chr(10) || """ + _JSON + """ || chr(10) || '  }' AS row FROM rolled)
  SELECT array_to_string(['{', '  "schemaVersion" : "2.0",', '  "sessionId" : 1,', '  "sessionName" : "Session #1",', '  "privacyMode" : "HASHED",', '  "scores" : [ ' || string_agg(row, ', ' ORDER BY h) || ' ]', '}'], chr(10)) AS document FROM rows""", "apc")  # fmt: skip
def json_export(s, d):
    """A session's scores as one JSON document (K4)."""
    return store.json_document(_export(s, d), 1, "name", b"salt")


@query(SQL["json_export"].replace(" SELECT array_to_string(['{',", ", doc AS (SELECT array_to_string(['{',", 1).replace("AS document FROM rows", "AS document FROM rows)", 1)
       + " SELECT line, count(*) AS n FROM (SELECT unnest(string_split(document, chr(10))) AS line FROM doc) GROUP BY 1")
def json_export_lines(s, d):
    """A session's scores written as one JSON document in parts, read again by lines (K4)."""
    path = new_path(s, "export")
    store.export_json(_export(s, d), path, 1, "name", b"salt")
    return s.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("+ " + _SCORES + _Z + " SELECT sha256('salt' || vk_id) AS author_hash, role FROM rolled", "apc")
def export_gate(s, d):
    """Rows of an export for which raw mode was asked for, but not confirmed (K5)."""
    return store.export_rows(_export(s, d), raw=True, salt=b"salt").select("author_hash", "role")


# ---- stored rows


@query("SELECT id, from_id FROM posts WHERE from_id % 5 = 2", "p")
def session_scan(s, d):
    """Posts of one session in time order."""
    return store.session_rows(t.posts(s, d).withColumn("session_id", F.col("from_id") % 5), 2).select("id", "from_id")


@query("SELECT conv_id, turn FROM conversations WHERE sha256(text) IN (SELECT sha256(text) FROM conversations WHERE role = 'user' AND turn = 0)")
def hash_lookup(s, d):
    """Rows whose text's hash is in a list."""
    rows = t.table(s, d, "conversations").withColumn("text_hash", text.text_hash(F.col("text")))
    return store.with_hashes(rows, rows.where("role = 'user' and turn = 0")).select("conv_id", "turn")


@query("SELECT c_custkey AS author_id, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END::DOUBLE AS score FROM customer UNION ALL SELECT 10000000 + s_suppkey, -1.0 FROM supplier")
def score_upsert(s, d):
    """Scores, replaced where new ones are there (K6)."""
    old = t.table(s, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_acctbal").cast("double").alias("score"))
    new = old.where("author_id % 3 = 0").select("author_id").unionByName(t.table(s, d, "supplier").select((10_000_000 + F.col("s_suppkey")).alias("author_id")))
    return store.upsert(old, new.withColumn("score", F.lit(-1.0)), ["author_id"])


@query("SELECT id, CASE WHEN k > 50 THEN true ELSE relevant END AS relevant, CASE WHEN k > 50 THEN NULL ELSE vote END AS vote FROM posts", "p")
def column_update(s, d):
    """Posts with columns set where a condition holds (K8)."""
    return store.update(t.posts(s, d), F.col("k") > 50, relevant=F.lit(True), vote=F.lit(None)).select("id", "relevant", "vote")


@query("""SELECT * FROM (VALUES (1, 'one', 'a' || chr(10) || 'b', NULL, 30, NULL), (2, 'two', 'a' || chr(10) || 'b', NULL, 30, 1)) v(id, name, primary_ngrams, excluded_ngrams, current_days, session_family_id)""")
def session_fork(s, d):
    """A new session, and one that goes on from it."""
    one = store.new_session(s, {"id": 1, "name": "one", "current_days": 30}, {"primary_ngrams": ["a ", "", "b"], "excluded_ngrams": [" "]})
    return one.unionByName(store.fork_session(one, 2, name="two")).select("id", "name", "primary_ngrams", "excluded_ngrams", "current_days", "session_family_id")


@query("SELECT c_custkey AS id, c_acctbal::DOUBLE AS created FROM customer ORDER BY floor(c_acctbal) DESC, c_custkey DESC LIMIT 25")
def newest_sessions(s, d):
    """The first 25 sessions, newest first."""
    rows = t.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("created"), F.timestamp_seconds(F.floor("c_acctbal")).alias("created_at"))
    return views.newest_sessions(rows).limit(25).select("id", "created")


@query("""SELECT o_orderkey::INTEGER AS vk_id, o_custkey::INTEGER AS from_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS text FROM orders""")
def import_documents(s, d):
    """Posts of dataset documents, one document an order, with keys that no record has."""
    post = F.struct(F.col("o_orderkey").alias("vkId"), F.col("o_custkey").alias("fromId"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("text"), F.lit(1).alias("unknown"))
    made = t.table(s, d, "orders").select(F.to_json(F.struct(F.array(post).alias("posts"), F.lit("x").alias("other"))).alias("document"))
    return importer.parse_import(made, "document")["posts"].select(F.col("vkId").alias("vk_id"), F.col("fromId").alias("from_id"), "text")


@query("""SELECT o_orderkey::INTEGER AS vk_id, o_custkey::INTEGER AS from_id, o_orderstatus || ' }], "posts": [{' || chr(10) || '\\"' AS text FROM orders""")
def import_files(s, d):
    """Posts of dataset files, one document for up to 1,000 orders, read in byte ranges."""
    text_of = F.concat("o_orderstatus", F.lit(' }], "posts": [{\n\\"'))
    post = F.struct(F.col("o_orderkey").alias("vkId"), F.col("o_custkey").alias("fromId"), text_of.alias("text"), F.array(F.struct(F.lit("}").alias("posts"))).alias("more"))
    made = t.table(s, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("g")).agg(F.to_json(F.struct(F.lit("1}").alias("version"), F.collect_list(post).alias("posts"))).alias("value"))
    path = new_path(s, "files")
    made.select("value").write.text(path)
    return importer.read_import(s, path)["posts"].select(F.col("vkId").alias("vk_id"), F.col("fromId").alias("from_id"), "text")


@query("+ " + _TOKENS + """, lem AS (SELECT id, CASE WHEN id % 2 = 0 THEN ['kept', 'é"\\'] ELSE list_transform(w, lambda x: lower(x)) END AS l FROM tokens) SELECT id, len(l)::INTEGER AS n, l[1] AS first, l[-1] AS last FROM lem""", "x")
def processed_text_join(s, d):
    """Lemmas of processed texts, which are stored as JSON, or computed ones."""
    kept = F.array(F.lit("kept"), F.lit('é"\\'))
    processed = t.texts(s, d).where("id % 2 = 0").select(F.col("id").alias("post_id"), text.encode_list(kept).alias("lemmas"))
    found = topic.with_processed(_tokens(s, d), processed, F.transform("tokens", F.lower))
    return found.select("id", F.size("lemmas").alias("n"), F.get("lemmas", F.lit(0)).alias("first"), F.try_element_at("lemmas", F.lit(-1)).alias("last"))


@query("SELECT id, '{\"long\":' || (k > 50) || ',\"voted\":' || (vote IS NOT NULL) || '}' AS gates FROM posts", "p")
def gates_json(s, d):
    """Named conditions as JSON."""
    return t.posts(s, d).select("id", text.gates_json({"voted": F.col("vote").isNotNull(), "long": F.col("k") > 50}).alias("gates"))


@query("+ " + _SCORES + _Z + " SELECT vk_id, role FROM rolled WHERE contains(lower(role), 'giant')", "apc")
def role_filter(s, d):
    """Authors whose role holds some text."""
    return views.by_role(_roles(s, d), "Giant").select("vk_id", "role")


@query("SELECT doc_id AS id, CASE WHEN lang = 'de' AND doc_id % 10 >= 5 THEN 'OK' WHEN lang = 'de' THEN 'UNCERTAIN' ELSE 'FILTERED_OUT' END AS status FROM documents")
def model_language(s, d):
    """Statuses by a language that a model detected."""
    status = text.model_language_status(F.coalesce("lang", F.lit("")), (F.col("doc_id") % 10) / 10, "de")
    return t.table(s, d, "documents").select(F.col("doc_id").alias("id"), status.alias("status"))


@query("SELECT vk_id, greatest(0, date_diff('second', first_seen_at, TIMESTAMP '2024-01-31') // 86400) AS days FROM authors", "a")
def age_days(s, d):
    """Authors' ages in whole days."""
    return t.authors(s, d).select("vk_id", scalars.age_days(F.col("first_seen_at"), t.as_of()).alias("days"))


@query("SELECT id, CASE originality WHEN 'ORIGINAL' THEN 1.0 WHEN 'REPOST_WITH_COMMENT' THEN 0.5 WHEN 'MEDIA_ONLY' THEN 0.25 ELSE 0.0 END::DOUBLE AS weight FROM (" + SQL["originality"].replace("WITH ", "WITH ", 1) + ")")
def originality_weights(s, d):
    """Weights of originality kinds."""
    return originality(s, d).select("id", dedup.originality_weight(F.col("originality")).alias("weight"))


@query("SELECT '# Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def markdown_report(s, d):
    """A Markdown report (Q8)."""
    return quality.report(t.table(s, d, "region").select("r_regionkey", "r_name"), "Regions", ["r_regionkey"])


# ---- models, with doubles that rules stand for


@query("""WITH c AS (SELECT conv_id, turn, left(coalesce(text, ''), 2000) AS t FROM conversations), s AS (SELECT *, length(t) % 7 AS p, (length(t) - length(replace(t, 'e', ''))) % 5 AS q FROM c)
  SELECT conv_id, turn, CASE WHEN p >= q AND p >= 10 - p - q THEN 'positive' WHEN 10 - p - q >= q THEN 'neutral' ELSE 'negative' END AS label, p / 10.0::DOUBLE AS positive, q / 10.0::DOUBLE AS negative FROM s""")  # fmt: skip
def model_sentiment(s, d):
    """Distributions of a sentiment model."""
    rows = sentiment.select_service(True, lambda df: models.sentiment(df, doubles.sentiment), lambda df: df)(t.table(s, d, "conversations"))
    return rows.select("conv_id", "turn", "sentiment.label", "sentiment.positive", "sentiment.negative")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'NEUTRAL' ELSE role END AS label, CASE WHEN conv_id % 2 = 0 THEN 'fallback_error' ELSE 'model' END AS method FROM conversations")
def batch_failures(s, d):
    """Labels where a model's batches failed, without a model in its place."""
    local = lambda df: df.withColumn("r", sentiment.fallback_label(F.col("role"), F.col("conv_id") % 2 == 0))
    return sentiment.select_service(False, lambda df: 1 / 0, local)(t.table(s, d, "conversations")).select("conv_id", "turn", "r.label", "r.method")


@query(r"SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), 's$', '')), ' ') AS lemmas FROM conversations")
def model_lemmas(s, d):
    """Normal forms of words."""
    found = models.lemmas(t.table(s, d, "conversations").select("conv_id", "turn", "text"), doubles.parses)
    return found.select("conv_id", "turn", F.array_join("lemmas", " ").alias("lemmas"))


@query("""WITH v AS (SELECT conv_id, turn, length(text)::DOUBLE AS a, 1.0::DOUBLE AS b, lead(length(text)) OVER w::DOUBLE AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, round((a * c + b) / sqrt((a * a + b) * (c * c + b)), 3) AS similarity FROM v WHERE c IS NOT NULL""")  # fmt: skip
def model_similarity(s, d):
    """Cosines of the vectors of a turn and the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t.table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b is not null")
    return rounded(models.similarity(pairs, doubles.vectors).select("conv_id", "turn", "similarity"), 3)


@query(r"SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'))::INTEGER AS n, regexp_extract(coalesce(text, ''), '[A-Z][a-z]+') AS first, CASE WHEN contains(text, 'e') THEN 'xx' ELSE 'unknown' END AS language FROM conversations")
def model_entities(s, d):
    """Named entities and languages."""
    found = models.language(models.entities(t.table(s, d, "conversations"), doubles.entities), doubles.language)
    return found.select("conv_id", "turn", F.size("entities").alias("n"), F.coalesce(F.get("entities", F.lit(0))["text"], F.lit("")).alias("first"), "language.language")
