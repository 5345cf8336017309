"""The driver's tables as authors, posts, comments and texts, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vociflow.params import Params

#: The time that ages and windows are counted from; windows of 10 and 20 days.
AS_OF = "2024-01-31 00:00:00"
PARAMS = Params(current_days=10, baseline_days=20)


def as_of():
    """The time that ages and windows are counted from."""
    return F.lit(AS_OF).cast("timestamp")


#: Bytes up to which a table of texts is dealt to all cores; larger ones are read in the splits of their files.
SMALL_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a small table of texts, which may be one row group, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "pages") or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as authors."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("vk_id"), F.col("c_name").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        F.floor(F.abs("c_acctbal")).cast("int").alias("followers"), (F.col("c_custkey") % 10 == 0).alias("is_closed"), F.col("c_nationkey").alias("community_id"),
        (as_of() - F.make_dt_interval((F.col("c_custkey") % 1000).cast("int"))).alias("first_seen_at"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: relevance is unknown for errors, and a quarter have no sentiment label."""
    from vociflow.functions.scalars import window_name

    value, kind, i = F.floor("value").cast("int"), F.col("event_type"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(i % 4 == 0, "POSITIVE").when(i % 4 == 1, "NEGATIVE").when(i % 4 == 2, "NEUTRAL")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), (i % 997).alias("vk_post"), F.col("user_id").alias("from_id"), F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("published_at"),
        F.when(kind == "view", value).alias("views"), (value % 50).alias("likes"), (value % 7).alias("reposts"), (value % 11).alias("comments"),
        F.when(kind != "error", kind.isin("purchase", "view")).alias("relevant"), window_name(F.col("ts").cast("timestamp"), as_of(), PARAMS).alias("window"),
        label.alias("label"), F.when(i % 3 != 0, k / 100.0).alias("p_positive"), F.when(i % 3 != 0, (100 - k) / 200.0).alias("p_neutral"), F.when(i % 3 != 0, (100 - k) / 200.0).alias("p_negative"),
        k.alias("k"), (k * 5).alias("own_text_length"), (k % 10 == 0).alias("has_copy_history"), (k % 3 == 0).alias("contains_media"),
        F.when(i % 5 != 0, k / 100.0).alias("combined"), F.when(i % 7 == 0, True).when(i % 7 == 1, False).alias("vote"), kind.alias("event_type"), "props",
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as comments on the posts with the order's number."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    label = F.when(flag == "R", "NEGATIVE").when(flag == "A", "POSITIVE").when(line % 2 == 1, "NEUTRAL")
    some = lambda c: F.when(line != 7, c)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("id"), F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("from_id"), label.alias("comment_label"),
        some(F.col("l_discount") * 5).alias("p_positive"), some(1 - F.col("l_discount") * 5 - F.col("l_tax") * 5).alias("p_neutral"), some(F.col("l_tax") * 5).alias("p_negative"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts with texts, one an hour."""
    from vociflow.functions.text import clean

    ts = F.timestamp_seconds(F.col("doc_id") * 3600)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", "source", ts.alias("published_at"), clean(F.col("text")).alias("clean_text"), F.length("text").alias("own_text_length"), F.lit(True).alias("relevant")
    )


#: The same relations as SQL, to stand before a query.
SQL_AUTHORS = """authors AS (SELECT c_custkey AS vk_id, c_name AS first_name, CAST(floor(abs(c_acctbal)) AS INTEGER) AS followers, c_custkey % 10 = 0 AS is_closed,
  c_nationkey AS community_id, TIMESTAMP '2024-01-31' - to_days(CAST(c_custkey % 1000 AS INTEGER)) AS first_seen_at FROM customer)"""
SQL_POSTS = """posts AS (SELECT event_id AS id, event_id % 997 AS vk_post, user_id AS from_id, user_id AS owner_id, ts AS published_at, CASE WHEN event_type = 'view' THEN v END AS views,
  v % 50 AS likes, v % 7 AS reposts, v % 11 AS comments, CASE WHEN event_type <> 'error' THEN event_type IN ('purchase', 'view') END AS relevant,
  CASE WHEN ts <= TIMESTAMP '2024-01-31' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-21' THEN 'CURRENT' WHEN date_trunc('second', ts) >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' THEN 'BASELINE' END AS "window",
  CASE event_id % 4 WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'NEUTRAL' END AS label,
  CASE WHEN event_id % 3 <> 0 THEN k / 100.0 END AS p_positive, CASE WHEN event_id % 3 <> 0 THEN (100 - k) / 200.0 END AS p_neutral, CASE WHEN event_id % 3 <> 0 THEN (100 - k) / 200.0 END AS p_negative,
  k, k * 5 AS own_text_length, k % 10 = 0 AS has_copy_history, k % 3 = 0 AS contains_media, CASE WHEN event_id % 5 <> 0 THEN k / 100.0 END AS combined,
  CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS vote, event_type, props
  FROM (SELECT *, CAST(floor(value) AS INTEGER) AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""
SQL_COMMENTS = """comments AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS post_id, l_suppkey AS from_id,
  CASE WHEN l_returnflag = 'R' THEN 'NEGATIVE' WHEN l_returnflag = 'A' THEN 'POSITIVE' WHEN l_linenumber % 2 = 1 THEN 'NEUTRAL' END AS comment_label,
  CASE WHEN l_linenumber <> 7 THEN l_discount * 5 END AS p_positive, CASE WHEN l_linenumber <> 7 THEN 1 - l_discount * 5 - l_tax * 5 END AS p_neutral,
  CASE WHEN l_linenumber <> 7 THEN l_tax * 5 END AS p_negative FROM lineitem)"""
SQL_TEXTS = r"""texts AS (SELECT doc_id AS id, text, lang, source, TIMESTAMP '1970-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published_at,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), 'https?://\S+', '[URL]', 'g'), '\[id\d+\|[^]]*]', '[USER]', 'g'), '@[\w.]+', '[USER]', 'g'),
    '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{200D}\x{20E3}]+', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text,
  length(text) AS own_text_length FROM documents)"""
