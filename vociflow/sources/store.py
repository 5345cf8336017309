"""Stored tables and exports: partitioned upserts, soft deletes, logs, checkpoints, safe and raw exports."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vociflow.functions.text import salted_hash
from vociflow.stage import number_rows, stage_table

# Columns of the exports, in order.
EXPORT_COLUMNS = (
    "aud", "age", "er_bg", "top_vol", "top_focus", "reach", "pos_positive", "pos_negative", "er_top", "resp_positive", "resp_negative",
    "role", "sufficiency", "topic_posts", "comments",
)
NOT_FLOAT = {"top_vol", "role", "sufficiency", "topic_posts", "comments"}


def write_session(df: DataFrame, path: str, partition: str = "session_id") -> None:
    """Replace the rows of the sessions in df, and leave others as they are (K6, K8)."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition).parquet(path)


def scan_session(spark: SparkSession, path: str, session_id: int) -> DataFrame:
    """Rows of one session: other partitions are pruned."""
    return spark.read.parquet(path).where(F.col("session_id") == session_id)


def session_rows(df: DataFrame, session_id: int) -> DataFrame:
    """Rows of one session in time order."""
    return df.where(F.col("session_id") == session_id).orderBy("published_at", "id")


def by_author(posts: DataFrame, author: int) -> DataFrame:
    """One author's posts, newest first."""
    return posts.where(F.col("from_id") == author).orderBy(F.desc("published_at"), "id")


def by_window(posts: DataFrame, window: str) -> DataFrame:
    """Posts of one window."""
    return posts.where(F.col("window") == window)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with given values of key columns."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def alive(df: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return df.where("deleted_at is null")


def deleted(df: DataFrame) -> DataFrame:
    """Deleted rows, the last deleted first."""
    return df.where("deleted_at is not null").orderBy(F.desc("deleted_at"))


def soft_delete(df: DataFrame, condition: Column, as_of: Column) -> DataFrame:
    """The rows with those that meet the condition marked as deleted (K9)."""
    return df.withColumn("deleted_at", F.when(condition, F.coalesce("deleted_at", as_of)).otherwise(F.col("deleted_at")))


def restore(df: DataFrame, condition: Column) -> DataFrame:
    """The rows with those that meet the condition no longer deleted (K9)."""
    return df.withColumn("deleted_at", F.when(~condition, F.col("deleted_at")))


def hard_delete(df: DataFrame, condition: Column) -> DataFrame:
    """The rows without those that meet the condition (K9)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def with_hashes(df: DataFrame, wanted: DataFrame, key: str = "text_hash") -> DataFrame:
    """Rows whose key is in a list (S11): a semi join instead of a long IN."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The existing rows without those whose keys are new, and the new rows (K6)."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """df with columns set where a condition holds (K8)."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def append_log(df: DataFrame, path: str) -> None:
    """Append events, metrics or checkpoints."""
    df.write.mode("append").parquet(path)


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The latest checkpoint of each session with status CHECKPOINTED."""
    rows = checkpoints.where("status = 'CHECKPOINTED'")
    return rows.groupBy("session_id").agg(F.max_by("checkpoint", F.struct("updated_at", "checkpoint")).alias("checkpoint"), F.max("updated_at").alias("updated_at"))


def new_session(spark: SparkSession, row: dict, ngram_lists: dict[str, list[str]]) -> DataFrame:
    """A session row; n-gram lists are joined by line ends, and empty ones are null."""
    lists = {k: "\n".join(x.strip() for x in v if x.strip()) or None for k, v in ngram_lists.items()}
    from vociflow.schemas import SESSION

    names = [c.strip().split()[0] for c in SESSION.replace("\n", " ").split(",")]
    whole = row | lists
    return spark.createDataFrame([tuple(whole.get(n) for n in names)], SESSION)


def fork_session(session: DataFrame, new_id: int, **changes) -> DataFrame:
    """A copy of a session that names its source as family."""
    out = session.withColumns({"session_family_id": F.coalesce("session_family_id", "id"), "id": F.lit(new_id)})
    return out.withColumns({k: F.lit(v) for k, v in changes.items()}) if changes else out


def number(c: str) -> Column:
    """A float with four decimals; null is empty (K3).

    It is rounded as a double, like SQL's round(x, 4): 0.02175 times 10,000 is below 217.5, so that it gives 0.0217, where
    its shortest decimal form would go up.
    """
    if c in NOT_FLOAT:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    value = F.col(c).cast("double")
    size = F.round(F.abs(value) * 1e4) / 1e4
    return F.coalesce(F.format_string("%.4f", F.when(value < 0, -size).otherwise(size)), F.lit(""))


def _plain(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(number(c)).alias(c)


def safe_rows(rows: DataFrame, salt: bytes) -> DataFrame:
    """Rows for a safe export: a salted hash instead of the author's id (K1)."""
    return rows.select(salted_hash(F.col("vk_id"), salt).alias("author_hash"), *[_plain(c) for c in EXPORT_COLUMNS])


def raw_rows(rows: DataFrame) -> DataFrame:
    """Rows for an export with ids and names (K2)."""
    return rows.select(F.col("vk_id").cast("string").alias("vk_id"), F.col("author_name"), *[_plain(c) for c in EXPORT_COLUMNS])


def json_document(rows: DataFrame, session_id: int, name: str, salt: bytes, raw: bool = False) -> DataFrame:
    """One JSON document with all scores of a session (K4): a report of one session's authors, not for large ones."""
    of = safe_rows(rows, salt).select(F.struct(F.col("author_hash").alias("authorHash"), *[F.col(c) for c in EXPORT_COLUMNS]).alias("s"))
    scores = of.agg(F.sort_array(F.collect_list("s")).alias("scores"))
    head = [F.lit("2.0").alias("schemaVersion"), F.lit(session_id).alias("sessionId"), F.lit(name if raw else f"Session #{session_id}").alias("sessionName"), F.lit("RAW" if raw else "HASHED").alias("privacyMode")]
    return scores.select(F.to_json(F.struct(*head, "scores"), {"pretty": "true"}).alias("document"))


def export_json(rows: DataFrame, path: str, session_id: int, name: str, salt: bytes, raw: bool = False) -> None:
    """Write the document of json_document to a folder, in parts that make it up in the order of their names (K4).

    Records are numbered in their order and written by many tasks; the first part has the head, the last one the foot.
    """
    of = safe_rows(rows, salt).withColumnRenamed("author_hash", "authorHash")
    of = stage_table(of.select("authorHash", *EXPORT_COLUMNS), "export")
    n = of.count()
    placed = number_rows(of, [F.col(c) for c in of.columns], n)
    fields = [F.concat(F.lit(f'    "{c}" : '), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)) for c in of.columns]
    record = F.concat(F.when(F.col("position") == 0, "").otherwise("  }, {\n"), F.array_join(F.array(*fields), ",\n"))
    quoted = json.dumps(name if raw else f"Session #{session_id}", ensure_ascii=False)
    head = ["{", '  "schemaVersion" : "2.0",', f'  "sessionId" : {session_id},', f'  "sessionName" : {quoted},', f'  "privacyMode" : "{"RAW" if raw else "HASHED"}",', f'  "scores" : [ {"{" if n else "]"}']
    ends = [(-1, "\n".join(head)), (n, "  } ]\n}" if n else "}")]
    lines = placed.select(F.col("position").cast("long").alias("position"), record.alias("value")).unionByName(rows.sparkSession.createDataFrame(ends, "position long, value string"))
    lines.orderBy("position").select("value").write.text(path)


def export_rows(rows: DataFrame, raw: bool = False, confirmed: bool = False, salt: bytes | None = None) -> DataFrame:
    """Rows of an export (K5): raw only if it is both asked for and confirmed."""
    return raw_rows(rows) if raw and confirmed else safe_rows(rows, salt or os.urandom(16))


def export_csv(rows: DataFrame, path: str, raw: bool = False, confirmed: bool = False, salt: bytes | None = None) -> None:
    """Write a CSV export (K1, K2, K5). Values are quoted where needed."""
    export_rows(rows, raw, confirmed, salt).write.option("header", True).csv(path)


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first rows in an order."""
    return df.orderBy(*order).limit(n)


def running_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in time order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")
