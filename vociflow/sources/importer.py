"""The JSON import dataset (S1-S5): four record arrays, first-wins upserts and key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vociflow import schemas
from vociflow.sources.json_records import read_arrays, records


def parse_import(documents: DataFrame, column: str) -> dict[str, DataFrame]:
    """The record arrays of dataset documents that lie in a column (S1); unknown keys are ignored."""
    whole = documents.select(F.from_json(column, schemas.IMPORT).alias("d")).select("d.*")
    return {name: whole.select(F.posexplode(name).alias("position", "r")).select("position", "r.*") for name in ("communities", "authors", "posts", "comments")}


def read_import(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The record arrays of a dataset file as DataFrames, read in byte ranges (S1). Unknown keys are ignored; a missing file is an error."""
    arrays = read_arrays(spark, path)
    kinds = {f.name: f.dataType.elementType.simpleString() for f in StructType.fromDDL(schemas.IMPORT)}
    return {name: records(arrays, name, kind) for name, kind in kinds.items()}


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (K7)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The existing rows, and the first new row of each key that they lack."""
    fresh = first_wins(new, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def import_communities(records: DataFrame) -> DataFrame:
    """Community rows with their negative-id convention resolved."""
    rows = first_wins(records, ["vkId"], ["position"])
    return rows.select(F.col("vkId").alias("vk_id"), "name", F.col("screenName").alias("screen_name"), F.col("membersCount").alias("members"), F.coalesce("isClosed", F.lit(False)).alias("is_closed"), "type")


def import_authors(records: DataFrame) -> DataFrame:
    """Author rows; a later record with the same key does not refresh an earlier one (S3)."""
    rows = first_wins(records, ["vkId"], ["position"])
    return rows.select(
        F.col("vkId").alias("vk_id"), F.col("firstName").alias("first_name"), F.col("lastName").alias("last_name"), F.col("screenName").alias("screen_name"),
        F.col("followersCount").alias("followers"), F.coalesce("isClosed", F.lit(False)).alias("is_closed"), F.lit("IMPORT").alias("discovery_source"),
    )


def import_posts(records: DataFrame, session_id: int) -> DataFrame:
    """Post rows, one for each (session, vk_id, owner_id, window)."""
    text, count = F.coalesce("text", F.lit("")), lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = records.select(
        F.lit(session_id).alias("session_id"), "position", F.col("vkId").alias("vk_id"), F.col("ownerId").alias("owner_id"), F.col("fromId").alias("from_id"),
        F.timestamp_seconds("date").alias("published_at"), text.alias("text"), F.length(text).alias("own_text_length"),
        count("likes"), count("reposts"), count("comments"), "views",
        F.coalesce("containsMedia", F.lit(False)).alias("contains_media"), F.coalesce("hasCopyHistory", F.lit(False)).alias("has_copy_history"),
        F.coalesce("window", F.lit("CURRENT")).alias("window"),
    )
    return first_wins(rows, ["session_id", "vk_id", "owner_id", "window"], ["position"]).drop("position")


def import_comments(records: DataFrame, posts: DataFrame, session_id: int) -> DataFrame:
    """Comment rows of known posts (S5, J6): unmatched ones are skipped, blank texts are null, repeated ids are ignored.

    A post that is in both windows takes its comments in the window that sorts last.
    """
    target = posts.groupBy(F.col("vk_id").alias("postVkId"), F.col("owner_id").alias("postOwnerId")).agg(F.max("window").alias("post_window"))
    rows = first_wins(records, ["vkId"], ["position"]).join(target, ["postVkId", "postOwnerId"])
    return rows.select(
        F.lit(session_id).alias("session_id"), F.col("vkId").alias("vk_id"), F.col("postVkId").alias("post_vk_id"), F.col("postOwnerId").alias("post_owner_id"), "post_window",
        F.col("fromId").alias("from_id"), F.timestamp_seconds("date").alias("published_at"), blank_to_null(F.col("text")).alias("text"), F.coalesce("likes", F.lit(0)).alias("likes"),
    )


def blank_to_null(text: Column) -> Column:
    """A text, or null if it holds white space alone."""
    return F.when(text.rlike(r"\S"), text)
