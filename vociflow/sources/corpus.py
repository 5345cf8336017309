"""Resource lists (S12), the corpus with ground truth (S24) and its generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vociflow import schemas
from vociflow.sources.json_records import read_arrays, records
from vociflow.stage import stage_table


def read_words(spark: SparkSession, path: str) -> list[str]:
    """Words of a list: trimmed, in lower case, without blank lines and comments (S12). Lists are a few thousand words."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> '' and not startswith(w, '#')")
    return sorted({r["w"] for r in rows.collect()})


def read_lexicon(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Positive and negative words of a JSON lexicon."""
    row = spark.read.schema("version string, positive array<string>, negative array<string>").option("multiLine", True).json(path).first()
    return [w.lower() for w in row["positive"] or []], [w.lower() for w in row["negative"] or []]


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Authors, posts, roles and anomalies of a ground-truth corpus, read in byte ranges."""
    arrays = stage_table(read_arrays(spark, path), "corpus")
    kinds = {f.name: f.dataType.elementType.simpleString() for f in StructType.fromDDL(schemas.CORPUS) if isinstance(f.dataType, ArrayType)}
    names = {"authors": "authors", "posts": "posts", "roles": "ground_truth_roles", "anomalies": "ground_truth_anomalies"}
    return {k: records(arrays, c, kinds[c]).drop("position") for k, c in names.items()}


def violations(authors: DataFrame, posts: DataFrame, roles: DataFrame) -> DataFrame:
    """What is wrong with a corpus (S24, U5): rows (rule, id). Ids are null for rules on a whole table."""
    known = authors.select(F.col("id").alias("a"))
    empty = lambda df, rule: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(rule).alias("rule"), F.lit(None).cast("long").alias("id"))
    lost = posts.join(known, posts["from_id"] == known["a"], "left_anti").select(F.lit("UNKNOWN_AUTHOR").alias("rule"), F.col("id").cast("long").alias("id"))
    bare = posts.where("ground_truth is null").select(F.lit("NO_GROUND_TRUTH").alias("rule"), F.col("id").cast("long").alias("id"))
    roleless = roles.join(known, roles["author_id"] == known["a"], "left_anti").select(F.lit("ROLE_OF_UNKNOWN").alias("rule"), F.col("author_id").cast("long").alias("id"))
    return empty(posts, "NO_POSTS").unionByName(empty(authors, "NO_AUTHORS")).unionByName(lost).unionByName(bare).unionByName(roleless)


#: Texts of generated posts: on the topic, and others.
TOPIC_TEXTS = ("The river is polluted again", "Clean air for the city", "The plant must be closed", "Waste sorting works well", "Trees were cut in the park")
OTHER_TEXTS = ("Football tonight", "Rain all day", "Reading a good book", "The concert was great")


def generate_posts(spark: SparkSession, posts: int = 500, authors: int = 50) -> DataFrame:
    """Posts of a synthetic corpus, by modular arithmetic on their number."""
    i = F.col("i")
    topical = F.pmod(i, F.lit(5)) <= 1
    pick = lambda texts: F.get(F.array(*map(F.lit, texts)), F.pmod(i - 1, F.lit(len(texts))).cast("int"))
    text = F.when(topical, pick(TOPIC_TEXTS)).otherwise(pick(OTHER_TEXTS))
    kind = F.when(i % 20 == 0, "DETECTED_COPY").when(i % 10 == 0, "PURE_REPOST").when(i % 7 == 0, "REPOST_WITH_COMMENT").otherwise("ORIGINAL")
    mood = F.get(F.array(*map(F.lit, ("POSITIVE", "NEGATIVE", "NEUTRAL"))), ((i - 1) % 3).cast("int"))
    return spark.range(1, posts + 1).withColumnRenamed("id", "i").select(
        (1000 + i).cast("int").alias("id"), ((i - 1) % authors + 1).cast("int").alias("from_id"), (1717196400 + F.floor((i - 1) / 8) % 60 * 86400).alias("published_at"), text.alias("text_clean"),
        (5 + i % 100).cast("int").alias("likes"), (i % 30).cast("int").alias("reposts"), (1 + i % 20).cast("int").alias("comments"), F.length(text).alias("own_text_length"),
        (i % 10 == 0).alias("has_copy_history"), (i % 3 == 0).alias("contains_media"),
        F.struct(topical.alias("is_topic_relevant"), mood.alias("sentiment"), kind.alias("originality_type")).alias("ground_truth"),
    )


def generate_authors(spark: SparkSession, authors: int = 50) -> DataFrame:
    """Authors of a synthetic corpus."""
    i = F.col("i")
    return spark.range(1, authors + 1).withColumnRenamed("id", "i").select(
        i.cast("int").alias("id"), F.format_string("hash_%04d", i).alias("vk_id_hashed"), (100 + i * i * 20).cast("int").alias("followers_count"),
        (i % 10 == 0).alias("is_closed"), F.when(i <= 30, "SEED").otherwise("DISCOVERY").alias("discovery_source"),
    )
