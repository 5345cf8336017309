"""The staged analysis end to end, and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from vociflow.params import Lexicon, Params
from vociflow.plans import adapters, pipeline
from vociflow.sources import corpus
from vociflow.streaming import dedup as stream


@pytest.fixture(scope="module")
def result(spark):
    rows = corpus.generate_posts(spark)
    posts = rows.select(
        "id", F.col("id").alias("vk_id"), "from_id", F.col("from_id").alias("owner_id"), F.timestamp_seconds("published_at").alias("published_at"), F.concat("text_clean", F.lit(" and some more words of the same kind")).alias("text"), "likes", "reposts", "comments",
        F.lit(None).cast("int").alias("views"), "has_copy_history", "contains_media", F.when(F.col("id") % 2 == 0, "CURRENT").otherwise("BASELINE").alias("window"),
    )
    authors = corpus.generate_authors(spark).select(F.col("id").alias("vk_id"), F.col("followers_count").alias("followers"), "is_closed", F.lit(None).cast("timestamp").alias("first_seen_at"))
    comments = rows.select((F.col("id") * 10).alias("id"), F.col("id").alias("post_id"), F.lit(1).alias("from_id"), F.lit("works well").alias("text"))
    params = Params(lexicon=Lexicon(positive=("well", "clean"), negative=("polluted",)), bootstrap=50, bootstrap_outer=10, bootstrap_inner=5)
    run = pipeline.Run(adapters.as_of(), [["river"], ["polluted"], ["clean"], ["air"], ["waste"], ["sorting"]], [["city"]], [["football"]], params, keep=lambda df, name: df.cache())
    return pipeline.analyse({"posts": posts, "authors": authors, "comments": comments}, run)


def test_all_results_are_there(result):
    assert result["scores"].count() == result["roles"].count() > 2
    assert {r["role"] for r in result["roles"].collect()} <= {"AUTHORITATIVE", "SLEEPING_GIANT", "TOPIC_DRIVER", "BACKGROUND_AUTHOR"}
    assert result["indicators"].count() == 10
    # without a model the semantic pass is off, which is a primary indicator
    assert result["quality"].first()["overall"] == "FAILED"


def test_copies_are_marked_but_scored(result):
    kinds = {r["originality"]: r["count"] for r in result["posts"].groupBy("originality").count().collect()}
    assert kinds["DETECTED_COPY"] > 0
    topical = result["posts"].where("window = 'CURRENT' and relevant <=> true").count()
    assert result["scores"].agg(F.sum("top_vol")).first()[0] <= topical


def test_stream_drops_repeated_texts(spark, tmp_path):
    rows = spark.createDataFrame([(k, "the same text as before, and long enough" if k % 2 else f"another text number {k}, long enough") for k in range(6)], "id long, text string")
    rows.withColumn("published_at", F.timestamp_seconds(F.col("id") + 1_700_000_000)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, text string, published_at timestamp").parquet(str(tmp_path / "in"))
    query = stream.first_texts(source).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("firsts").count() == 4
    counts = stream.windowed_counts(source.withColumn("from_id", F.lit(1))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert spark.table("counts").first()["n"] == 6
