"""The staged analysis: each stage is a function of named DataFrames, composed lazily.

Results that are expensive or drawn at random (lemmas, scores, intervals) are materialised by the caller's function,
so that later stages read them instead of computing them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.functions import text
from vociflow.operators import bootstrap, dedup, quality, robust, scores, sentiment, topic
from vociflow.params import DEFAULT, Params

Frames = dict[str, DataFrame]


@dataclass
class Run:
    """What a run is made with: n-grams, reference vectors, time, parameters and a way to materialise a result."""

    as_of: Column
    primary: list[list[str]]
    secondary: list[list[str]]
    excluded: list[list[str]]
    params: Params = DEFAULT
    seed: int = 42
    semantic: Column | None = None
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df


def preprocess(f: Frames, run: Run) -> Frames:
    """Clean texts, tokens, lemmas without stop words, and sentiment of CURRENT posts and of comments."""
    lexicon = run.params.lexicon
    posts = f["posts"].withColumn("__c", text.cleaned(F.col("text"), run.params)).select("*", "__c.clean_text").drop("__c")
    posts = posts.withColumn("own_text_length", F.length("clean_text")).withColumn("tokens", text.tokenize(F.col("clean_text")))
    lemmas = F.transform(text.without_stop_words(F.col("tokens"), lexicon.stop_words), F.lower)
    spoken = (F.col("window") == "CURRENT") & F.col("text").rlike(r"\S")
    posts = posts.withColumns({"lemmas": lemmas, "label": F.when(spoken, sentiment.by_dictionary(F.col("tokens"), lexicon, run.params)["label"])})
    comments = f["comments"].withColumn("comment_label", F.when(F.col("text").rlike(r"\S"), sentiment.local_service(F.col("text"), lexicon, run.params)["label"]))
    return f | {"posts": run.keep(posts, "lemmas"), "comments": run.keep(comments, "comment_sentiment")}


def filter_topic(f: Frames, run: Run) -> Frames:
    """Topic decisions, then duplicates and originality; copies still count in the scores."""
    semantic = run.semantic if run.semantic is not None else F.lit(None).cast("double")
    scored = topic.score_posts(f["posts"].drop("relevant"), run.primary, run.secondary, run.excluded, semantic, run.semantic is not None)
    if "votes" in f:
        scored = topic.apply_votes(scored.join(f["votes"], "id", "left"))
    once = dedup.first_seen(scored)
    exact = dedup.exact_edges(once, run.params)
    near = dedup.near_edges(once, exact, run.params)
    edges = exact.select("canonical_id", "duplicate_id", "similarity", "method").unionByName(near)
    edges = run.keep(edges, "edges")
    return f | {"posts": run.keep(dedup.mark_copies(scored, edges), "posts"), "edges": edges, "topic_summary": topic.summary(scored)}


def score(f: Frames, run: Run) -> Frames:
    """The eleven scores, in single precision as they are stored."""
    found = scores.author_scores(f["authors"], f["posts"], f["comments"], run.as_of)
    stored = found.withColumns({c: F.col(c).cast("float") for c, k in found.dtypes if k == "double"})
    return f | {"scores": run.keep(stored, "scores")}


def infer(f: Frames, run: Run) -> Frames:
    """Intervals of all scores."""
    p = run.params
    samples = bootstrap.score_samples(f["authors"].where("not is_closed"), f["posts"], f["comments"])
    return f | {"intervals": run.keep(bootstrap.intervals(samples, p.bootstrap, p.bootstrap_outer, p.bootstrap_inner, run.seed), "intervals")}


def compose(f: Frames, run: Run) -> Frames:
    """Composites, thresholds and roles."""
    doubles = f["scores"].withColumns({c: F.col(c).cast("double") for c, k in f["scores"].dtypes if k == "float"})
    return f | {"roles": run.keep(robust.assign_roles(doubles), "roles")}


def check(f: Frames, run: Run) -> Frames:
    """Sufficiency of each author, the session's indicators and overall quality."""
    width = bootstrap.mean_width(f["intervals"]).withColumnRenamed("author_id", "vk_id")
    judged = f["scores"].join(width, "vk_id", "left").select("vk_id", "ci_width", quality.sufficiency(F.col("topic_posts"), F.col("n_comments"), F.col("ci_width"), run.params).alias("sufficiency"))
    judged = run.keep(judged, "sufficiency")
    methods = f["posts"].where("label is not null").select(F.lit("DICTIONARY").alias("method"))
    inputs = quality.quality_inputs(f["posts"], f["comments"], f["authors"], methods, judged, run.params, semantic=run.semantic is not None)
    found = run.keep(quality.indicators(inputs), "indicators")
    return f | {"sufficiency": judged, "indicators": found, "quality": quality.overall(found)}


#: Stages in order.
STAGES = (("PREPROCESSING", preprocess), ("TOPIC_FILTERING", filter_topic), ("SCORING", score), ("BOOTSTRAP", infer), ("COMPOSITE_ROLES", compose), ("QUALITY_CHECK", check))


def analyse(frames: Frames, run: Run) -> Frames:
    """All stages over authors, posts and comments."""
    for _, stage in STAGES:
        frames = stage(frames, run)
    return frames
