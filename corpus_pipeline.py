"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() applies them to documents and
writes each stage's result to the shared folder, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vociflow.llm import decontam, jaccard, langid, packing, quality
from vociflow.llm.common import crc_fold, stage_table, table

#: Near duplicates: words of a shingle, and a similarity of 80 in 100.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Share of the shingle space in which large documents look for partners first.
SHARE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, on hosts that pass them."""
    return quality.keep_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; it is learnt from the lang column of two thirds of the documents at hand."""
    langs, prototypes = langid.learn_prototypes(docs.where(crc_fold(F.col("doc_id"), 3) != 1))
    return langid.keep_known_languages(docs, langs, prototypes)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return jaccard.drop_linked(docs, SHINGLE_WORDS, *SIMILARITY, share=SHARE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express language profiles and tokenizing; a test holds every stage of a run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: all stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
