"""Hits of very many n-grams by an inverted index of their rarest words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vociflow.stage import stage_table

#: Posts of a block and bytes of their distinct lemmas, and n-grams in a part of the index, about.
BLOCK, BLOCK_BYTES, PART_GRAMS = 200_000, 32 << 20, 1_000_000
KINDS = ("primary", "secondary", "excluded")


def _bags(grams: DataFrame) -> DataFrame:
    """Each distinct bag of words, and how often it is listed as each kind."""
    bags = grams.select("kind", F.sort_array(F.array_distinct("words")).alias("words")).where("size(words) > 0 and not exists(words, w -> w is null)")
    return stage_table(bags.groupBy("words").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]), "ngrams")


def _by_rarest(words: np.ndarray, sizes: np.ndarray, values: np.ndarray, df: np.ndarray) -> list[tuple]:
    """For each size of bags: where the bags of each rarest word begin, how many there are, their other words as columns, and their values.

    Bags with a word that no post of the block has are left out, as they have no hits there.
    """
    ends = np.cumsum(sizes)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        bags = words[(ends[rows] - size)[:, None] + np.arange(size)]
        found = (df[bags] > 0).all(axis=1)
        rows, bags = rows[found], bags[found]
        rarest = bags[np.arange(len(bags)), df[bags].argmin(axis=1)]
        order = np.argsort(rarest, kind="stable")
        rows, bags, rarest = rows[order], bags[order], rarest[order]
        others = bags[bags != rarest[:, None]].reshape(len(bags), size - 1)
        counts = np.bincount(rarest, minlength=len(df))
        out.append((np.cumsum(counts) - counts, counts, [np.ascontiguousarray(c) for c in others.T], values[rows]))
    return out


def _hits(posts: pa.Table, grams: pa.Table) -> pa.Table:
    """id and the sums of each kind over the bags that lie within a post's lemmas, for a block of posts and a part of the bags."""
    sums = np.zeros((len(posts), len(KINDS)), np.int64)
    if len(posts) and len(grams):
        words = grams["words"].combine_chunks()
        coded = words.flatten().dictionary_encode()
        lemmas = posts["lemmas"].combine_chunks()
        known = pc.index_in(lemmas.flatten(), value_set=coded.dictionary)
        listed = np.asarray(known.is_valid())
        have = np.asarray(known.drop_null())
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lemmas), 0)))
        ends = np.concatenate([[0], np.cumsum(listed)])[np.concatenate([[0], ends])]
        values = np.stack([np.asarray(grams[k]) for k in KINDS], axis=1)
        index = _by_rarest(np.asarray(coded.indices), np.asarray(pc.list_value_length(words)), values, np.bincount(have, minlength=len(coded.dictionary)))
        mark = np.zeros(len(coded.dictionary), bool)
        for post in range(len(posts)):
            mine = have[ends[post] : ends[post + 1]]
            mark[mine] = True
            for starts, counts, others, listed_as in index:
                n = counts[mine]
                at = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
                for column in others:
                    at = at[mark[column[at]]]
                sums[post] += listed_as[at].sum(axis=0)
            mark[mine] = False
    return pa.table({"id": posts["id"], **{k: sums[:, i] for i, k in enumerate(KINDS)}})


def match_many(posts: DataFrame, grams: DataFrame) -> DataFrame:
    """id, primary, secondary and excluded of each post, as functions.text.match gives them, for any number of n-grams.

    posts has unique ids and lemmas (an array of texts), grams has kind (primary, secondary or excluded) and words. Posts
    are dealt to blocks, and each block gets the n-grams; there a post's words look at the n-grams of which they are the
    block's rarest word, so that neither words nor candidates are shuffled. Very many n-grams come in parts, whose sums are
    added. N-grams listed twice count twice, those without words or with a null word never; posts with null or no lemmas
    have no hits; other columns are ignored. posts is read twice, and should be a table that was written.
    """
    rows, index = posts.select("id", F.array_distinct("lemmas").alias("lemmas")), _bags(grams)
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "lemmas"))), F.lit(0)), F.count("*")).first()
    blocks = max(2 * posts.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES), -(-n // BLOCK))
    parts = max(1, -(-index.count() // PART_GRAMS))
    of, every = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = rows.withColumn("block", of("id", blocks)).withColumn("part", every(parts)).groupBy("block", "part")
    right = index.withColumn("part", of("words", parts)).withColumn("block", every(blocks)).groupBy("block", "part")
    kind = posts.schema["id"].dataType.simpleString()
    sums = left.cogroup(right).applyInArrow(_hits, f"id {kind}, " + ", ".join(f"{k} long" for k in KINDS))
    if parts > 1:
        sums = sums.groupBy("id").agg(*[F.sum(k).alias(k) for k in KINDS])
    out = sums.withColumn("excluded", F.col("excluded") > 0)
    return out.select("id", *[F.when(F.col("excluded"), F.lit(0)).otherwise(F.col(k)).cast("int").alias(k) for k in KINDS[:2]], "excluded")
