"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and a tree over the groups (operator 13).

Rows are numbered within their group, and aligned blocks of them, of which none is larger than BLOCK, are hashed in one
piece: an Arrow list of 64-byte digests is a contiguous matrix, whose rows of fanout digests are hashed level by level.
The blocks' digests are the rows of the next round, so that two or three rounds reach a group's root, however large it
is. Proofs go the other way: the steps from a block's digest to the root are handed down to the block, and index
arithmetic gives the siblings of all its rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import small_join, stage_table, texts_of, tidy
from vociflow.stage import number_rows

#: Children of a node; leaves of a block at most.
FANOUT, BLOCK = 2, 4_096
#: Bytes of a digest, as hex text.
WIDTH = 64
#: What of a row its leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<before:string,after:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """A leaf: the digest of a row's values, each as its length in bytes, a colon and the value, or - if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass(frozen=True)
class Shape:
    """Children of a node, and levels of a whole block, of which fanout ** height leaves are the most that BLOCK allows."""

    fanout: int
    height: int

    @classmethod
    def of(cls, fanout: int) -> Shape:
        return cls(fanout, max(1, int(np.log(BLOCK) / np.log(fanout) + 1e-9)))

    @property
    def span(self) -> int:
        return self.fanout**self.height


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """Digests of consecutive runs of nodes, an (n, WIDTH) matrix; the last run may be shorter."""
    flat, step = nodes.tobytes(), fanout * WIDTH
    return np.frombuffer("".join(sha256(flat[i : i + step]).hexdigest() for i in range(0, len(flat), step)).encode(), np.uint8).reshape(-1, WIDTH)


def levels(leaves: np.ndarray, of: int, shape: Shape) -> list[np.ndarray]:
    """All levels of a block, from its leaves on: up to its root where it is its tree's only block, of so many rows, else as many as every block has."""
    out = [leaves]
    while len(out[-1]) > 1 if of <= shape.span else len(out) <= shape.height:
        out.append(_parents(out[-1], shape.fanout))
    return out


@dataclass
class Steps:
    """At one level, for each leaf of a block: the run of nodes that its node is in, its place there, and the run's size."""

    runs: np.ndarray
    slot: np.ndarray
    size: np.ndarray

    @classmethod
    def at(cls, nodes: np.ndarray, place: np.ndarray, fanout: int) -> Steps:
        padded = np.zeros((-(-len(nodes) // fanout) * fanout, WIDTH), np.uint8)
        padded[: len(nodes)] = nodes
        run, slot = np.divmod(place, fanout)
        return cls(padded.reshape(-1, fanout, WIDTH)[run], slot, np.minimum(fanout, len(nodes) - run * fanout))

    def sides(self) -> Iterator[tuple[bytes, bytes]]:
        """The siblings before and after each leaf's node."""
        flat, step = self.runs.tobytes(), self.runs.shape[1] * WIDTH
        for k, (slot, size) in enumerate(zip(self.slot.tolist(), self.size.tolist(), strict=True)):
            yield flat[k * step : k * step + slot * WIDTH], flat[k * step + (slot + 1) * WIDTH : k * step + size * WIDTH]


def steps_of(leaves: np.ndarray, of: int, shape: Shape) -> Iterator[Steps]:
    """The steps of all leaves of a block, from the lowest level up."""
    for k, nodes in enumerate(levels(leaves, of, shape)[:-1]):
        yield Steps.at(nodes, np.arange(len(leaves)) // shape.fanout**k, shape.fanout)


def _matrix(digests: pa.Array) -> np.ndarray:
    """Digests of a column as a matrix, without a copy of each."""
    values = digests.cast(pa.binary())
    start, end = (int(np.frombuffer(values.buffers()[1], np.int32)[values.offset + k]) for k in (0, len(values)))
    return np.frombuffer(values.buffers()[2], np.uint8)[start:end].reshape(-1, WIDTH)


def _blocks(rows: DataFrame, shape: Shape, *carried: str) -> DataFrame:
    """tree, block, of (rows of the tree), members (place, digest and what is carried, in order) and node, the block's digest; written.

    rows has tree, place, of and digest. A group of rows is a block, so no group is larger than BLOCK.
    """
    members = F.sort_array(F.collect_list(F.struct("place", "digest", *carried))).alias("members")
    grouped = texts_of(rows).withColumn("block", F.floor(F.col("place") / shape.span)).groupBy("tree", "block", "of").agg(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for k, of in enumerate(batch["of"].to_pylist()):
                nodes.append(levels(_matrix(batch["members"].slice(k, 1).flatten().field("digest")), of, shape)[-1].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()).cast(pa.string())], [*batch.schema.names, "node"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema)
    return stage_table(grouped.mapInArrow(tidy(run), f"{fields}, node string"), "blocks")


def _rounds(rows: DataFrame, largest: int, shape: Shape, *carried: str) -> list[DataFrame]:
    """Blocks of all rounds, until the largest tree has one node; the last round's nodes are the roots."""
    found = [_blocks(rows, shape, *carried)]
    while largest > shape.span:
        largest = -(-largest // shape.span)
        above = found[-1].select("tree", F.col("block").alias("place"), F.ceil(F.col("of") / shape.span).alias("of"), F.col("node").alias("digest"))
        found.append(_blocks(above, shape))
    return found


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the steps from their nodes up; both sides are dealt out by block, as many as there are."""
    return blocks.join(paths.hint("merge"), ["tree", "block"])


def _members_paths(blocks: DataFrame, shape: Shape) -> DataFrame:
    """tree, place, path of every member of blocks that have paths: the steps inside the block, then the block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, of, members, above in zip(*(batch[c].to_pylist() for c in ("tree", "of", "members", "path")), strict=True):
                leaves = np.frombuffer("".join(m["digest"] for m in members).encode(), np.uint8).reshape(-1, WIDTH)
                own: list[list] = [[] for _ in members]
                for step in steps_of(leaves, of, shape):
                    for path, (before, after) in zip(own, step.sides(), strict=True):
                        path.append({"before": before.decode(), "after": after.decode()})
                kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(members), pa.int64()), pa.array([m["place"] for m in members], pa.int64()), pa.array([p + above for p in own], kind)], ["tree", "place", "path"]
                )

    return blocks.mapInArrow(tidy(run), f"tree long, place long, path {_STEPS}")


def _paths_down(rounds: list[DataFrame], top: DataFrame, shape: Shape) -> DataFrame:
    """Paths of the lowest round's blocks, from those of the highest's."""
    paths = top
    for blocks in reversed(rounds[1:]):
        paths = _members_paths(_with_paths(blocks, paths), shape).withColumnRenamed("place", "block")
    return paths


@dataclass
class Manifest:
    """A written manifest: blocks of leaves with their paths, roots of the groups by their numbers, and the root of all."""

    blocks: DataFrame
    groups: DataFrame
    root: str
    shape: Shape


def build(rows: DataFrame, group: str, order: list[Column], n: int, fanout: int = FANOUT, carried: Sequence[str] = ()) -> Manifest:
    """The manifest of about n rows, which have leaf and a group column; rows of a group ascend in the given order.

    Groups are ordered by their bytes, null first. Where rows tie, leaves decide; equal leaves are interchangeable.
    carried names columns that stay with their leaves.
    """
    spark, shape = rows.sparkSession, Shape.of(fanout)
    key = F.col(group).asc_nulls_first()
    numbered = number_rows(stage_table(rows.select(F.col(group).alias("__group"), "*"), "leaves"), [key, *order, F.col("leaf")], n)
    placed = stage_table(numbered, "places")
    groups = stage_table(placed.groupBy("__group").agg(F.min("position").alias("first"), F.count("*").alias("of")), "groups")
    sizes = groups.agg(F.max("of").alias("largest"), F.count("*").alias("n")).first()
    if not sizes["n"]:
        return Manifest(spark.createDataFrame([], f"tree long, members array<struct<place:long,digest:string>>, of long, path {_STEPS}"), spark.createDataFrame([], "tree long, subroot string"), "", shape)
    trees = stage_table(number_rows(groups, [F.col("first")], sizes["n"], "tree"), "trees").withColumnRenamed("__group", "__of")
    leaves = small_join(placed, trees, F.col("__group").eqNullSafe(F.col("__of")), "inner")
    rounds = _rounds(leaves.select("tree", (F.col("position") - F.col("first")).alias("place"), "of", F.col("leaf").alias("digest"), *carried), sizes["largest"], shape, *carried)
    roots = rounds[-1].select("tree", F.col("node").alias("subroot"))
    over = _rounds(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(sizes["n"]).cast("long").alias("of"), F.col("subroot").alias("digest")), sizes["n"], shape)
    root = over[-1].first()["node"]
    start = over[-1].select("tree", "block", F.array().cast(_STEPS).alias("path"))
    of_trees = _members_paths(_with_paths(over[0], _paths_down(over, start, shape)), shape)
    top = of_trees.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("block"), "path")
    return Manifest(_with_paths(rounds[0], _paths_down(rounds, top, shape)), roots, root, shape)


def proofs(manifest: Manifest) -> DataFrame:
    """tree, place and path of every leaf: the siblings before and after its node at each level, up to the root."""
    return _members_paths(manifest.blocks, manifest.shape)


def audit(manifest: Manifest, key: str, key_type: str, claimed: str) -> DataFrame:
    """Per leaf: the carried key, leaf, tree, proof_sha256 and folded_root.

    proof_sha256 is the digest of all its siblings, from the lowest level to the root. folded_root is what its proof
    makes of the carried digest that is claimed for the row, or of the leaf where that is null.
    """
    shape = manifest.shape

    def one(members: pa.Array, of: int, above: list[dict]) -> tuple[list[str], list[str]]:
        leaves = _matrix(members.field("digest"))
        given = members.field(claimed).to_pylist()
        current = [(g or leaf).encode() for g, leaf in zip(given, members.field("digest").to_pylist(), strict=True)]
        proof = [sha256() for _ in given]
        for step in steps_of(leaves, of, shape):
            for k, (before, after) in enumerate(step.sides()):
                proof[k].update(before + after)
                current[k] = sha256(before + current[k] + after).hexdigest().encode()
        outer = [(s["before"].encode(), s["after"].encode()) for s in above]
        rest = b"".join(before + after for before, after in outer)
        for k, p in enumerate(proof):
            p.update(rest)
            for before, after in outer:
                current[k] = sha256(before + current[k] + after).hexdigest().encode()
        return [p.hexdigest() for p in proof], [c.decode() for c in current]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (tree, of, above) in enumerate(zip(*(batch[c].to_pylist() for c in ("tree", "of", "path")), strict=True)):
                members = batch["members"].slice(k, 1).flatten()
                proof, folded = one(members, of, above)
                yield pa.RecordBatch.from_arrays(
                    [members.field(key), members.field("digest"), pa.array([tree] * len(proof), pa.int64()), pa.array(proof), pa.array(folded)], [key, "leaf", "tree", "proof_sha256", "folded_root"]
                )

    return texts_of(manifest.blocks).mapInArrow(tidy(run), f"`{key}` {key_type}, leaf string, tree long, proof_sha256 string, folded_root string")


def verify_documents(docs: DataFrame, tampered: Column, fanout: int = FANOUT) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, by a manifest with one tree for each lang.

    Where tampered holds, n_chars is claimed to be one more (a null stays null), and the fold of the original proof no
    longer gives the root. Null texts and columns have leaves of their own; a null lang is a group, the first; null and
    repeated doc_ids are ordered by their leaves; equal rows have equal leaves and proofs of their own. Empty tables
    give no rows; other columns are ignored. Texts are hashed where they are read and never shuffled.
    """
    own = [F.col(c) for c in COLUMNS]
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in COLUMNS]
    claimed = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(more))
    rows = docs.select("doc_id", "lang", leaf_digest(own).alias("leaf"), claimed.alias("claimed"))
    found = build(rows, "lang", [F.col("doc_id").asc_nulls_first()], docs.count(), fanout, ["doc_id", "claimed"])
    if not found.root:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    audited = audit(found, "doc_id", docs.schema["doc_id"].dataType.simpleString(), "claimed")
    return small_join(audited, found.groups, "tree", "inner").select(
        "doc_id", "leaf", "subroot", F.lit(found.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == found.root).alias("verified")
    )
