"""N-gram Jaccard join: an exact similarity join of shingle sets in the Jaccard metric space (operator 1).

d(x, y) = 1 - |x & y| / |x | y| is a metric. Two levels of pivots partition it:

* Over the whole corpus pivots are single shingles: a document is nearest to the pivots that it holds, and among
  those the rarest one names its Voronoi region. Distances to pivots that are documents all lie near 1 in a large
  corpus, so that their windows would copy every document everywhere (figures are in the README). A document's
  window reaches over its d + 1 rarest shingles, where d is the number of shingles that a partner may lack; a
  shingle held by one document alone is a region of its own and only uses up the window, so that a document with
  more than d of those has no partner at all.
* Regions that share documents join to clusters, and inside a cluster pivots are documents: each document goes to
  the cell of its nearest pivot, the triangle inequality bounds which documents of other cells are copied into it,
  cells join recursively, and a cell within half the radius of its pivot needs no comparison at all. Pivots meet all
  members of their region, so that they leave it, whatever its size; members that distances do not part are compared
  by pairs or by their rarest shingles.
* In a large corpus chance joins most regions to one cluster. A cluster too large for one task is parted first between
  sets of one region that small sketches of both tell apart for certain. What is too large still, a family of near copies,
  is parted by distributed rounds: pivots of each region, cells and windows, until a cell is linked throughout or fits a task.

Every link is verified on whole sets with integers; no candidate is dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import BROADCAST_ROWS, filtered_join, hold, may_match, raw_texts, slices, small_join, stage_table, texts_of, tidy
from vociflow.llm.components import components

#: Documents with at least so many shingles compare only those of a fixed share of the shingle space at first.
RESTRICT_FROM = 64
#: Word hashes that a worker keeps.
CACHE_WORDS = 200_000
#: Copies of one shingle, after which it counts as this frequent; bounds what a task holds of one shingle.
HOT = 1 << 18
#: Pivots of a region, and the size up to which members that pivots do not part are compared by pairs.
PIVOTS, SMALL_REGION = 8, 48

#: Shingles of a cluster that one task joins; larger clusters are joined in rounds, and regions by blocks of documents.
CLUSTER_SHINGLES, BLOCK_DOCS = 6_000_000, 2_000
#: Binary digits of the number of ranges in a sketch, and sets whose sketches one task compares.
SKETCH_BITS, REGION_DOCS = (6, 12), 10_000
#: Bytes of pivot sets that are broadcast; more are joined by region. Rounds of pivots for a large cluster, and how many times
#: the documents of a round's regions cells may hold.
BROADCAST_PIVOTS, ROUNDS, COPIES = 16 << 20, 4, 1.5
#: Documents of 1,000 that hold a key from which it counts as common without a shuffle, and common keys that are broadcast.
COMMON_IN_BATCH, COMMON_KEYS = 50, 10_000

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one shingle, an empty one has none."""
    split = text.lower().split() if text else []
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    k = min(words, len(split))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = _mix(acc * M1 + h[j : len(h) - k + 1 + j])
    acc.sort()
    keep = np.empty(len(acc), bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(found.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def allowed(n: int, num: int, den: int) -> int:
    """Shingles of a set of n that a linked set may lack: den * intersection >= num * union >= num * n."""
    return n - -(-n * num // den)


def _describe(words: int, num: int, den: int, share: float):
    """Per document: set size, fingerprint and the shingles to look for partners with.

    The lowest bit of a key tells whether it stands for the whole space (1) or for the restricted share (0). Small
    sets use the whole space. A linked pair meets in the whole space if either set is smaller than RESTRICT_FROM,
    as the larger one then has at most (RESTRICT_FROM - 1) * den / num shingles; else both use the share, where one
    of them holds more keys than it may lack, or both are short of keys and use the whole space too. A batch's first
    row names the keys that COMMON_IN_BATCH different sets of the batch or more hold.
    """
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    small = (RESTRICT_FROM - 1) * den // num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hold("word hashes", WordHashes)
        for batch in slices(batches, 1000):
            sizes, highs, lows, restricted, whole, keys = [], [], [], [], [], []
            blank = [[]] * (batch.num_rows - 1)
            seen: set[tuple[int, int]] = set()
            for text, doc_id in zip(raw_texts(batch["text"]), batch["doc_id"].to_pylist(), strict=True):
                found = shingles(text, words, hashes)
                n = len(found)
                mark = _fingerprint(found)
                own = []
                if n and doc_id is not None and mark not in seen:
                    seen.add(mark)
                    part = found[: int(np.searchsorted(found, limit))]
                    if n < RESTRICT_FROM:
                        part = part[:0]
                    if n <= small or len(part) <= allowed(n, num, den):
                        own.append(_mix(found * M1) | np.uint64(1))
                    if len(part):
                        own.append(part & ~np.uint64(1))
                    restricted.append(len(part))
                else:
                    restricted.append(0)
                own = np.concatenate(own) if own else np.empty(0, np.uint64)
                sizes.append(n)
                highs.append(mark[0])
                lows.append(mark[1])
                whole.append(len(own) - restricted[-1])
                keys.append(own.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            found, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    batch["mark"],
                    pa.array(sizes, pa.int64()),
                    pa.array(highs, pa.int64()),
                    pa.array(lows, pa.int64()),
                    pa.array(restricted, pa.int32()),
                    pa.array(whole, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64())),
                    pa.array([found[times >= COMMON_IN_BATCH].tolist(), *blank][: batch.num_rows], pa.list_(pa.int64())),
                ],
                ["doc_id", "mark", "n", "high", "low", "n_part", "n_whole", "keys", "common"],
            )

    return tidy(run)


DESCRIBED = "doc_id long, mark long, n long, high long, low long, n_part int, n_whole int, keys array<long>, common array<long>"


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, node) sorted by both: those whose key two or more nodes have, with that number (HOT at most), once each."""
    tail_keys, tail_nodes, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
    before = None

    def out(keys, nodes, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["node", "key", "df"]
        )

    def counted(keys, nodes, hot):
        if not len(keys):
            return None
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        each = np.minimum(np.repeat(counts, counts), HOT)
        if hot is not None:
            each[keys == hot] = HOT
        keep = each > 1
        return out(keys[keep], nodes[keep], each[keep])

    for batch in batches:
        keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not len(keys):
            continue
        first = np.concatenate([[before != (keys[0], nodes[0])], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        before = (keys[-1], nodes[-1])
        keys, nodes = np.concatenate([tail_keys, keys[first]]), np.concatenate([tail_nodes, nodes[first]])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1])) if hot != keys[-1] else len(keys)
        if len(keys) - last > HOT:  # what is still to come of this key counts as HOT as well
            hot, last = keys[-1], len(keys)
        tail_keys, tail_nodes = keys[last:], nodes[last:]
        if (found := counted(keys[:last], nodes[:last], hot)) is not None:
            yield found
    if (found := counted(tail_keys, tail_nodes, hot)) is not None:
        yield found


def _window_keys(described: DataFrame, equal: DataFrame, common: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (node, key) of each set's window: its rarest shared shingles, as far as its window reaches.

    Keys in common come after all others and are not counted, so that no task gets all holders of one of them. Any
    order of keys finds the same links; rarest first finds them with the fewest comparisons. Keys are shuffled as they
    were described, equal sets of other batches included: to leave those out first would shuffle and write all keys once more.
    """
    rows = described.select(F.explode("keys").alias("key"), F.col("high").alias("node"))
    rare = rows.join(F.broadcast(common), "key", "left_anti").repartition("key").sortWithinPartitions("key", "node")
    shared = rare.mapInArrow(tidy(_shared_keys), "node long, key long, df long")
    shared = shared.unionByName(rows.join(F.broadcast(common), "key", "left_semi").distinct().select("node", "key", F.lit(HOT + 1).cast("long").alias("df")))
    # Dealt as rows: lists that tasks have begun are twice as large.
    held = shared.repartition("node").groupBy("node").agg(F.collect_list(F.struct("df", "key")).alias("held"))
    lacking = F.expr(f"n - ceil(n * {num} / {den})").cast("int")
    mine = held.join(equal.select("node", "n", "n_part", "n_whole"), "node")

    def window(size: str, bit: int):
        found = F.filter("held", lambda x: x["key"].bitwiseAND(F.lit(1)) == bit)
        reach = lacking + 1 - (F.col(size) - F.size(found))
        return F.slice(F.sort_array(found), F.lit(1), F.greatest(reach, F.lit(0)))

    kept = mine.select("node", F.concat(window("n_part", 0), window("n_whole", 1)).alias("kept"))
    return kept.select("node", F.explode("kept.key").alias("key"))


class Region:
    """The sets of one cluster, and which of them are linked so far (equal labels)."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.label = np.arange(len(sets))
        #: Labels that each step has done away with: pivots with their regions, pairs, and shingles.
        self.merged: Counter[str] = Counter()

    def union(self, x: int, others: np.ndarray, step: str) -> None:
        """Give a set and others one label, the least of theirs."""
        labels = np.unique(np.append(self.label[others], self.label[x]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
            self.merged[step] += len(labels) - 1

    def shared(self, x: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with those that lie in flat from starts on."""
        own = self.sets[x]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        return np.add.reduceat((own[at] == flat).astype(np.int32), starts)

    def link(self, x: int, members: np.ndarray, shared: np.ndarray, step: str) -> None:
        """Link a set with those members that are similar enough."""
        self.union(x, members[self.den * shared >= self.num * (self.sizes[x] + self.sizes[members] - shared)], step)

    def lay(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members' sets one after the other, and where each starts."""
        starts = np.concatenate([[0], np.cumsum(self.sizes[members])[:-1]])
        return np.concatenate([self.sets[m] for m in members]), starts

    def join(self, members: np.ndarray) -> None:
        """Link all linked pairs among the members, by pivots, cells and windows."""
        stack = [members]
        radius = 1 - self.num / self.den
        while stack:
            members = stack.pop()
            if len(members) < 2 or (self.label[members] == self.label[members[0]]).all():
                continue
            flat, starts = self.lay(members)
            rows, pivots = [], []
            far = np.full(len(members), np.inf)
            pick = 0
            while len(pivots) < PIVOTS:
                pivots.append(pick)
                pivot = int(members[pick])
                shared = self.shared(pivot, flat, starts)
                self.link(pivot, members, shared, "pivots")
                rows.append(1 - shared / (self.sizes[pivot] + self.sizes[members] - shared))
                far = np.minimum(far, rows[-1])
                pick = int(far.argmax())
                if far[pick] <= radius / 2:
                    break
            distance = np.array(rows)
            cell, nearest = distance.argmin(0), distance.min(0)
            rest = np.ones(len(members), bool)
            rest[pivots] = False  # they have met all members
            inside = [rest & ((cell == k) | (distance[k] <= nearest + 2 * radius + 1e-9)) for k in range(len(rows))]
            # A cell within half the radius of its pivot is linked already: any two in it, and all with the pivot.
            regions = [members[i] for k, i in enumerate(inside) if distance[k][i].max(initial=0) > radius / 2 - 1e-9]
            if sum(map(len, regions)) <= COPIES * rest.sum():
                stack += regions
            elif rest.sum() <= SMALL_REGION:  # distances do not part them
                self.compare(members[rest])
            else:
                self.anchored(members[rest], *self.lay(members[rest]))

    def compare(self, members: np.ndarray) -> None:
        """Compare all members of a small region that are not linked yet."""
        for x in members.tolist():
            rest = members[self.label[members] != self.label[x]]
            if len(rest):
                flat, starts = self.lay(rest)
                self.link(x, rest, self.shared(x, flat, starts), "pairs")

    def anchored(self, members: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> None:
        """As over the corpus: each member's window is its shingles that are rarest here, as far as it reaches.

        Members with the commonest label are linked with each other, so only the others search; each compares with
        the members that share a shingle of both windows, have another label, and a size that allows a link.
        """
        sizes = self.sizes[members]
        owner = np.repeat(np.arange(len(members)), sizes)
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.lexsort((inverse, counts[inverse], owner))
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        reach = sizes - -(-sizes * self.num // self.den) + 1
        kept = rank[(place < reach[owner]) & (counts[inverse[rank]] > 1)]
        window_of, window_key = owner[kept], inverse[kept]  # by owner
        own_starts = np.searchsorted(window_of, np.arange(len(members) + 1))
        by_key = np.argsort(window_key, kind="stable")
        holders = window_of[by_key]
        key_starts = np.searchsorted(window_key[by_key], np.arange(len(counts) + 1))
        labels, times = np.unique(self.label[members], return_counts=True)
        for x in np.flatnonzero(self.label[members] != labels[times.argmax()]).tolist():
            keys = window_key[own_starts[x] : own_starts[x + 1]]
            if not len(keys):
                continue
            met = np.unique(np.concatenate([holders[key_starts[k] : key_starts[k + 1]] for k in keys.tolist()]))
            fits = (self.label[members[met]] != self.label[members[x]]) & (self.den * np.minimum(sizes[met], sizes[x]) >= self.num * np.maximum(sizes[met], sizes[x]))
            if fits.any():
                rest = members[met[fits]]
                self.link(int(members[x]), rest, self.shared(int(members[x]), *self.lay(rest)), "shingles")


def _join_clusters(words: int, num: int, den: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hold("word hashes", WordHashes)
        for batch in slices(batches, 1000):
            blobs = []
            for text, high, low in zip(raw_texts(batch["text"]), batch["high"].to_pylist(), batch["low"].to_pylist(), strict=True):
                found = shingles(text, words, hashes)
                blobs.append(found.tobytes() if _fingerprint(found) == (high, low) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["cluster"], batch["high"], batch["low"], pa.array(blobs, pa.binary())], ["cluster", "high", "low", "blob"]
            )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["high", "low"]).drop_duplicates(["high", "low"]).reset_index(drop=True)
        region = Region([np.frombuffer(b, np.uint64) for b in pdf["blob"]], num, den)
        region.join(np.arange(len(pdf)))
        return pd.DataFrame({"high": pdf["high"], "low": pdf["low"], "component": pdf["high"].to_numpy()[region.label]})

    return tidy(sets), join


def _cells(num: int, den: int):
    """From rows (region, node, blob, pivots): the cells that each document belongs to or is copied into, and its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for region, doc, blob, pivots in zip(*[batch[c].to_pylist() for c in ("region", "node", "blob", "pivots")], strict=True):
                x = np.frombuffer(blob, np.uint64)
                others = [np.frombuffer(p["blob"], np.uint64) for p in pivots]
                both = np.array([(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum() for y in others])
                union = np.array([len(x) + len(y) for y in others]) - both
                distance = 1 - both / union
                for k in np.flatnonzero(distance <= distance.min() + 2 * (1 - num / den) + 1e-9):
                    out.append((region, doc, pivots[k]["node"], bool(den * both[k] >= num * union[k])))
            cols = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["region", "node", "pivot", "linked"])

    return run


def _deal_blocks(rows: DataFrame, block_docs: int) -> DataFrame:
    """Rows (region, node, label) dealt to tasks (region, i, j) so that documents with different labels meet in one of them.

    Documents that do not have the commonest label of their region are the ones that search: a task holds a block of
    them and a block of all. The others are copied once for each block of searching ones, not for each block of all.
    """
    labels = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
    sizes = labels.groupBy("region").agg(F.sum("n").alias("c"), F.max(F.struct("n", "label")).alias("top")).where("c > top.n")
    number = lambda n: F.ceil(n / block_docs).cast("int")
    sizes = sizes.select("region", F.col("top.label").alias("top"), number(F.col("c") - F.col("top.n")).alias("few"), number(F.col("c")).alias("all"))
    # A table of its own, so that AQE may split the join at a large region.
    dealt = small_join(rows, stage_table(sizes, "sizes"), "region", "inner").withColumn("searches", F.col("label") != F.col("top"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    searching = dealt.where("searches").select("region", block("few").alias("i"), F.explode(to("all")).alias("j"), "node", "label")
    found = dealt.select("region", F.explode(to("few")).alias("i"), block("all").alias("j"), "node", "label")
    return searching.unionByName(found).distinct()


def _copies(rows: DataFrame, block_docs: int) -> int:
    """Sets that _deal_blocks hands to tasks at most, by the sizes of regions."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("c")).where("c > 1")
    return sizes.agg(F.sum(F.col("c") * F.ceil(F.col("c") / block_docs))).first()[0] or 0


def _join_large(sets: DataFrame, window: DataFrame, num: int, den: int, block_docs: int) -> DataFrame:
    """Components (node, component) of clusters too large for a task: sets has cluster, node, low, blob.

    In each round every region takes pivots, its documents link with those and go to cells, with windows. A cell whose
    documents are all linked by now is done; one of block_docs documents or fewer is joined by a task; others are the
    regions of the next round. If cells hardly part them, documents are joined by blocks of a region, or shingle by
    shingle of their windows.
    """
    blobs = sets.select("node", "blob")
    regions = stage_table(sets.select(F.col("cluster").alias("region"), "node"), "regions")
    links, known, size = None, None, regions.count()

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        region = Region([np.frombuffer(b, np.uint64) for b in pdf["blob"]], num, den)
        region.label = pdf.groupby("label")["node"].transform("idxmin").to_numpy().copy()
        region.join(np.arange(len(pdf)))
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"u": ids, "v": ids[region.label]})

    def joined(rows: DataFrame) -> DataFrame:
        """Links within the regions of rows (region, node, label)."""
        dealt = _deal_blocks(rows, block_docs).join(blobs, "node")
        return stage_table(dealt.groupBy("region", "i", "j").applyInPandas(join, "u long, v long").where("u <> v"), "region_links")

    for k in range(ROUNDS):
        order = F.xxhash64("node", F.lit(k))
        chosen = regions.groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("salt")).agg(F.min(F.struct(order.alias("h"), "node")).alias("p"))
        pivots = stage_table(chosen.select("region", F.col("p.node").alias("node")).join(blobs, "node"), "pivots")
        own = pivots.groupBy("region").agg(F.collect_list(F.struct("node", "blob")).alias("pivots"))  # PIVOTS at most
        small = (pivots.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) <= BROADCAST_PIVOTS
        met = regions.join(blobs, "node").join(F.broadcast(own) if small else own, "region").select("region", "node", "blob", "pivots")
        cells = stage_table(met.mapInArrow(_cells(num, den), "region long, node long, pivot long, linked boolean"), "cells")
        new = cells.where("linked and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        links = new if links is None else links.unionByName(new)
        known = components(links).withColumnRenamed("component", "label")
        rows = stage_table(labelled(cells.select(F.xxhash64("region", "pivot").alias("region"), "node")), "labelled_cells")
        sizes = rows.groupBy("region").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        rows = stage_table(small_join(rows, stage_table(sizes.select("region", "c"), "open"), "region", "inner"), "open_cells")
        before, size = size, rows.count()
        if size > COPIES * before:  # windows copy too many documents into too many cells
            regions = regions.join(rows.select("node").distinct(), "node", "left_semi").select("region", "node")
            break
        links = links.unionByName(joined(rows.where(F.col("c") <= block_docs).drop("c")))
        regions = rows.where(F.col("c") > block_docs).select("region", "node")
        size = regions.count()
        if not size:
            break
    if size:
        known = components(links).withColumnRenamed("component", "label")
        by_shingle = window.withColumnRenamed("key", "region").join(regions.select("node").distinct(), "node", "left_semi").select("region", "node")
        # Whole regions by blocks, or by shared shingles: whatever copies sets less often.
        dealt = min((stage_table(r, "dealt") for r in (regions, by_shingle)), key=lambda r: _copies(r, block_docs))
        links = links.unionByName(joined(stage_table(labelled(dealt), "shingles")))
    return sets.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _sketches(words: int):
    """From rows (text, node, low): counts of the set's shingles by ranges of hashes, 8 to a range or 16, 255 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hold("word hashes", WordHashes)
        for batch in slices(batches, 1000):
            out = []
            for text, node, low in zip(raw_texts(batch["text"]), batch["node"].to_pylist(), batch["low"].to_pylist(), strict=True):
                found = shingles(text, words, hashes)
                if _fingerprint(found) == (node, low):
                    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], (len(found) // 8).bit_length()))
                    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    out.append((node, len(found), np.minimum(counts, 255).astype(np.uint8).tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            types = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["node", "n", "sketch"])

    return tidy(run)


def _alike(nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """For each set the least node that it reaches by pairs which sketches and sizes do not tell apart.

    Differences of counts add up to no more than the shingles that one of two sets has alone, of which a linked pair
    has (a + b) * (den - num) / (den + num) at most for sizes a and b.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, levels = sizes[order], np.array([len(sketches[k]) for k in order])
    rows, place = {}, np.zeros(len(order), np.int64)
    for level in np.unique(levels).tolist():
        of = np.flatnonzero(levels == level)
        place[of] = np.arange(len(of))
        rows[level] = np.frombuffer(b"".join(sketches[k] for k in order[of]), np.uint8).reshape(len(of), level).astype(np.int16)

    def fold(counts: np.ndarray, level: int) -> np.ndarray:
        return counts.reshape(len(counts), level, -1).sum(2) if counts.shape[1] > level else counts

    label, open_ = np.full(len(order), -1), np.ones(len(order), bool)
    for start in range(len(order)):
        stack = [start] if open_[start] else []
        open_[start] = False
        while stack:
            x = stack.pop()
            label[x] = start
            low, high = np.searchsorted(den * sizes, num * sizes[x]), np.searchsorted(num * sizes, den * sizes[x], "right")
            others = low + np.flatnonzero(open_[low:high])
            for level in np.unique(levels[others]).tolist():
                some = others[levels[others] == level]
                least = min(level, int(levels[x]))
                own = fold(rows[int(levels[x])][place[x] : place[x] + 1], least)
                apart = np.abs(fold(rows[level][place[some]], least) - own).sum(1)
                near = some[apart * (den + num) <= (sizes[some] + sizes[x]) * (den - num)]
                open_[near] = False
                stack += near.tolist()
    out = np.empty(len(order), np.int64)
    for start in np.unique(label):
        out[order[label == start]] = nodes[order[label == start]].min()
    return out


def _alike_in_regions(num: int, den: int):
    """From rows (region, node, n, sketch) sorted by region: links (u, v) of the sets that are alike in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(rows: pa.Table) -> pa.RecordBatch:
            regions, nodes, sizes, sketches = rows["region"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy(), rows["sketch"].to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1]]))
            least = np.concatenate([_alike(nodes[a:b], sizes[a:b], sketches[a:b], num, den) for a, b in zip(starts, np.append(starts[1:], len(regions)), strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != least]), pa.array(least[nodes != least])], ["u", "v"])

        for batch in (b for b in batches if b.num_rows):
            regions = batch["region"].to_numpy()
            last = int(np.flatnonzero(regions == regions[-1])[0])
            if held and held[-1]["region"][0].as_py() != regions[0] or last:
                yield linked(pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield linked(pa.Table.from_batches(held))

    return tidy(run)


def _part_clusters(members: DataFrame, texts: DataFrame, window: DataFrame, words: int, num: int, den: int, region_docs: int) -> DataFrame:
    """The members of clusters, parted where no pair that could link holds them together; members without such a pair leave.

    In a large corpus chains of sets that share a shingle but are quite different join most regions to one cluster. Sets of
    one region that sketches do not tell apart stay together; a region of more than region_docs sets is dealt by pairs of blocks.
    """
    sketches = texts.select("text", F.col("high").alias("node"), "low").mapInArrow(_sketches(words), "node long, n long, sketch binary")
    sketches = stage_table(sketches.dropDuplicates(["node"]), "sketches")
    held = stage_table(window.join(sketches.select("node"), "node", "left_semi"), "held")
    blocks = held.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / region_docs).cast("int").alias("blocks"))
    # A table of its own, so that AQE may split the join at a key that many windows hold.
    dealt = small_join(held, stage_table(blocks, "blocks"), "key", "inner")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.select("node", "key", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = dealt.select("node", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("region")).join(sketches, "node")
    dealt = dealt.repartition("region").sortWithinPartitions("region").select("region", "node", "n", "sketch")
    alike = components(dealt.mapInArrow(_alike_in_regions(num, den), "u long, v long"))
    return members.drop("cluster").join(alike.select(F.col("node").alias("high"), F.col("component").alias("cluster")), "high").select(members.columns)


def _grouped(
    docs: DataFrame, words: int, num: int, den: int, share: float | None, cluster_shingles: int, block_docs: int, region_docs: int = REGION_DOCS
) -> DataFrame:
    """Per document: doc_id, mark (a hash of its text), n (size of its set), node (its set), component (the least node it is linked with).

    Sets without words, and those that only rows without an id have, have no component.
    """
    spark_share = min(1.0, 2 * (1 - num / den)) if share is None else share
    pairs = texts_of(docs).select("doc_id", "text")
    rows = stage_table(pairs.withColumn("mark", F.xxhash64("text")).mapInArrow(_describe(words, num, den, spark_share), DESCRIBED), "sets")
    common = rows.select(F.explode("common").alias("key")).groupBy("key").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "key").limit(COMMON_KEYS).select("key")
    # A set is a node of the graph, known by its fingerprint; one of its documents stands for it. Keys stay in the rows.
    counts = [F.max(c).alias(c) for c in ("n_part", "n_whole")]  # 0 where a batch has the set before
    equal = rows.where("n > 0 and doc_id is not null").groupBy(F.col("high").alias("node"), "low", "n").agg(F.min("doc_id").alias("doc_id"), *counts)
    equal = stage_table(equal, "equal")
    window = stage_table(_window_keys(rows, equal, stage_table(common, "common"), num, den), "windows")
    # A table of its own, so that AQE may split the join at a key that many windows hold.
    centres = stage_table(window.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").select("key", "v"), "centres")
    edges = small_join(window, centres, "key", "inner").select(F.col("node").alias("u"), "v")
    clusters = components(edges).withColumnRenamed("component", "cluster")
    members = stage_table(clusters.join(equal.select("node", "low", "doc_id", "n"), "node").withColumnRenamed("node", "high"), "members")
    to_sets, join = _join_clusters(words, num, den)
    beyond = lambda m: stage_table(m.groupBy("cluster").agg(F.sum("n").alias("n")).where(F.col("n") > cluster_shingles).select("cluster"), "large")
    texts = lambda m: filtered_join(pairs, m, "doc_id", "inner")
    blobs = lambda m: texts(m).select("cluster", "text", "high", "low").mapInArrow(to_sets, "cluster long, high long, low long, blob binary").where("blob is not null")
    apart, large = None, beyond(members)
    if not large.isEmpty():
        parted = small_join(members, large, "cluster", "left_semi")
        parted = _part_clusters(parted, texts(parted), window, words, num, den, region_docs)
        members = stage_table(small_join(members, large, "cluster", "left_anti").unionByName(parted), "parted")
        large = beyond(members)
        if not large.isEmpty():
            apart = stage_table(small_join(members, large, "cluster", "left_semi"), "apart")
            members = stage_table(small_join(members, large, "cluster", "left_anti"), "members")
    joined = blobs(members).groupBy("cluster").applyInPandas(join, "high long, low long, component long").select(F.col("high").alias("node"), "component")
    if apart is not None:
        sets = stage_table(blobs(apart).withColumnRenamed("high", "node").dropDuplicates(["node"]), "blobs")
        joined = joined.unionByName(_join_large(sets, window, num, den, block_docs))
    joined = stage_table(joined, "joined")
    final = equal.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("high")).alias("node")).join(final, "node", "left")


def jaccard_components(
    docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, share: float | None = None, cluster_shingles: int = CLUSTER_SHINGLES, block_docs: int = BLOCK_DOCS, region_docs: int = REGION_DOCS
) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that links lead to.

    Words are split at ASCII white space after lower-casing A-Z. Two documents link when
    den * intersection >= num * union of their sets of distinct n-word shingles. A text with fewer words is one
    shingle; one without words, or null, has none and links with nothing. Rows with equal sets link, repeated rows
    are all returned, rows with one doc_id and different texts are judged apart, a null doc_id names no component (its
    row's component_id is that of its equals, or null), and an empty table gives no rows. Other columns are ignored.
    share is the part of the shingle space in which large sets look for partners: above 1 - num / den any value finds
    the same links. cluster_shingles, block_docs and region_docs bound what one task holds, and do not change the result.
    """
    found = _grouped(docs, words, num, den, share, cluster_shingles, block_docs, region_docs)
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return found.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def drop_linked(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, share: float | None = None) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id; its repeated rows stay once.

    Rows are known by doc_id and text: of rows with one doc_id and different texts, linked ones are one group, others
    stay. Documents without words, or without an id, are kept. The columns stay as they are.
    """
    found = stage_table(_grouped(docs, words, num, den, share, CLUSTER_SHINGLES, BLOCK_DOCS).where("component is not null and doc_id is not null"), "groups")
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("c")).where("c > 1")
    judged = found.join(stays.select("component", "first"), "component").withColumn("stays", F.struct("doc_id", "mark") == F.col("first"))
    gone = judged.where("not stays").select("doc_id", "mark").distinct()
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    on = lambda other: (F.col("doc_id") == other["__id"]) & (F.col("__mark") == other["__of"])
    named = lambda rows: stage_table(rows.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of")), "marks")
    gone = named(gone)
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = marked.join(F.broadcast(gone), on(gone), "left_anti")
    else:  # ids alone are shuffled: those of rows that look like gone ones, and are not
        seen = may_match(marked.where("doc_id is not null"), F.xxhash64("doc_id", "__mark"), gone, F.xxhash64("__id", "__of"))
        taken = named(seen.where("__may").select("doc_id", "__mark").distinct().join(gone, on(gone), "left_anti").withColumnRenamed("__mark", "mark"))
        back = small_join(seen.where("__may"), taken, on(taken), "left_semi")
        kept = seen.where("not __may").unionByName(back).drop("__may").unionByName(marked.where("doc_id is null"))
    again = named(judged.where("stays").groupBy("doc_id", "mark").count().where("count > 1"))
    if again.isEmpty():
        return kept.drop("__mark")
    once = small_join(kept, again, on(again), "left_semi").dropDuplicates(["doc_id", "__mark"])
    return small_join(kept, again, on(again), "left_anti").unionByName(once).drop("__mark")
