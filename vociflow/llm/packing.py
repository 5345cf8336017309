"""Cost-balanced packing of documents into sequences (operator 2).

A sequence's cost is linear in its tokens plus quadratic in each piece, as attention within a document is. Pieces
are taken in descending size; each goes to the sequence of lowest cost that has room for it, and is cut only where
none has. Sequences are full, or of a power-of-two length, so that no padding is needed.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import gather, slices, texts_of, tidy
from vociflow.llm.tokens import ENCODE_ROWS, default_tokenizer, encoder

#: Tokens of a full sequence.
SEQUENCE = 2048
#: Tokens packed at a time: bounds memory, and leaves sequences enough for an even balance.
BLOCK_TOKENS = 2_000_000
#: Words that a worker keeps.
CACHE_WORDS = 400_000
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def capacities(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Sequence lengths that hold exactly so many tokens: full ones, then powers of two for the rest."""
    rest = tokens % sequence
    return [sequence] * (tokens // sequence) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def piece_cost(length: int) -> float:
    """Estimated cost of a piece: linear work per token plus quadratic attention within the piece."""
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given lengths.

    Every token lies in exactly one piece and every sequence of capacities() is filled. Documents longer than a
    sequence first fill sequences of their own.
    """
    room = capacities(sum(lengths), sequence)
    full = sum(1 for c in room if c == sequence)
    used = [0] * len(room)
    pieces = []
    whole = 0
    left: list[tuple[int, int, int]] = []  # length, document, start
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= sequence and whole < full:
            pieces.append((doc, start, sequence, whole, 0))
            used[whole] = sequence
            whole += 1
            start += sequence
        if start < length:
            left.append((length - start, doc, start))
    left.sort(key=lambda x: (-x[0], x[1], x[2]))
    # Open sequences by cost. One without room for a piece waits until pieces, which shrink, fit into it.
    by_cost = [(0.0, k) for k in range(whole, len(room))]
    heapq.heapify(by_cost)
    waiting: list[tuple[int, float, int]] = []  # largest room first
    for length, doc, start in left:
        while waiting and -waiting[0][0] >= length:
            _, cost, k = heapq.heappop(waiting)
            heapq.heappush(by_cost, (cost, k))
        while length:
            while by_cost and room[by_cost[0][1]] - used[by_cost[0][1]] < length:
                cost, k = heapq.heappop(by_cost)
                heapq.heappush(waiting, (-(room[k] - used[k]), cost, k))
            if by_cost:
                cost, k = heapq.heappop(by_cost)
                take = length
            else:  # no sequence has room for all of it: fill the one with most room
                gap, cost, k = heapq.heappop(waiting)
                take = -gap
            pieces.append((doc, start, take, k, used[k]))
            used[k] += take
            start, length = start + take, length - take
            if room[k] > used[k]:
                heapq.heappush(by_cost, (cost + piece_cost(take), k))
            while length and waiting and -waiting[0][0] >= length:
                _, cost, k = heapq.heappop(waiting)
                heapq.heappush(by_cost, (cost, k))
    return pieces


def _pack_partition(path: str, sequence: int, block_tokens: int):
    def emit(held: list[np.ndarray], lengths: list[int], doc_ids: list, first: int) -> pa.RecordBatch:
        ids = memoryview(np.concatenate(held)).cast("B")
        begins = np.cumsum(lengths) - lengths
        pieces = sorted(pack(lengths, sequence), key=lambda p: (p[3], p[4]))
        room = capacities(sum(lengths), sequence)
        cols = np.array(pieces, dtype=np.int64).reshape(-1, 5)
        at = 4 * (begins[cols[:, 0]] + cols[:, 1])
        sums = [zlib.crc32(ids[a : a + 4 * n]) for a, n in zip(at.tolist(), cols[:, 2].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids).take(pa.array(cols[:, 0])),
                pa.array(cols[:, 1]),
                pa.array(cols[:, 2]),
                pa.array(sums, pa.int64()),
                pa.array(np.array(lengths, dtype=np.int64)[cols[:, 0]]),
                pa.array(cols[:, 3] + first),
                pa.array(cols[:, 4]),
                pa.array(np.array(room, dtype=np.int64)[cols[:, 3]]),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, CACHE_WORDS)
        first, held, lengths, doc_ids, tokens = -1, [], [], [], 0
        for batch in gather(slices(batches, ENCODE_ROWS), ENCODE_ROWS):
            if first < 0:
                first = batch["part"][0].as_py() << 40
            ids, starts = enc.encode(batch["text"])
            held.append(ids)
            lengths += np.diff(starts).tolist()
            doc_ids += batch["doc_id"].to_pylist()
            tokens += len(ids)
            if tokens >= block_tokens:
                yield _cast(emit(held, lengths, doc_ids, first), batch)
                first += len(capacities(tokens, sequence))
                held, lengths, doc_ids, tokens = [], [], [], 0
        if lengths:
            yield _cast(emit(held, lengths, doc_ids, first), batch)

    def _cast(out: pa.RecordBatch, like: pa.RecordBatch) -> pa.RecordBatch:
        return out.set_column(0, "doc_id", out["doc_id"].cast(like["doc_id"].type))

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack every document into sequences; one row per piece.

    Each partition packs its own documents in blocks, without a shuffle; sequence ids are the partition's number
    times 2^40 plus a count. Null texts are empty and hold the end id alone; repeated rows are packed as often as
    they occur; empty tables give no rows; columns other than doc_id and text are ignored.
    """
    rows = texts_of(docs).select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_pack_partition(tokenizer or default_tokenizer(), sequence, block_tokens)), PIECES.format(id_type))
