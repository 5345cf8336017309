"""Language model scoring with a weighted backoff automaton (operator 5).

The model is learnt from all training texts. Every word and every n-gram of two and three words, whatever its count, is a
state or an arc of an automaton whose table is distributed: no machine holds all of it. An n-gram's probability is its
count smoothed by the probability that the shorter context gives the word, as a Dirichlet prior of fixed weight:

    p(w | h) = (count(h w) + prior * p(w | shorter h)) / (count(h) + prior)

Where a state h has no arc for a word, its failure arc leads to the state of the shorter context and weighs
prior / (count(h) + prior), so that the probabilities of each state sum to 1. Without context a word has its discounted
share of all tokens, and the discounts are shared by the unseen words, whose number is estimated (Chao's estimator).

Texts travel in compressed blocks of bounded size. A block sends its n-grams with their training counts to parts by hash,
as differences of sorted keys, and gets the counts over all blocks back in the same order, without keys. A large corpus
goes there in two steps, so that rows stay large: blocks deal to groups of parts, bundles of as many blocks put their
n-grams of a group together and deal these to the group's parts, and counts come back the same way. From these a block
builds the part of the automaton that its texts visit, states, arcs and failure arcs, and walks all its texts in step, from
left to right: each carries its state, follows failure arcs where its state has no arc for the next word, and adds up what
the arcs weigh.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log10, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import raw_texts, release, stage_table, texts_of

#: Orders of n-grams in the automaton.
ORDER = 3
#: Weight of the shorter context's probability, by the length of the context.
PRIOR = {1: 1000.0, 2: 4.0}
#: Subtracted from each word's count and given to unseen words.
DISCOUNT = 0.75
#: Bytes of text in a block, but for a longer text, which is a block of its own; and rows at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 16
#: Training tokens for each part of the table of n-grams.
PART_TOKENS = 1_000_000
#: Parts that one task merges, one after the other.
PARTS_A_TASK = 8
#: Parts beyond which blocks deal to groups of parts, as many as a group has parts, about.
DIRECT_PARTS = 2_048
#: Words after which a text goes on as a walk of its own, from the state that the words before leave.
WALK = 4_096
#: Bits of a hash that tell n-grams of one part apart, and the other ones, which deal n-grams to parts.
KEY_BITS, PART_BITS = 36, 28
#: The end of a text, and its start as a context; words hold no white space.
END, START = b"\n", b"\t"

WORDS, GRAMS, TEXTS = 1, 2, 3
PACKED = "block long, texts long, tokens long, blob binary"
DEALT = "part int, kind int, block long, keys binary, counts binary"
MERGED = "block long, kind int, part int, blob binary, distinct long, once long, twice long"
SPREAD = "block long, kind int, part int, blob binary"


class _Ids(dict):
    """Numbers for words, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, and the end."""
    return [*text.lower().split(), END] if text else [END]


def _numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (START is 0), the numbers of all texts' words after a START each, and where the texts begin."""
    number = _Ids({START: 0, END: 1})
    ids, starts, at = [], [], 0
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(number.__getitem__, (START, *words)), np.int32, len(words) + 1))
        starts.append(at)
        at += len(words) + 1
    return list(number), np.concatenate(ids), np.array(starts)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) + b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _hashes(names: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(names, object), categorize=False)


def _places(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the two and of the three words that end at each place, and whether there are such; none spans an end."""
    own = hashes[ids]
    two, three = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
    two[1:] = _mix(own[:-1], own[1:])
    three[1:] = _mix(two[:-1], own[1:])
    is_two = ids != 0
    is_three = is_two.copy()
    is_three[1:] &= is_two[:-1]
    return two, three, is_two, is_three


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys & np.uint64((1 << PART_BITS) - 1)) % np.uint64(parts)


def _grams_of(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as part and key in one number, ascending, and the place of each of keys among them."""
    return np.unique(_part_of(keys, parts) << np.uint64(KEY_BITS) | keys >> np.uint64(PART_BITS), return_inverse=True)


def _words_of_parts(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by part and hash, and their parts in that order."""
    part = _part_of(hashes, parts)
    order = np.lexsort((hashes, part))
    return order, part[order]


def _press(values: np.ndarray, width: int = 8) -> bytes:
    """How many numbers there are, and the numbers, below 2^(8 * width), byte by byte of all of them, compressed; bytes that are 0 take no room."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpress(blob: bytes, width: int = 8) -> np.ndarray:
    count = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], count * width, codec="zstd"), np.uint8).reshape(width, count)
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _spans(part: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal numbers begin and end."""
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: its number, training texts and tokens, and all of its rows (doc_id, held_out, text), compressed."""
    held: list[pa.RecordBatch] = []
    task, count, rows, size, tokens, texts = 0, 0, 0, 0, 0, 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        own = pa.concat_batches(held)
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(own)
        number = (task << 32) + count
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([texts], pa.int64()), pa.array([tokens], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "texts", "tokens", "blob"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        task, begin = batch["task"][0].as_py(), 0
        own = batch.select(["doc_id", "held_out", "text"])
        for k, (text, out) in enumerate(zip(raw_texts(batch["text"]), batch["held_out"].to_pylist(), strict=True)):
            length = len(text) if text else 0
            if rows and (size + length > BLOCK_BYTES or rows >= BLOCK_ROWS):
                held.append(own.slice(begin, k - begin))
                yield block()
                held, begin, count, rows, size, tokens, texts = [], k, count + 1, 0, 0, 0, 0
            rows, size = rows + 1, size + length
            if not out:
                tokens, texts = tokens + (len(text.split()) if text else 0) + 1, texts + 1
        held.append(own.slice(begin))
    if rows:
        yield block()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _rows(block: int, parts: int, each: int, hashes: np.ndarray, hash_counts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Words and n-grams (ascending) with their counts as rows, one for each kind and each group of so many parts."""
    out = []
    order, part = _words_of_parts(hashes, parts)
    group = part // np.uint64(each)
    for a, b in _spans(group):
        out.append((int(group[a]), WORDS, block, hashes[order[a:b]].tobytes(), _press(hash_counts[order[a:b]])))
    group = (keys >> np.uint64(KEY_BITS)) // np.uint64(each)
    for a, b in _spans(group):
        first = np.uint64(int(group[a]) * each << KEY_BITS)
        out.append((int(group[a]), GRAMS, block, _press(np.diff(keys[a:b], prepend=first)), _press(counts[a:b])))
    cols = zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["part", "kind", "block", "keys", "counts"])


def _deal(parts: int, each: int):
    """Per block and group of so many parts: its words and its n-grams, ascending, with their training counts."""

    def dealt(block: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        names, ids, starts = _numbered(raw_texts(rows["text"]))
        train = np.repeat(~rows["held_out"].to_numpy(zero_copy_only=False), np.diff([*starts, len(ids)]))
        hashes = _hashes(names)
        two, three, is_two, is_three = _places(ids, hashes)
        keys, inverse = _grams_of(np.concatenate([two[is_two], three[is_three]]), parts)
        counts = np.bincount(inverse, np.concatenate([train[is_two], train[is_three]]), len(keys)).astype(np.int64)
        return _rows(block, parts, each, hashes[1:], np.bincount(ids[train], minlength=len(names))[1:], keys, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                yield dealt(block, _unpack(blob.as_py()))
                release()

    return run


def _summed(kind: int, rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of dealt rows, ascending, and the sums of their counts."""
    found = [_row(kind, *r) for r in rows]
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)


def _bundle(parts: int, each: int):
    """Rows sorted by unit, a bundle's n-grams of one group of so many parts: put together, and dealt to the group's parts."""

    def dealt(unit: int, group: int, rows: dict[int, list[tuple[bytes, bytes]]]) -> pa.RecordBatch:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes, hash_counts = _summed(WORDS, rows[WORDS]) if rows[WORDS] else empty
        keys, counts = _summed(GRAMS, rows[GRAMS]) if rows[GRAMS] else empty
        return _rows(unit, parts, 1, hashes, hash_counts, keys + np.uint64(group * each << KEY_BITS), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for unit, group, kind, *row in zip(*[batch[c].to_pylist() for c in ("unit", "part", "kind", "keys", "counts")], strict=True):
                if (unit, group) != at:
                    if at:
                        yield dealt(*at, held)
                        release()
                    at, held = (unit, group), {WORDS: [], GRAMS: []}
                held[kind].append(tuple(row))
        if at:
            yield dealt(*at, held)

    return run


def _spread(parts: int):
    """Rows sorted by unit, kind and part: the totals of a bundle's keys (block is null), then its blocks' rows, which get theirs."""

    def totals(kind: int, sums: list[bytes], rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = [np.frombuffer(k, np.uint64) if kind == WORDS else np.cumsum(_unpress(k), dtype=np.uint64) for _, _, k in rows]
        keys, own = np.unique(np.concatenate(found)), np.concatenate([_unpress(b) for b in sums])
        if kind == WORDS:
            order, _ = _words_of_parts(keys, parts)
            by_key = np.empty_like(own)
            by_key[order] = own
            own = by_key
        blobs = [_press(own[np.searchsorted(keys, k)]) for k in found]
        cols = [pa.array([b for b, _, _ in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([g for _, g, _ in rows], pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["block", "kind", "part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, rows = None, [], []
        for batch in batches:
            for unit, kind, part, block, data in zip(*[batch[c].to_pylist() for c in ("unit", "kind", "part", "block", "data")], strict=True):
                if (unit, kind) != at:
                    if at:
                        yield totals(at[1], sums, rows)
                        release()
                    at, sums, rows = (unit, kind), [], []
                if block is None:
                    sums.append(data)
                else:
                    rows.append((block, part, data))
        if at:
            yield totals(at[1], sums, rows)

    return run


def _row(kind: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A dealt row's keys and counts."""
    found = np.frombuffer(keys, np.uint64) if kind == WORDS else np.cumsum(_unpress(keys), dtype=np.uint64)
    return found, _unpress(counts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and kind: for each row the counts of its keys over all rows; and how many words there are, and occur once and twice."""

    def merged(part: int, kind: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        found = [_row(kind, k, c) for _, k, c in rows]
        keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
        ends = np.cumsum([len(k) for k, _ in found])
        blobs = [_press(totals[own]) for own in np.split(inverse, ends[:-1])]
        blocks, kinds = [b for b, _, _ in rows], [kind] * len(rows)
        seen = [None] * len(rows)
        if kind == WORDS:
            blocks, kinds, blobs = [-1, *blocks], [0, *kinds], [None, *blobs]
        stats = [[int(x), *seen] if kind == WORDS else seen for x in ((totals > 0).sum(), (totals == 1).sum(), (totals == 2).sum())]
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blobs, pa.binary()), *[pa.array(x, pa.int64()) for x in stats]],
            ["block", "kind", "part", "blob", "distinct", "once", "twice"],
        )

    at, held = None, []
    for batch in batches:
        for p, kind, *row in zip(*[batch[c].to_pylist() for c in ("part", "kind", "block", "keys", "counts")], strict=True):
            if (p, kind) != at and held:
                yield merged(*at, held)
                held = []
                release()
            at = (p, kind)
            held.append(row)
    if held:
        yield merged(*at, held)


def unseen_words(once: int, twice: int) -> float:
    """Chao's estimate of the number of words that no training text holds, from those that occur once and twice; 1 at least."""
    return max(1.0, once * once / (2 * twice) if twice else once * (once - 1) / 2)


class Vocabulary:
    """What all texts share: training tokens, texts, distinct words and unseen ones."""

    def __init__(self, tokens: int, texts: int, distinct: int, once: int, twice: int):
        self.tokens, self.texts, self.distinct = tokens, texts, distinct
        self.unseen = unseen_words(once, twice)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities, without context, of words with these training counts; 1 for all words if there are no tokens."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - DISCOUNT, DISCOUNT * self.distinct / self.unseen) / self.tokens


class Arcs:
    """States, arcs and failure arcs as arrays; state 0 has no context, and every word is numbered.

    keys are state * words + word of the arcs of all other states, ascending, with weight and target (a state) of each;
    state 0 has an arc for every word: root and root_target by word. fail and fail_weight are by state.
    """

    def __init__(self, words: int, fail: np.ndarray, fail_weight: np.ndarray, arcs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], root: np.ndarray, root_target: np.ndarray):
        state, word, weight, target = arcs
        keys = state * words + word
        order = np.argsort(keys)
        self.words, self.keys, self.weight, self.target = words, np.append(keys[order], np.iinfo(np.int64).max), weight[order], target[order]
        self.fail, self.fail_weight, self.root, self.root_target = fail, fail_weight, root, root_target
        self.failures = 0  # failure arcs that walks have taken

    def walk(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """What the words at the places from begin to end of each walk weigh, all walks in step, from their states on."""
        order = np.argsort(begin - end, kind="stable")  # the longest first
        at, left, state = begin[order].copy(), (end - begin)[order], state[order].copy()
        ends = np.searchsorted(-left, -np.arange(1, left[0] + 1 if len(left) else 1), side="right")  # walks of more than so many words
        out = np.zeros(len(left))
        for active in ends.tolist():
            word, now = ids[at[:active]], state[:active]
            total, after = np.zeros(active), np.zeros(active, np.int64)
            todo = np.arange(active)
            while len(todo):
                own, read = now[todo], word[todo]
                place = np.searchsorted(self.keys, own * self.words + read)
                hit = (self.keys[place] == own * self.words + read) & (own > 0)
                found = todo[hit]
                total[found] += self.weight[place[hit]]
                after[found] = self.target[place[hit]]
                if hit.all():
                    break
                bare = own == 0
                found = todo[bare]
                total[found] += self.root[word[found]]
                after[found] = self.root_target[word[found]]
                todo = todo[~hit & ~bare]
                self.failures += len(todo)
                total[todo] += self.fail_weight[now[todo]]
                now[todo] = self.fail[now[todo]]
            out[:active] += total
            state[:active] = after
            at[:active] += 1
        back = np.empty_like(out)
        back[order] = out
        return back


def block_arcs(shared: Vocabulary, ids: np.ndarray, counts: np.ndarray, grams: tuple[np.ndarray, np.ndarray], times: np.ndarray) -> tuple[Arcs, np.ndarray]:
    """The part of the automaton that a block's texts visit, and the state after each place.

    ids are the words at all places, counts how often the corpus has each word, START as often as texts. grams are, by
    place, the numbers of the two and of the three words that end there (-1: none), and times the corpus's counts by number.
    """
    two, three = grams
    words = len(counts)
    is_two, is_three = two >= 0, three >= 0
    # States: 0, words that the corpus has, and pairs that it has and that a text goes on from.
    word_state = np.where(counts > 0, np.cumsum(counts > 0), 0)
    last = np.full(len(times), -1, np.int64)
    last[two[is_two]] = np.flatnonzero(is_two)
    pairs = np.flatnonzero((last >= 0) & (times > 0))
    pair_state = np.zeros(len(times), np.int64)
    pair_state[pairs] = int((counts > 0).sum()) + 1 + np.arange(len(pairs))
    a, b = ids[last[pairs] - 1], ids[last[pairs]]
    of_word, of_pair = counts[counts > 0].astype(np.float64), times[pairs].astype(np.float64)
    fail = np.concatenate([np.zeros(1 + len(of_word), np.int64), word_state[b]])
    fail_weight = np.concatenate([[0.0], np.log10(PRIOR[1] / (of_word + PRIOR[1])), np.log10(PRIOR[2] / (of_pair + PRIOR[2]))])
    # Arcs of one-word states, then of two-word states; an n-gram's weight goes back to the shorter one's.
    by_word = shared.word(counts)
    p2 = np.zeros(len(times))
    p2[pairs] = (of_pair + PRIOR[1] * by_word[b]) / (counts[a] + PRIOR[1])
    seen = np.full(len(times), -1, np.int64)
    seen[three[is_three]] = np.flatnonzero(is_three)
    triples = np.flatnonzero((seen >= 0) & (times > 0))
    at = seen[triples]
    before, after = two[at - 1], two[at]
    some = (times[before] > 0) & (times[after] > 0)  # always, but for n-grams that share a hash
    triples, at, before, after = triples[some], at[some], before[some], after[some]
    p3 = (times[triples] + PRIOR[2] * p2[after]) / (times[before] + PRIOR[2])
    some = word_state[a] > 0
    arcs = (
        np.concatenate([word_state[a][some], pair_state[before]]), np.concatenate([b[some], ids[at]]).astype(np.int64),
        np.log10(np.concatenate([p2[pairs][some], p3])), np.concatenate([pair_state[pairs][some], pair_state[after]]),
    )
    reached = np.where(is_two & (pair_state[two] > 0), pair_state[two], word_state[ids])
    return Arcs(words, fail, fail_weight, arcs, np.log10(by_word), word_state), reached


def _score(shared: Vocabulary, parts: int, walk: int):
    """Rows sorted by block, kind and part: counts of its words and n-grams, then its texts."""

    def scored(totals: dict[int, list[bytes]], rows: pa.RecordBatch) -> pa.RecordBatch:
        names, ids, starts = _numbered(raw_texts(rows["text"]))
        hashes = _hashes(names)
        order, _ = _words_of_parts(hashes[1:], parts)
        counts = np.zeros(len(names), np.int64)
        counts[1 + order] = np.concatenate([_unpress(blob) for blob in totals[WORDS]])
        floor = log10(1 / (shared.tokens + shared.distinct + 1))
        ends = np.array([*starts[1:], len(ids)])
        lengths = ends - starts - 1
        known = np.add.reduceat((counts > 0)[ids].astype(np.int64), starts)
        base = np.add.reduceat(np.log10(counts + 1.0)[ids], starts) + lengths * floor
        two, three, is_two, is_three = _places(ids, hashes)
        _, inverse = _grams_of(np.concatenate([two[is_two], three[is_three]]), parts)
        grams = np.full((2, len(ids)), -1, np.int64)
        grams[0][is_two], grams[1][is_three] = inverse[: int(is_two.sum())], inverse[int(is_two.sum()) :]
        counts[0] = shared.texts
        arcs, reached = block_arcs(shared, ids, counts, (grams[0], grams[1]), np.concatenate([_unpress(blob) for blob in totals[GRAMS]]).astype(np.int64))
        # A text's first walk starts behind START; a long text goes on from the state that its words before leave.
        walks = [(k, at, min(at + walk, end)) for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) for at in range(start + 1, end, walk)]
        owner, begin, end = np.array(walks, np.int64).T
        score = np.bincount(owner, arcs.walk(ids, begin, end, reached[begin - 1]), len(starts))
        return pa.RecordBatch.from_arrays(
            [
                rows["doc_id"], rows["held_out"], pa.array(lengths, pa.int64()), pa.array(known, pa.int64()),
                pa.array([shared.tokens] * len(starts), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, totals = None, {}
        for batch in batches:
            for block, kind, blob in zip(batch["block"].to_pylist(), batch["kind"].to_pylist(), batch["blob"], strict=True):
                if block != at:
                    at, totals = block, {WORDS: [], GRAMS: []}
                if kind == TEXTS:
                    yield scored(totals, _unpack(blob.as_py()))
                    release()
                else:
                    totals[kind].append(blob.as_py())

    return run


class Automaton:
    """The automaton of a small corpus on one machine: the plain form that scores are checked with.

    State 0 has no context. arcs[s] maps a word to its log10 probability; fail and weight are the failure arcs.
    """

    def __init__(self, texts: list[list[bytes]], order: int = ORDER):
        """From the words of training texts, without their ends."""
        padded = [[START, *t, END] for t in texts]
        grams = Counter(tuple(t[i : i + k]) for t in padded for k in range(1, order + 1) for i in range(len(t) - k + 1))
        words = {g[0]: n for g, n in grams.items() if len(g) == 1 and g != (START,)}
        of = Counter(words.values())
        shared = Vocabulary(sum(words.values()), len(texts), len(words), of[1], of[2])
        self.vocabulary, self.unknown = shared, log10(shared.word(np.zeros(1))[0])
        contexts = [(), *sorted({g[:-1] for g in grams if len(g) > 1}, key=lambda c: (len(c), c))]
        self.state = {c: k for k, c in enumerate(contexts)}
        self.arcs: list[dict[bytes, float]] = [{} for _ in contexts]
        self.arcs[0] = {w: log10(p) for w, p in zip(words, shared.word(np.array(list(words.values()))), strict=True)} if words else {}
        self.fail, self.weight = [0] * len(contexts), [0.0] * len(contexts)
        for c in contexts[1:]:
            self.fail[self.state[c]] = self.longest(c[1:])
            self.weight[self.state[c]] = log10(PRIOR[len(c)] / (grams[c] + PRIOR[len(c)]))
        for g in sorted((g for g in grams if len(g) > 1), key=len):
            s, prior = self.state[g[:-1]], PRIOR[len(g) - 1]
            self.arcs[s][g[-1]] = log10((grams[g] + prior * 10 ** self.step(self.fail[s], g[-1])) / (grams[g[:-1]] + prior))

    def longest(self, context: tuple[bytes, ...]) -> int:
        """The state of the longest end of a context."""
        while context not in self.state:
            context = context[1:]
        return self.state[context]

    def step(self, s: int, word: bytes) -> float:
        """log10 probability of a word in a state: failure arcs until one has the word."""
        total = 0.0
        while s and word not in self.arcs[s]:
            total, s = total + self.weight[s], self.fail[s]
        return total + self.arcs[s].get(word, self.unknown)

    def score(self, words: list[bytes]) -> float:
        """log10 probability of a text's words and its end: one traversal that carries the state."""
        context, total = (START,), 0.0
        for word in [*words, END]:
            total += self.step(self.longest(context), word)
            context = (*context, word)[-ORDER + 1 :]
        return total


def _totals(dealt: DataFrame, parts: int) -> DataFrame:
    """Dealt rows merged by part, and written: counts for each row, and how many words there are."""
    dealt = dealt.repartition(max(1, -(-parts // PARTS_A_TASK)), "part") if parts > PARTS_A_TASK else dealt.repartition("part")
    return stage_table(dealt.sortWithinPartitions("part", "kind").mapInArrow(_merge, MERGED), "counts")


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out is a boolean column (null counts as false); the model learns from the other rows. base_score is the add-one
    unigram log10 probability, score that of the automaton. Null and empty texts are their end alone; repeated rows count
    as often as they occur; with no training rows all words are unknown and certain; empty tables give no rows. Other
    columns are ignored.
    """
    out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    rows = texts_of(docs).select("doc_id", out, "text", F.spark_partition_id().cast("long").alias("task"))
    blocks = stage_table(rows.mapInArrow(_pack, PACKED), "blocks")
    tokens, texts = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    parts = min(max(1, -(-tokens // PART_TOKENS)), 1 << PART_BITS)
    each = 1 if parts <= DIRECT_PARTS else ceil(sqrt(parts))
    dealt = blocks.select("block", "blob").mapInArrow(_deal(parts, each), DEALT)
    if each > 1:
        # Bundles of as many blocks as there are groups hold about as many n-grams of a group as a block of all.
        bundles = -(-blocks.count() // -(-parts // each))
        unit = F.col("part") * F.lit(bundles).cast("long") + F.pmod(F.xxhash64("block"), F.lit(bundles))
        dealt = stage_table(dealt.withColumn("unit", unit), "dealt")
        units = max(1, -(-parts // each) * bundles // PARTS_A_TASK)
        bundled = dealt.repartition(units, "unit").sortWithinPartitions("unit").mapInArrow(_bundle(parts, each), DEALT)
        counts = _totals(bundled, parts)
        sums = counts.where("kind > 0").select(F.col("block").alias("unit"), "kind", "part", F.lit(None).cast("long").alias("block"), F.col("blob").alias("data"))
        both = sums.unionAll(dealt.select("unit", "kind", "part", "block", F.col("keys").alias("data")))
        together = both.repartition(units, "unit").sortWithinPartitions("unit", "kind", "part").mapInArrow(_spread(parts), SPREAD)
    else:
        counts = _totals(dealt, parts)
        together = counts.where("kind > 0").select("block", "kind", "part", "blob")
    stats = counts.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "once", "twice")]).first()
    together = together.unionAll(blocks.select("block", F.lit(TEXTS).alias("kind"), F.lit(0).alias("part"), "blob"))
    together = together.repartition("block").sortWithinPartitions("block", "kind", "part")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(_score(Vocabulary(tokens, texts, *stats), parts, WALK), schema)
