"""Benchmark decontamination: BM25 retrieval of test items for every passage, then verification (operator 10).

The test items are an inverted index with BM25 impacts, and every passage (an overlapping window of a document) is a
query for block-max WAND. An item is retrieved if a passage reaches its threshold, so impacts are divided by their item's
threshold and all items share one: 1. Postings lie in blocks of items, in ascending order of thresholds, that know each
term's largest impact. A passage has a cursor on each of its terms' blocks. Sorted by block, the cursors' largest impacts
anywhere are added up until they reach the threshold: the block there is the pivot, and no block before it can hold an
item above the threshold, so that all cursors before it move to it. If the maxima within the pivot block reach the
threshold as well, its items are scored. Many passages are traversed in step, as rows of arrays. All items above the
threshold are kept, and verified by the share of their question's and answer's five-word shingles that the document holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vociflow.llm.common import hold, slices, stage_table, texts_of, tidy

#: Words of a passage and between passages: an item of STRIDE words or fewer lies whole in some passage.
PASSAGE, STRIDE = 128, 64
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Share that a passage must reach of the lowest score among the forms of an item that make a leak.
THRESHOLD = 0.6
#: Items in a block of the postings.
BLOCK = 4
#: Passages that are traversed together, and postings that are laid out at a time: they bound memory, whatever the index.
PASSAGES, POSTINGS = 1000, 2_000_000
#: Terms times blocks up to which an index has a table instead of a binary search.
FOLLOWING = 2_000_000
#: What sums of numbers in single precision may lack; scores are exact.
SLACK = 1e-5
#: Words of a shingle and share of shingles to be found for a leak.
SHINGLE, OVERLAP = 5, 0.8
#: Words from which a question alone makes a leak.
QUESTION_WORDS = 13
#: Items in one index, which is broadcast; more items are searched in several passes. Texts searched together.
MAX_ITEMS, TEXTS = 50_000, 500

_not_word = re.compile(r"[\W_]+")


def normal(word: bytes) -> str:
    """A word's letters and digits, in lower case; empty if it has none."""
    return _not_word.sub("", word.decode().lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item: its last sentence is the answer, if another comes before it."""
    sentences = [s for s in (text or "").replace("\n", ". ").split(". ") if normal(s.encode())]
    words = [[w for w in (normal(x) for x in s.encode().split()) if w] for s in sentences]
    question, answer = sum(words[:-1], []), words[-1] if words else []
    return (question, answer) if question else (answer, answer)


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of so many ids; runs with an id below 0 are 0."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    acc, bad = np.zeros(len(ids) - size + 1, np.uint64), np.zeros(len(ids) - size + 1, bool)
    for j in range(size):
        own = ids[j : len(ids) - size + 1 + j]
        bad |= own < 0
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own.astype(np.uint64) + np.uint64(1)
    return np.where(bad, 0, acc)


def _shingles(ids: np.ndarray) -> tuple[int, np.ndarray]:
    """Shingle size (SHINGLE, or the words there are) and the distinct shingles."""
    size = min(SHINGLE, len(ids))
    return size, np.unique(_grams(ids, size)) if size else np.zeros(0, np.uint64)


@dataclass
class Level:
    """Postings by blocks of items: term t has the blocks, and the largest impacts in them, from starts[t] to starts[t + 1]."""

    size: int
    count: int
    starts: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    #: Term and block of each posting as one number, ascending.
    keys: np.ndarray
    #: For each such number the first posting that is not before it, if there are FOLLOWING numbers or fewer.
    following: np.ndarray | None

    def seek(self, key: np.ndarray) -> np.ndarray:
        """The first postings that are not before terms and blocks."""
        return np.searchsorted(self.keys, key) if self.following is None else self.following[key]


@dataclass
class Index:
    """Test items as an inverted index with impacts; impacts are shares of their item's threshold."""

    item_ids: list
    terms: dict[str, int]
    #: Postings by block and by item, and each term's largest impact.
    blocks: Level
    items: Level
    largest: np.ndarray
    threshold: np.ndarray
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]
    whole: list[tuple[int, np.ndarray]]
    question_words: list[int]


def _lowest(ids: np.ndarray, own: np.ndarray) -> float:
    """The lowest score of what some passage holds of these words: all of them, or STRIDE words or more."""
    windows = range(0, max(1, len(ids) - STRIDE + 1))
    return min(own[np.unique(ids[w : w + STRIDE], return_index=True)[1] + w].sum() for w in windows)


def _lowest_form(ids: np.ndarray, own: np.ndarray, cut: int, question: np.ndarray, answer: np.ndarray, whole: np.ndarray) -> float:
    """The lowest score that a form of an item gives which makes a leak (see leaks).

    The item is ids with impacts own, and its question ends at cut. Forms are the whole item, its question or answer alone if
    that is enough, and both in passages far from each other, of which the better one counts.
    """
    forms = [_lowest(ids, own)]
    if cut < len(ids):
        q, a = _lowest(ids[:cut], own[:cut]), _lowest(ids[cut:], own[cut:])
        share = lambda *found: np.isin(whole, np.concatenate(found)).mean()
        if cut >= QUESTION_WORDS or share(question) >= OVERLAP:
            forms.append(q)
        if share(answer) >= OVERLAP:
            forms.append(a)
        if share(question, answer) >= OVERLAP:
            forms.append(max(q, a))
    return min(forms)


def _words(text: str | None) -> list[str]:
    """The words of an item, empty for one without any."""
    question, answer = parts(text or "")
    return question + answer if question is not answer else question


@dataclass
class Statistics:
    """What BM25 needs to know of a whole benchmark: items with words, their words, and the items that hold each word."""

    items: int
    words: int
    holding: Counter

    def add(self, texts: list[str | None]) -> None:
        for words in filter(None, map(_words, texts)):
            self.items += 1
            self.words += len(words)
            self.holding.update(set(words))


def build_index(items: list[tuple[int, str | None]], statistics: Statistics | None = None) -> Index:
    """Index (item_id, text) rows; items without words are left out, and equal items are separate ones.

    statistics are those of the whole benchmark, if items are a part of it.
    """
    split = [(i, *parts(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) if parts(t or "")[1]]
    words = [q + a if q is not a else q for _, q, a in split]
    terms: dict[str, int] = {}
    ids = [np.array([terms.setdefault(w, len(terms)) for w in ws], np.int64) for ws in words]
    n = len(ids)
    lengths = np.array([len(x) for x in ids], float)
    mean = (statistics.words / statistics.items if statistics else lengths.mean()) if n else 1.0
    term_of, item_of, tf = [], [], []
    for k, x in enumerate(ids):
        found, counts = np.unique(x, return_counts=True)
        term_of.append(found)
        item_of.append(np.full(len(found), k))
        tf.append(counts)
    term_of, item_of, tf = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (term_of, item_of, tf))
    df = np.bincount(term_of, minlength=len(terms))
    held, total = (np.array([statistics.holding[w] for w in terms], float), statistics.items) if statistics else (df, n)
    idf = np.log1p((total - held + 0.5) / (held + 0.5))
    impact = idf[term_of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item_of] / mean)) if n else np.zeros(0)
    order = np.lexsort((term_of, item_of))
    term_of, item_of, impact = term_of[order], item_of[order], impact[order]
    by_item = np.searchsorted(item_of, np.arange(n + 1))
    marks = [[_shingles(np.array([terms[w] for w in ws], np.int64)) for ws in (q, a, q + a if q is not a else q)] for _, q, a in split]
    threshold = np.zeros(n)
    for k, x in enumerate(ids):
        own = impact[by_item[k] + np.searchsorted(term_of[by_item[k] : by_item[k + 1]], x)]
        _, q, a = split[k]
        threshold[k] = THRESHOLD * _lowest_form(x, own, len(q) if q is not a else len(x), *[m for _, m in marks[k]])
    # Items with like thresholds share blocks, so that a short item's large shares do not loosen the bounds of long ones.
    order = np.argsort(threshold, kind="stable")
    place = np.argsort(order)
    share, item_of = impact / threshold[item_of] if n else impact, place[item_of]
    pick = lambda xs: [xs[k] for k in order.tolist()]
    blocks, items_ = (_level(size, n, len(terms), term_of, item_of, share) for size in (BLOCK, 1))
    largest = np.maximum.reduceat(blocks.maxima, blocks.starts[:-1]) if terms else np.zeros(0)
    return Index(
        pick([i for i, _, _ in split]), terms, blocks, items_, largest.astype(np.float32), threshold[order], *[pick([m[j] for m in marks]) for j in range(3)],
        pick([len(q) for _, q, _ in split]),
    )


def _level(size: int, items: int, terms: int, term_of: np.ndarray, item_of: np.ndarray, share: np.ndarray) -> Level:
    count = -(-items // size)
    keys = term_of * count + item_of // size
    order = np.argsort(keys, kind="stable")
    keys, share = keys[order], share[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, maxima = keys[firsts], np.maximum.reduceat(share, firsts) if len(firsts) else np.zeros(0)
    starts = np.searchsorted(keys, np.arange(terms + 1) * count)
    following = np.searchsorted(keys, np.arange(terms * count)).astype(np.int32) if terms * count <= FOLLOWING else None
    return Level(size, count, starts, keys % max(1, count), maxima, keys, following)


class _Terms(dict):
    """Term ids of raw words, -1 for words that no item has and -2 for those without a letter or digit."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        plain = normal(word)
        value = self.terms.get(plain, -1) if plain else -2
        if len(self) < 200_000:
            self[word] = value
        return value


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each lo to hi, and the place of the range that each is of."""
    counts = hi - lo
    at = np.repeat(np.arange(len(lo)), counts)
    return at, np.arange(len(at)) + np.repeat(lo - (np.cumsum(counts) - counts), counts)


def _traverse(index: Index, ids: np.ndarray, passage_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block), by passage, of the blocks that block-max WAND scores: rows of arrays are passages, columns cursors."""
    level, last = index.blocks, np.uint32(index.blocks.count)
    first = np.flatnonzero(np.concatenate([[True], passage_of[1:] != passage_of[:-1]]))
    passages, sizes = passage_of[first], np.diff([*first, len(passage_of)])
    width = int(sizes.max())
    column = np.arange(width, dtype=np.uint32)
    there = column < sizes[:, None]
    term = np.zeros(there.shape, np.int32)
    term[there] = ids
    at, end = level.starts[term].astype(np.int32), level.starts[term + 1].astype(np.int32)
    most = np.where(there, index.largest[term], np.float32(0))
    block = np.where(there, level.blocks[at].astype(np.uint32), last)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def move(cursor: np.ndarray, to: np.ndarray) -> None:
        """Set cursors to postings; those behind their term's last one are over, and count nothing."""
        over = to >= end.ravel()[cursor]
        at.ravel()[cursor] = to
        block.ravel()[cursor] = np.where(over, last, level.blocks[np.minimum(to, len(level.blocks) - 1)].astype(np.uint32))
        most.ravel()[cursor[over]] = 0

    while True:
        order = np.sort(block << np.uint32(8) | column, 1)
        places = (np.arange(len(order)) * width)[:, None] + (order & np.uint32(255))
        reached = np.cumsum(most.ravel()[places], 1) >= 1 - SLACK
        pivot = order[np.arange(len(order)), reached.argmax(1)] >> np.uint32(8)
        going = reached[:, -1] & (pivot < last)
        if not going.all():
            passages, term, at, end, most, block, pivot = (x[going] for x in (passages, term, at, end, most, block, pivot))
        if not len(passages):
            break
        behind = np.flatnonzero(block < pivot[:, None])
        key = term.ravel()[behind].astype(np.int64) * level.count + pivot[behind // width]
        move(behind, np.minimum(level.seek(key), end.ravel()[behind]).astype(np.int32))
        on = np.flatnonzero(block == pivot[:, None])
        bound = np.bincount(on // width, level.maxima[at.ravel()[on]], len(passages))
        scored = bound >= 1 - SLACK
        out.append((passages[scored], pivot[scored].astype(np.int64)))
        move(on, at.ravel()[on] + 1)
    passage, block = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((block, passage))
    return passage[order], block[order]


def _reached(level: Level, passage: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score), ascending, of the items whose score reaches the threshold, from ranges of postings."""
    at, posting = _ranges(lo, hi)
    cells, inverse = np.unique(passage[at] * level.count + level.blocks[posting], return_inverse=True)
    score = np.bincount(inverse, level.maxima[posting], len(cells))
    good = score >= 1 - 1e-9
    return cells[good] // level.count, cells[good] % level.count, score[good]


def _runs(passage: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Slices of rows, without parting a passage, whose sizes sum up to POSTINGS at most but for a single passage."""
    ends, a = np.cumsum(size), 0
    while a < len(passage):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, "right"))
        if b < len(passage):
            b = int(np.searchsorted(passage, passage[b]))
        b = b if b > a else int(np.searchsorted(passage, passage[a], "right"))
        yield slice(a, b)
        a = b


def search(index: Index, ids: np.ndarray, passage_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all items that reach their threshold in a passage.

    ids are the distinct terms, 255 at most, of the passages in passage_of, which ascend.
    """
    level, out = index.items, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    starts = np.flatnonzero(np.concatenate([[True], passage_of[1:] != passage_of[:-1]])) if level.count and len(ids) else []
    for a in range(0, len(starts), PASSAGES):
        own = slice(starts[a], starts[a + PASSAGES] if a + PASSAGES < len(starts) else len(ids))
        passage, block = _traverse(index, ids[own], passage_of[own])
        # The terms of each passage, for each of its blocks: their postings in that block.
        first, last = np.searchsorted(passage_of, passage), np.searchsorted(passage_of, passage, "right")
        for some in _runs(passage, last - first):
            at, term = _ranges(first[some], last[some])
            base, item = ids[term] * level.count, block[some][at] * BLOCK
            lo = np.searchsorted(level.keys, base + np.minimum(item, level.count))
            hi = np.searchsorted(level.keys, base + np.minimum(item + BLOCK, level.count))
            has = hi > lo
            out.append(_reached(level, passage[some][at][has], lo[has], hi[has]))
    passage, item, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return passage, item, score * index.threshold[item] if len(item) else score


def _word_ids(texts: pa.Array, known: _Terms) -> list[np.ndarray]:
    """The terms of each text's words, without those that have no letter or digit: Arrow splits the texts and numbers their words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    numbered = lists.flatten().dictionary_encode()
    words = numbered.dictionary.cast(pa.binary()).to_pylist()
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[numbered.indices.to_numpy()] if words else np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    keep = ids > -2
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return np.split(ids[keep], ends[1:-1]) if len(lists) else []


def leaks(index: Index, texts: pa.Array, known: _Terms) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item, score, overlap, question overlap, answer overlap) of all verified leaks in the texts."""
    docs, terms, passage_of, owner = _word_ids(texts, known), [], [], []
    count = 0
    for k, ids in enumerate(docs):
        windows = max(1, -(-(len(ids) - STRIDE) // STRIDE)) if len(ids) else 0
        places = np.flatnonzero(ids >= 0)
        if len(places):
            own = places // STRIDE
            for step in (0, 1):  # a word at place p is in the passages that start at p // STRIDE and one before
                window = own - step
                ok = (window >= 0) & (window < windows)
                terms.append(ids[places[ok]])
                passage_of.append(window[ok] + count)
        owner.append(np.full(windows, k))
        count += windows
    if not terms:
        return []
    owner = np.concatenate(owner)
    size = len(index.terms)
    cells = np.sort(np.concatenate(passage_of) * size + np.concatenate(terms))
    cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])]
    passage, item, score = search(index, cells % size, cells // size)
    best: dict[tuple[int, int], float] = {}
    for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist(), strict=True):
        key = (int(owner[p]), i)
        best[key] = max(best.get(key, 0.0), s)
    out = []
    grams: dict[tuple[int, int], np.ndarray] = {}
    for (k, i), s in sorted(best.items()):
        shares = []
        for length, wanted in (index.whole[i], index.question[i], index.answer[i]):
            if (k, length) not in grams:
                grams[k, length] = np.unique(_grams(docs[k], length))
            shares.append(float(np.isin(wanted, grams[k, length]).mean()))
        if shares[0] >= OVERLAP or (shares[1] >= OVERLAP and index.question_words[i] >= QUESTION_WORDS):
            out.append((k, i, s, *shares))
        if len(grams) > 2000:
            grams.clear()
    return out


def indexes(benchmark: DataFrame, max_items: int = MAX_ITEMS) -> tuple[int, Iterator[Index]]:
    """How many indexes of about max_items each hold all test items (item_id, text), and the indexes in turn.

    The driver reads one slice at a time. Scores and thresholds are those of one index over all items.
    """
    shards = -(-benchmark.count() // max_items)
    slice_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards)))
    read = lambda k: [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").where(slice_of == k).collect()]

    def made() -> Iterator[Index]:
        statistics = None
        if shards > 1:
            statistics = Statistics(0, 0, Counter())
            for k in range(shards):
                statistics.add([text for _, text in read(k)])
        for k in range(shards):
            yield build_index(read(k), statistics)

    return shards, made()


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """A row for each document and test item that leaked into it: doc_id, item_id, score, overlap, overlap_question, overlap_answer.

    Words are compared by their letters and digits in lower case, over whole texts. Null and empty texts and items
    have no leaks, repeated rows give repeated results, ties in score do not matter as all items above their
    threshold are verified, and empty tables give no rows. Ids may be of any type; other columns are ignored. More than
    max_items test items are searched in passes, each written to the shared folder before the next index is made.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, score double, overlap double, overlap_question double, overlap_answer double"
    found = None
    shards, made = indexes(benchmark, max_items)
    for index in made:
        shared = _Shared(docs.sparkSession, index)
        part = texts_of(docs).select("doc_id", "text").mapInArrow(tidy(_leak_rows(shared, to_arrow_type(item_type))), schema)
        if shards > 1:
            part = stage_table(part, "leaks")
            shared.broadcast.destroy()
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


class _Shared:
    """A broadcast index and a number that tells it from others."""

    def __init__(self, spark, index: Index):
        self.broadcast = spark.sparkContext.broadcast(index)
        self.id = self.broadcast._jbroadcast.id() if self.broadcast._jbroadcast is not None else id(self)

    @property
    def value(self) -> Index:
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def _leak_rows(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = hold(("terms", shared.id), lambda: _Terms(index.terms))
        for batch in slices(batches, TEXTS):
            rows = leaks(index, batch["text"], known)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(cols[0])),
                        pa.array([index.item_ids[i] for i in cols[1]], item_type),
                        *[pa.array(c, pa.float64()) for c in cols[2:]],
                    ],
                    ["doc_id", "item_id", "score", "overlap", "overlap_question", "overlap_answer"],
                )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of docs that hold no test item; their columns stay as they are. Passes are as in find_leaks."""
    shards, made = indexes(benchmark, max_items)
    for index in made:
        shared = _Shared(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = hold(("terms", shared.id), lambda: _Terms(shared.value.terms))
            for batch in slices(batches, TEXTS):
                bad = {k for k, *_ in leaks(shared.value, batch["text"], known)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = texts_of(docs).mapInArrow(tidy(run), docs.schema)
        if shards > 1:
            docs = stage_table(docs, "kept")
            shared.broadcast.destroy()
    return docs
