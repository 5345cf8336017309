"""Token ids: a cached encoder, and a Parquet file format for token streams (operator 7).

The encoder is the tokenizers library's own; as its pre-tokenizer never joins characters across white space, the
ids of a text are those of its white-space separated words in turn, and each distinct word is encoded only once.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vociflow.llm.common import gather, hold, new_path, slices, texts_of, tidy

#: Id appended to every document.
END_ID = 1
#: Texts encoded together, whose distinct words are looked up once, and texts whose ids are copied together.
ENCODE_ROWS, COPY_ROWS = 2000, 200
#: Full stop and comma.
STOPS = ".,"
#: Words that a worker keeps, and the share of unknown ones among the distinct words of a batch from which it starts anew when that is reached.
CACHE_WORDS, UNKNOWN_SHARE = 600_000, 0.9

#: Parquet settings of the token files: delta encoded lists, which need no dictionary or compression, bounded row groups,
#: small indexed pages.
FILE_OPTIONS = {
    "compression": "uncompressed",
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.writer.version": "PARQUET_2_0",
}


def default_tokenizer() -> str:
    """Path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _is_plain(word: str) -> bool:
    """Whether a word is all letters, in lower case and composed form."""
    return word.isalpha() and word.islower() and (word.isascii() or unicodedata.is_normalized("NFC", word))


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, with a bounded cache of words."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_words = self.tokenizer.encode_batch_fast
        spaced = Tokenizer.from_file(path)
        spaced.normalizer = normalizers.Sequence([])
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spaced.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])
        self.encode_letters = spaced.encode_batch_fast
        self.cache_words = cache_words
        self.stops = {s: array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes() for s in STOPS}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of words that are not known yet.

        The pre-tokenizer parts letters from other characters: a plain word and the stop after it are encoded apart.
        """
        known, stops = self.known, self.stops
        plain, stopped, others, found = {}, [], [], {"": b""}
        for word in missing:
            if _is_plain(word):
                plain[word] = None
            elif word[-1:] in stops and _is_plain(word[:-1]):
                stopped.append(word)
                if word[:-1] not in known:
                    plain[word[:-1]] = None
            elif word:
                others.append(word)
        plain = list(plain)
        if not self._learn_letters(plain, found):
            others += plain
        for word, encoding in zip(others, self.encode_words(others, add_special_tokens=False), strict=True):
            found[word] = array("I", encoding.ids).tobytes()
        for word in stopped:
            found[word] = (found.get(word[:-1]) or known[word[:-1]]) + stops[word[-1]]
        return found

    def _learn_letters(self, words: list[str], found: dict[str, bytes]) -> bool:
        """Encode plain words, which are normal and one pre-token each, as one text without those steps; tokens that end a
        word part them. False if the tokenizer does not mark the ends of all words.
        """
        for start in range(0, len(words), 20_000):
            some = words[start : start + 20_000]
            encoding = self.encode_letters([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(encoding.ids, dtype="<u4")
            blob, ends = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()]
            if len(ends) != len(some) + 1:
                return False
            found.update(zip(some, [blob[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        return True

    def encode(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other, and where each text starts; null is empty.

        Arrow splits the texts and numbers their distinct words; only those are looked up or encoded.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # Lower-casing first saves cache entries, as the tokenizer lower-cases too; a special token's text is kept.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        found = list(map(self.known.get, words))
        if missing := [w for w, ids in zip(words, found, strict=True) if ids is None]:
            new = self.learn(missing)
            found = [new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            if len(self.known) >= self.cache_words and len(missing) > UNKNOWN_SHARE * len(words):
                self.known = {}
            self.known.update(islice(new.items(), max(0, self.cache_words - len(self.known))))
        each = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(each, dtype=np.int64) - each
        del words, found
        word = numbered.indices.to_numpy()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        counts = each[word] if len(word) else np.zeros(0, np.int32)
        per_text = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[offsets])
        starts = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(starts[-1], end, "<u4")
        for a in range(0, len(per_text), COPY_ROWS):  # in parts, as each id takes several places while it is copied
            b = min(a + COPY_ROWS, len(per_text))
            some, n = slice(offsets[a], offsets[b]), int(per_text[a:b].sum())
            places = np.repeat(first[word[some]] - (np.cumsum(counts[some], dtype=np.int64) - counts[some]), counts[some])
            places += np.arange(n)
            into = np.arange(n) + np.repeat(np.arange(b - a), per_text[a:b])
            out[starts[a] : starts[b]][into] = ids[places]
        return out, starts


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    return hold(("encoder", path, cache_words), lambda: WordEncoder(path, cache_words))


def _encode_sorted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(path), 0
        for batch in gather(slices(batches, ENCODE_ROWS), ENCODE_ROWS):
            ids, starts = enc.encode(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["part"],
                    pa.array(before + starts[:-1], pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("<i4"), pa.int32())),
                ],
                ["doc_id", "part", "start_in_part", "n_tokens", "tokens"],
            )
            before += int(starts[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None) -> None:
    """Encode whole texts and write them in ascending doc_id order, one range of ids per file.

    Ids are ranged together with a hash of the text, so that an id which repeats with other texts can be split;
    rows with a null id come first, a null text is empty, and every document ends in the end id.
    """
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        texts_of(docs).select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(count, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, part int, start_in_part long, n_tokens long, tokens array<int>"
    rows.mapInArrow(tidy(_encode_sorted(tokenizer)), schema).write.options(**FILE_OPTIONS).parquet(path)


def read_token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document, without reading a token: other columns are pruned."""
    files = spark.read.parquet(path).select("doc_id", "part", "start_in_part", "n_tokens")
    return files.join(_part_starts(spark, path), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens"
    )


def read_tokens(spark: SparkSession, path: str, first_id: int, last_id: int) -> DataFrame:
    """The tokens of a range of ids: row groups and pages outside it are skipped by their indexes."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "n_tokens", "tokens")


def _part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file; one row per file that was written, so it is small enough to broadcast."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start")))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["tokens"]
        flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the CRC-32 of its ids, all read from the files."""
    rows = (
        texts_of(spark.read.parquet(path))
        .join(_part_starts(spark, path), "part")
        .select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_checksums), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of all documents to the shared folder and return the digest read back from them.

    Columns doc_id and text are used, others are ignored. Empty tables give no rows, repeated rows are written as
    often as they occur, and the order of rows with equal ids is by a hash of their texts.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer or default_tokenizer())
    return token_digest(spark, path)
