"""What the operators of this subpackage share: intermediate tables, text columns and small joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vociflow.stage import new_path, shared_dir, stage_table

#: Largest table, in rows, that an operator broadcasts after counting it; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bits of a table of hashes that rows are looked up in before a shuffle, and bits of one of its rows.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15

#: Rows and bytes of an Arrow batch of texts, and bytes of batches that are put together.
BATCH_ROWS, BATCH_BYTES, GATHER_BYTES = 1_000, 16 << 20, 24 << 20

_held: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def small_join(df: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """Join a table that is usually small: broadcast after counting it, else a shuffle join that AQE may split."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def may_match(df: DataFrame, key: Column, others: DataFrame, other_key: Column) -> DataFrame:
    """df with a column __may: whether others may have a row whose key (a hash of 64 bits) is the same; false is certain.

    Two bits stand for each key, in two tables of 8 MB, whatever the size of others, so that this table is broadcast and df stays where it is.
    """
    out, hit = df.withColumn("__hash", key), F.lit(True)
    for k, digits in enumerate((0, 32)):
        slot = lambda h, digits=digits: F.pmod(F.shiftright(h, digits), F.lit(FILTER_BITS))
        row, at = (lambda s: F.floor(s / FILTER_ROW)), (lambda s: F.pmod(s, F.lit(FILTER_ROW)))
        bits = others.select(slot(other_key).alias("s")).groupBy(row(F.col("s")).alias(f"__row{k}")).agg(F.bitmap_construct_agg(at(F.col("s"))).alias(f"__bits{k}"))
        out = out.withColumn(f"__row{k}", row(slot(F.col("__hash")))).join(F.broadcast(stage_table(bits, "bits")), f"__row{k}", "left")
        place = at(slot(F.col("__hash")))
        byte = F.conv(F.hex(F.substring(F.col(f"__bits{k}"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit &= F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    return out.withColumn("__may", hit).select(*[F.col(f"`{c}`") for c in df.columns], "__may")


def filtered_join(df: DataFrame, small: DataFrame, on: str, how: str) -> DataFrame:
    """As small_join, by a column and for long rows of which few find a partner: where the join shuffles, the others leave before."""
    if small.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        df = may_match(df, F.xxhash64(on), small, F.xxhash64(on)).where("__may").drop("__may")
    return small_join(df, small, on, how)


def hold(key, make):
    """What an operator keeps in a Python worker between tasks; another operator's takes its place, so memory stays bounded."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
        release()
    return _held[key]


def release() -> None:
    """Give freed memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over the batches of a task that gives memory back at its end, as idle workers stay alive."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def texts_of(df: DataFrame) -> DataFrame:
    """df, after lowering the session's limits of an Arrow batch, by rows and by bytes, as batches lie in memory.

    The limits hold when the result runs, so that they stay lowered; they bound memory and change no result.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def gather(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Record batches put together until they have so many rows, or GATHER_BYTES, or more."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
        if count >= rows or size >= GATHER_BYTES:
            yield pa.concat_batches(held)
            held, count, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
