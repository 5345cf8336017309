"""Records of a large JSON file in parallel: one object whose arrays hold record objects.

The file is read in byte ranges and cut at every closing brace, inside texts or not. Which cuts are real follows from the
chain of all pieces from the file's start: the number of quotes before a piece tells whether it begins inside a text, and
the brackets outside texts tell how deep it is. Both are running sums, taken within ranges and carried on over the sums of
ranges, so that no task reads more than its range. Each sum reads the ranges anew, where they lie; only at the end pieces
are shuffled, once, and those between real ends of records are put together and parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vociflow.stage import BATCH_BYTES, stage_table

#: What an open array counts for in the depth, where an open object counts for 1.
ARRAY = 1 << 32
#: An escaped character; a text without such ones, which may be cut off.
_ESCAPED, _TEXT = r"(?s)\\.", r'"[^"]*(?:"|$)'
_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
#: What may come before the first record of an array: the end of another one, values that are no objects, and the array's name.
_HEAD = rf'(?s)^\s*[\]{{]?(?:\s*,?\s*{_STRING}\s*:\s*(?:{_STRING}|\[\s*\]|[^\[{{"]*?))*\s*,?\s*"([^"\\]+)"\s*:\s*\[\s*(?=\{{)'


def _walk(what: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks along the pieces of ranges, which follow each other in a partition.

    changes: sums of quotes and, for ranges that begin outside (0) and inside (1) of a text, of changes of depth. ends: sums
    of real ends, from the quotes and the depth before a range. pieces: the number of the record that each piece belongs to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals = None, {}
        for batch in (b for b in batches if b.num_rows):
            column = lambda c: np.asarray(batch[c])  # noqa: B023, E731
            of = [batch["file"], batch["range"]]
            turns = np.zeros(batch.num_rows, bool)
            turns[0] = [c[0].as_py() for c in of] != last
            for c in of:
                turns[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
            segment, last = np.cumsum(turns), [c[-1].as_py() for c in of]

            def earlier(key: str, values: np.ndarray) -> np.ndarray:
                """Sums over the earlier pieces of the range, from batch to batch."""
                before = np.cumsum(values) - values
                before -= np.concatenate([[-totals.get(key, 0)], before[turns]])[segment]  # noqa: B023
                totals[key] = int(before[-1] + values[-1])  # noqa: B023
                return before

            def summed(**values: np.ndarray) -> pa.RecordBatch:
                """A row for each range in the batch."""
                turns[0] = True  # noqa: B023
                at = np.flatnonzero(turns)  # noqa: B023
                return pa.RecordBatch.from_pydict({"file": of[0].take(pa.array(at)), "range": of[1].take(pa.array(at))} | {k: np.add.reduceat(v, at) for k, v in values.items()})  # noqa: B023

            quotes = column("quotes")
            before = earlier("quotes", quotes)
            if what == "changes":
                outside, inside = (np.where((before + p) % 2 == 1, column("inside"), column("outside")) for p in (0, 1))
                yield summed(quotes=quotes, outside=outside, inside=inside)
                continue
            before = before + column("quotes_before")
            change = np.where(before % 2 == 1, column("inside"), column("outside"))
            depth = column("depth_before") + earlier("change", change) + change
            # An object that ends in an array of the outermost object is a record; others that end in the outermost one are left out.
            ends = (((before + quotes) % 2 == 0) & np.isin(depth, (0, 1, ARRAY + 1))).astype(np.int64)
            if what == "ends":
                yield summed(ends=ends)
            else:
                number = column("ends_before") + earlier("ends", ends)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("file", "range", "at", "value")], pa.array(number), pa.array(depth, mask=ends == 0)], names=["file", "range", "at", "value", "number", "depth"])

    return run


def _before(ranges: DataFrame, value: Column | str, name: str) -> DataFrame:
    """Rows for each range of a file, with the sum of a column over the earlier ranges."""
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, name of the array, position in it (from 0) and json of every record of the files at a path.

    A file is one JSON object in UTF-8; its arrays hold objects, however nested, and other values beside them are left out.
    A missing file is an error; texts may hold braces, brackets, quotes and line ends.
    """
    spark.read.text(path).limit(0).count()  # a missing file is an error even before any record is read
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))
    pieces = pieces.withColumn("bare", F.regexp_replace("value", _ESCAPED, ""))
    pieces = pieces.withColumn("quotes", _count(F.col("bare"), '"').cast("long"))
    # What a piece changes in the depth depends on whether it begins inside a text.
    texts = {"outside": F.regexp_replace("bare", _TEXT, ""), "inside": F.regexp_replace(F.concat(F.lit('"'), "bare"), _TEXT, "")}
    pieces = pieces.withColumns({f"{k}_text": v for k, v in texts.items()})

    def change(k: str) -> Column:
        text, closes = F.col(f"{k}_text"), F.when(F.col("quotes") % 2 == (k == "inside") * 1, 1).otherwise(0)
        return (_count(text, "{") - closes + (_count(text, "[") - _count(text, "]")) * F.lit(ARRAY)).cast("long")

    pieces = pieces.select("file", "range", "at", "value", "quotes", *[change(k).alias(k) for k in texts])
    turns = pieces.select("file", "range", "quotes", *texts)
    sums = turns.mapInArrow(_walk("changes"), "file string, range long, quotes long, outside long, inside long").groupBy("file", "range")
    ranges = _before(sums.agg(*[F.sum(c).alias(c) for c in ("quotes", *texts)]), "quotes", "quotes_before")
    change_of = F.when(F.col("quotes_before") % 2 == 1, F.col("inside")).otherwise(F.col("outside"))
    ranges = _before(ranges.withColumn("change", change_of), "change", "depth_before").select("file", "range", "quotes_before", "depth_before")
    ranges = stage_table(ranges, "ranges")
    ends = turns.join(F.broadcast(ranges), ["file", "range"]).mapInArrow(_walk("ends"), "file string, range long, ends long").groupBy("file", "range").agg(F.sum("ends").alias("ends"))
    ranges = stage_table(_before(ends, "ends", "ends_before").drop("ends").join(F.broadcast(ranges), ["file", "range"]), "ranges")
    placed = pieces.join(F.broadcast(ranges), ["file", "range"]).mapInArrow(_walk("pieces"), "file string, range long, at long, value string, number long, depth long")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "at", "value"))), lambda p: p["value"]), "}")
    whole = placed.groupBy("file", "number").agg(F.concat(joined, F.lit("}")).alias("text"), F.max("depth").alias("depth")).where(F.col("depth") == ARRAY + 1)
    follows = F.col("text").rlike(r"^\s*,\s*\{")
    record = F.when(F.col("follows"), F.regexp_replace("text", r"^\s*,\s*", "")).otherwise(F.regexp_replace("text", _HEAD, ""))
    name = F.when(~F.col("follows"), F.nullif(F.regexp_extract("text", _HEAD, 1), F.lit("")))
    named = stage_table(whole.withColumn("follows", follows).select("file", "number", "follows", name.alias("name"), record.alias("json")), "records")
    # A row for each array of a file.
    following = F.lead("first").over(Window.partitionBy("of").orderBy("first"))
    arrays = named.where(~F.col("follows")).select(F.col("file").alias("of"), F.col("number").alias("first"), F.col("name").alias("array")).withColumn("next", F.coalesce(following, F.lit(1 << 62)))
    found = named.join(F.broadcast(arrays), (F.col("file") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("next")))
    return found.select("file", F.col("array").alias("name"), (F.col("number") - F.col("first")).alias("position"), "json")


def records(arrays: DataFrame, name: str, schema: str) -> DataFrame:
    """position and the fields of one array's records; unknown fields are ignored."""
    return arrays.where(F.col("name") == name).select(F.col("position").cast("int").alias("position"), F.from_json("json", schema).alias("r")).select("position", "r.*")
