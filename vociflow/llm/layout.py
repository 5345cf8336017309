"""A clustered layout over four values, and how many of its files a query has to read (operator 11).

Each value becomes a coordinate, the eighth of all rows in which it falls; the coordinates' bits interleave to a place z
on a curve, and rows go to files in that order. A file covers a box of coordinates. Which files a query on a row's
neighbourhood touches is a difference array of four dimensions: each file's box, dilated by the reach of queries, adds
signed corners, which are summed before the shuffle, and prefix sums along each axis give the count of every cell. The
number of cells is fixed, whatever the number of rows and files.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vociflow.llm.common import crc_fold, stage_table
from vociflow.operators.selection import order_statistics
from vociflow.stage import number_rows

#: Coordinates of a value (a power of two), and rows of a file.
BINS, FILE_ROWS = 8, 2_000
#: The values, with the reach of a query on each, and the order in which their bits take turns.
REACH = {"source": 0, "lang": 0, "length": 1, "date": 1}
TURNS = ("date", "length", "lang", "source")


def _text_key(value: Column) -> Column:
    """A text that sorts as the value's bytes do, with null smallest."""
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value))


def _number_key(value: Column) -> Column:
    """A text that sorts as a whole number of at least -1 does."""
    return F.lpad((value + 1).cast("string"), 20, "0")


def values_of(docs: DataFrame) -> DataFrame:
    """doc_id and the four values as texts that sort as they do: source, lang, length in bytes (null text: -1) and date, a fold of doc_id."""
    length = F.coalesce(F.octet_length("text").cast("long"), F.lit(-1))
    return docs.select(
        "doc_id", _text_key(F.col("source")).alias("source"), _text_key(F.col("lang")).alias("lang"), _number_key(length).alias("length"), _number_key(crc_fold(F.col("doc_id"), 365)).alias("date")
    )


def cuts_of(rows: DataFrame, bins: int = BINS) -> dict[str, list[str]]:
    """For each value those at ranks k * n / bins: a value above so many of them lies in that bin.

    A value has at least m smaller ones exactly if the m-th smallest lies below it.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(c).alias("value")) for k, c in enumerate(REACH)]))
    found = order_statistics(rows.select(each.alias("e")).select("e.*"), lambda n: [-(-k * n // bins) for k in range(1, bins)])
    return {c: [found[k][1][-(-b * found[k][0] // bins)] for b in range(1, bins)] if k in found else [] for k, c in enumerate(REACH)}


def interleaved(coordinates: dict[str, Column], bins: int = BINS) -> Column:
    """z: the coordinates' bits, highest first, in turns."""
    z = F.lit(0).cast("long")
    for bit in reversed(range(bins.bit_length() - 1)):
        for c in TURNS:
            z = z * 2 + F.shiftright(coordinates[c], bit).bitwiseAND(F.lit(1))
    return z


def coordinate(z: Column, name: str, bins: int = BINS) -> Column:
    """A coordinate from z."""
    bits, turn = bins.bit_length() - 1, len(TURNS) - 1 - TURNS.index(name)
    out = F.lit(0).cast("int")
    for bit in range(bits):
        out = out + F.shiftleft(F.shiftright(z, bit * len(TURNS) + turn).bitwiseAND(F.lit(1)).cast("int"), bit)
    return out


def _cells(z: Column, bins: int) -> dict[str, Column]:
    return {c: coordinate(z, c, bins) for c in REACH}


def touched(boxes: DataFrame, bins: int = BINS) -> np.ndarray:
    """For every cell (source, lang, length, date) the boxes that its query meets.

    boxes has min_<value> and max_<value>. A box's 16 corners are added up by Spark; (bins + 1)^4 sums at most come here.
    """
    side = bins + 1
    corners = []
    for ends in product((0, 1), repeat=len(REACH)):
        index, sign = F.lit(0), 1
        for end, (c, reach) in zip(ends, REACH.items(), strict=True):
            at = F.least(F.col(f"max_{c}") + reach + 1, F.lit(bins)) if end else F.greatest(F.col(f"min_{c}") - reach, F.lit(0))
            index, sign = index * side + at, -sign if end else sign
        corners.append(F.struct(index.alias("at"), F.lit(sign).alias("sign")))
    sums = boxes.select(F.explode(F.array(*corners)).alias("e")).groupBy("e.at").agg(F.sum("e.sign").alias("n")).where("n <> 0").collect()
    out = np.zeros(side ** len(REACH), np.int64)
    for r in sums:
        out[r["at"]] = r["n"]
    out = out.reshape((side,) * len(REACH))
    for axis in range(len(REACH)):
        out = out.cumsum(axis)
    return out[(slice(bins),) * len(REACH)]


def matching(pairs: DataFrame, bins: int = BINS) -> np.ndarray:
    """For every cell the files with a row in its query; pairs has file and z, once for each cell of a file."""
    cells = _cells(F.col("z"), bins)
    moves = [F.struct(*[(cells[c] + d).alias(c) for c, d in zip(REACH, move, strict=True)]) for move in product(*[range(-r, r + 1) for r in REACH.values()])]
    inside = " AND ".join(f"e.{c} BETWEEN 0 AND {bins - 1}" for c in REACH)
    met = pairs.select("file", F.explode(F.array(*moves)).alias("e")).where(inside).select("file", "e.*").distinct()
    out = np.zeros((bins,) * len(REACH), np.int64)
    for r in met.groupBy(*REACH).agg(F.count("*").alias("n")).collect():
        out[tuple(r[c] for c in REACH)] = r["n"]
    return out


def cluster_layout(docs: DataFrame, bins: int = BINS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Per document: doc_id, z, position, file, files_touched, files_matching (longs) and file_bounds.

    Null values are smallest and share a coordinate; null and empty texts have lengths of -1 and 0 bytes; a null doc_id
    has the date of an empty text and comes first in its cell. Rows of equal z and doc_id take places of their own, in
    any order, as nothing else of them shows. Empty tables give no rows; other columns are ignored.

    A task sees bounded parts of the rows: values are counted before ranks are taken, places are numbered in ranges, and
    files hold file_rows rows. The driver gets cuts and sums of cells, whose number is fixed.
    """
    rows = stage_table(values_of(docs), "values")
    cuts = cuts_of(rows, bins)
    above = {c: sum((F.col(c) > F.lit(cut)).cast("int") for cut in cuts[c]) + F.lit(0) for c in REACH}
    celled = stage_table(rows.select("doc_id", interleaved(above, bins).alias("z")), "cells")
    numbered = number_rows(celled, [F.col("z"), F.col("doc_id").asc_nulls_first()], celled.count())
    placed = stage_table(numbered.withColumn("file", F.floor(F.col("position") / file_rows)), "places")
    pairs = stage_table(placed.select("file", "z").distinct(), "pairs")
    cells = _cells(F.col("z"), bins)
    ends = {f"{name}_{c}": f(cells[c]) for c in REACH for name, f in (("min", F.min), ("max", F.max))}
    counts = touched(pairs.groupBy("file").agg(*[e.alias(k) for k, e in ends.items()]), bins), matching(pairs, bins)
    # One row a cell: bins^4 rows, whatever the input.
    schema = ", ".join(f"c_{c} int" for c in REACH) + ", files_touched long, files_matching long"
    known = docs.sparkSession.createDataFrame([(*at, *(int(n[at]) for n in counts)) for at in np.ndindex(*counts[0].shape)], schema)
    of_cell = known.select(interleaved({c: F.col(f"c_{c}") for c in REACH}, bins).alias("z"), "files_touched", "files_matching")
    file = Window.partitionBy("file")
    bounds = F.concat_ws(",", *[ends[f"{end}_{c}"].over(file).cast("string") for c in REACH for end in ("min", "max")])
    return placed.withColumn("file_bounds", bounds).join(F.broadcast(of_cell), "z").select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
