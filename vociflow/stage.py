"""Intermediate tables in the folder that all executors share, and the numbering of rows in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task of a numbering sorts, about; sums of partitions that one task adds up.
RUN_ROWS, SPAN = 250_000, 1_024

#: Rows and bytes of an Arrow batch, at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20

_own_dir: list[str] = []


def set_arrow_limits(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch; they bound memory and change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in a local session.

    On a cluster without that setting this raises, as a machine-local folder would lose data there.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="vociflow-"))
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own for one intermediate table."""
    return f"{shared_dir(spark)}/vociflow-{tag}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _starts(sums: DataFrame, n: int) -> DataFrame:
    """part and start: the sum of n over all smaller parts; sums has part, of 0 to n - 1, and n.

    No task adds up more than SPAN sums: beyond that, groups of SPAN parts are summed first, and started in the same way.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("span").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.withColumn("span", F.floor(F.col("part") / SPAN))
    inner = spans.select("part", "span", before.alias("start"))
    if n <= SPAN:
        return inner.drop("span")
    outer = _starts(spans.groupBy(F.col("span").alias("part")).agg(F.sum("n").alias("n")), -(-n // SPAN))
    return inner.join(outer.select(F.col("part").alias("span"), F.col("start").alias("base")).hint("merge"), "span").select("part", (F.col("start") + F.col("base")).alias("start"))


def number_rows(df: DataFrame, order: list[Column], rows: int, name: str = "position") -> DataFrame:
    """df with a column of places from 0 in a global order; df has about so many rows, and is written on the way.

    Ranges of the order are dealt to tasks and sorted there; equal rows are told apart by their places in df's files, so
    that many equal keys are split too. df should be read from files, so that a lost task finds the same places again.
    Parts are joined with their starts by a shuffle, as their number grows with the rows.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RUN_ROWS))
    keyed = df.withColumn("__tie", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(parts, *order, F.col("__tie")).sortWithinPartitions(*order, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    # That id is the number of the partition, and the row's place in it in the lower 33 bits.
    staged = stage_table(placed.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    starts = _starts(staged.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")), parts)
    joined = staged.join(starts.hint("merge"), F.col("__part") == F.col("part"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("start") + F.col("__at")).alias(name))
