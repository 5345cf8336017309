"""WARC archives: written with one record a page, read back by boundary-chain verification (operator 4).

Archives are uncompressed, so that tasks read them in splits. A record starts with a version line, but payloads may
hold that line too. Tasks therefore emit every candidate record with the offset at which its header says that the
next one starts. Candidates that follow each other without a break are one segment; pointer jumping over segments
from the start of each file keeps what can be reached and rejects candidates inside payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vociflow.llm.common import BROADCAST_ROWS, new_path, small_join, stage_table

#: What every record starts with.
MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
#: Payloads of fewer bytes are always responses.
MIN_REVISIT_BYTES = 0
#: A hot payload's pages are spread over so many tasks.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Date of all records, as pages have none.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a payload's SHA-1: five hexadecimal digits at a time are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, and refers_to: the page whose payload a revisit repeats.

    Digests are counted before the shuffle. Those that repeat are broadcast after counting them, and payloads stay
    where they are; if they are too many the join is salted, as a third of all pages may have the same payload.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"payload_digest": base32_sha1(F.col("html")), "payload_bytes": F.octet_length("html").cast("long")}
    )
    repeated = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    repeated = repeated.agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    keys = ["payload_digest", "payload_bytes"]
    repeated = stage_table(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeated), keys, "left")
    else:
        repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(repeated, [*keys, "salt"], "left")
    refers = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def _record(c: dict[str, Column]) -> Column:
    """A record's text, without the last line end, which the writer adds."""
    revisit = c["refers_to"].isNotNull()
    uri = F.replace(F.url_encode(F.coalesce(c["url"], F.lit(""))), F.lit("%3A%2F%2F"), F.lit("://"))
    uri = F.replace(F.replace(F.replace(uri, F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":")), F.lit("%3F"), F.lit("?"))
    uid = F.md5(F.concat_ws("|", c["page_id"].cast("string"), c["url"], c["payload_digest"]))
    dashed = F.concat_ws("-", *[F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.when(revisit, F.lit(b"")).otherwise(c["html"])
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), dashed, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), c["payload_digest"],
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nX-Refers-To-Page: "), c["refers_to"].cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nX-Page-Id: "), F.coalesce(c["page_id"].cast("string"), F.lit("")),
        F.lit("\r\nX-Payload-Length: "), c["payload_bytes"].cast("string"),
        F.lit("\r\nContent-Type: application/octet-stream\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BREAK),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n")).cast("string")


def write_warc(records: DataFrame, path: str) -> None:
    """Write planned records as archives, one for each partition, through Spark's text writer: bytes stay as they are."""
    cols = {c: F.col(c) for c in records.columns}
    records.select(_record(cols).alias("value")).write.option("lineSep", "\r\n").text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line in the archives: file, offset of the line, next offset by its header, fields.

    Splits are read on their own; a chunk's offset is the sum of those before it in its split, and of the splits
    before. payload_digest is null where a payload goes beyond the chunk, as it holds a version line itself.
    """
    chunk = spark.read.option("lineSep", MAGIC).text(path)
    chunk = chunk.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    whole = F.col("value").contains(BREAK)
    sized = chunk.withColumns({"bytes": F.octet_length("value").cast("long"), "head": F.when(whole, F.substring_index("value", BREAK, 1))})
    length = F.try_to_number(_field("Content-Length"), F.lit("999999999999999999")).cast("long")
    sized = sized.withColumns({"length": length, "skip": F.octet_length("head").cast("long") + len(BREAK)})
    body = F.substring(F.col("value").cast("binary"), (F.col("skip") + 1).cast("int"), F.col("length").cast("int"))
    rows = sized.select(
        "file", "split", "at", "bytes", "skip", "length", _field("WARC-Type").alias("record_type"),
        _field("X-Page-Id").cast("long").alias("page_id"), _field("X-Refers-To-Page").cast("long").alias("refers_to"),
        _field("X-Payload-Length").cast("long").alias("stated_bytes"),
        F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha1:([A-Z2-7]*)", 1).alias("stated_digest"),
        F.when(F.col("skip") + F.col("length") + len(BREAK) <= F.col("bytes"), base32_sha1(body)).alias("payload_digest"),
    )
    return _offsets(stage_table(rows, "chunks"))


def _offsets(rows: DataFrame) -> DataFrame:
    step = F.col("bytes") + len(MAGIC)
    splits = rows.groupBy("file", "split").agg(F.sum(step).alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = small_join(rows.withColumn("own", F.coalesce(F.sum(step).over(inside), F.lit(0))), splits, ["file", "split"], "inner")
    # The text before the first version line is a chunk as well, with the place of the line as its end.
    offset = F.col("base") + F.col("own") - len(MAGIC)
    reach = offset + len(MAGIC) + F.col("skip") + F.col("length") + len(BREAK)
    return placed.withColumns({"offset": offset, "next": reach}).where("offset >= 0").drop("base", "own", "split", "at")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain of records from the start of their file reaches."""
    order = Window.partitionBy("file").orderBy("offset")
    rows = found.withColumn("follows", F.coalesce(F.lag("next").over(order) == F.col("offset"), F.lit(False)))
    rows = rows.withColumn("leads", F.lead("offset").over(order))
    far = rows.where("next is not null and (leads is null or next <> leads)").select("file", F.col("next").alias("offset"))
    targets = far.distinct().withColumn("target", F.lit(True))
    rows = small_join(rows, targets, ["file", "offset"], "left")
    cut = ~F.col("follows") | F.coalesce("target", F.lit(False))
    rows = rows.withColumn("segment", F.max(F.when(cut, F.col("offset"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stage_table(rows, "segments")
    # A segment leads to where its last record does: to the head of another one, or to the end of the file.
    last = rows.groupBy("file", "segment").agg(F.max_by("next", "offset").alias("to"))
    reach, jump = stage_table(last.where("segment = 0").select("file", "segment"), "reach"), stage_table(last, "jump")
    count = reach.count()
    while True:
        new = reach.join(jump, ["file", "segment"]).select("file", F.col("to").alias("segment")).where("segment is not null")
        heads = jump.select("file", "segment")
        reach = stage_table(reach.unionAll(new.join(heads, ["file", "segment"], "left_semi")).distinct(), "reach")
        if (now := reach.count()) == count:
            break
        count = now
        ends = jump.select("file", F.col("segment").alias("to"), F.col("to").alias("then"))
        jump = stage_table(jump.join(ends, ["file", "to"], "left").select("file", "segment", F.col("then").alias("to")), "jump")
    return small_join(rows, reach, ["file", "segment"], "left_semi")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records: page_id, payload_bytes, payload_digest (of the bytes read), record_type, refers_to.

    A revisit has no payload, so its length and digest are those in its header. A response whose payload does not
    have the digest that its header states raises an error.
    """
    kept = reachable(candidates(spark, path))
    long = kept.where("payload_digest is null").select("file", "offset", "skip", "length")
    if not long.isEmpty():
        kept = kept.join(_long_digests(spark, path, stage_table(long, "long")), ["file", "offset"], "left")
        kept = kept.withColumn("payload_digest", F.coalesce("payload_digest", "long_digest"))
    response = F.col("record_type") == "response"
    damaged = response & ~F.col("payload_digest").eqNullSafe(F.col("stated_digest"))
    digest = F.when(damaged, F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))).cast("string"))
    return kept.select(
        "page_id", F.when(response, F.col("length")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.coalesce(digest, F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def _long_digests(spark: SparkSession, path: str, long: DataFrame) -> DataFrame:
    """Digests of payloads that hold version lines themselves: joined from the chunks that they span."""
    chunk = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    files = small_join(chunk, long.select("file").distinct(), "file", "left_semi")
    files = files.withColumns({"bytes": F.octet_length("value").cast("long"), "skip": F.lit(0), "length": F.lit(0)})
    rows = _offsets(files).select("file", F.col("offset").alias("chunk"), "value", "bytes")
    # Every chunk lies in one record at most: the last that starts at or before it.
    records = long.select("file", F.col("offset").alias("chunk"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("bytes"), F.struct("offset", "skip", "length").alias("r"))
    both = records.unionByName(rows.withColumn("r", F.lit(None).cast(records.schema["r"].dataType)))
    order = Window.partitionBy("file").orderBy("chunk", F.col("r").isNull())
    owned = both.withColumn("own", F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("value is not null")
    owned = owned.where(F.col("chunk") < F.col("own.offset") + len(MAGIC) + F.col("own.skip") + F.col("own.length"))
    parts = owned.groupBy("file", F.col("own.offset").alias("offset"), F.col("own.skip").alias("skip"), F.col("own.length").alias("length"))
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("chunk", "value"))).alias("parts"))
    text = F.array_join(F.col("parts.value"), MAGIC).cast("binary")
    body = F.substring(text, (F.col("skip") + 1).cast("int"), F.col("length").cast("int"))
    return joined.select("file", "offset", base32_sha1(body).alias("long_digest"))


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for every page to archives, and return what reading them back finds.

    Null html is an empty payload, a null url an empty one, rows with a null page_id are responses; of repeated rows
    with the smallest page_id all are responses; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(plan_records(pages, min_bytes), path)
    return read_warc(spark, path)
