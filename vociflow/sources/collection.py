"""Collection rules (S13-S23) as relational operators over rows already fetched, and the connector's own rules.

Remote calls are made by a function that the caller passes; no network is used here.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Caps of the collectors.
WALL_CAPS = {"BASELINE": 200, "CURRENT": 100}
COMMUNITY_CAPS = {"BASELINE": 10_000, "CURRENT": 5_000}
TOP_AUTHORS, TOP_POSTS, SEARCH_CAP, SEGMENT_FULL = 100, 200, 100, 1000
FLOOD_WAITS, FLOOD_CODE = (10, 30, 60), 9
PAGE_ROWS, SEARCH_ROWS, CALLS_A_SECOND, BATCH_CALLS = 100, 200, 2, 25


def newest_per_key(rows: DataFrame, key: str, ts: str, cap: int, tie: str) -> DataFrame:
    """The newest rows of each key, at most cap of them."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), tie))
    return rows.withColumn("__place", place).where(F.col("__place") <= cap).drop("__place")


def wall_posts(posts: DataFrame, since: Column, until: Column, cap: int) -> DataFrame:
    """Each author's newest posts between two times."""
    return newest_per_key(posts.where(F.col("published_at").between(since, until)), "from_id", "published_at", cap, "id")


def community_windows(posts: DataFrame, as_of: Column, baseline_days: int, current_days: int) -> DataFrame:
    """Posts tagged by collection window; both windows end at as_of, so that they overlap."""
    out = None
    for name, days in (("BASELINE", baseline_days), ("CURRENT", current_days)):
        part = posts.where(F.unix_timestamp("published_at") >= F.unix_timestamp(as_of) - days * 86400)
        part = newest_per_key(part, "owner_id", "published_at", COMMUNITY_CAPS[name], "id").withColumn("window", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def flatten_remote(posts: DataFrame) -> DataFrame:
    """Rows of remote posts: missing counters are 0 but missing views stay null."""
    count = lambda c: F.coalesce(F.col(f"{c}.count"), F.lit(0)).alias(c)
    some = lambda c: (F.coalesce(F.size(c), F.lit(0)) > 0)
    return posts.where("id <> 0").select(
        F.col("id").alias("vk_id"), "owner_id", "from_id", F.timestamp_seconds("date").alias("published_at"), F.coalesce("text", F.lit("")).alias("text"),
        count("likes"), count("reposts"), count("comments"), F.col("views.count").alias("views"),
        some("attachments").alias("contains_media"), some("copy_history").alias("has_copy_history"),
    )


def registry_upsert(existing: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Existing rows refreshed by fetched ones with the same key, and the new ones (S19, MERGE)."""
    cols = [c for c in existing.columns if c != key]
    both = existing.alias("e").join(fetched.alias("f"), key, "full")
    return both.select(key, *[F.coalesce(f"f.{c}", f"e.{c}").alias(c) for c in cols])


def registered_authors(posts: DataFrame) -> DataFrame:
    """Distinct positive authors of CURRENT posts."""
    return posts.where("window = 'CURRENT' and from_id > 0").select("from_id").distinct()


def top_authors(posts: DataFrame, n: int = TOP_AUTHORS) -> DataFrame:
    """Authors with the most topic posts."""
    return posts.where("relevant <=> true and from_id > 0").groupBy("from_id").agg(F.count("*").alias("n_posts")).orderBy(F.desc("n_posts"), "from_id").limit(n)


def top_commented(posts: DataFrame, n: int = TOP_POSTS) -> DataFrame:
    """CURRENT posts with the most comments."""
    return posts.where("window = 'CURRENT' and comments > 0").orderBy(F.desc("comments"), "id").limit(n)


def time_segments(spark: SparkSession, start: Column, end: Column, days: int) -> DataFrame:
    """Consecutive segments of so many days that cover a period; the last may be shorter."""
    starts = F.sequence(F.unix_timestamp(start), F.unix_timestamp(end) - 1, F.lit(days * 86400))
    rows = spark.range(1).select(F.explode(starts).alias("start"), F.unix_timestamp(end).alias("end"))
    return rows.select(F.timestamp_seconds("start").alias("start"), F.timestamp_seconds(F.least(F.col("start") + days * 86400, F.col("end"))).alias("end"))


def search_segments(posts: DataFrame, start: Column, end: Column, full: int = SEGMENT_FULL) -> DataFrame:
    """Post counts of 7-day segments; segments that reach the page limit are counted day by day instead."""
    second = F.unix_timestamp("published_at")
    inside = posts.where(F.col("published_at").between(start, end)).withColumn("week", F.floor((second - F.unix_timestamp(start)) / (7 * 86400)))
    weekly = inside.groupBy("week").agg(F.count("*").alias("n"))
    marked = inside.join(F.broadcast(weekly), "week").withColumn("split", F.col("n") >= full)
    origin = F.when(F.col("split"), F.floor((second - F.unix_timestamp(start)) / 86400) * 86400).otherwise(F.col("week") * 7 * 86400)
    length = F.when(F.col("split"), 1).otherwise(7)
    return marked.groupBy(F.timestamp_seconds(F.unix_timestamp(start) + origin).alias("segment_start"), length.alias("days")).agg(F.count("*").alias("n_posts"))


def community_ids(entries: DataFrame, column: str) -> DataFrame:
    """Kinds and values of community identifiers in free text: numeric ids or screen names."""
    parts = F.explode(F.filter(F.transform(F.split(column, "[,\n ]"), lambda x: F.trim(x)), lambda x: x != ""))
    cleaned = entries.select(column, parts.alias("part")).withColumn("part", F.regexp_replace("part", r"^(https://)?(http://)?(vk\.com/)?(m\.vk\.com/)?", ""))
    number = F.coalesce(F.nullif(F.regexp_extract("part", r"^(?:club|public)(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract("part", r"^([+-]?\d+)$", 1), F.lit("")))
    kind = F.when(number.try_cast("int").isNotNull(), "ID").when(F.col("part").rlike(r"^[a-zA-Z0-9_.]+$"), "NAME")
    return cleaned.select(column, kind.alias("kind"), F.when(kind == "ID", number.try_cast("int")).alias("id"), F.when(kind == "NAME", F.col("part")).alias("name")).where("kind is not null")


class RateLimiter:
    """At most so many calls in any second."""

    def __init__(self, per_second: float = 2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.count, self.window = max(1, int(per_second)), max(1.0, 1.0 / per_second)
        self.clock, self.sleep = clock, sleep
        self.calls: deque[float] = deque()

    def acquire(self) -> None:
        """Wait until another call is allowed, and count it."""
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0] >= self.window:
                self.calls.popleft()
            if len(self.calls) < self.count:
                self.calls.append(now)
                return
            self.sleep(self.window - (now - self.calls[0]))


class RemoteError(OSError):
    """A failed remote call: an HTTP status, or an error number of the remote service."""

    def __init__(self, message: str = "", status: int | None = None, code: int | None = None):
        super().__init__(message)
        self.status, self.code = status, code


def with_retry(call: Callable, retries: int = 5, longest: float = 60, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None):
    """The result of a call, tried again after waits of 2, 4, 8 ... seconds, longest at most, and up to one more.

    A client's error (a status that is neither 429 nor 500 to 599) and flood control are raised at once.
    """
    rng = rng or random.Random()
    for attempt in range(1, retries + 2):
        try:
            return call()
        except OSError as e:
            status = getattr(e, "status", None)
            if getattr(e, "code", None) == FLOOD_CODE or attempt > retries or not (status is None or status == 429 or 500 <= status <= 599):
                raise
            sleep(min(2**attempt, longest) + rng.random())


class FloodControl:
    """Retries of a page under flood control (S22): waits of FLOOD_WAITS seconds, as many times in a row as there are waits."""

    def __init__(self, waits: Sequence[float] = FLOOD_WAITS, retries: int | None = None, sleep: Callable[[float], None] = time.sleep):
        self.waits, self.sleep = waits, sleep
        self.retries = len(waits) if retries is None else retries
        self.used = 0

    def reset(self) -> None:
        """A page arrived: the next flood starts a new series."""
        self.used = 0

    def wait(self) -> bool:
        """Wait before the same page is tried again; False if the series has used all retries."""
        self.used += 1
        if self.used > self.retries:
            return False
        self.sleep(self.waits[min(self.used, len(self.waits)) - 1])
        return True

    def page(self, call: Callable):
        """The result of a call that flood control may refuse, or None after the last retry."""
        while True:
            try:
                found = call()
            except OSError as e:
                if getattr(e, "code", None) != FLOOD_CODE:
                    raise
                if not self.wait():
                    return None
                continue
            self.reset()
            return found


def pages(fetch: Callable[[int], tuple[list[dict], int]], max_rows: int, since: datetime | None = None) -> Iterator[dict]:
    """Rows of an offset-paged source: until an empty page, the cap, a row older than since, or the count."""
    offset = 0
    while offset < max_rows:
        rows, count = fetch(offset)
        for row in rows[: max_rows - offset]:
            if since is not None and row["date"] < since.timestamp():
                return
            if row.get("id"):
                yield row
        offset += len(rows)
        if not rows or offset >= count:
            return


def batches(calls: Sequence, run: Callable[[Sequence], list], size: int = 25) -> list:
    """Results of calls made in batches; a batch that returns too few is padded with nulls."""
    out = []
    for k in range(0, len(calls), size):
        found = run(calls[k : k + size])
        out += [*found, *[None] * (len(calls[k : k + size]) - len(found))]
    return out


def cursor_pages(fetch: Callable[[str | None], tuple[list[dict], str | None]], max_rows: int) -> Iterator[dict]:
    """Rows of a source whose pages name the next one: until none is named, an empty page, or the cap."""
    cursor, seen = None, 0
    while seen < max_rows:
        rows, cursor = fetch(cursor)
        yield from rows[: max_rows - seen]
        seen += len(rows)
        if not rows or not cursor:
            return


class _Keys(InputPartition):
    def __init__(self, keys: list[str], share: float):
        super().__init__(keys)
        self.keys, self.share = keys, share


class _RemoteReader(DataSourceReader):
    """Reads keys (owners, ids, queries) of a remote method through a function that the option fetch names (module:function).

    Keys are dealt to the number of partitions that the option partitions gives (1 by default), which share the calls a
    second that are allowed among them, so that together they never make more.
    """

    def __init__(self, options, kind: str):
        self.options, self.kind = dict(options), kind

    def partitions(self):
        keys = [k.strip() for k in self.options["keys"].split(",") if k.strip()]
        count = max(1, min(int(self.options.get("partitions", 1)), len(keys)))
        return [_Keys(keys[k::count], float(self.options.get("calls_a_second", CALLS_A_SECOND)) / count) for k in range(count)]

    def read(self, partition):
        import importlib

        module, name = self.options["fetch"].split(":")
        fetch, limiter, flood = getattr(importlib.import_module(module), name), RateLimiter(partition.share), FloodControl()
        most = int(self.options.get("max_rows", 10_000))

        def call(key, at):
            def once():
                limiter.acquire()
                return with_retry(lambda: fetch(key, at))

            return flood.page(once)

        make = REMOTE[self.kind][1]
        if self.kind in ("wall", "comments", "groups"):
            for key in partition.keys:
                for row in pages(lambda offset, key=key: call(key, offset) or ([], 0), most):
                    yield make(key, row)
        elif self.kind == "newsfeed":
            for key in partition.keys:
                for row in cursor_pages(lambda cursor, key=key: call(key, cursor) or ([], None), most):
                    yield make(key, row)
        else:  # many keys in one call, at most a page of them
            size = BATCH_CALLS if self.kind in ("likes", "resolve") else PAGE_ROWS
            for start in range(0, len(partition.keys), size):
                some = partition.keys[start : start + size]
                for key, row in zip(some, batches(some, lambda part: call(part, None) or [], size), strict=True):
                    if row is not None:
                        yield make(key, row)


_count = lambda row, name: (row.get(name) or {}).get("count", 0)
#: Remote methods: the columns of their rows, and a row from a key and a record.
REMOTE = {
    "wall": (
        "owner_id long, id long, from_id long, date long, text string, likes int, reposts int, comments int, views int",
        lambda k, r: (int(k), r["id"], r.get("from_id"), r["date"], r.get("text", ""), *(_count(r, c) for c in ("likes", "reposts", "comments")), (r.get("views") or {}).get("count")),
    ),
    "comments": ("post string, id long, from_id long, date long, text string, likes int", lambda k, r: (k, r["id"], r.get("from_id"), r["date"], r.get("text", ""), _count(r, "likes"))),
    "users": (
        "id long, first_name string, last_name string, screen_name string, followers int, is_closed boolean",
        lambda k, r: (r["id"], r.get("first_name"), r.get("last_name"), r.get("screen_name"), r.get("followers_count"), r.get("is_closed", False)),
    ),
    "groups": ("query string, id long, name string, screen_name string, members int, is_closed boolean", lambda k, r: (k, r["id"], r.get("name"), r.get("screen_name"), r.get("members_count"), bool(r.get("is_closed", 0)))),
    "newsfeed": ("query string, id long, owner_id long, from_id long, date long, text string", lambda k, r: (k, r["id"], r.get("owner_id"), r.get("from_id"), r["date"], r.get("text", ""))),
    "likes": ("item string, likes int", lambda k, r: (k, r["count"])),
    "resolve": ("name string, type string, id long", lambda k, r: (k, r.get("type"), r.get("object_id"))),
}


class RemoteSource(DataSource):
    """A remote method as a Spark data source: wall, comments, users, groups, newsfeed, likes or resolve.

    Options: method, keys (with commas between them), fetch (module:function), and partitions, calls_a_second, max_rows.
    The function gets a key and an offset, a cursor or, where many keys go in one call, a list of keys, and returns
    (rows, count), (rows, next cursor) or a row for each key; it raises RemoteError with a status or a code.
    """

    @classmethod
    def name(cls) -> str:
        return "vociflow_remote"

    def schema(self) -> str:
        return REMOTE[self.options["method"]][0]

    def reader(self, schema):
        return _RemoteReader(self.options, self.options["method"])
