"""Import, collection rules, stores and exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vociflow.operators import sentiment
from vociflow.sources import collection, corpus, importer, store

DATASET = {
    "communities": [{"vkId": 1, "name": "c"}, {"vkId": 1, "name": "later"}],
    "authors": [{"vkId": 5, "firstName": "A", "followersCount": 3, "unknown": 1}, {"vkId": 5, "firstName": "B"}],
    "posts": [
        {"vkId": 10, "ownerId": 5, "fromId": 5, "date": 1700000000, "text": "hello", "likes": 2},
        {"vkId": 10, "ownerId": 5, "fromId": 5, "date": 1700000000, "text": "again"},
        {"vkId": 10, "ownerId": 5, "fromId": 5, "date": 1700000000, "window": "BASELINE"},
    ],
    "comments": [
        {"vkId": 1, "postVkId": 10, "postOwnerId": 5, "fromId": 6, "date": 1700000001, "text": " "},
        {"vkId": 1, "postVkId": 10, "postOwnerId": 5, "fromId": 6, "date": 1700000001, "text": "twice"},
        {"vkId": 2, "postVkId": 99, "postOwnerId": 5, "fromId": 6, "date": 1700000001, "text": "lost"},
    ],
}


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("import") / "d.json"
    path.write_text(json.dumps(DATASET))
    return importer.read_import(spark, str(path))


def test_import(dataset):
    assert [r["name"] for r in importer.import_communities(dataset["communities"]).collect()] == ["c"]
    assert importer.import_authors(dataset["authors"]).first()["first_name"] == "A"
    posts = importer.import_posts(dataset["posts"], 1)
    assert {(r["window"], r["text"], r["likes"], r["views"]) for r in posts.collect()} == {("CURRENT", "hello", 2, None), ("BASELINE", "", 0, None)}
    comments = importer.import_comments(dataset["comments"], posts, 1).collect()
    assert [(c["vk_id"], c["text"], c["post_window"]) for c in comments] == [(1, None, "CURRENT")]


def test_import_twice_changes_nothing(dataset):
    once = importer.import_posts(dataset["posts"], 1)
    keys = ["session_id", "vk_id", "owner_id", "window"]
    assert importer.insert_if_absent(once, once, keys, ["published_at"]).count() == once.count()


def test_a_missing_file_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        importer.read_import(spark, "/nowhere.json")["posts"].count()


def test_corpus_violations(spark):
    authors, posts = corpus.generate_authors(spark), corpus.generate_posts(spark)
    roles = spark.createDataFrame([(1,), (999,)], "author_id int")
    assert [(r["rule"], r["id"]) for r in corpus.violations(authors, posts, roles).collect()] == [("ROLE_OF_UNKNOWN", 999)]
    assert posts.count() == 500 and authors.where("is_closed").count() == 5


def test_pages_stop_rules():
    rows = [{"id": k, "date": 100 - k} for k in range(1, 8)]
    fetch = lambda offset: (rows[offset : offset + 3], len(rows))
    assert [r["id"] for r in collection.pages(fetch, 100)] == [1, 2, 3, 4, 5, 6, 7]
    assert [r["id"] for r in collection.pages(fetch, 4)] == [1, 2, 3, 4]


def test_batches_pad_and_retries_end():
    assert collection.batches([1, 2, 3], lambda c: [x * 2 for x in c][:1], 2) == [2, None, 6]
    calls = []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        collection.with_retry(fails, retries=2, sleep=lambda s: None, rng=random.Random(1))
    assert len(calls) == 3


def test_rate_limiter_waits():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    limiter = collection.RateLimiter(2, lambda: now[0], sleep)
    for _ in range(3):
        limiter.acquire()
    assert waits == [1.0]


def test_partitions_share_the_calls_that_are_allowed():
    time = [0.0]
    slow = collection.RateLimiter(0.5, lambda: time[0], lambda s: time.__setitem__(0, time[0] + s))
    for _ in range(4):
        slow.acquire()
    assert time[0] == 6.0
    reader = collection._RemoteReader({"keys": "1,2,3", "partitions": "2", "fetch": "m:f"}, "wall")
    assert [(p.keys, p.share) for p in reader.partitions()] == [(["1", "3"], 1.0), (["2"], 1.0)]


def test_flood_control_waits_longer_and_gives_up():
    waits, answers = [], [9, 9, None, 9, 9, 9, 9]

    def call():
        code = answers.pop(0)
        if code:
            raise collection.RemoteError(code=code)
        return "page"

    flood = collection.FloodControl(sleep=waits.append)
    assert flood.page(call) == "page" and waits == [10, 30] and flood.used == 0
    assert flood.page(call) is None and waits == [10, 30, 10, 30, 60]


def test_retries_wait_twice_as_long_and_leave_client_errors():
    waits, answers = [], [503, 429, None]

    def call():
        status = answers.pop(0)
        if status:
            raise collection.RemoteError(status=status)
        return 1

    assert collection.with_retry(call, sleep=waits.append) == 1 and [int(w) for w in waits] == [2, 4]
    for error in (collection.RemoteError(status=404), collection.RemoteError(code=9)):
        with pytest.raises(OSError):
            collection.with_retry(lambda e=error: (_ for _ in ()).throw(e), sleep=waits.append)
    assert len(waits) == 2
    with pytest.raises(OSError):
        collection.with_retry(lambda: (_ for _ in ()).throw(collection.RemoteError(status=500)), 3, sleep=waits.append)
    assert len(waits) == 5


def fake_remote(key, at):
    """A remote service: two pages of 2 rows, then an end; users and likes come by lists of keys."""
    if isinstance(key, list):
        return [None if k == "0" else {"id": int(k), "count": 3, "object_id": 5, "type": "user"} for k in key[:-1]] if len(key) > 2 else [{"id": int(k), "count": 4} for k in key]
    if at is None or isinstance(at, str):
        return [{"id": 7 if at else 6, "date": 1}], None if at else "next"
    rows = [{"id": at + k + 1, "date": 1, "likes": {"count": 2}, "views": None} for k in range(2 if at < 4 else 0)]
    return rows, 100


@pytest.mark.parametrize(("method", "keys", "expected"), [
    ("wall", "1,2", 8), ("comments", "1_2", 4), ("groups", "q", 4), ("newsfeed", "q", 2), ("users", "1,2", 2), ("likes", "1,0,2,3", 2), ("resolve", "4,5,6", 2),
])
def test_remote_methods(method, keys, expected):
    reader = collection._RemoteReader({"keys": keys, "fetch": "test_sources:fake_remote", "calls_a_second": "1000"}, method)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    columns = [c.split()[0] for c in collection.REMOTE[method][0].split(", ")]
    assert len(rows) == expected and all(len(r) == len(columns) for r in rows)


def test_remote_source_in_a_session(spark):
    spark.dataSource.register(collection.RemoteSource)
    got = spark.read.format("vociflow_remote").option("method", "wall").option("keys", "1,2").option("fetch", "test_sources:fake_remote").load()
    assert got.columns == ["owner_id", "id", "from_id", "date", "text", "likes", "reposts", "comments", "views"]


def test_session_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_session(spark.createDataFrame([(1, "a"), (2, "b")], "session_id int, v string"), path)
    store.write_session(spark.createDataFrame([(2, "c")], "session_id int, v string"), path)
    assert {(r["session_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    assert "PartitionFilters: [isnotnull(session_id" in store.scan_session(spark, path, 2)._jdf.queryExecution().toString()


def test_sessions_and_forks(spark):
    one = store.new_session(spark, {"id": 1, "name": "s"}, {"primary_ngrams": ["a ", " ", "b"], "excluded_ngrams": []})
    row = store.fork_session(one, 2, name="t").first()
    assert (row["id"], row["session_family_id"], row["name"], row["primary_ngrams"], row["excluded_ngrams"]) == (2, 1, "t", "a\nb", None)


def test_raw_export_needs_confirmation(spark, tmp_path):
    row = {c: 1.0 for c in store.EXPORT_COLUMNS} | {"vk_id": 7, "author_name": 'A, "B"', "role": None, "sufficiency": "x", "top_vol": 2, "topic_posts": 2, "comments": 3}
    rows = spark.createDataFrame([{k: v for k, v in row.items() if k != "role"}]).withColumn("role", F.lit(None).cast("string"))
    store.export_csv(rows, str(tmp_path / "safe"), raw=True)
    safe = spark.read.option("header", True).csv(str(tmp_path / "safe"))
    assert "author_hash" in safe.columns and len(safe.first()["author_hash"]) == 64
    store.export_csv(rows, str(tmp_path / "raw"), raw=True, confirmed=True)
    raw = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "raw")).first()
    assert raw["vk_id"] == "7" and raw["aud"] == "1.0000" and raw["top_vol"] == "2"
    assert json.loads(store.json_document(rows, 4, "secret", b"s").first()["document"])["sessionName"] == "Session #4"


def test_import_query_keeps_one_comment_of_each_repeated_id(spark, duck, sf_dir):
    from vociflow.plans import catalog

    found = [r["vk_id"] for r in catalog.composite_key_import_join(spark, sf_dir).select("vk_id").collect()]
    wanted = duck.execute("SELECT DISTINCT l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 = 1").fetchall()
    assert sorted(found) == sorted(x for (x,) in wanted)


@pytest.mark.parametrize("n", [0, 1, 40])
def test_a_json_export_in_parts_is_the_document(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("vk_id"), F.lit('a "quoted" \\ name').alias("role"), *[(F.col("id") / 3).alias(c) for c in store.EXPORT_COLUMNS if c != "role"])
    for raw in (False, True):
        path = tmp_path / f"{n}{raw}"
        store.export_json(rows, f"file://{path}", 4, 'se"cret', b"s", raw)
        parts = "".join(f.read_text() for f in sorted(path.glob("part-*")))
        assert parts.removesuffix("\n") == store.json_document(rows, 4, 'se"cret', b"s", raw).first()["document"]


def test_a_second_run_finds_all_results_without_moving_the_table(spark):
    texts = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)] + [(99, None)], "id long, text string")
    asked = []

    def compute(missing):
        asked.append(sorted(str(r["text"]) for r in missing.collect()))
        return missing.select("text_hash", F.upper("text").alias("result"))

    name = "cache_of_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    first = sentiment.cached_in_table(texts.where("id < 3"), name, "v1", compute)
    assert first.count() == 3 and asked == [["text 0", "text 1", "text 2"]]
    whole = sentiment.cached_in_table(texts, name, "v1", compute)
    assert {(r["text"], r["result"]) for r in whole.collect()} == {(f"text {k}", f"TEXT {k}") for k in range(7)} | {(None, None)}
    again = sentiment.cached_in_table(texts.where("text is not null"), name, "v1", compute)
    assert again.count() == 40 and asked[2] == []
    sentiment.cached_in_table(texts.where("id < 3"), name, "v2", compute)
    assert len(asked[3]) == 3 and spark.table(name).where("model_version = 'v1' and text_hash is not null").count() == 7
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again._jdf.queryExecution().sparkPlan().toString(), again._jdf.queryExecution().executedPlan().toString()
        side = plan[1].split("Initial Plan")[-1].split("Bucketed: true")[0].rsplit("SortMergeJoin", 1)[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan[1] and side.count("Exchange hashpartitioning") <= 1  # that of the texts


def test_exported_floats_are_rounded_as_sql_rounds_them(spark, duck):
    """Among fractions with a 5 in the fifth place are some whose product with 10,000 is below the tie (0.02175)."""
    made = "(SELECT k * 1.0::DOUBLE / n AS aud, k * n AS i FROM range(1, 700) a(k), (SELECT unnest([32, 160, 800, 4000, 20000])::BIGINT AS n))"
    values = [x for (x,) in duck.execute(f"SELECT DISTINCT aud FROM {made} UNION SELECT -0.02175 UNION SELECT -0.00001").fetchall()]
    wanted = dict(duck.execute("SELECT x, printf('%.4f', round(x, 4)) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall())
    found = {r["aud"]: r["text"] for r in spark.createDataFrame([(x,) for x in values], "aud double").select("aud", store.number("aud").alias("text")).collect()}
    assert found == wanted and found[0.02175] == "0.0217"
