"""WARC archives, URL rules and quality rules against plain versions and SQL."""

import base64
import hashlib
import re

import pytest
from compare import canonical
from pyspark.sql import functions as F

from vociflow.llm import quality, queries, url_rules, warc


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    assert canonical(queries.QUERIES[name](spark, sf_dir)) == canonical(duck.execute(queries.SQL[name]))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, file int, head string")


def test_archives_reject_version_lines_in_payloads(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 666\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [
        (1, "http://a/ü ?q", "plain ünïcode"), (2, None, None), (3, "http://a", ""), (4, "http://b\r\nX: 1", fake), (5, "http://b", fake * 3 + "tail"), (6, "u", "WARC/1.0\r\n"), (7, "u", "plain ünïcode"),
        (8, "u", "\r\n\r\n"), (9, "u", "x" * 300_000), (10, "u", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (11, "u", fake), (5, "http://b", fake * 3 + "tail"), (None, "u", "plain ünïcode"),
    ]
    got = warc.archive_pages(pages(spark, rows).coalesce(2), "file://" + str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    expected = []
    for i, _, h in rows:
        again = i is not None and i != first[h or ""]
        expected.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first[h or ""] if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_archives_read_in_small_splits(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k} " * (k % 50)) for k in range(300)]
    path = "file://" + str(tmp_path / "w")
    warc.write_warc(warc.plan_records(pages(spark, rows).coalesce(1)), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sorted(r["page_id"] for r in warc.read_warc(spark, path).collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages(spark, tmp_path):
    assert warc.archive_pages(pages(spark, []), "file://" + str(tmp_path / "w")).count() == 0


def test_url_rules(spark):
    urls = [
        "http://x.com/a", "http://Example.COM/en/1?x#y", "https://www.example.com/en/2", "http://a.net/es/", "http://a.net/fr", "http://org/", "nothing", None, "", "http://com", "http://com/", "x://b.example.com/en/", "http://notexample.com/en/",
        "http://h.org/ads/1", "http://h.org/?sid=3", "http://h.org/x/login", "http://h.org/tag/a/page/2", "http://h.org/tag/a/", "http://com:80/", "http://a.net/es/", "ftp://q?http://com/",
    ]
    rows = spark.createDataFrame([(k % 19, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_rules.judge_urls(rows).collect()))
    expected = []
    for k, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in url_rules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = any(re.search(p, u or "") for _, p, _ in url_rules.PATTERN_RULES)
        best = max(fit, default=None)
        expected.append((k % 19, host, path, best[1] if best else "", best[2] if best else "block" if own else "allow"))
    assert got == sorted(expected)
    assert url_rules.judge_urls(rows.limit(0)).count() == 0


def adblock_fits(rule, url):
    """Whether a rule of a filter list fits a URL, character by character."""
    body = rule.removeprefix("@@")
    if len(body) > 2 and body[0] == body[-1] == "/":
        return bool(re.search(body[1:-1], url, re.I | re.S))
    domain, start, end = body.startswith("||"), body.startswith("|") and not body.startswith("||"), body.endswith("|")
    body = body.removeprefix("||").removeprefix("|").removesuffix("|").lower()
    low = url.lower()

    def at(i, k):
        if k == len(body):
            return i == len(low) if end else True
        if body[k] == "*":
            return any(at(j, k + 1) for j in range(i, len(low) + 1))
        if body[k] == "^" and i == len(low):
            return at(i, k + 1)
        if i < len(low) and (not re.match(r"[0-9a-z_.%-]", low[i]) if body[k] == "^" else low[i] == body[k]):
            return at(i + 1, k + 1)
        return False

    if domain:
        m = re.match(r"[a-z][a-z0-9+.-]*://", low)
        host = re.match(r"[^/?#]*", low[m.end() :])[0] if m else ""
        places = [m.end(), *(m.end() + j + 1 for j, c in enumerate(host) if c == ".")] if m else []
    else:
        places = [0] if start else range(len(low) + 1)
    return any(at(i, 0) for i in places)


@pytest.mark.parametrize("broadcast_rows", [200_000, 10])
def test_thousands_of_rules_from_a_list(spark, tmp_path, monkeypatch, broadcast_rows):
    import random

    from vociflow.llm import common

    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(4)
    names = [f"n{rng.randrange(900)}" for _ in range(900)]
    pick = lambda: rng.choice(names)
    kinds = [
        lambda: f"||{pick()}.com^", lambda: f"/{pick()}/{pick()}^", lambda: f"&{pick()}=", lambda: f"{pick()}/{pick()}", lambda: f"/{pick()}*{pick()}|", lambda: f"|http://{pick()}.org/", lambda: f"@@||{pick()}.org^*/{pick()}/",
    ]
    rules = [rng.choice(kinds)() for _ in range(3000)] + ["/x[0-9]{3}y/", "@@/Q(1|2)z/", "a.b|c", "b*^"]
    path = tmp_path / "rules.txt"
    path.write_text("\n".join(["! comment", "[Adblock]", "example.com##.ad", "||h.com^$third-party", "", *rules]))
    urls = [f"http://{pick()}.{rng.choice(['com', 'org', 'com.x'])}/{pick()}/{pick()}{rng.choice(['', '/', '?a=1&' + pick() + '=2', '/' + pick(), 'x123Y', '/q1Z'])}" for _ in range(400)] + [None, "", "nothing", "http://A.b|c", "HTTP://N1.com"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_rules.read_rules(spark, "file://" + str(path))
    assert found.count() == len(set(rules))
    hosts = url_rules.rules_table(spark, pattern_rules=(), any_token=(), host_rules=[("allow", f"{n}.com.x", "/") for n in names[:50]])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(table, found.unionByName(hosts)).collect()}
    for k, u in enumerate(urls):
        fit = [r for r in rules if adblock_fits(r, u or "")]
        own = "block" if fit and not any(r.startswith("@@") for r in fit) else "allow"
        host = next((f"{n}.com.x/" for n in names[:50] if (u or "").startswith(f"http://{n}.com.x/")), None)
        assert got[k] == (host, "allow" if host else own), (u, fit)
    assert {"block", "allow"} == {v for _, v in got.values()}


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a a", "x\n x\nx\n\nx", "é# <b>|$%&* é", "a b c d a b c e a b", "one\x0btwo\x0cthree\rfour", "w " * 30_000]
    rows = spark.createDataFrame([(k, t, None if k % 2 else "s", 5, "m") for k, t in enumerate(texts)], "doc_id long, text string, source string, n long, m string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.judge_documents(rows).collect()}
    for k, t in enumerate(texts[:-1]):
        assert got[k] == plain_measures(t), t
    assert got[len(texts) - 1] == (30_000, 30_000, 0, 0, 30_000)
    assert quality.judge_documents(rows.limit(0)).count() == 0


def test_bad_hosts_are_rejected_and_columns_stay(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good, "fine", "h") for k in range(40)] + [(100 + k, good if k < 5 else "short", "bad", "h") for k in range(60)] + [(300, good, None, "h"), (300, good, None, "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    kept = quality.keep_quality(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 300, 300]
    judged = {(r["doc_id"], r["base_failed"], r["kept"]) for r in quality.judge_documents(table).collect()}
    assert (100, False, False) in judged and (0, False, True) in judged


def test_documents_are_not_written_to_be_judged(spark, monkeypatch):
    written = []
    stage = quality.stage_table
    monkeypatch.setattr(quality, "stage_table", lambda df, tag: written.append(df.columns) or stage(df, tag))
    texts = [None, "", "word " * 49, " ".join(f"w{k}" for k in range(50)), "a b c " * 20, " ".join(f"w{k}" for k in range(40)) + " a b c" * 9, "\x0b\n"]
    table = spark.createDataFrame([(k, t, "s", "r") for k, t in enumerate(texts)], "doc_id long, text string, source string, row string")
    kept = {r["doc_id"] for r in quality.keep_quality(table).collect()}
    assert kept == {r["doc_id"] for r in quality.judge_documents(table).where("kept").collect()}
    assert written[0] == ["host", "n", *quality.RULES]


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] >= sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]
