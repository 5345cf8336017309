"""Records of JSON files read in byte ranges against the whole file parsed at once."""

import json

import numpy as np
import pytest

from vociflow.sources import importer, json_records


def awkward(rng, k):
    parts = ['}', '{', '"', '\\', '\n', '],[', '": [{', '"posts": [ {', "ünï", "\U0001f600", "a b", "\\u007d", "}}}", "\\\""]
    return {"vkId": k, "text": "".join(rng.choice(parts) for _ in range(int(rng.integers(0, 9)))), "more": {"deep": [{"x": "}"}, {}], "posts": [{"vkId": 7}]}, "list": [[1, 2], []]}


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_equal_those_of_the_whole_file(spark, tmp_path, small_ranges, indent, seed):
    rng = np.random.default_rng(seed)
    whole = {
        "version": "1} [{", "meta": {"a": {"b": "}"}, "posts": []}, "empty": [], "n": -1.5e3, "communities": [awkward(rng, k) for k in range(3)], "none": None,
        "authors": [awkward(rng, k) for k in range(25)], "posts": [awkward(rng, k) for k in range(60)], "description": 'say "posts": [ {', "comments": [awkward(rng, 1)], "last": True,
    }
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=seed == 2), encoding="utf-8")
    found = {}
    arrays = json_records.read_arrays(spark, f"file://{tmp_path}/*.json")
    for r in arrays.collect():
        found[r["file"].rsplit("/", 1)[-1], r["name"], r["position"]] = json.loads(r["json"])
    assert found == {(f"{f}.json", n, k): v for f in ("one", "two") for n, rows in whole.items() if isinstance(rows, list) for k, v in enumerate(rows)}


def test_ranges_of_a_file_are_read_by_several_tasks(spark, tmp_path, small_ranges):
    rows = [{"vkId": k, "ownerId": k, "fromId": 1, "date": k, "text": "}{" * (k % 5)} for k in range(300)]
    (tmp_path / "d.json").write_text(json.dumps({"posts": rows}))
    read = spark.read.option("lineSep", "}").text(f"file://{tmp_path}/d.json")
    assert read.rdd.getNumPartitions() > 10
    posts = importer.read_import(spark, f"file://{tmp_path}/d.json")["posts"].orderBy("position").collect()
    assert [(r["position"], r["vkId"], r["text"]) for r in posts] == [(k, k, "}{" * (k % 5)) for k in range(300)]


def test_only_records_are_written(spark, tmp_path, small_ranges, monkeypatch):
    """Pieces stay in their ranges: besides a row for each range, the records alone are written, once."""
    (tmp_path / "d.json").write_text(json.dumps({"posts": [{"vkId": k, "text": "}" * 5} for k in range(300)]}))
    written = []
    stage = json_records.stage_table
    monkeypatch.setattr(json_records, "stage_table", lambda df, tag: (written.append(tag), stage(df, tag))[1])
    assert importer.read_import(spark, f"file://{tmp_path}/d.json")["posts"].count() == 300
    assert written.count("records") == 1 and set(written) == {"ranges", "records"}
