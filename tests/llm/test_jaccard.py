"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from vociflow.llm import common, jaccard


def brute(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed, n=150, vocabulary=60, long=(1, 140)):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(*long))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 12])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(500)}"] * rng.randint(0, 2)
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "words", "num"), [(1, 3, 90), (2, 5, 80), (3, 1, 80)])
def test_equals_brute_force(docs, seed, words, num):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(rows), words, num, 100).collect()}
    assert got == brute(rows, words, num, 100)
    assert any(c != i for i, (_, c) in got.items())


def test_large_clusters_are_joined_in_parts(docs):
    rows = corpus(7, 120)
    got = jaccard.jaccard_components(docs(rows), 3, 90, 100, cluster_shingles=100, block_docs=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("cluster_shingles", [100, 6_000_000])
def test_common_shingles_do_not_change_links(docs, monkeypatch, cluster_shingles):
    monkeypatch.setattr(jaccard, "COMMON_IN_BATCH", 3)
    rows = [(i, "this line is in every text of them " + t) for i, t in corpus(9, 120)]
    got = jaccard.jaccard_components(docs(rows), 3, 90, 100, cluster_shingles=cluster_shingles, block_docs=10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 90, 100)


def test_large_cluster_that_pivots_do_not_part(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    rng = random.Random(3)
    common = [f"c{k}" for k in range(12)]
    rows = [(k, " ".join([*common, *(f"p{k}x{j}" for j in range(4)), *(["q"] * (k % 3))])) for k in range(60)]
    rows += [(100 + k, rng.choice(rows)[1] + " end") for k in range(30)]
    got = jaccard.jaccard_components(docs(rows), 2, 85, 100, cluster_shingles=50, block_docs=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 2, 85, 100)


def test_rows_with_one_id_and_different_texts(docs):
    a, b, c = ("a b c d e f g h i j k l m n o p", "one two three four five six seven eight nine ten", "quite another text of some more words than five")
    rows = docs([(1, a), (5, a), (5, b), (7, b), (7, c), (8, None), (8, None), (9, c), (9, c)])
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.drop_linked(rows).collect() if r["text"])
    assert got == sorted([(1, a), (5, b), (7, c)])
    assert jaccard.drop_linked(rows).where("text is null").count() == 2
    parts = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(rows).where("n_shingles > 0").collect()}
    assert parts == {(1, 1), (5, 1), (5, 5), (7, 5), (7, 7), (9, 7)}


def test_pivots_and_cells_make_the_links_of_small_clusters():
    rng = np.random.default_rng(6)
    bases = [rng.integers(0, 2**62, 100).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.append(bases[k % 4][rng.random(100) > 0.02], rng.integers(0, 2**62, 2).astype(np.uint64))) for k in range(20)]
    region = jaccard.Region(sets, 85, 100)
    region.join(np.arange(20))
    assert len(set(region.label.tolist())) == 4 and region.merged == {"pivots": 16}


def test_edge_rows(docs):
    long = " ".join(f"a{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, long), (8, long + " end"), (9, "É b c"), (10, "é b c"), (4, "One two"), (None, "one two")]
    got = jaccard.jaccard_components(docs(rows), 3, 90, 100).collect()
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got)
    assert found == [(-1, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29_998, 7), (8, 29_999, 7), (9, 1, 9), (10, 1, 10)]
    assert jaccard.jaccard_components(docs([]), 3, 90, 100).count() == 0


def test_one_of_each_group_stays_with_all_columns(docs):
    rows = corpus(4)
    table = docs([*rows, rows[0], rows[0]])
    kept = jaccard.drop_linked(table)
    expected = {c for _, c in brute(rows, 5, 80, 100).values()}
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)


def test_a_region_of_many_near_copies_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) > 0.05], rng.integers(0, 2**62, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(150)]
    region = jaccard.Region(sets, 85, 100)
    region.join(np.arange(150))
    label = list(range(150))
    for a in range(150):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    assert region.label.tolist() == label


def test_clusters_of_chance_are_parted_before_rounds(docs, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    links = [fresh(3) for _ in range(31)]
    rows = [(k, " ".join([*links[k], *fresh(60), *links[k + 1], *fresh(60)])) for k in range(30)]  # a chain, two shingles at a time
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 30, 3)] + [(200 + k, rows[k][1].replace("w", "v", 12)) for k in range(30)]
    monkeypatch.setattr(jaccard, "_join_large", lambda *_: pytest.fail("went by rounds"))
    for blocks in (2, 10_000):
        got = jaccard.jaccard_components(docs(rows), 3, 90, 100, cluster_shingles=1000, region_docs=blocks).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 90, 100)


def test_sketches_part_no_linked_pair():
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 20, 127, 128, 600, 5000, 40_000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(np.append(base[rng.random(n) > p / 2], rng.integers(0, 2**63, int(n * p / 2)).astype(np.uint64))) for p in (0, 0.01, 0.05, 0.1, 0.2, 0.3) * 2]
    lookup = jaccard._sketches(1)
    import pyarrow as pa

    nodes = np.arange(len(sets))
    sketches = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "shingles", lambda text, *_: sets[int(text)])
        for k in nodes:
            mark = jaccard._fingerprint(sets[k])
            batch = pa.RecordBatch.from_pydict({"text": [str(k)], "node": [mark[0]], "low": [mark[1]]})
            sketches += [b for out in lookup(iter([batch])) for b in out["sketch"].to_pylist()]
    label = jaccard._alike(nodes, np.array([len(s) for s in sets]), sketches, 90, 100)
    for a in nodes:
        for b in nodes[:a]:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert label[a] == label[b] or 100 * both < 90 * (len(sets[a]) + len(sets[b]) - both)
    assert len(set(label.tolist())) > 10


def test_equal_sets_of_other_batches_count_once():
    import pyarrow as pa

    rows = [(1, 5), (1, 5), (2, 5), (2, 6), (2, 6), (3, 7), (4, 1), (4, 1), (4, 2)]
    for cut in range(1, len(rows)):
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "node": [n for _, n in part]}) for part in (rows[:cut], rows[cut:])]
        out = [tuple(r.values()) for b in jaccard._shared_keys(iter(batches)) for r in b.to_pylist()]
        assert sorted(out) == [(1, 4, 2), (2, 4, 2), (5, 2, 2), (6, 2, 2)]


def test_texts_stay_where_they_are_when_many_go(docs, spark, monkeypatch):
    rows = corpus(4)
    table = docs([*rows, rows[0], rows[0], (None, rows[3][1])])
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.drop_linked(table)
        expected = {c for _, c in brute(rows, 5, 80, 100).values()}
        assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(expected)
        assert kept.where("doc_id is null").count() == 1
        assert jaccard.drop_linked(docs(rows)).where("n = 1")._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    some = docs([(k, "t") for k in range(0, 400, 3)]).select(F.col("doc_id").alias("k"))
    seen = common.may_match(docs([(k, "t") for k in range(400)]), F.xxhash64("doc_id"), some, F.xxhash64("k")).collect()
    assert {r["doc_id"] for r in seen if r["__may"]} == set(range(0, 400, 3))
