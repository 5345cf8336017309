"""Decontamination against brute force, and toxicity on planted words."""

import random

import numpy as np
import pytest

from vociflow.llm import decontam, toxicity


@pytest.fixture(scope="module")
def items(duck):
    return duck.execute("SELECT item_id, text FROM benchmark").fetchall()


def planted(items, n=120, seed=3):
    rng = random.Random(seed)
    words = sorted({w for _, t in items for w in t.split()}) + [f"z{k}" for k in range(200)]
    rows, truth = [], set()
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 700))]
        if k % 3 == 0:
            item, passage = rng.choice(items)
            at = rng.randint(0, len(text))
            passage = passage.upper().split() if k % 2 and passage.isascii() else passage.replace(",", "").split()
            text[at:at] = passage
            truth.add((k, item))
        rows.append((k, " ".join(text)))
    return rows, truth


def test_planted_items_are_found_and_nothing_else(spark, docs, items):
    rows, truth = planted(items)
    benchmark = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    table = docs(rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(table, benchmark).collect()}
    assert got == truth
    kept = decontam.drop_leaks(table, benchmark)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in truth}


@pytest.mark.parametrize(("postings", "passages"), [(decontam.POSTINGS, decontam.PASSAGES), (50, 7)])
def test_search_finds_all_items_above_their_threshold(items, monkeypatch, postings, passages):
    monkeypatch.setattr(decontam, "POSTINGS", postings)
    monkeypatch.setattr(decontam, "PASSAGES", passages)
    index = decontam.build_index(items)
    rng = np.random.default_rng(1)
    some = [[index.terms[w] for w in decontam._words(items[k][1])[: rng.integers(5, 60)]] for k in range(40)]
    queries = [np.unique(np.concatenate([rng.choice(len(index.terms), 60), own])) for own in some]
    passage, item, score = decontam.search(index, np.concatenate(queries), np.repeat(np.arange(40), [len(q) for q in queries]))
    level, found = index.items, 0
    for k, ids in enumerate(queries):
        exact = np.zeros(len(index.item_ids))
        for t in ids:
            own = slice(level.starts[t], level.starts[t + 1])
            exact[level.blocks[own]] += level.maxima[own]
        mine = item[passage == k]
        found += len(mine)
        assert mine.tolist() == np.flatnonzero(exact >= 1 - 1e-9).tolist()
        assert score[passage == k] == pytest.approx(exact[mine] * index.threshold[mine])
    assert found


@pytest.mark.parametrize("following", [decontam.FOLLOWING, 0])
def test_traversal_scores_the_blocks_whose_maxima_reach_the_threshold(items, monkeypatch, following):
    monkeypatch.setattr(decontam, "FOLLOWING", following)
    index = decontam.build_index(items)
    rng, level = np.random.default_rng(7), index.blocks
    queries = [np.unique(rng.choice(len(index.terms), rng.integers(1, 120))) for _ in range(60)]
    passage, block = decontam._traverse(index, np.concatenate(queries), np.repeat(np.arange(60), [len(q) for q in queries]))
    for k, ids in enumerate(queries):
        bound = np.zeros(level.count)
        for t in ids:
            own = slice(level.starts[t], level.starts[t + 1])
            bound[level.blocks[own]] += level.maxima[own]
        assert block[passage == k].tolist() == np.flatnonzero(bound >= 1 - decontam.SLACK).tolist()


def test_all_pairs_by_overlap_are_found(spark, docs, items):
    """Retrieval loses no pair that verification accepts: against verifying every document with every item."""
    rng = random.Random(8)
    words = sorted({w for _, t in items for w in t.split()})
    rows = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split()
            cut = passage[: rng.randint(len(passage) // 2, len(passage))] if rng.random() < 0.5 else [w if rng.random() > 0.02 else "other" for w in passage]
            at = rng.randint(0, len(text))
            text[at:at] = cut
        rows.append((k, " ".join(text)))
    index = decontam.build_index(items)
    known, expected = decontam._Terms(index.terms), set()
    for k, text in rows:
        ids = np.array([known[w.encode()] for w in text.split()], np.int64)
        ids = ids[ids > -2]
        for i, item in enumerate(index.item_ids):
            shares = [np.isin(wanted, decontam._grams(ids, n)).mean() for n, wanted in (index.whole[i], index.question[i])]
            if shares[0] >= 0.8 or (shares[1] >= 0.8 and index.question_words[i] >= 13):
                expected.add((k, item))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.MAX_ITEMS, len(items) // 3):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs(rows), benchmark, most).collect()}
        assert got == expected and len(got) > 40


def test_ids_may_be_texts(spark, items):
    benchmark = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    rows = spark.createDataFrame([("a", items[3][1]), ("b", "nothing here")], "doc_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(rows, benchmark).collect()] == [("a", f"i{items[3][0]}")]


def test_thresholds_do_not_depend_on_the_number_of_indexes(spark, items):
    benchmark = spark.createDataFrame([*items, (10_000, None), (10_001, "")], "item_id long, text string")
    whole, shards = list(decontam.indexes(benchmark)[1]), list(decontam.indexes(benchmark, max_items=len(items) // 4)[1])
    assert len(whole) == 1 and len(shards) > 3
    of = lambda found: {i: t for index in found for i, t in zip(index.item_ids, index.threshold.tolist(), strict=True)}
    assert of(shards) == pytest.approx(of(whole))


def test_questions_alone_and_split_items_are_found(spark, docs):
    rng = random.Random(5)
    draw = lambda letter, n: [f"{letter}{rng.randint(0, 4000)}" for _ in range(n)]
    pairs = [(draw("q", 15 if k % 2 else 25), draw("r", 40 if k % 2 else 25)) for k in range(60)]
    benchmark = spark.createDataFrame([(k, " ".join(q) + ". " + " ".join(a)) for k, (q, a) in enumerate(pairs)], "item_id long, text string")
    filler = lambda: [f"z{rng.randint(0, 300)}" for _ in range(300)]
    rows = [(k, " ".join([*filler(), *q, *filler(), *([] if k % 2 else a), *filler()])) for k, (q, a) in enumerate(pairs)]
    rows += [(100 + k, " ".join([*filler(), *a, *filler()])) for k, (_, a) in enumerate(pairs)]
    table = docs(rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(table, benchmark).collect()}
    assert got == {(k, k) for k in range(60)}
    assert {r["doc_id"] for r in decontam.drop_leaks(table, benchmark).collect()} == set(range(100, 160))


def test_leak_edge_rows(spark, docs, items):
    text = items[0][1]
    benchmark = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "item_id long, text string")
    rows = docs([(1, None), (2, ""), (3, text), (3, text), (4, "word " * 60_000 + text)])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(rows, benchmark).collect())
    assert got == [(3, 1), (3, 1), (3, 4), (3, 4), (4, 1), (4, 4)]
    assert decontam.find_leaks(docs([]), benchmark).count() == 0
    assert decontam.find_leaks(rows, benchmark.limit(0)).count() == 0 and decontam.drop_leaks(rows, benchmark.limit(0)).count() == 5


def subsequence_kernel(a, b, decay=toxicity.DECAY, n=3):
    """The gap-weighted subsequence kernel by its dynamic programme, over whole words."""
    inner = np.ones((len(a) + 1, len(b) + 1))
    for _ in range(n - 1):
        below, new = inner, np.zeros_like(inner)
        for i in range(1, len(a) + 1):
            row = 0.0
            for j in range(1, len(b) + 1):
                row = decay * row + (decay**2 * below[i - 1, j - 1] if a[i - 1] == b[j - 1] else 0.0)
                new[i, j] = decay * new[i - 1, j] + row
        inner = new
    return sum(decay**2 * inner[i - 1, j - 1] for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if a[i - 1] == b[j - 1])


def test_kernel_equals_its_dynamic_programme():
    words = [toxicity.classes(w) for w in (b"idiot", b"idixot", b"banana", b"anagram", b"stupid", b"tpd")]
    for a in words:
        for b in words:
            norm = toxicity._norm(len(a)) * toxicity._norm(len(b))
            assert toxicity.kernel(toxicity.features(a), toxicity.features(b)) == pytest.approx(subsequence_kernel(a, b) / norm)


def test_folded_weights_equal_the_kernel_expansion():
    words = [toxicity.classes(w) for w in (b"idiot", b"stupid", b"moron", b"house", b"garden", b"window", b"river")]
    space = toxicity.Space(words)
    beta = np.array([1.0, 2, -1, 0, 3, 0.5, -2])
    model, probe = space.fold(beta, -0.5), toxicity.classes(b"idixot")
    value = sum(x * toxicity.kernel(toxicity.features(probe), toxicity.features(w)) for x, w in zip(beta, words, strict=True)) - 0.5
    assert toxicity.decide(model, [probe])[0] == pytest.approx(value)
    # With all words as landmarks coordinates give the kernel itself.
    x = space.place(words)
    assert (x @ x.T)[0, 2] == pytest.approx(toxicity.kernel(toxicity.features(words[0]), toxicity.features(words[2])), abs=1e-6)
    trained = space.train(words[:3], words[3:])
    assert (toxicity.decide(trained, words[:3]) > 0).all() and (toxicity.decide(trained, words[3:]) < 0).all()


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["idiot", "moron", "stupid"]
    rows = []
    for k in range(n):
        text = [word() for _ in range(rng.randint(5, 80))]
        if k % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((k, " ".join(text), int(k % 4 == 0)))
    return rows, word


def test_insults_are_learnt_with_gaps_and_inserted_characters(spark, docs):
    rows, word = labelled()
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows], "doc_id long, toxic int, text string")
    from pyspark.sql import functions as F

    model = toxicity.learn(docs([(i, t) for i, t, _ in rows]), labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs([(i, t) for i, t, _ in rows]), model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    tricks = ["id.iot", "i-d-i-o-t", "idiiot", "m o r o n", "St*upid!", "stupiid"]
    clean = [" ".join(word() for _ in range(20)) for _ in range(40)]
    probe = docs([(k, f"{clean[k]} {t} {clean[k + 1]}") for k, t in enumerate(tricks)] + [(100 + k, c) for k, c in enumerate(clean)])
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(probe, model).collect()}
    assert sum(found[k] for k in range(len(tricks))) >= 5 and sum(v for k, v in found.items() if k >= 100) <= 1


def test_toxicity_edge_rows(spark, docs):
    rows, _ = labelled(200)
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs([(i, t) for i, t, _ in rows]), labels, F.lit(True))
    probe = docs([(1, None), (2, ""), (3, "a"), (4, "x" * 100_000), (5, "idiot " * 30_000), (5, "idiot")])
    got = sorted((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.score_toxicity(probe, model).collect())
    assert all(0 <= s <= 1 for _, s, _ in got) and [p for *_, p in got[:3]] == [0, 0, 0]
    assert got[4] == got[5] and got[4][2] == 1
    empty = toxicity.learn(docs([]), labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity.score_toxicity(probe, empty).collect()} == {0}
