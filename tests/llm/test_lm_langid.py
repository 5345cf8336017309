"""The language model and language identification against plain versions."""

from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from vociflow.llm import backoff_lm, langid

ROWS = [
    (0, "the cat sat on the mat"), (1, "The cat sat on the hat"), (2, "a dog sat on the mat the cat sat"), (3, None), (4, ""), (5, "zebra the cat sat on"), (6, "unknown words only here and once"), (9, "twice here or there twice"),
    (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (8, " ".join(["the cat"] * 4000)),
]
HELD = {5, 6}


def plain_model(order=3):
    train = [["\t", *(t or "").lower().split(), "\n"] for i, t in ROWS if i not in HELD]
    counts = Counter(w for t in train for w in t[1:])
    n, v = sum(counts.values()), len(counts)
    grams = Counter(tuple(t[i : i + k]) for t in train for k in range(1, order + 1) for i in range(len(t) - k + 1))
    of = Counter(counts.values())
    unseen = max(1, of[1] ** 2 / (2 * of[2]))

    def p(word, context):
        if not context:
            return (counts[word] - 0.75) / n if counts[word] else 0.75 * v / n / unseen
        prior = {1: 1000, 2: 4}[len(context)]
        return (grams[*context, word] + prior * p(word, context[1:])) / (grams[context] + prior)

    def score(text):
        words = ["\t", *(text or "").lower().split(), "\n"]
        return sum(log10(p(w, tuple(words[max(0, i - order + 1) : i]))) for i, w in enumerate(words) if i)

    return counts, n, v, score


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_BYTES": 30, "PART_TOKENS": 500}, {"BLOCK_ROWS": 1, "PART_TOKENS": 40, "PARTS_A_TASK": 1}, {"PART_TOKENS": 100, "DIRECT_PARTS": 1}])
def test_scores_equal_a_plain_model(docs, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(backoff_lm, name, value)
    counts, n, v, score = plain_model()
    got = backoff_lm.score_texts(docs(ROWS), F.col("doc_id").isin(*HELD)).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        words = [*(texts[r["doc_id"]] or "").lower().split(), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]))
        assert r["held_out"] == (r["doc_id"] in HELD)


def test_probabilities_of_a_state_sum_to_one():
    model = backoff_lm.Automaton([backoff_lm.words_of(t.encode())[:-1] if t else [] for _, t in ROWS])
    words, unseen = list(model.arcs[0]), model.vocabulary.unseen
    for s in range(len(model.arcs)):
        assert sum(10 ** model.step(s, w) for w in words) + unseen * 10 ** model.step(s, b"?") == pytest.approx(1, abs=1e-9)


def test_two_steps_of_dealing_give_the_counts_of_one(docs, monkeypatch):
    """Blocks of single texts, 30 parts in 5 groups, bundles of several blocks: all counts come back to their blocks."""
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 500)) for k in range(60)] + [(90, None), (91, "")]
    frame = docs(rows).repartition(12).select("doc_id", F.lit(False).alias("held_out"), "text", F.spark_partition_id().cast("long").alias("task"))
    blocks = backoff_lm.stage_table(frame.mapInArrow(backoff_lm._pack, backoff_lm.PACKED), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0]
    assert blocks.count() == 12
    monkeypatch.setattr(backoff_lm, "PART_TOKENS", -(-tokens // 30))
    expected = {(r["doc_id"], round(r["score"], 9)) for r in backoff_lm.score_texts(docs(rows).repartition(12), F.lit(False)).collect()}
    monkeypatch.setattr(backoff_lm, "DIRECT_PARTS", 4)
    assert {(r["doc_id"], round(r["score"], 9)) for r in backoff_lm.score_texts(docs(rows).repartition(12), F.lit(False)).collect()} == expected
    # A bundle's rows are one for each of its group's parts and kinds, whatever the number of its blocks.
    dealt = blocks.select("block", "blob").mapInArrow(backoff_lm._deal(30, 6), backoff_lm.DEALT).withColumn("unit", F.col("part").cast("long"))
    bundled = dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(backoff_lm._bundle(30, 6), backoff_lm.DEALT)
    assert dealt.count() <= 12 * 5 * 2 and bundled.count() == 30 * 2


def test_the_traversal_gives_the_scores_of_a_larger_corpus(docs, monkeypatch):
    monkeypatch.setattr(backoff_lm, "PART_TOKENS", 20_000)
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 100_000)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 800))) for k in range(320)] + [(500, "rare pair here"), (501, "rare pair here"), (502, "a rare pair here")]
    model = backoff_lm.Automaton([backoff_lm.words_of(t.encode())[:-1] for _, t in rows[:-1]])
    got = {r["doc_id"]: r["score"] for r in backoff_lm.score_texts(docs(rows), F.col("doc_id") == 502).collect()}
    assert model.vocabulary.tokens > 250_000 and (b"rare", b"pair") in model.state
    for i, text in rows:
        assert got[i] == pytest.approx(model.score(backoff_lm.words_of(text.encode())[:-1]), rel=1e-9)


def test_walks_take_failure_arcs_and_split_texts_score_alike(docs, monkeypatch):
    """The query's arcs on one block: failure arcs are counted, and walks of a few words give what whole ones give."""
    shared = backoff_lm.Vocabulary(9, 2, 4, 2, 1)
    names, ids, starts = backoff_lm._numbered([b"a b c", b"a b d b c", b"x b c"])
    counts = np.array([2 if n == b"\t" else {b"\n": 2, b"a": 2, b"b": 3, b"c": 2, b"d": 1}.get(n, 0) for n in names])
    known = Counter(g for t in (b"\ta b c\n", b"\ta b d b c\n") for w in [[b"\t", *t.strip().split(), b"\n"]] for k in (2, 3) for g in (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    number, two, three = {}, np.full(len(ids), -1), np.full(len(ids), -1)
    for i in range(len(ids)):
        if ids[i]:
            two[i] = number.setdefault((names[ids[i - 1]], names[ids[i]]), len(number))
            if ids[i - 1]:
                three[i] = number.setdefault(tuple(names[k] for k in ids[i - 2 : i + 1]), len(number))
    arcs, reached = backoff_lm.block_arcs(shared, ids, counts, (two, three), np.array([known[g] for g in number]))
    begin, end = starts + 1, np.array([*starts[1:], len(ids)])
    whole = arcs.walk(ids, begin, end, reached[starts])
    # START x: failure arcs from START, then state 0; b, c and the end in states of one and two words: (x, b) is unknown.
    assert arcs.failures == 1
    pieces = [(k, i) for k, (a, b) in enumerate(zip(begin, end, strict=True)) for i in range(a, b)]
    at = np.array([i for _, i in pieces])
    parts = np.bincount([k for k, _ in pieces], arcs.walk(ids, at, at + 1, reached[at - 1]))
    assert parts == pytest.approx(whole) and arcs.failures == 2


@pytest.mark.parametrize("walk", [1, 3, 1000])
def test_scores_do_not_depend_on_the_length_of_walks(docs, monkeypatch, walk):
    expected = {(r["doc_id"], round(r["score"], 9)) for r in backoff_lm.score_texts(docs(ROWS), F.col("doc_id").isin(*HELD)).collect()}
    monkeypatch.setattr(backoff_lm, "WALK", walk)
    assert {(r["doc_id"], round(r["score"], 9)) for r in backoff_lm.score_texts(docs(ROWS), F.col("doc_id").isin(*HELD)).collect()} == expected


def test_a_text_longer_than_a_block(docs, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 1000)
    rows = [(1, "a b c"), (2, " ".join(f"w{k}" for k in range(50_000))), (3, None), (4, "w1 w2 w3")]
    got = {r["doc_id"]: r for r in backoff_lm.score_texts(docs(rows), F.col("doc_id") == 4).collect()}
    assert got[2]["n_tokens"] == 50_001 and got[4]["n_known"] == 4 and got[3]["n_tokens"] == 1


def test_without_training_rows_or_any_rows(docs):
    got = backoff_lm.score_texts(docs([(1, "a b")]), F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)]
    assert backoff_lm.score_texts(docs([]), F.lit(False)).count() == 0


def test_bundles_are_sums_of_bound_letters():
    vectors, sizes = langid.bundle(["ab", None, "", "12", "Ab"], 64)
    rolled = lambda c, k: np.roll(langid._letter_vector(ord(c), 64), k).astype(int)
    expected = rolled(" ", 2) * rolled("a", 1) * rolled("b", 0) + rolled("a", 2) * rolled("b", 1) * rolled(" ", 0)
    assert vectors[0].tolist() == expected.tolist() == vectors[4].tolist()
    assert sizes.tolist() == [2, 0, 0, 0, 2] and not vectors[1:4].any()


def test_many_letters_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(0x4E00 + k) for k in rng.integers(0, 8000, 300)) for _ in range(6)] + ["plain letters"]
    whole, _ = langid.bundle(texts, 128)
    monkeypatch.setattr(langid, "CODES", 100)
    parts, sizes = langid.bundle(texts, 128)
    assert np.array_equal(whole, parts) and sizes[0] == 300

    def peak(n):
        import tracemalloc

        tracemalloc.start()
        langid.bundle(["".join(chr(0x4E00 + k) for k in rng.integers(0, 20000, 2000)) for _ in range(n)])
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found / 1e6

    monkeypatch.setattr(langid, "CODES", 4096)
    assert peak(40) < 120


def test_prototypes_equal_plain_sums(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "CODES", 7)
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "a dog", "en"), (4, None, "de"), (5, "x", None)]
    langs, prototypes = langid.learn_prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en"]
    vectors, _ = langid.bundle([t for _, t, _ in rows])
    for lang, found in zip(langs, prototypes, strict=True):
        total = sum(vectors[k] for k, (_, t, x) in enumerate(rows) if x == lang and t)
        assert found == pytest.approx(total / np.linalg.norm(total), abs=1e-6)


def test_filter_rejects_other_languages_and_random_letters(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 400").select("doc_id", "text", "lang")
    langs, prototypes = langid.learn_prototypes(table)
    rng = np.random.default_rng(2)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan oikeuksiltaan heille on annettu järki omatunto heidän toimittava toisiaan kohtaan".split()
    word = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(3, 10)))
    bad = [(10_000 + k, " ".join(rng.choice(finnish, 80)) if k % 2 else " ".join(word() for _ in range(80)), "en") for k in range(40)]
    both = table.unionByName(spark.createDataFrame(bad, table.schema))
    kept = {r["doc_id"] for r in langid.keep_known_languages(both, langs, prototypes).collect()}
    assert kept == {r["doc_id"] for r in table.collect()}


def test_languages_of_held_out_documents(spark, duck, sf_dir):
    from vociflow.llm.queries import op9_language_id

    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in op9_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_rows(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "123 !"), (4, "the " * 20_000), (4, "the")])
    langs, prototypes = langid.learn_prototypes(docs([(0, "the cat and the dog"), (1, None)]))
    assert langs == ["en"]
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(rows, langs, prototypes).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert langid.keep_known_languages(rows, langs, prototypes).columns == rows.columns
    none = langid.learn_prototypes(docs([]))
    assert {r["lang_pred"] for r in langid.predict_languages(rows, *none).collect()} == {"und"}
