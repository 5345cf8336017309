"""N-grams by their rarest words against the loop over all n-grams."""

import numpy as np
from pyspark.sql import functions as F

from vociflow.functions import text
from vociflow.operators import ngram_index

POSTS, GRAMS = "id long, lemmas array<string>, kind string", "kind string, words array<string>"


def loop(rows, grams):
    out = {}
    for i, lemmas, _ in rows:
        have = set(lemmas or [])
        hits = {k: sum(bool(w) and None not in w and have.issuperset(w) for kind, w in grams if kind == k) for k in ngram_index.KINDS}
        out[i] = (0, 0, True) if hits["excluded"] else (hits["primary"], hits["secondary"], False)
    return out


def found(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (r["primary"], r["secondary"], r["excluded"]) for r in rows}


def test_ten_thousand_ngrams_equal_the_loop(spark, monkeypatch):
    """Frequent words go to blocks; one word is in every post."""
    monkeypatch.setattr(ngram_index, "BLOCK", 20)
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 3000]
    rows = [(i, ["all", *draw(40)], "x") for i in range(300)]
    grams = [(str(rng.choice(["primary", "secondary"])), draw(int(rng.integers(1, 4)))) for _ in range(10_000)] + [("primary", ["all"]), ("excluded", ["w2999", "all"]), ("excluded", ["w17", "w3"])]
    expected = loop(rows, grams)
    assert found(ngram_index.match_many(spark.createDataFrame(rows, POSTS), spark.createDataFrame(grams, GRAMS))) == expected
    assert any(x for _, _, x in expected.values()) and max(p for p, _, _ in expected.values()) > 100


def test_edges_and_the_column_function_agree(spark):
    """Nulls, no words, repeated n-grams and words, and a column with a clashing name."""
    rows = [(1, None, "a"), (2, [], "b"), (3, ["a", "b", "a", None], "c"), (4, ["b"], None), (5, ["c", "b"], "primary")]
    grams = [("primary", ["a", "b"]), ("primary", ["b", "a"]), ("primary", ["b", "b"]), ("primary", []), ("secondary", ["b", None]), ("secondary", ["nowhere", "b"]), ("excluded", ["c"])]
    posts = spark.createDataFrame(rows, POSTS)
    got = found(ngram_index.match_many(posts, spark.createDataFrame(grams, GRAMS)))
    assert got == loop(rows, grams) == {1: (0, 0, False), 2: (0, 0, False), 3: (3, 0, False), 4: (1, 0, False), 5: (0, 0, True)}
    spec = lambda k: F.array(*[F.array(*map(F.lit, w)) for kind, w in grams if kind == k and w and None not in w])
    m = posts.where("lemmas is not null").select("id", text.match(F.col("lemmas"), spec("primary"), spec("secondary"), spec("excluded")).alias("m")).select("id", "m.*")
    assert found(m) == {k: v for k, v in got.items() if k != 1}


def test_no_posts_or_no_ngrams(spark):
    posts, none = spark.createDataFrame([(1, ["a"], "x")], POSTS), spark.createDataFrame([], GRAMS)
    assert found(ngram_index.match_many(posts, none)) == {1: (0, 0, False)}
    assert ngram_index.match_many(posts.where("id > 1"), spark.createDataFrame([("primary", ["a"])], GRAMS)).count() == 0


def test_candidates_are_not_shuffled_and_parts_are_added(spark, monkeypatch):
    """A frequent word is the rarest of very many n-grams: posts and n-grams are dealt, never joined by words."""
    rows = [(i, ["x", *[f"w{k}" for k in range(i % 40)]], "k") for i in range(200)]
    grams = [(k, ["x", f"w{j}", *rest]) for j in range(40) for k, rest in (("primary", []), ("primary", ["w0"]), ("secondary", ["w39"]))] + [("excluded", ["w38", "w1"])]
    posts, listed = spark.createDataFrame(rows, POSTS), spark.createDataFrame(grams, GRAMS)
    got = ngram_index.match_many(posts, listed)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert found(got) == loop(rows, grams)
    monkeypatch.setattr(ngram_index, "PART_GRAMS", 7)
    assert found(ngram_index.match_many(posts, listed)) == loop(rows, grams)
