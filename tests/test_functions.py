"""Kernels with known results."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vociflow.functions import scalars, text
from vociflow.functions.stem import stem_word
from vociflow.operators import bootstrap, dedup, quality, robust, scores, sentiment, topic
from vociflow.params import RUSSIAN, Params


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clean_text(spark):
    raw = "<b>Hi</b>  @me see https://a.b/c [id12|Ann] \U0001f600 end"
    assert value(spark, text.clean(F.lit(raw))) == "Hi [USER] see [URL] [USER] end"


def test_long_text_is_cut_with_a_reason(spark):
    row = value(spark, text.cleaned(F.lit("x" * 15_001)))
    assert len(row["clean_text"]) == 15_000 and row["truncation_reason"] == "TEXT_EXCEEDS_15000_CHARS"


def test_tokens_and_placeholders(spark):
    assert value(spark, text.tokenize(F.lit("Да, [URL] ok!"))) == ["Да", ",", "ok", "!"]


def test_ngrams_are_bags_of_words(spark):
    spec = text.parse_ngrams(F.lit("clean air\nriver, "))
    lemmas = F.array(F.lit("air"), F.lit("very"), F.lit("clean"))
    assert value(spark, text.ngram_hits(lemmas, spec)) == 1


@pytest.mark.parametrize(("primary", "secondary", "excluded", "level"), [(5, 0, False, 1.0), (2, 0, False, 2 / 3), (1, 0, False, 1 / 3), (9, 9, True, 0.0)])
def test_keyword_level(spark, primary, secondary, excluded, level):
    got = value(spark, scalars.keyword_level(F.lit(primary), F.lit(secondary), F.lit(excluded)))
    assert got == pytest.approx(level, abs=1e-6)


def test_topic_decision_without_a_model_disputes_one_hit(spark):
    level = scalars.keyword_level(F.lit(1), F.lit(0), F.lit(False))
    row = value(spark, scalars.topic_decision(level, F.lit(False), F.lit(None).cast("double"), full=False))
    assert (row["stratum"], row["relevant"]) == ("DISPUTED", False)


def test_duplicate_key_ignores_placeholders(spark):
    a, b = (value(spark, text.dedup_key(F.lit(x))) for x in ("Same [URL] text [USER] #tag", "same text"))
    assert a == b


def test_token_similarity(spark):
    words = [F.lit(f"w{k}") for k in range(11)]
    changed = [*words[:5], F.lit("other"), *words[6:]]
    assert value(spark, text.token_similarity(F.array(*words), F.array(*changed))) == pytest.approx(1 - 1 / 11)
    assert value(spark, text.token_similarity(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1


def test_salted_hash(spark):
    assert value(spark, text.salted_hash(F.lit(7), b"s")) == hashlib.sha256(b"s7").hexdigest()


def test_indicator_round_trip(spark):
    made = text.format_indicator(F.lit("a b"), F.lit("PASSED"), F.lit(0.1234))
    assert value(spark, made) == "a b: PASSED (0.123)"
    assert value(spark, text.parse_indicator(F.lit("a b: PASSED (0,123)"))).asDict() == {"name": "a b", "status": "PASSED", "value": 0.123}
    assert value(spark, text.parse_indicator(F.lit("nothing")))["value"] is None


def test_stems():
    assert [stem_word(w) for w in ("книгами", "радость", "хороший", "прекрасный", "читал")] == ["книг", "радост", "хорош", "прекрасн", "чита"]


def test_median_iqr_mad(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 7.0)], "k string, v double")
    got = {r["k"]: r for r in rows.groupBy("k").agg(robust.median(F.col("v")).alias("m"), robust.iqr(F.col("v")).alias("q")).collect()}
    assert got["a"]["m"] == 2.5 and got["b"]["m"] == 7 and got["b"]["q"] == 0
    assert {r["k"]: r["mad"] for r in robust.mad(rows, "k", "v").collect()} == {"a": pytest.approx(1.4826), "b": 0}


def test_huber_downweights_an_outlier(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0]
    got = value(spark, robust.huber(F.array(*map(F.lit, xs))))
    mu, s = float(np.median(xs)), 1.4826 * float(np.median(np.abs(np.array(xs) - np.median(xs))))
    for _ in range(100):
        w = np.minimum(1, 1.345 * s / np.maximum(np.abs(np.array(xs) - mu), 1e-300))
        mu = float((w * xs).sum() / w.sum())
    assert got == pytest.approx(mu, abs=1e-4) and value(spark, robust.huber(F.array(F.lit(5.0), F.lit(5.0), F.lit(5.0)))) == 5


def test_huber_of_keys_with_many_values_equals_that_of_arrays(spark, monkeypatch):
    """Rounds over all values against arrays: ties, outliers, an even and an odd number, two values, NaN, huge ranges, a null key."""
    rng = np.random.default_rng(5)
    rows = [("even", float(x)) for x in rng.standard_t(1.5, 600)] + [("odd", float(x)) for x in rng.normal(3, 1e-6, 301)] + [("ties", float(x)) for x in rng.integers(0, 9, 400)]
    rows += [("two", 1.0), ("two", 4.0), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), ("wide", 0.0), ("wide", 1e-300), ("wide", 5e-324), ("wide", 1e300), ("one", 7.0), ("none", None)]
    rows += [(None, float(x)) for x in rng.exponential(2, 200)]
    df = spark.createDataFrame(rows, "key string, v double")
    found = lambda: {r["key"]: r["mu"] for r in robust.huber_by(df, "key", "v").collect()}
    arrays = found()
    monkeypatch.setattr(robust, "ARRAY_VALUES", 1)
    rounds = found()
    assert set(arrays) == set(rounds) == {"even", "odd", "ties", "two", "nan", "wide", "one", None}
    assert rounds.pop("nan") is arrays.pop("nan") is None and rounds["two"] == arrays["two"] == 2.5
    for k in arrays:
        assert rounds[k] == pytest.approx(arrays[k], rel=1e-11, abs=1e-15), k


def test_robust_z_of_nulls(spark):
    rows = spark.createDataFrame([(float(x) if x else None,) for x in (1, None, 3, None, 5)], "v double")
    got = robust.robust_z(rows, ["v"]).orderBy("v").collect()
    assert [r["z_v"] for r in got] == [0, 0, -1, 0, 1] and sum(r["null_imputed"] for r in got) == 2


def test_audience_and_rates(spark):
    assert value(spark, scores.audience(F.lit(1000))) == pytest.approx(math.log(1001))
    assert value(spark, scores.engagement(F.lit(10), F.lit(0), F.lit(5))) == 0
    assert value(spark, scores.focus(F.lit(10), F.lit(0))) == 1 and value(spark, scores.focus(F.lit(0), F.lit(0))) == 0


@pytest.mark.parametrize(("args", "kind"), [((True, True, True, 50), "DETECTED_COPY"), ((False, True, False, 30), "REPOST_WITH_COMMENT"), ((False, True, False, 29), "PURE_REPOST"), ((False, False, True, 20), "ORIGINAL"), ((False, False, True, 19), "MEDIA_ONLY")])
def test_originality(spark, args, kind):
    assert value(spark, dedup.originality(*map(F.lit, args))) == kind


@pytest.mark.parametrize("least", [0.8, 0.9, 0.95])
def test_near_pairs_equal_all_pairs(spark, least):
    rng = np.random.default_rng(3)
    base = [[f"w{rng.integers(40)}" for _ in range(n)] for n in (3, 8, 11, 20, 25, 60)]
    rows = []
    for k in range(90):
        tokens = list(base[k % 6])
        for _ in range(int(rng.integers(0, 2 + len(tokens) // 5))):
            at = int(rng.integers(len(tokens)))
            tokens[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(99)}"] * int(rng.integers(0, 2))
        rows.append((k, int(rng.integers(0, 12)) * 86400, tokens))
    twenty = [f"t{k}" for k in range(20)]
    rows += [(500, 0, twenty), (501, 0, [f"u{k}" if k % 5 == 2 else f"t{k}" for k in range(20)])]
    df = spark.createDataFrame(rows, "id long, at long, tokens array<string>").withColumn("published_at", F.timestamp_seconds("at"))
    x, y = df.alias("x"), df.alias("y")
    order = F.struct("x.published_at", "x.id") < F.struct("y.published_at", "y.id")
    pairs = x.join(y, order & (F.abs(F.col("x.at") - F.col("y.at")) <= 72 * 3600) & (F.size("x.tokens") > 0) & (F.size("y.tokens") > 0))
    similarity = text.token_similarity(F.col("x.tokens"), F.col("y.tokens"))
    expected = {(r[0], r[1]) for r in pairs.where(similarity >= least - 1e-12).select("x.id", "y.id").collect()}
    found = dedup.near_pairs(df, Params(near_similarity=least))
    assert {(r["a"], r["b"]) for r in found.collect()} == expected and expected
    assert ((500, 501) in expected) == (least == 0.8)


def test_near_pairs_write_no_row_for_each_token(spark, monkeypatch):
    """Tokens common over all time and rare in each window are not dealt to blocks, and exact copies leave without their tokens."""
    monkeypatch.setattr(dedup, "BLOCK", 10)
    written = {}

    def stage(df, tag):
        written[tag] = df.count()
        return df.localCheckpoint()

    monkeypatch.setattr(dedup, "stage_table", stage)
    rows = [(k, k * 40 * 3600, [f"common{j}" for j in range(20)] + [f"own{k // 2}x{j}" for j in range(60)] + ["end"] * (k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, at long, tokens array<string>").withColumn("published_at", F.timestamp_seconds("at"))
    pairs = lambda *a: {(r["a"], r["b"]) for r in dedup.near_pairs(df, Params(near_similarity=0.85), *a).collect()}
    assert pairs() == {(k, k + 1) for k in range(0, 60, 2)}
    assert written["met"] == 30 and max(written.values()) == 60
    assert pairs(df.where("id < 10 or id = 13").select("id")) == {(k, k + 1) for k in range(10, 60, 2) if k != 12}
    marked = df.select("id", "published_at", F.lit(100).alias("own_text_length"), (F.col("id") % 7).alias("hash"))
    assert dedup.exact_edges(marked).count() == 53


def test_near_pairs_of_boilerplate(spark, monkeypatch):
    """Every text holds the same passage, and many look for the same elements, which are dealt out in blocks."""
    monkeypatch.setattr(dedup, "BLOCK", 3)
    monkeypatch.setattr(dedup, "FREQUENT", 40)
    rng = np.random.default_rng(8)
    passage, rows = [f"p{k}" for k in range(30)], []
    for k in range(120):
        own = [f"v{rng.integers(6)}" for _ in range(12)] if k % 3 else [f"only{k}x{j}" for j in range(8)]
        rows.append((k, int(rng.integers(0, 200)) * 3600, own + passage if k % 2 else passage + own))
    df = spark.createDataFrame(rows, "id long, at long, tokens array<string>").withColumn("published_at", F.timestamp_seconds("at"))
    found = {(r["a"], r["b"]): r["similarity"] for r in dedup.near_pairs(df, Params(near_similarity=0.85)).collect()}
    expected = {}
    for i, at, x in rows:
        for j, when, y in rows:
            if (at, i) < (when, j) and when - at <= 72 * 3600:
                before = list(range(len(y) + 1))
                for n, a in enumerate(x, 1):
                    now = [n]
                    for m, b in enumerate(y, 1):
                        now.append(min(before[m] + 1, now[-1] + 1, before[m - 1] + (a != b)))
                    before = now
                if 1 - before[-1] / max(len(x), len(y)) >= 0.85 - 1e-12:
                    expected[i, j] = 1 - before[-1] / max(len(x), len(y))
    assert found == pytest.approx(expected) and len(expected) > 10


def test_patterns_fit_the_same_characters_as_plain_ones(spark):
    """Every code point against the plain lists of emoji and word characters; a very long word of changing case is one token."""
    plain = (
        r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}"
        r"\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{200D}\x{20E3}]+"
    )
    points = spark.range(0x110000).where("id not between 55296 and 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    texts = points.select(c.alias("c"), F.concat(F.lit("aZ"), c, F.lit("9я"), c).alias("t"))
    tokens = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
    emoji = (F.regexp_replace("t", text.EMOJI, " ") != F.regexp_replace("t", plain, " ")) | (F.col("c").rlike(text.EMOJI) != F.col("c").rlike(plain))
    assert texts.where(emoji | (tokens(text.TOKEN) != tokens(r"(\[URL]|\[USER]|[а-яёА-ЯЁa-zA-Z0-9]+|[^\s])"))).count() == 0
    assert texts.where(F.col("c").rlike(text.EMOJI)).count() > 1000
    assert value(spark, F.size(text.tokenize(F.repeat(F.lit("aZ9я"), 200_000)))) == 1


def test_elements_are_ordered_where_they_are(spark):
    """Each list's rarest elements are found without a shuffle of elements, and repeated tokens are told apart."""
    rows = [(k, ["all"] * 3 + [f"w{k // 2}", "some" if k % 2 else "other", *[f"t{j}" for j in range(15)]]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").withColumns({"n": F.size("tokens"), "at": F.lit(0).cast("long"), "bucket": F.lit(0).cast("long")})
    found = dedup._prefixes(df, 0.9)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    postings = found.collect()
    shared = [{r["e"] for r in postings if r["id"] == k} for k in range(40)]
    assert all(shared[k] & shared[k + 1] for k in range(0, 40, 2)) and all(r["place"] <= 2 for r in postings)


def test_similarity_with_a_limit(spark):
    a, b = F.array(*[F.lit(f"t{k}") for k in range(20)]), F.array(*[F.lit(f"t{k if k % 7 else k + 50}") for k in range(20)])
    assert value(spark, text.token_similarity(a, b)) == pytest.approx(0.85)
    assert value(spark, text.token_similarity(a, b, 0.85)) == pytest.approx(0.85) and value(spark, text.token_similarity(a, b, 0.9)) == 0
    assert value(spark, text.token_similarity(F.array().cast("array<string>"), F.array().cast("array<string>"), 0.9)) == 1


def test_similarity_of_very_many_tokens(spark):
    one, other = F.transform(F.sequence(F.lit(1), F.lit(43_000)), lambda k: k.cast("string")), F.lit("x")
    assert value(spark, text.token_similarity(F.slice(one, 42_900, 100), F.concat(F.slice(one, 42_900, 99), F.array(other)))) == pytest.approx(0.99)


def test_negation_window(spark):
    tokens = F.array(*map(F.lit, ["не", "день", "хороший"]))
    lexicon = type(RUSSIAN)(positive=("хороший",), negators=RUSSIAN.negators)
    assert value(spark, sentiment.polarity_counts(tokens, lexicon, 1))["positive"] == 1
    assert value(spark, sentiment.polarity_counts(tokens, lexicon, 3))["negative"] == 1


def test_signals(spark):
    row = value(spark, sentiment.by_dictionary(F.array(F.lit("против"), F.lit("!")), RUSSIAN))
    assert (row["label"], row["method"]) == ("NEGATIVE", "SIGNAL") and row["score"] == pytest.approx(-0.25)


def test_bootstrap_needs_two_values_and_clusters():
    rng, one = np.random.default_rng(1), np.array([1])
    assert bootstrap.one_level(np.array([1.0]), one, rng, 100) is None
    assert bootstrap.two_level(np.array([[1, 0, 0]]), one, rng, 10, 10) is None
    assert bootstrap.two_level(np.array([[0, 0, 0], [1, 0, 0]]), np.array([9, 1]), rng, 10, 10) is None
    low, high = bootstrap.one_level(np.arange(50.0), np.ones(50, int), rng, 1000)
    assert low < 24.5 < high
    (pl, ph), _ = bootstrap.two_level(np.array([[3, 1, 1], [1, 3, 1], [2, 2, 1]]), np.ones(3, int), rng, 30, 30)
    assert 0 <= pl <= ph <= 1


def test_bootstrap_of_counts_equals_that_of_rows():
    """Distributions over many draws: counts of distinct values and kinds of clusters against rows drawn one by one."""
    rng = np.random.default_rng(2)
    values, times = np.array([1.0, 2.0, 5.0, 9.0]), np.array([4, 1, 3, 2])
    rows = np.repeat(values, times)
    plain = np.quantile(rows[rng.integers(0, 10, (100_000, 10))].mean(1), bootstrap.TAILS)
    assert bootstrap.one_level(values, times, rng, 100_000) == pytest.approx(plain, abs=0.15)
    many, plain_many = 20 * times, np.quantile(np.repeat(values, 20 * times)[rng.integers(0, 200, (20_000, 200))].mean(1), bootstrap.TAILS)
    assert bootstrap.one_level(values, many, rng, 20_000) == pytest.approx(plain_many, abs=0.05)
    assert bootstrap.one_level(values, times, rng, 100_000, "sum") == pytest.approx(10 * plain, abs=1.5)
    counts, times = np.array([[2, 0, 0], [1, 1, 0], [2, 2, 0], [0, 1, 3], [0, 0, 1]]), np.array([2, 3, 1, 2, 1])
    clusters = [np.repeat([0, 1, 2], c) for c, n in zip(counts, times, strict=True) for _ in range(n)]
    found = []
    for _ in range(4000):
        chosen = rng.integers(0, len(clusters), len(clusters))
        for _ in range(5):
            drawn = np.concatenate([rng.choice(clusters[k], len(clusters[k])) for k in chosen])
            found.append(((drawn == 0).mean(), (drawn == 2).mean()))
    plain = np.quantile(np.array(found), bootstrap.TAILS, axis=0)
    (pl, ph), (nl, nh) = bootstrap.two_level(counts, times, rng, 20_000, 5)
    assert (pl, ph) == pytest.approx(plain[:, 0], abs=0.06) and (nl, nh) == pytest.approx(plain[:, 1], abs=0.06)


def test_hashed_intervals_by_join_and_by_array_are_equal(spark):
    rows = spark.createDataFrame([(k, k % 7 if k < 60 else 9, float(k * k % 31)) for k in range(61)], "id long, key long, x double")
    wanted = {"mean": F.avg("x"), "total": F.sum("x")}
    found = [sorted(tuple(round(x, 9) for x in r) for r in bootstrap.hashed_intervals(rows, "key", "id", wanted, 200, array_rows=n).collect()) for n in (0, 8, 10_000)]
    assert len(found[0]) == 7 and found[0] == found[1] == found[2]
    mean = {r["key"]: r["m"] for r in rows.groupBy("key").agg(F.avg("x").alias("m")).collect()}
    assert all(low < mean[k] < high for k, low, high, *_ in found[0])
    leaves = [sorted(tuple(round(x, 9) for x in r) for r in bootstrap.hashed_intervals(rows, "key", "id", wanted, 200, array_rows=n, leaf_rows=3).collect()) for n in (0, 8, 10_000)]
    assert len(leaves[0]) == 7 and leaves[0] == leaves[1] == leaves[2] != found[0]


def test_draws_between_chunks_add_up_and_spread_as_binomial_ones(spark):
    n, rows = 27_000, 4_000
    df = spark.range(400).select(F.xxhash64("id").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("c"))
    drawn = df.select("h", "c", bootstrap._in_chunk(F.col("h"), F.lit(n).cast("long"), F.col("c"), rows).alias("m")).toPandas()
    assert set(drawn.groupby("h")["m"].sum()) == {n}
    for c, own in drawn.groupby("c"):
        share = min(rows, n - c * rows) / n
        assert own["m"].mean() == pytest.approx(n * share, rel=0.01) and own["m"].std() == pytest.approx((n * share * (1 - share)) ** 0.5, rel=0.15)


def test_intervals_of_a_large_key_are_those_of_plain_draws(spark):
    rng = np.random.default_rng(4)
    values = rng.exponential(3, 20_000)
    df = spark.createDataFrame([(k, 1, float(v)) for k, v in enumerate(values)], "id long, key long, x double")
    row = bootstrap.hashed_intervals(df, "key", "id", {"mean": F.avg("x")}, 400, array_rows=1_000, leaf_rows=3_000).first()
    half = 1.96 * values.std() / len(values) ** 0.5
    assert row["mean_low"] == pytest.approx(values.mean() - half, abs=half / 4) and row["mean_high"] == pytest.approx(values.mean() + half, abs=half / 4)


def test_two_level_intervals_of_an_author_are_those_of_a_plain_double_loop(spark):
    rng = np.random.default_rng(6)
    names = ["POSITIVE", "NEUTRAL", "NEGATIVE"]
    clusters = [rng.choice(3, int(rng.integers(1, 7)), p=[0.5, 0.3, 0.2]) for _ in range(25)]
    rows = [(7, "resp", "cluster", None, k, names[x]) for k, c in enumerate(clusters) for x in c] + [(8, "resp", "cluster", None, 1, "NEUTRAL")]
    samples = spark.createDataFrame(rows, "author_id long, score string, kind string, value double, cluster long, label string")
    got = {(r["author_id"], r["score"]): (r["low"], r["high"]) for r in bootstrap.intervals(samples, 1000, 300, 100).collect()}
    drawn = []
    for _ in range(1500):
        chosen = rng.integers(0, 25, 25)
        for _ in range(4):
            own = np.concatenate([rng.choice(clusters[k], len(clusters[k])) for k in chosen])
            drawn.append([(own == x).mean() for x in (0, 2)])
    plain = np.quantile(np.array(drawn), bootstrap.TAILS, axis=0).T
    assert set(got) == {(7, "resp_positive"), (7, "resp_negative")}
    assert got[7, "resp_positive"] == pytest.approx(plain[0], abs=0.03) and got[7, "resp_negative"] == pytest.approx(plain[1], abs=0.03)
    widths = bootstrap.mean_width(bootstrap.intervals(samples, 1000, 300, 100)).collect()
    assert [(r["author_id"], r["ci_width"]) for r in widths] == [(7, pytest.approx(np.mean([h - l for l, h in got.values()]), abs=1e-6))]


def test_beta_posterior_without_votes(spark):
    assert value(spark, topic.beta_posterior(F.lit(1), F.lit(1)))["mean"] == 0.5


def test_sufficiency(spark):
    p = Params()
    cases = {(2, 99, None): "UNRELIABLE", (10, 50, None): "RELIABLE", (10, 50, 0.3): "PRELIMINARY", (10, 50, 0.6): "UNRELIABLE"}
    for (posts, comments, width), expected in cases.items():
        assert value(spark, quality.sufficiency(F.lit(posts), F.lit(comments), F.lit(width).cast("double"), p)) == expected


def test_kappa_of_equal_ratings_is_one(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (1, 1)], "a int, b int")
    assert quality.cohen_kappa(rows, "a", "b").first()["kappa"] == pytest.approx(1.0)
    assert quality.cohen_kappa(rows.limit(0), "a", "b").first()["kappa"] == 0


def test_chi_square_of_equal_distributions_is_zero(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 5)], "k string, n long")
    assert quality.chi_square(rows.withColumnRenamed("n", "o"), rows.withColumnRenamed("n", "e"), "k").first()["chi2"] == pytest.approx(0)


def test_pearson_without_variance_is_zero(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert quality.pearson(rows, "x", "y").first()["r"] == 0


def test_disputed_posts_are_filtered_after_their_strata_are_written(spark):
    """The filter holds no expression of the match, and the rows are the first of the stratum in time order."""
    rows = spark.range(50).select("id", F.timestamp_seconds(100 - F.col("id")).alias("published_at"), F.split(F.when(F.col("id") % 3 == 0, "a b").otherwise("c d"), " ").alias("lemmas"))
    scored = topic.score_posts(rows, [["a", "b"]], [["b"]], [["x"]], F.lit(0.2)).select("id", "published_at", "stratum")
    found = topic.disputed(scored, 5)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in found.collect()] == [r["id"] for r in scored.orderBy("published_at", "id").collect() if r["stratum"] == "DISPUTED"][:5]


@pytest.mark.parametrize("array_rows, leaf_rows", [(10_000, 4_000), (8, 4_000), (10_000, 7), (0, 7)])
def test_intervals_in_numpy_are_those_of_aggregates(spark, array_rows, leaf_rows):
    """Keys with one array and several, null values, a key without values, one with one row, and texts as keys."""
    rows = spark.createDataFrame([(k, f"k{k % 7 if k < 60 else 9}", None if k % 5 == 1 or k % 7 == 3 else float(k * k % 31)) for k in range(61)], "id long, key string, x double")
    run = lambda wanted: {r["key"]: r for r in bootstrap.hashed_intervals(rows, "key", "id", wanted, 200, array_rows=array_rows, leaf_rows=leaf_rows).collect()}
    plain, fast = run({"mean": F.avg("x"), "total": F.sum("x")}), run({"mean": ("mean", F.col("x")), "total": ("sum", F.col("x"))})
    assert set(plain) == set(fast) and len(fast) == 7
    for key, row in plain.items():
        assert list(fast[key]) == [v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for v in row]
    assert fast["k3"]["mean_low"] is None


def test_registered_intervals_draw_without_a_row_for_each_draw(spark, sf_dir):
    from vociflow.plans import catalog

    for name in ("boot_mean_ci", "boot_sum_ci", "boot_label_ci", "quality_score"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate explode(sequence(0, 999" not in plan and "__i" not in plan, name


@pytest.mark.parametrize("scale", [0, 1, 400])
def test_sums_of_binomial_draws_spread_as_such(scale):
    """Small rows go by their distribution, large ones by draws; a share of a half, rows without labels."""
    labels, shares, n = scale * np.array([[3, 8, 5], [0, 4, 0], [0, 0, 0]]), np.array([0.2, 0.5, 2 / 3]), 40_000 if scale < 2 else 400
    found = bootstrap.binomial_sums(labels, shares, np.random.default_rng(5), n)
    assert found.shape == (3, n) and (found >= 0).all() and (found <= labels.sum(1)[:, None]).all()
    mean, deviation = labels @ shares, (labels @ (shares * (1 - shares))) ** 0.5
    assert np.abs(found.mean(1) - mean).max() <= 5 * deviation.max() / n**0.5 and found.std(1) == pytest.approx(deviation, rel=0.15)
    if scale == 1:
        assert np.bincount(found[1], minlength=5) / n == pytest.approx([1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], abs=0.01)


def test_exact_edges_join_written_hashes(spark):
    """No text is cleaned or hashed again by the join's condition."""
    rows = spark.createDataFrame([(1, "x" * 40), (2, "y" * 40), (3, "X" * 40), (4, None)], "id long, clean_text string")
    found = dedup.exact_edges(rows.withColumns({"published_at": F.timestamp_seconds(100 - F.col("id")), "own_text_length": F.length("clean_text")}))
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["canonical_id"], r["duplicate_id"], r["copies"]) for r in found.collect()] == [(3, 1, 2)]
