"""Host-level quality rules (operator 8), with DataFrame functions alone.

Rule failures are aggregated by host. A host's failure rate is shrunk towards an empirical beta prior, fitted to all
hosts by the method of moments, so that a host with few documents is judged by the others; a host whose shrunk rate
for some rule is above MAX_RATE is rejected, and its verdict joins back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vociflow.llm.common import BROADCAST_ROWS, stage_table

#: ASCII white space, which parts words.
SPACE = " \t\n\x0b\f\r"
#: A document with fewer words, or a larger percentage of words in repeated windows, fails.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Soft rules, which count for the host alone: symbols a word, share of repeated lines, mean characters of a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_CHARS = 0.1, 0.3, (3, 10)
#: Shrunk failure rate from which a host is rejected.
MAX_RATE = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1000.0)
#: Salts of a join with hosts too many to broadcast.
SALTS = 32

RULES = ("short", "repetitive", "symbols", "dup_lines", "word_chars")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more.

    Windows are compared by 64-bit hashes; sorted with their places, equal ones lie side by side.
    """

    def windows(hashes: Column) -> Column:
        inner = F.slice(hashes, F.lit(1), F.size(hashes) - 2)
        return F.transform(inner, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda a, x: F.coalesce(a["h"] == x["h"], F.lit(False))
        twice = _let(placed, lambda s: F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x)))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(windows(h), count)))


def _words(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def measures(text: Column) -> Column:
    """A struct of a text's counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    whole, words = F.coalesce(text, F.lit("")), _words(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return _let(
        words,
        lambda w: _let(
            of_lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                x["dup"].alias("n_dup_lines"),
                _repeated_words(w).alias("n_repeat_words"),
                x["n"].alias("n_lines"),
            ),
        ),
    )


def _fails_itself(words: Column, repeated: Column) -> dict[str, Column]:
    return {"short": words < MIN_WORDS, "repetitive": 100 * repeated > MAX_REPEATED * words}


def _sound(words: Column, repeated: Column) -> Column:
    fails = _fails_itself(words, repeated)
    return ~(fails["short"] | fails["repetitive"])


def _fails(m: Column) -> dict[str, Column]:
    words = m["n_words"]
    mean = F.when(words > 0, m["word_chars"] / words)
    return {
        **_fails_itself(words, m["n_repeat_words"]),
        "symbols": m["n_symbols"] > MAX_SYMBOLS * words,
        "dup_lines": m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"],
        "word_chars": F.coalesce((mean < WORD_CHARS[0]) | (mean > WORD_CHARS[1]), F.lit(False)),
    }


def rejected_hosts(measured: DataFrame, host: str, of: str) -> DataFrame:
    """Hosts (a null one included) with a rule whose shrunk failure rate is above MAX_RATE, one row each.

    Rows are summed by host before the shuffle, so a hot host costs no more than others; the prior needs one row of
    sums over all hosts.
    """
    fails = _fails(F.col(of))
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(r) for r, c in fails.items()])
    hosts = stage_table(hosts, "hosts")
    moments = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{r}_{k}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    bad = F.lit(False)
    for r in RULES:
        mean, var = moments[f"{r}_mean"] or 0.0, moments[f"{r}_var"] or 0.0
        strength = min(STRENGTH[1], max(STRENGTH[0], mean * (1 - mean) / var - 1)) if var > 0 else STRENGTH[1]
        bad |= (F.col(r) + mean * strength) / (F.col("n") + strength) > MAX_RATE
    return hosts.where(bad).select("host")


def _without_hosts(rows: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """rows with a column host_rejected: hosts are broadcast after counting them, else the join is salted."""
    marked = hosts.withColumn("__vf_bad", F.lit(True))
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(marked), F.col(host).eqNullSafe(F.col("host")), "left")
    else:
        salted = rows.withColumn("__vf_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        spread = marked.withColumn("__vf_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, F.col(host).eqNullSafe(F.col("host")) & (F.col("__vf_salt") == F.col("__vf_salt2")), "left")
    return joined.withColumn("host_rejected", F.coalesce("__vf_bad", F.lit(False)))


def judge_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, its counts, base_failed and kept.

    Null texts have no words and fail, a null source is a host of its own, repeated rows count as often as they
    occur, hosts with equal rates get equal verdicts, and empty tables give no rows. Other columns are ignored.
    """
    rows = stage_table(docs.select("doc_id", F.col("source").alias("of_host"), measures(F.col("text")).alias("m")), "measures")
    judged = _without_hosts(rows, rejected_hosts(rows, "of_host", "m"), "of_host")
    fails = _fails(F.col("m"))
    failed = fails["short"] | fails["repetitive"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in names], failed.alias("base_failed"), (~failed & ~F.col("host_rejected")).alias("kept"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass: neither failing themselves nor on a rejected host. Their columns stay as they are.

    Texts are looked at twice: rows may be equal, so that a verdict cannot join back, and rows that are written with their
    verdicts take as much disk as the documents.
    """
    hosts = rejected_hosts(docs.select(F.col("source").alias("of_host"), measures(F.col("text")).alias("m")), "of_host", "m")
    # One expression, as a condition on a column of counts would count anew for each use.
    passes = _let(_words(F.col("text")), lambda w: _sound(F.size(w).cast("long"), _repeated_words(w)))
    passed = docs.where(passes).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("of_host"))
    return _without_hosts(passed, hosts, "of_host").where("not host_rejected").select("row.*")
