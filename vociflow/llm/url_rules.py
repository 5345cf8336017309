"""URL filters with rules indexed by their rarest literal token (operator 6), with DataFrame functions alone.

Every rule is a regular expression with literal tokens that any URL it fits must hold. The index has each rule once,
under the one of its tokens that the fewest URLs hold; a URL's tokens fetch the rules to try, and only those are run.
Rules come from tables, or from filter lists in the syntax that ad blockers share.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vociflow.llm.common import BROADCAST_ROWS, small_join

#: (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: (verdict, regular expression, its literal tokens): the method's own rules, for URLs that no host rule fits.
PATTERN_RULES = (
    ("block", r"^[^?#]*[/.](ads|adserver|banner)[/.]", ("ads", "adserver", "banner")),
    ("block", r"^[^?#]*/(login|signup|logout)([/?#.]|$)", ("login", "signup", "logout")),
    ("block", r"[?&](sessionid|sid)=", ("sessionid", "sid")),
    ("block", r"^[^?#]*/tag/[^?#]*/page/[0-9]+", ("tag", "page")),
)
#: Pattern rules whose tokens are alternatives stand in the index under each of them; others under the rarest.
ANY_TOKEN = (True, True, True, False)
#: Salts of the join with an index too large to broadcast.
SALTS = 32

#: Fetches the rules that need no token; every URL has it.
NO_TOKEN = "*"

RULE = "rule string, verdict string, pattern string, own boolean, length int, tokens array<string>"


def host_rule(verdict: str, host: str, path: str) -> tuple:
    """A host rule as a row of the index: its expression fits host and path as in url_parts(), one after the other.

    The path has to start with a slash, which no host holds.
    """
    pattern = rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return host + path, verdict, pattern, False, len(host + path), [t for t in re.split("[^0-9a-z]+", host.lower()) if t]


def rules_table(spark: SparkSession, host_rules: Sequence = HOST_RULES, pattern_rules: Sequence = PATTERN_RULES, any_token: Sequence = ANY_TOKEN) -> DataFrame:
    """All rules as rows. A rule with alternative tokens is several rows, with one token each."""
    rows = [host_rule(*r) for r in host_rules]
    for (verdict, pattern, tokens), split in zip(pattern_rules, any_token, strict=True):
        for group in [[t] for t in tokens] if split else [list(tokens)]:
            rows.append((pattern, verdict, pattern, True, len(pattern), group))
    return spark.createDataFrame(rows, RULE)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules from filter lists, a rule a line: * is any text, ^ a separator or the end, | an end of the URL, || the
    begin of a domain, /.../ a regular expression, and @@ before a rule makes it an exception. Letter case does not count.

    Comments (! or [), element rules (with ##, #@# or #?#) and rules with options ($) are left out, as a URL alone does not
    tell whether they hold. A rule's tokens are its runs of letters and digits that other literal characters bound.
    """
    line = F.trim("value")
    lines = spark.read.text(path).select(line.alias("rule")).where("rule <> ''").where(~F.col("rule").rlike(r"^[!\[]|#[@?]?#")).distinct()
    rows = lines.select("rule", F.regexp_replace("rule", "^@@", "").alias("body")).withColumn("is_regex", F.col("body").rlike("^/.+/$"))
    rows = rows.where(F.col("is_regex") | ~F.contains("body", F.lit("$")))
    text = F.regexp_replace("body", r"([\\.+?{}()\[\]])", r"\\$1")
    for what, by in (
        (r"^\|\|", r"\\A[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*[.])?"), (r"^\|", r"\\A"), (r"\|$", r"\\z"), (r"\|", r"[|]"), (r"(?<!\[)\^", r"(?:[^0-9A-Za-z_.%-]|\\z)"), (r"(?<![\])])\*", ".*"),
    ):
        text = F.regexp_replace(text, what, by)
    pattern = F.concat(F.lit("(?is)"), F.when(F.col("is_regex"), F.expr("substring(body, 2, length(body) - 2)")).otherwise(text))
    tokens = F.regexp_extract_all(F.lower("body"), F.lit("(?<=[^0-9a-z*])([0-9a-z]+)(?=[^0-9a-z*])"), F.lit(1))
    none = F.array().cast("array<string>")
    return rows.select(
        "rule", F.when(F.startswith("rule", F.lit("@@")), "allow").otherwise("block").alias("verdict"), pattern.alias("pattern"), F.lit(True).alias("own"), F.length("rule").alias("length"),
        F.when(F.col("is_regex"), none).otherwise(F.array_distinct(tokens)).alias("tokens"),
    )


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both are empty without a '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased; a URL without any has one empty token."""
    return F.array_distinct(F.split(F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^0-9a-z]+"))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule with the token, of those it needs, that the fewest of the URLs (rows with tokens) hold; NO_TOKEN if it needs none."""
    group = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(NO_TOKEN)))
    needed = rules.select("rule", "verdict", "pattern", "own", "length", F.posexplode(group).alias("place", "token"), F.col("tokens").alias("group"))
    wanted = needed.select("token").distinct()
    held = small_join(urls.select(F.explode("tokens").alias("token")), wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    counted = needed.join(held, "token", "left")
    keys = ["rule", "verdict", "pattern", "own", "length", "group"]
    rarest = counted.groupBy(*keys).agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "place", "token")).alias("least"))
    return rarest.select("rule", "verdict", "pattern", "own", "length", F.col("least.token").alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict.

    The longest host rule that fits wins (of equal ones the first by its text); where none fits, rule is null and the
    pattern rules decide: block if one that blocks fits and none that allows, else allow. Null URLs have an empty host and path and are
    allowed; repeated rows are all returned; empty tables give no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    rules = rules_table(spark) if rules is None else rules
    host, path = url_parts(F.col("url"))
    # The verdict depends on the URL alone: equal rows are judged once and repeated at the end.
    urls = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    urls = urls.select("page_id", "url", "copies", host.alias("host"), path.alias("path"), _tokens(F.coalesce("url", F.lit(""))).alias("tokens"))
    index = index_rules(rules, urls)
    tried = urls.withColumn("token", F.explode(F.array_append("tokens", F.lit(NO_TOKEN)))).drop("tokens")
    if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        tried = tried.join(F.broadcast(index), "token", "left")
    else:
        salted = tried.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        tried = salted.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"], "left")
    subject = F.when(F.col("own"), F.coalesce("url", F.lit(""))).otherwise(F.concat("host", "path"))
    fits = F.when(F.col("pattern").isNotNull(), F.regexp_like(subject, F.col("pattern")))
    best = F.min(F.when(fits & ~F.col("own"), F.struct((-F.col("length")).alias("rank"), "rule", "verdict")))
    says = lambda verdict: F.bool_or(F.coalesce(fits & F.col("own") & (F.col("verdict") == verdict), F.lit(False)))
    blocked = says("block") & ~says("allow")
    judged = tried.groupBy("page_id", "url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"), best.alias("best"), blocked.alias("blocked"))
    verdict = F.coalesce("best.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    out = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")
