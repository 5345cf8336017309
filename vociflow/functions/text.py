"""Text functions: cleaning, tokens, language, n-grams and hashes. All are JVM expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vociflow.params import DEFAULT, Params

# The patterns that define cleaned text.
TAG = r"<[^>]+>"
URL = r"https?://\S+"
ID_MENTION = r"\[id\d+\|[^]]*]"
MENTION = r"@[\w.]+"
HASHTAG = r"#[\wА-яёЁ]+"
# Most characters are below the first of these, and need no look at each range; runs of small letters are the most frequent words.
EMOJI = (
    r"[\x{200D}-\x{10FFFF}&&\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}"
    r"\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{200D}\x{20E3}]+"
)
TOKEN = r"((?:[a-z]+|[A-Z0-9]+|[а-яёА-ЯЁ]+)++|\[URL]|\[USER]|[^\s])"
LETTER_FIRST = r"^[а-яёА-ЯЁa-zA-Z]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def clean(raw: Column) -> Column:
    """Text without tags and emoji, with links and mentions as placeholders and single spaces (X1), not yet cut."""
    text = raw
    for pattern, by in ((TAG, ""), (URL, "[URL]"), (ID_MENTION, "[USER]"), (MENTION, "[USER]"), (EMOJI, " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def cleaned(raw: Column, p: Params = DEFAULT) -> Column:
    """A struct of the clean text, cut at the longest length, and why it was cut."""

    def cut(text: Column) -> Column:
        long = F.length(text) > p.max_text
        return F.struct(
            F.substring(text, 1, p.max_text).alias("clean_text"),
            F.coalesce(long, F.lit(False)).alias("truncated"),
            F.when(long, F.lit(f"TEXT_EXCEEDS_{p.max_text}_CHARS")).alias("truncation_reason"),
        )

    return let(clean(raw), cut)


def tag_counts(raw: Column) -> Column:
    """Hashtags, and counts of hashtags, links and mentions, from the raw text."""
    tags = F.transform(F.regexp_extract_all(raw, F.lit(f"({HASHTAG})"), F.lit(1)), lambda t: F.substring(t, 2, 1_000_000))
    return F.struct(
        tags.alias("hashtags"),
        F.size(tags).alias("hashtags_count"),
        F.regexp_count(raw, F.lit(URL)).alias("urls_count"),
        (F.regexp_count(raw, F.lit(MENTION)) + F.regexp_count(raw, F.lit(ID_MENTION))).alias("mentions_count"),
        F.array_join(F.regexp_extract_all(raw, F.lit(f"({EMOJI})"), F.lit(1)), "").alias("emojis"),
    )


def tokenize(text: Column) -> Column:
    """Words and single other characters, without placeholders."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    return F.filter(found, lambda t: ~t.isin("[URL]", "[USER]"))


def without_stop_words(tokens: Column, stop: Sequence[str]) -> Column:
    """Tokens that are no stop words in lower case."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stop)) if stop else tokens


def words_only(tokens: Column) -> Column:
    """Tokens that start with a letter."""
    return F.filter(tokens, lambda t: t.rlike(LETTER_FIRST))


def language_share(tokens: Column, frequent: Sequence[str]) -> Column:
    """Share of frequent words among tokens that start with a letter; 0 without any."""
    hits = lambda words: F.size(F.filter(words, lambda t: F.lower(t).isin(*frequent))).cast("double")
    return let(words_only(tokens), lambda words: F.coalesce(F.try_divide(hits(words), F.size(words)), F.lit(0.0)))


def language_status(share: Column, words: Column, p: Params = DEFAULT) -> Column:
    """OK, UNCERTAIN or FILTERED_OUT by the share; UNKNOWN without words."""
    status = F.when(share >= p.language_ok, "OK").when(share >= p.language_uncertain, "UNCERTAIN").otherwise("FILTERED_OUT")
    return F.when(F.size(words) == 0, "UNKNOWN").otherwise(status)


def model_language_status(lang: Column, confidence: Column, wanted: str = "ru", p: Params = DEFAULT) -> Column:
    """The status for a language that a model detected with some confidence."""
    return F.when((lang == wanted) & (confidence >= p.language_ok), "OK").when(lang == wanted, "UNCERTAIN").otherwise("FILTERED_OUT")


def parse_ngrams(spec: Column, fallback: Column | None = None) -> Column:
    """N-grams of a specification (lines or commas) as arrays of lower-cased words; else those of the fallback."""

    def parse(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")
        return F.filter(F.transform(parts, lambda x: F.transform(words_only(tokenize(x)), F.lower)), lambda x: F.size(x) > 0)

    found = parse(spec)
    return found if fallback is None else F.when(F.size(found) > 0, found).otherwise(parse(fallback))


def ngram_hits(lemmas: Column, ngrams: Column) -> Column:
    """How many n-grams have all of their words somewhere among the lemmas, in any order."""
    return F.size(F.filter(ngrams, lambda g: F.forall(g, lambda w: F.array_contains(lemmas, w))))


def match(lemmas: Column, primary: Column, secondary: Column, excluded: Column) -> Column:
    """primary and secondary hits and whether an excluded n-gram is present, which zeroes both."""
    out = ngram_hits(lemmas, excluded) > 0
    zero = F.lit(0)
    return F.struct(
        F.when(out, zero).otherwise(ngram_hits(lemmas, primary)).alias("primary"),
        F.when(out, zero).otherwise(ngram_hits(lemmas, secondary)).alias("secondary"),
        out.alias("excluded"),
    )


def dedup_key(text: Column) -> Column:
    """SHA-256 of the text without placeholders, hashtags, case and surplus spaces."""
    plain = F.regexp_replace(F.lower(text), r"\[url]|\[user]", "")
    plain = F.regexp_replace(plain, r"#[\wа-яё]+", "")
    return F.sha2(F.trim(F.regexp_replace(plain, r"\s+", " ")), 256)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 - Levenshtein distance of two token arrays / the longer length; 1 if both are empty.

    Each token becomes one character, so that the built-in distance counts tokens. Characters come from a hash of the
    token; where different tokens of a pair share one, another hash is tried, and in the end their places in a list of the
    pair's tokens are taken. With least, similarities below it are 0, and the distance stops at the edits that it allows.
    """

    def coded(numbers: Column) -> Column:
        # Four-byte characters, of which none is a surrogate, by their hexadecimal numbers.
        digits = F.transform(numbers, lambda k: F.lpad(F.hex(k + 0x10000), 8, "0"))
        return F.decode(F.unhex(F.array_join(digits, "")), "UTF-32")

    def compare(x: Column, y: Column, names: Column) -> Column:
        longer = F.greatest(F.size(x), F.size(y))
        hashed = lambda salt: lambda tokens: F.transform(tokens, lambda t: F.pmod(F.xxhash64(t, F.lit(salt)), F.lit(1_000_000)))
        listed = lambda tokens: F.transform(tokens, lambda t: F.array_position(names, t))
        apart = lambda salt: F.size(F.array_distinct(hashed(salt)(names))) == F.size(names)

        def distance(code) -> Column:
            if least is None:
                return F.levenshtein(coded(code(x)), coded(code(y)))
            return F.call_function("levenshtein", coded(code(x)), coded(code(y)), F.floor((1 - least) * longer + 1e-9).cast("int"))

        edits = F.when(apart(0), distance(hashed(0))).when(apart(1), distance(hashed(1))).otherwise(distance(listed))
        found = let(edits, lambda d: F.when(d < 0, F.lit(0.0)).otherwise(1 - d / longer))
        return F.when(longer == 0, F.lit(1.0)).when(F.least(F.size(x), F.size(y)) == 0, F.lit(0.0)).otherwise(found)

    return let(a, lambda x: let(b, lambda y: let(F.array_distinct(F.concat(x, y)), lambda names: compare(x, y, names))))


def salted_hash(value: Column, salt: bytes) -> Column:
    """SHA-256, in hexadecimal, of a salt followed by the value's UTF-8 bytes."""
    return F.sha2(F.concat(F.lit(salt), F.encode(value.cast("string"), "UTF-8")), 256)


def text_hash(text: Column) -> Column:
    """SHA-256 of a text, as the key of cached results."""
    return F.sha2(text, 256)


def format_indicator(name: Column, status: Column, value: Column) -> Column:
    """A quality indicator as 'name: STATUS (0.123)' (X19)."""
    return F.format_string("%s: %s (%.3f)", name, status, value.cast("double"))


def parse_indicator(message: Column) -> Column:
    """name, status and value of a formatted indicator; a decimal comma is understood, other texts give nulls."""
    pattern = r"^(.*): ([A-Z_]+) \(([-0-9.,]+)\)$"
    part = lambda k: F.nullif(F.regexp_extract(message, pattern, k), F.lit(""))
    value = F.replace(part(3), F.lit(","), F.lit("."))
    return F.struct(part(1).alias("name"), part(2).alias("status"), value.try_cast("double").alias("value"))


def encode_list(values: Column) -> Column:
    """A list of texts as JSON, as lemma lists are stored."""
    return F.to_json(values)


def decode_list(document: Column) -> Column:
    """A list of texts from JSON; null and broken documents give null."""
    return F.from_json(document, "array<string>")


def gates_json(gates: dict[str, Column]) -> Column:
    """Named conditions as one JSON object, in the order of their names."""
    return F.to_json(F.struct(*[gates[n].alias(n) for n in sorted(gates)]))


def preview(text: Column, length: int) -> Column:
    """The first characters of a text, with an ellipsis if it is longer."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)
