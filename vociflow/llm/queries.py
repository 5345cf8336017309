"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vociflow.llm import backoff_lm, decontam, jaccard, langid, layout, merkle, packing, quality, rules, tokens, toxicity, url_rules, warc
from vociflow.llm.common import crc_fold, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their 3-word shingles, 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("sequence_length")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels of folds 1 to 4."""
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score_toxicity(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from the archives."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under the add-one unigram model and the backoff automaton."""
    return backoff_lm.score_texts(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 7) == 2)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all documents' token ids, written to token files and read back."""
    return tokens.token_files(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for all documents."""
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the lang column of folds 0 and 2."""
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 3)
    langs, prototypes = langid.learn_prototypes(docs.where(fold != 1))
    found = langid.predict_languages(docs, langs, prototypes)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked into documents: a row for each document and item."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in a layout clustered by source, lang, length and date, and the files that their queries read."""
    return layout.cluster_layout(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels of folds 1 to 4."""
    docs, fold = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5)
    measured = rules.measure(docs)
    model = rules.learn(measured, table(spark, sf_dir, "labels"), fold != 0)
    return rules.score_quality(measured, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in a Merkle manifest, one in seven of them held against a changed row."""
    return merkle.verify_documents(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 7) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_lm_score": op5_lm_score,
    "op6_url_filter": op6_url_filter,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_layout": op11_layout,
    "op12_quality_rules": op12_quality_rules,
    "op13_merkle": op13_merkle,
}

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
rare AS (SELECT doc_id, n, g FROM shingles WHERE g IN (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1)),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT x, y FROM links UNION SELECT r.x, b.y FROM reach r JOIN links b ON r.y = b.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(s.doc_id, m.y), s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = s.doc_id
"""

_QUALITY = r"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT k, i, h, count(*) OVER (PARTITION BY k, h) AS c FROM (
    SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS h
    FROM words WHERE len(w) >= 3)),
repeated AS (SELECT k, count(DISTINCT i + o) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY k),
counts AS (
  SELECT words.k, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated USING (k)),
fails AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2,
    n_symbols > 0.1 * n_words AS f3, (len(lines) - len(list_distinct(lines))) > 0.3 * len(lines) AS f4,
    coalesce(word_chars / nullif(n_words, 0) < 3 OR word_chars / nullif(n_words, 0) > 10, false) AS f5 FROM counts),
rates AS (
  SELECT source, r, count(*) AS n, count(*) FILTER (f) AS bad FROM (
    SELECT source, unnest([1, 2, 3, 4, 5]) AS r, unnest([f1, f2, f3, f4, f5]) AS f FROM fails) GROUP BY source, r),
prior AS (SELECT r, avg(bad / n) AS m, var_pop(bad / n) AS v FROM rates GROUP BY r),
strengths AS (SELECT r, m, CASE WHEN v > 0 THEN least(1000, greatest(1, m * (1 - m) / v - 1)) ELSE 1000 END AS s FROM prior),
hosts AS (SELECT DISTINCT source FROM rates JOIN strengths USING (r) WHERE (bad + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
  (NOT (f1 OR f2) AND NOT EXISTS (SELECT 1 FROM hosts WHERE hosts.source IS NOT DISTINCT FROM fails.source)) AS kept FROM fails
"""

_URLS = r"""
WITH urls AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
rules (verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT page_id, url, host, path, (SELECT {'rule': h || p, 'verdict': verdict} FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS best FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN regexp_matches(url, '^[^?#]*[/.](ads|adserver|banner)[/.]')
  OR regexp_matches(url, '^[^?#]*/(login|signup|logout)([/?#.]|$)') OR regexp_matches(url, '[?&](sessionid|sid)=')
  OR regexp_matches(url, '^[^?#]*/tag/[^?#]*/page/[0-9]+') THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

_WARC = r"""
WITH digests AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
firsts AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS f, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to FROM firsts
"""

#: crc32 of a number's decimal text: each character, then eight shifts, as -1.
_CRC = """4294967295 - list_reduce(flatten(list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1),
    lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)"""

_LAYOUT = f"""
WITH base AS (
  SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN -1 ELSE octet_length(encode(text)) END AS length, ({_CRC}) % 365 AS date FROM documents),
placed AS (
  SELECT doc_id, 8 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS s, 8 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS g,
    8 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS l, 8 * (rank() OVER (ORDER BY date) - 1) // count(*) OVER () AS d FROM base),
curve AS (
  SELECT *, ((d >> 2 & 1) << 11) + ((l >> 2 & 1) << 10) + ((g >> 2 & 1) << 9) + ((s >> 2 & 1) << 8) + ((d >> 1 & 1) << 7) + ((l >> 1 & 1) << 6)
    + ((g >> 1 & 1) << 5) + ((s >> 1 & 1) << 4) + ((d & 1) << 3) + ((l & 1) << 2) + ((g & 1) << 1) + (s & 1) AS z FROM placed),
ordered AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM curve),
filed AS (SELECT *, position // 2000 AS file FROM ordered),
boxes AS (SELECT file, min(s) AS s0, max(s) AS s1, min(g) AS g0, max(g) AS g1, min(l) AS l0, max(l) AS l1, min(d) AS d0, max(d) AS d1 FROM filed GROUP BY file),
cells AS (SELECT DISTINCT z, s, g, l, d FROM filed),
held AS (SELECT DISTINCT file, s, g, l, d FROM filed),
met AS (SELECT z, count(*) AS n FROM cells JOIN boxes ON s BETWEEN s0 AND s1 AND g BETWEEN g0 AND g1 AND l BETWEEN l0 - 1 AND l1 + 1 AND d BETWEEN d0 - 1 AND d1 + 1 GROUP BY z),
inside AS (
  SELECT z, count(DISTINCT file) AS n FROM cells c JOIN held h ON c.s = h.s AND c.g = h.g AND abs(c.l - h.l) <= 1 AND abs(c.d - h.d) <= 1 GROUP BY z)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, met.n::BIGINT AS files_touched, inside.n::BIGINT AS files_matching,
  concat_ws(',', s0, s1, g0, g1, l0, l1, d0, d1) AS file_bounds
FROM filed JOIN boxes USING (file) JOIN met USING (z) JOIN inside USING (z)
"""

_MERKLE = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, ({_CRC}) % 7 = 0 AND n_chars IS NOT NULL AS tampered,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text, (n_chars::HUGEINT + 1)::VARCHAR], lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END) AS f
  FROM documents),
hashed AS (SELECT doc_id, lang, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf, CASE WHEN tampered THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) END AS claimed FROM fields),
leaves AS (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS v, i, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, v + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, v + 1, i // 2, (n + 1) // 2),
roots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS v, i, n, h FROM roots
  UNION ALL SELECT v + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY v + 1, i // 2, (n + 1) // 2),
walk AS (
  SELECT k, lang, 0 AS v, i, n, coalesce(claimed, leaf) AS c, '' AS p FROM leaves
  UNION ALL SELECT k, w.lang, w.v + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || c ELSE c || coalesce(s.h, '') END), p || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.v = w.v AND s.i = xor(w.i, 1) WHERE w.n > 1),
climb AS (
  SELECT k, 0 AS v, r.i, r.n, c, p FROM walk w JOIN roots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT k, w.v + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || c ELSE c || coalesce(s.h, '') END), p || coalesce(s.h, '')
  FROM climb w LEFT JOIN tops s ON s.v = w.v AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, sha256(p) AS proof_sha256, c AS folded_root, c = t.h AS verified
FROM leaves l JOIN (SELECT * FROM climb WHERE n = 1) USING (k) JOIN roots r ON r.lang IS NOT DISTINCT FROM l.lang, (SELECT h FROM tops WHERE n = 1) t
"""

SQL: dict[str, str] = {"op1_jaccard_join": _JACCARD, "op4_warc": _WARC, "op6_url_filter": _URLS, "op8_quality_rules": _QUALITY, "op11_layout": _LAYOUT, "op13_merkle": _MERKLE}
