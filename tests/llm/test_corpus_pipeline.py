"""Every stage of a pipeline run against a brute-force version of it, on documents with planted cases."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from test_jaccard import brute
from test_native import plain_measures
from vociflow.llm import decontam, langid, packing, quality, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_quality(rows):
    """Rows that pass the rules, on hosts whose shrunk failure rates do."""
    fails, hosts = [], defaultdict(lambda: [0, *[0] * 5])
    for r in rows:
        words, chars, symbols, dup, repeated = plain_measures(r["text"])
        lines = sum(1 for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        fails.append((words < 50, 100 * repeated > 50 * words, symbols > 0.1 * words, dup > 0.3 * lines, words > 0 and not 3 <= chars / words <= 10))
        host = hosts[r["source"]]
        host[0] += 1
        for k, f in enumerate(fails[-1]):
            host[k + 1] += f
    bad = set()
    for k in range(1, 6):
        rates = [h[k] / h[0] for h in hosts.values()]
        mean, var = np.mean(rates), np.var(rates)
        strength = min(1000, max(1, mean * (1 - mean) / var - 1)) if var > 0 else 1000
        bad |= {name for name, h in hosts.items() if (h[k] + mean * strength) / (h[0] + strength) > quality.MAX_RATE}
    return [r for r, f in zip(rows, fails, strict=True) if not f[0] and not f[1] and r["source"] not in bad]


def plain_language(rows):
    vectors = {id(r): langid.bundle([r["text"]])[0][0].astype(float) for r in rows}
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            sums[r["lang"]] += vectors[id(r)]
    cosine = lambda a, b: a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)
    least = lambda r: 0.22 * min(1, len(langid.trigrams(r["text"])) / 250) ** 0.5
    return [r for r in rows if len(langid.trigrams(r["text"])) and max(cosine(vectors[id(r)], s) for s in sums.values()) >= least(r)]


def plain_leaks(rows, items):
    index = decontam.build_index(items)
    known = decontam._Terms(index.terms)

    def leaks(r):
        ids = np.array([known[w.encode()] for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w], np.int64)
        ids = ids[ids > -2]
        share = lambda n, wanted: np.isin(wanted, decontam._grams(ids, n)).mean()
        return any(share(*w) >= 0.8 or (n >= 13 and share(*q) >= 0.8) for w, q, n in zip(index.whole, index.question, index.question_words, strict=True))

    return [r for r in rows if not leaks(r)]


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """A folder with the test tables, whose documents hold planted cases too, and the ids of those."""
    rng = random.Random(11)
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r for r in rows if len((r["text"] or "").split()) > 120 and len(set(r["text"].split())) > 60]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan oikeuksiltaan heille on annettu järki omatunto heidän toimittava toisiaan kohtaan".split()
    cases = defaultdict(list)

    def add(kind, text, lang="en", source="planted.org"):
        rows.append({"doc_id": 10**6 + len(rows), "text": text, "lang": lang, "source": source, "n_chars": len(text or "")})
        cases[kind].append(rows[-1]["doc_id"])

    for k in range(12):
        base = rng.choice(clean)
        add("foreign", " ".join(rng.choice(finnish) + "abcdefghij"[rng.randrange(10)] * (k % 2) for _ in range(90)))
        add("letters", " ".join("".join(chr(97 + rng.randrange(26)) for _ in range(rng.randint(3, 9))) for _ in range(90)))
        add("copy", base["text"], base["lang"])
        words = base["text"].split()
        words[rng.randrange(len(words))] = "changed"
        add("near", " ".join(words), base["lang"])
        at = rng.randrange(len(words))
        add("leak", " ".join([*(f"{w}x" for w in words[:at]), rng.choice(items)[1], *(f"{w}x" for w in words[at:])]), base["lang"])
        add("short", "too short")
    add("null", None)
    folder = str(tmp_path_factory.mktemp("sf"))
    for name in os.listdir(sf_dir):
        if not name.startswith("documents"):
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).schema).write.parquet(f"{folder}/documents.parquet")
    return folder, rows, items, cases


def test_stages_equal_brute_force(spark, planted):
    import corpus_pipeline

    folder, rows, items, cases = planted
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rs: sorted((r["doc_id"], r["text"] or "") for r in rs)
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), rows
    expected = {
        "quality_rules": plain_quality, "language_id": plain_language, "decontamination": lambda rs: plain_leaks(rs, items),
        "near_duplicates": _least,
    }
    ids = lambda rs: {r["doc_id"] for r in rs}
    for name, gone in (("quality_rules", ["short", "null"]), ("language_id", ["foreign", "letters"]), ("near_duplicates", ["copy", "near"]), ("decontamination", ["leak"])):
        found = [r.asDict() for r in stages[name](spark, docs, folder).collect()]
        wanted = expected[name](left)
        assert key(found) == key(wanted), name
        assert not ids(found) & {i for kind in gone for i in cases[kind] if i in ids(left)} or name == "near_duplicates"
        docs, left = spark.createDataFrame(found, docs.schema), wanted
    assert not ids(left) & {i for kind in ("foreign", "letters", "leak", "short", "null") for i in cases[kind]}
    pieces = stages["packing"](spark, docs, folder).collect()
    _assert_packed(pieces, left)
    run = corpus_pipeline.run(spark, folder).collect()
    _assert_packed(run, left)


def _least(rows):
    groups = brute([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)
    return [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]


def _assert_packed(pieces, rows):
    """Every id of every document lies in one piece, and sequences are full or of a power of two."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    wanted = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}
    covered, room = {i: np.zeros(len(x), int) for i, x in wanted.items()}, defaultdict(int)
    for p in pieces:
        own = wanted[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"]
        covered[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
        room[p["sequence_id"]] += p["length"]
    assert all((c == 1).all() for c in covered.values())
    assert all(n == packing.SEQUENCE or n & (n - 1) == 0 for n in room.values())
