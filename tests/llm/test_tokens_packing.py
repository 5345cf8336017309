"""Token files and packing: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from vociflow.llm import common, packing, tokens

TEXTS = [
    (3, "Hello, wörld. don't it's <|endoftext|> a<|startoftext|>b ÀB́ x\ty \x1cz 12,5 3. a, ."),
    (1, None), (2, ""), (5, " \n "), (4, "İstanbul ΣΑΣ. ﬁ, Å, é. ́a. ...,, word.,"), (9, "the cat, the dog. " * 3000), (7, "x" * 5000), (4, "again"), (3, "Hello, Hello"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_words_encode_as_texts_do(library, duck):
    rows = [t for (t,) in duck.execute("SELECT text FROM documents").fetchall()] + [t for _, t in TEXTS]
    enc = tokens.WordEncoder(tokens.default_tokenizer(), cache_words=500)
    for start in range(0, len(rows), 20):
        some = rows[start : start + 20]
        ids, starts = enc.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [library(t) for t in some]


def test_token_files(spark, docs, library, tmp_path):
    path = "file://" + str(tmp_path / "t")
    table = docs(TEXTS)
    tokens.write_token_files(table, path, tokens.default_tokenizer(), partitions=3)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_digest(spark, path).collect())
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((i, len(library(t)), crc(library(t))) for i, t in TEXTS)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == sorted(i for i, _ in TEXTS)
    assert [r[1] for r in by_start] == np.concatenate([[0], np.cumsum([r[2] for r in by_start])[:-1]]).tolist()
    assert {(r["doc_id"], r["start"]) for r in tokens.read_token_metadata(spark, path).collect()} == {(r[0], r[1]) for r in got}
    assert [r["tokens"] for r in tokens.read_tokens(spark, path, 9, 9).collect()] == [library(TEXTS[5][1])]
    plan = tokens.read_token_metadata(spark, path)._jdf.queryExecution().toString()
    assert ",tokens#" not in plan.split("== Physical Plan ==")[1]


def test_empty_tables(docs):
    assert tokens.token_files(docs([])).count() == 0
    assert packing.pack_documents(docs([])).count() == 0


def test_pieces_cover_documents_and_fill_sequences(docs, library):
    got = [r.asDict() for r in packing.pack_documents(docs(TEXTS).coalesce(2), sequence=256, block_tokens=3000).collect()]
    wanted = sorted((i, library(t)) for i, t in TEXTS)
    for r in got:
        assert any(i == r["doc_id"] and r["doc_tokens"] == len(ids) and crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for i, ids in wanted)
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in wanted)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == pieces[0][2] and (at == 256 or at & (at - 1) == 0)


def test_packing_is_even_and_cuts_little():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1500, 800).tolist()
    pieces = packing.pack(lengths)
    room = packing.capacities(sum(lengths))
    held = np.zeros(len(room), int)
    cost = np.zeros(len(room))
    for _, _, n, s, offset in pieces:
        assert offset == held[s]
        held[s] += n
        cost[s] += packing.piece_cost(n)
    assert held.tolist() == room and len(pieces) <= len(lengths) + len(room)
    full = cost[: sum(lengths) // packing.SEQUENCE]
    assert full.std() / full.mean() < 0.25
    assert packing.pack([]) == [] and packing.capacities(5) == [4, 1]


def plain_pack(lengths, sequence):
    """The rule word by word: long documents fill sequences first; then descending pieces go to the cheapest sequence with room."""
    room = packing.capacities(sum(lengths), sequence)
    full = [k for k, c in enumerate(room) if c == sequence]
    used, cost, out, left = [0] * len(room), [0.0] * len(room), [], []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= sequence and full:
            k = full.pop(0)
            out.append((doc, start, sequence, k, 0))
            used[k], start = sequence, start + sequence
        if start < n:
            left.append((n - start, doc, start))
    for n, doc, start in sorted(left, key=lambda x: (-x[0], x[1], x[2])):
        while n:
            fits = [(cost[k], k) for k in range(len(room)) if room[k] - used[k] >= n]
            k = min(fits)[1] if fits else max((room[k] - used[k], -cost[k], -k) for k in range(len(room)) if room[k] > used[k])[2] * -1
            take = min(n, room[k] - used[k])
            out.append((doc, start, take, k, used[k]))
            used[k], cost[k] = used[k] + take, cost[k] + packing.piece_cost(take)
            n, start = n - take, start + take
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pieces_go_to_the_cheapest_sequence_with_room(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [40, 300, 700][seed % 3], 120).tolist()
    assert sorted(packing.pack(lengths, 256)) == sorted(plain_pack(lengths, 256))


def test_long_texts_are_gathered_by_bytes(docs, library):
    batches = [pa.RecordBatch.from_arrays([pa.array(["word " * 200_000])], ["text"]) for _ in range(60)]
    sizes = [b.nbytes for b in common.gather(iter(batches), 2000)]
    assert sum(sizes) >= 60_000_000 and max(sizes) <= common.GATHER_BYTES + 1_100_000
    rows = [(k, ("" if k % 2 else "ключ 漢字 ") + "long words, " * 80_000) for k in range(4)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_files(docs(rows)).collect()}
    assert got == {k: len(library(t)) for k, t in rows}
    assert sum(r["length"] for r in packing.pack_documents(docs(rows)).collect()) == sum(got.values())
