"""Token ids, packing and record files: against whole-text encoding, as exact partitions, and read back."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drainrules.llm import packing, queries, records
from drainrules.llm.tokens import PieceEncoder
from drainrules.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SF001 = "/root/testdata/sf0.001"


def whole(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path):
    rnd = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "'", "1", "23", "#", " ", "\x1c", "\x85", "ß", "İ", "Σ", "é", "́", "漢", "🙂", "<|endoftext|>", "\r\n", "the", "　"]
    texts = ["", " ", "\n"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    t = Tokenizer.from_file(path)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for cache in (5, 10_000):  # the cache turns over all the time, or never
        enc = PieceEncoder(path, cache)
        assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in texts] == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_marks_after_every_lower_case_character(path):
    lower = [chr(c) for c in range(0x110000) if chr(c).islower()]
    texts = [f"go {start}{c}{marks} on" for c in lower for start in ("", "a") for marks in (".", ",;", "!?*")]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(path)
    wrong = {x for x, ids in zip(texts, want, strict=True) if np.frombuffer(enc.encode(x), "<u4").tolist() != ids}
    assert not wrong


def test_words_that_differ_by_case_are_one_piece():
    enc = PieceEncoder(WORDS)
    texts = ["Gr\u00f6\u00dfe gr\u00f6\u00dfe GR\u00d6\u00dfE", "Of OF of"]
    assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in texts] == [whole(WORDS, x) for x in texts]
    assert len(enc._cache) == 2


def test_latin_1_texts_and_added_tokens_in_capitals():
    rnd = random.Random(11)
    parts = [*map(chr, range(0x100)), "<|ENDOFTEXT|>", "<|endoftext|>", "'S", "H\u0331", "\u212a", "\u03a3"]
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> B"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    texts += [f"{a}{chr(c)}{a} {chr(c)}{a}." for c in range(0x100) for a in ("A", "z")]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(WORDS)
    assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in texts] == want


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_an_exact_partition_without_padding(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 2, 63, 64, 65, 300, 5000]) + rnd.randint(0, 5) for _ in range(200)]
    pieces = packing.plan_block(lengths, 64)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o, size in pieces:
        assert n > 0
        by_doc[d].append((s, n))
        by_seq[q].append((o, n, size))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(by_doc[d]):
            assert s == at
            at += k
        assert at == n
    for rows in by_seq.values():
        at = 0
        for o, n, size in sorted(rows):
            assert o == at
            at += n
        assert at == rows[0][2] and at <= 64 and at & (at - 1) == 0


def test_costs_are_balanced():
    rnd = random.Random(1)
    pieces = packing.plan_block([rnd.randint(1, 600) for _ in range(2000)])
    cost = defaultdict(float)
    for _, _, n, q, _, size in pieces:
        if size == packing.CAPACITY:
            cost[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
    values = np.array(list(cost.values()))
    assert values.std() / values.mean() < 0.02


def check_pieces(rows, docs, path):
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(tuple([*whole(path, text or ""), 1]))
    got = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        got[r["doc_id"]][r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for doc_id, texts in want.items():
        for n in {len(t) for t in texts}:
            same = [t for t in texts if len(t) == n]
            assert len(set(same)) == 1  # the fixtures repeat whole rows only
            flat = sorted(got[doc_id][n], key=lambda p: p[0])
            counts = np.zeros(n, dtype=int)
            for start, ids in flat:
                assert tuple(ids) == same[0][start : start + len(ids)]
                counts[start : start + len(ids)] += 1
            assert (counts == len(same)).all()


def check_sequences(rows):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
    for pieces in seqs.values():
        at = 0
        for o, n, _ in sorted(pieces):
            assert o == at
            at += n
        assert at == pieces[0][2] <= packing.CAPACITY and at & (at - 1) == 0


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs.coalesce(2), BYTES, block_tokens=3000).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    texts = [d for d in docs if d[0] is not None]
    check_sequences(rows)
    check_pieces([r for r in rows if r["doc_id"] is not None], texts, BYTES)
    assert sum(r["length"] for r in rows) == sum(len(whole(BYTES, t or "")) + 1 for _, t in docs)
    assert packing.pack_documents(no_docs, BYTES).count() == 0


def test_packing_query_covers_the_table(spark):
    rows = queries.op6_packing(spark, SF001).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*whole(BYTES, text), 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_frames_hold_and_damage_shows():
    for payload in (b"", b"x", bytes(range(256)) * 50):
        data = records.frame(payload)
        assert records.unframe(data) == payload
        for at in (0, 9, len(data) - 1):
            bad = bytearray(data)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                records.unframe(bytes(bad))


def test_records_of_odd_documents_in_any_order(spark, odd_docs, no_docs):
    folder = scratch_path(spark, "records-test")
    index = records.with_global_start(records.write_records(odd_docs, folder, WORDS, parts=3))
    found = records.read_records(index.orderBy(F.rand(3)), folder).collect()
    docs = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == sorted((d or -1, [*whole(WORDS, t), 1]) for d, t in docs)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    empty = scratch_path(spark, "records-empty")
    index = records.with_global_start(records.write_records(no_docs, empty, WORDS))
    assert records.read_records(index, empty).count() == 0


def test_records_query(spark):
    rows = {r["doc_id"]: r for r in queries.op7_token_records(spark, SF001).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    at = 0
    for doc_id, text in docs:
        ids = np.array([*whole(WORDS, text), 1], dtype="<u4")
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(docs)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_line_ends_and_added_tokens(path):
    """Line ends everywhere and strings of added tokens: the ids of the library as it is."""
    rnd = random.Random(11)
    parts = [" ", " ", "\n", "\n", "\r\n", "\t", "a", "Bc.", "d,", "'s", "1", "#", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "é", "\x1c", "　", "ⓐ."]
    texts = ["", "\n", "\n\n", " \n", "a\n", "a\nb", "a \nb", "a\n b", "a\n\nb", "\na", "a\n.b", "x <|endoftext|> y"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for cache in (10_000, 50, 5):
        enc = PieceEncoder(path, cache)
        found = [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode_many(pa.array(texts, pa.string()))]
        wrong = [t for t, a, b in zip(texts, found, want, strict=True) if a != b]
        assert not wrong, wrong[:5]
    assert list(enc.encode_many(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_letters_go_straight_to_the_merges(path):
    """The ids of the library as it is, from its merges alone, for every pair of letters and for longer words."""
    letters = [chr(c) for c in range(0x100) if chr(c).isalpha()]
    rnd = random.Random(5)
    words = [a + b for a in letters for b in letters] + ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(3000)]
    words += ["".join(rnd.choices("eationrsTHE", k=rnd.randint(1, 14))) for _ in range(3000)] + ["a" * 3000]
    texts = [f"{a} {b} {c}\n{d}" for a, b, c, d in zip(words[::4], words[1::4], words[2::4], words[3::4])]
    enc = PieceEncoder(path)
    assert enc._merge is not None
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in texts] == want
    whole_calls = []
    enc._direct = lambda text: whole_calls.append(text) or b""
    enc.encode("x quitenewword Straße élève")
    assert whole_calls == (["x"] if path == BYTES else [])
