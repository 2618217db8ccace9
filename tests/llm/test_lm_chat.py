"""Byte model and chat formatting against slow, direct forms."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drainrules.llm import chat, common, ctw, lm, queries

SF001 = "/root/testdata/sf0.001"




def slow_tree(stream, depth, expanded):
    """Predictor by recursion over expanded contexts; a context is the bytes before, the latest last."""

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def counts(events, prefix):
        k = len(prefix)
        a = sum(n for (byte, n) in events if f"{byte:08b}"[:k] == prefix and f"{byte:08b}"[k] == "0")
        b = sum(n for (byte, n) in events if f"{byte:08b}"[:k] == prefix and f"{byte:08b}"[k] == "1")
        return a, b

    table = defaultdict(Counter)
    for context, byte in stream:
        for d in range(depth + 1):
            table[context[len(context) - d :]][byte] += 1

    def kids(s):
        return [c for c in expanded if len(c) == len(s) + 1 and c.endswith(s)]

    def other(s):
        rest = Counter(table[s])
        for c in kids(s):
            rest -= table[c]
        return rest

    def weighted(s, prefix):
        e = estimate(*counts(table[s].items(), prefix))
        if len(s) == depth or not kids(s):
            return e
        below = sum(weighted(c, prefix) for c in kids(s)) + estimate(*counts(other(s).items(), prefix))
        return math.log(0.5) + np.logaddexp(e, below)

    def one(context, s, prefix):
        a, b = counts(table[s].items(), prefix)
        kt = (b + 0.5) / (a + b + 1)
        if len(s) == depth or not kids(s):
            return kt
        beta = math.exp(math.log(0.5) + estimate(a, b) - weighted(s, prefix))
        longer = context[len(context) - len(s) - 1 :]
        if longer in expanded:
            q = one(context, longer, prefix)
        else:
            x, y = counts(other(s).items(), prefix)
            q = (y + 0.5) / (x + y + 1)
        return beta * kt + (1 - beta) * q

    def log10_probability(context, byte):
        bits, total = f"{byte:08b}", 0.0
        for k in range(8):
            p = one(context, b"", bits[:k])
            total += math.log10(p if bits[k] == "1" else 1 - p)
        return total

    return log10_probability


def stream_of(texts, depth):
    out = []
    for t in texts:
        whole = ctw.START * depth + t + ctw.END
        out += [(whole[i - depth : i], whole[i]) for i in range(depth, len(whole))]
    return out


def test_tree_equals_slow_form(spark):
    texts = ["abracadabra", "abrab é", "", "cab cad", "bra bra bra"]
    depth, share = 2, 0.06
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tree = lm.fit_tree(df, depth, share)
    stream = stream_of([t.encode() for t in texts], depth)
    total = len(stream)
    expanded = {b""}
    for d in range(1, depth + 1):
        c = Counter(context[len(context) - d :] for context, _ in stream)
        expanded |= {k for k, n in c.items() if n >= share * total}
    assert [len(c) for c in tree.contexts] == [sum(len(e) == d for e in expanded) for d in range(depth + 1)]
    slow = slow_tree(stream, depth, expanded)
    for text in (b"abra", b"", "é?".encode(), b"zzz cab"):
        want = sum(slow(c, b) for c, b in stream_of([text], depth))
        assert tree.log10_probability(text) == pytest.approx(want, abs=1e-4)


def test_log_gammas():
    n = np.array([0.0, 1, 2, 7, 100, 1e9])
    assert ctw.log_gamma_half(n) == pytest.approx([math.lgamma(x + 0.5) for x in n])
    assert ctw.log_factorial(n) == pytest.approx([math.lgamma(x + 1) for x in n], abs=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    tree = lm.fit_tree(docs.select("text"), 3, 1e-3)
    assert np.abs((10.0 ** tree.table.astype(float)).sum(axis=1) - 1).max() < 1e-5


def test_query_base_scores_and_gain(spark):
    rows = {r["doc_id"]: r for r in queries.op5_lm_scoring(spark, SF001).collect()}
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    tokens = {d: [*t.lower().split(), None] for d, t in docs}
    c = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = rows[d]
        assert r["held_out"] == out[d] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in rows.values() if r["held_out"]]
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(len(t) + 1 for d, t in docs if out[d])
    assert bits < 3.2  # eight without a model


def test_rare_words_go_by_the_join(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a b", "a", "", None, "x a"])] + [(0, "a b c")], "doc_id long, text string")
    few = lm.score_texts(docs, depth=1, share=0.01, hot_words=1).orderBy("doc_id", "base_score").collect()
    many = lm.score_texts(docs, depth=1, share=0.01, hot_words=1000).orderBy("doc_id", "base_score").collect()
    assert len(few) == 7
    for a, b in zip(few, many, strict=True):
        assert a["n_known"] == b["n_known"] and a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == b["score"]


def test_lm_odd_input(spark, odd_docs, no_docs):
    rows = lm.score_texts(odd_docs, depth=2, share=0.001).collect()
    assert len(rows) == 10 and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in rows)
    assert sum(r["doc_id"] is None and not r["held_out"] for r in rows) == 2
    assert lm.score_texts(no_docs, depth=2).count() == 0
    from pyspark.sql import functions as F

    none = lm.score_texts(odd_docs, is_held_out=F.lit(True), depth=2).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["base_score"] for r in none} == {0.0}


ROLES = ["system", "user", "assistant", "assistant", "user", "tool", "", None]


def slow_digest(turns):
    turns = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
    whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_formatting_round_trip_on_odd_texts(spark):
    rnd = random.Random(5)
    parts = ["\\", "### Assistant:", "### Assistant: ", "### User:", " </turn>", "</turn>\n", "### Role 61:", "a", "é", "\n", " ", "\\### System:", "</", "turn>", "###", "🙂"]
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 8)):
            text = None if rnd.random() < 0.05 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
            rows.append((c if c else None, rnd.choice([t, t, 0, None]), rnd.choice(ROLES), text, "extra"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r, x))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == slow_digest(turns)


@pytest.mark.parametrize(
    ("roles", "valid"),
    [
        (["user", "assistant"], True), (["system", "user", "assistant", "user", "assistant"], True), (["user"], False), (["assistant"], False),
        (["user", "user", "assistant"], False), (["user", "system", "assistant"], False), (["user", "assistant", "tool"], False), (["system"], False),
    ],
)
def test_order_of_roles(spark, roles, valid):
    df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).first()["valid"] == valid


def test_loss_covers_assistant_texts_only(spark):
    segments = chat.format_conversations(spark.read.parquet(f"{SF001}/conversations.parquet")).collect()
    assert all(s["loss"] == (s["role"] == "assistant" and s["part"] == "text") for s in segments)


def test_chat_query_and_empty_table(spark):
    rows = {r["conv_id"]: r for r in queries.op8_chat_formatting(spark, SF001).collect()}
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    by[-7] = [(t, r, x) for _, t, r, x in queries.CONTROL_ONLY]
    assert set(rows) == set(by)
    for c, turns in by.items():
        assert tuple(rows[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == slow_digest(turns)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0

def test_scores_are_of_the_whole_tree(spark):
    """No context is pooled, whatever its share, and the broadcast changes nothing."""
    texts = ["abracadabra", "abrab é", "", "cab cad", "bra bra bra", "abrx cad"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = F.col("doc_id") == 5
    for depth, ways in ((0, [{}]), (3, [{"share": 0.2}, {"hot_grams": 0}]), (6, [{"hot_grams": 9}])):
        stream = stream_of([t.encode() for t in texts[:5]], depth)
        expanded = {context[len(context) - d :] for context, _ in stream for d in range(depth + 1)}
        slow = slow_tree(stream, depth, expanded)
        for more in ways:
            got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, out, depth, **more).collect()}
            for i, t in enumerate(texts[:5]):
                assert got[i] == pytest.approx(sum(slow(c, b) for c, b in stream_of([t.encode()], depth)), abs=1e-9)
            assert math.isfinite(got[5])


def test_held_out_texts_score_above_single_words(spark):
    """On held-out texts of the words that were learnt the model is no worse than the base."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=80))) for i in range(300)], "doc_id long, text string")
    rows = lm.score_texts(docs, share=0.01).where("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > 1.1 * sum(r["base_score"] for r in rows)


def test_runs_end_where_the_context_changes():
    keys = [0] * 3 + [1] * 7 + [2] + [4] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array(range(i, min(i + 2, len(keys))))], names=["shared", "x"]) for i in range(0, len(keys), 2)]
    for rows in (1, 4, 100):
        runs = [list(x) for (x,) in lm.whole_contexts(iter(batches), rows)]
        assert sum(runs, []) == list(range(len(keys)))
        assert all(keys[a[-1]] != keys[b[0]] for a, b in zip(runs, runs[1:]))
        assert rows == 100 or len(runs) > 1


def test_grams_are_summed_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_BYTES", 20)
    monkeypatch.setattr(lm, "COUNT_ROWS", 12)
    texts = [("abcAb", False), ("abc", True), ("", False), ("zab" * 5, True), ("é", False)] * 4
    got = lm.gram_counts(spark.createDataFrame(texts, "text string, held_out boolean").coalesce(1), 2).collect()
    n, seen = Counter(), Counter()
    for text, out in texts:
        data = b"\xff\xff" + text.lower().encode() + b"\xff"
        for i in range(len(data) - 2):
            seen[int.from_bytes(data[i : i + 3], "big")] += 1
            n[int.from_bytes(data[i : i + 3], "big")] += not out
    assert {r["code"]: (r["n"], r["seen"]) for r in got} == {c: (n[c], k) for c, k in seen.items()} and len(got) == len(seen)


def test_hot_grams_are_looked_up_unsorted():
    texts = [b"abab", b"", b"ba"]
    codes = [[int.from_bytes((b"\xff" + t + b"\xff")[i : i + 2], "big") for i in range(len(t) + 1)] for t in texts]
    hot = {codes[0][1]: -0.5, codes[0][0]: -2.0}
    score, others, n_others = lm.hot_sums(texts, 1, pd.Index(np.array(list(hot))), np.array([*hot.values(), 0.0]))
    assert score.tolist() == [sum(hot.get(c, 0.0) for c in cs) for cs in codes]
    assert others.tolist() == [c for cs in codes for c in cs if c not in hot]
    assert n_others.tolist() == [sum(c not in hot for c in cs) for cs in codes]


def peak_bytes(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_counting_holds_few_copies():
    rng = random.Random(5)
    words = [b"".join(rng.choices([b"a", b"b", b"c", b"d", b"e"], k=rng.randint(2, 6))) for _ in range(50)]
    texts = [b" ".join(rng.choices(words, k=4000)) for _ in range(60)]
    size = sum(map(len, texts))
    assert peak_bytes(lambda: ctw.gram_codes(texts, 6)) < 14 * size
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts]), pa.array([i % 7 == 2 for i in range(60)])], names=["text", "held_out"])
    assert peak_bytes(lambda: list(lm.count_grams(iter([batch]), 6, 1 << 30, 1 << 30))) < 16 * size


def test_frequent_grams_are_dropped_by_other_stages(spark, tmp_path):
    docs = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)
    spark.createDataFrame([(1, -0.5)], "code long, log_p double").write.parquet(f"{tmp_path}/hot")
    for looks_up in (True, False):
        lm.frequent(f"file://{tmp_path}/hot")
        list(common.map_arrow(docs, iter, "x long", looks_up=looks_up)(iter([])))
        assert lm.frequent.cache_info().currsize == looks_up


def test_tasks_that_weigh_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") * 256).alias("key"))
    assert lm._dealt(rows, 2).rdd.getNumPartitions() == 1
    monkeypatch.setattr(lm, "DEAL_ROWS", 50)
    assert lm._dealt(rows, 2).rdd.getNumPartitions() == 20
