"""Decontamination against brute force, and the pipeline against its operators in memory."""

import random

import numpy as np
import pytest

import corpus_pipeline
from drainrules.llm import decontaminate as D
from drainrules.llm import packing, quality, queries, simhash
from drainrules.llm.tokens import PieceEncoder

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def slow_distance(item, words):
    """Least edits of the item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(3))
def test_semi_global_equals_slow_form(seed):
    r = random.Random(seed)
    for _ in range(300):
        item = [r.randint(1, 4) for _ in range(r.randint(1, 70 if seed == 2 else 9))]
        words = [r.randint(0, 4) for _ in range(r.randint(0, 16))]
        edits, start, end = D.semi_global(np.array(item), np.array(words, dtype=int))
        assert edits == slow_distance(item, words)
        assert D._distances(item, words[start:end], True)[-1] == edits


def slow_leaks(text, items, similarity=0.8):
    words = D.text_words(text or "")
    out = {}
    for i, t in items:
        item = D.text_words(t or "")
        if item:
            d = slow_distance(item, words)
            if d <= int((1 - similarity) * len(item) + 1e-9):
                out[i] = d
    return out


def test_query_equals_brute_force_on_exact_and_near_passages(spark):
    rows = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op9_decontamination(spark, SF001).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    short = [d for d in docs if len(d[1] or "") < 3000][:60] + [d for d in docs if d[0] in {k[0] for k in rows}]
    want = {(d, i): e for d, t in short for i, e in slow_leaks(t, items).items()}
    assert {k: v for k, v in rows.items() if k[0] in {d for d, _ in short}} == want
    assert {(d, i) for d, t in docs for i, x in items if x in (t or "")} <= set(rows)


def edited(words, k, r):
    words = list(words)
    for _ in range(k):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0 and len(words) > 1:
            del words[at]
        elif kind == 1:
            words.insert(at, f"new{r.randrange(99)}")
        else:
            words[at] = f"other{r.randrange(99)}"
    return words


def test_recall_on_edited_copies():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)] + ["the", "of"] * 40
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 60)))) for i in range(60)]
    block = D.fit_items(items)
    assert block.trial_recall >= D.RECALL
    found = total = 0
    for i, text in items:
        words = text.split()
        for share in (0, 0.05, 0.1, 0.2):
            copy = edited(words, int(share * len(words)), r)
            noise = [r.choice(vocabulary) for _ in range(50)]
            doc = " ".join([*noise, *copy, *noise])
            want = slow_leaks(doc, [(i, text)])
            got = {block.ids[n]: e for n, e, _, _ in D.leaks_in([doc], block)[0]}
            total += len(want)
            found += want.keys() <= got.keys() and bool(want)
            for item, e in got.items():
                assert e >= slow_leaks(doc, items)[item]
    assert found / total >= 0.93


def long_and_short(r):
    vocabulary = [f"w{i}" for i in range(3000)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(400 if i < 4 else r.randint(15, 59)))) for i in range(150)]


def copies_found(block, items, r, copies):
    found = 0
    for i, text in items * copies:
        words = text.split()
        doc = " ".join([*["noise"] * 40, *edited(words, len(words) // 5, r), *["noise"] * 40])
        found += i in {block.ids[n] for n, _, _, _ in D.leaks_in([doc], block)[0]}
    return found / len(items) / copies


def test_long_items_among_short_ones_reach_the_recall_too():
    r = random.Random(5)
    items = long_and_short(r)
    block = D.fit_items(items)
    assert copies_found(block, items[:4], r, 10) >= 0.85
    assert min(block.class_recall.values()) >= D.RECALL and not block.exact
    assert block.rounds_of[400] > min(block.rounds_of.values())


def test_classes_that_sampling_does_not_reach_are_compared_exactly():
    r = random.Random(6)
    items = long_and_short(r)
    block = D.fit_items(items, max_rounds=2)
    assert min(block.class_recall.values()) < D.RECALL <= block.trial_recall and len(block.exact[400]) == 4
    assert copies_found(block, items[:20], r, 2) == 1


def test_items_in_blocks_and_odd_input(spark, odd_docs, no_docs):
    items = [(1, "three four five six seven eight"), (1, "three four five six seven eight"), (2, None), (3, ""), (4, "ten"), (None, "EIGHT nine, ten!"), (5, "not in there at all")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, edits string")
    want = sorted((d["doc_id"], i or 0, e) for d in odd_docs.collect() for i, t in items for i2, e in slow_leaks(d["text"], [(i, t)]).items() if d["doc_id"])
    for at_once in (2, 5000):
        got = D.find_leaks(odd_docs, benchmark, items_at_once=at_once).collect()
        assert sorted((r["doc_id"], r["item_id"] or 0, r["edits"]) for r in got if r["doc_id"]) == want
        left = D.drop_leaks(odd_docs, benchmark, items_at_once=at_once)
        assert left.columns == odd_docs.columns
        assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 1, 2, 3, 6, 7]
    assert D.find_leaks(no_docs, benchmark).count() == 0
    assert D.find_leaks(odd_docs, benchmark.limit(0)).count() == 0
    assert D.drop_leaks(odd_docs, benchmark.limit(0)).count() == 10


def test_pipeline_equals_its_operators_in_memory(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    table = spark.read.parquet(f"{SF01}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF01)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name.replace(' ', '-')}"
        table.write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
        out[name] = {r["doc_id"] for r in table.select("doc_id").collect()}
    # quality: the operator's own verdicts
    verdicts = quality.judge_quality(spark.read.parquet(f"{SF01}/documents.parquet"), labels).collect()
    assert out["quality rules"] == {r["doc_id"] for r in verdicts if r["kept"]}
    assert out["toxicity"] <= out["quality rules"] and len(out["toxicity"]) > 0.7 * len(out["quality rules"])
    # near duplicates: brute force over fingerprints; the smallest id of each group stays
    left = sorted(out["toxicity"])
    prints = [simhash.fingerprint(docs[d]) & (1 << 64) - 1 for d in left]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= simhash.RADIUS and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert out["simhash near-dedup"] == {left[i] for i in set(group)}
    # decontamination: no exact passage is left, and only documents with a leak went
    items = [tuple(r) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text").collect()]
    for d in out["simhash near-dedup"]:
        if any(t in docs[d] for _, t in items):
            assert d not in out["benchmark decontamination"]
    for d in out["simhash near-dedup"] - out["benchmark decontamination"]:
        assert slow_leaks(docs[d], items)
    # packing: all that is left, token by token
    rows = corpus_pipeline.STAGES[-1][1](spark, table, SF01).collect()
    import public_tokenizers

    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    held = {}
    for r in rows:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= r["sequence_tokens"] <= packing.CAPACITY
    assert held == {d: len(enc.encode(docs[d])) // 4 + 1 for d in out["benchmark decontamination"]}


def test_pipeline_run_and_odd_documents(spark, odd_docs, no_docs):
    assert corpus_pipeline.run(spark, SF001).count() > 0
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF001)
        docs.count()
