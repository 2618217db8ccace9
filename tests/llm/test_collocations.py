"""Collocations: against brute force, whichever way a phrase is counted; the trie against a plain set."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from drainrules.llm import collocations as co
from drainrules.llm import queries

SF001 = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, phrase string, n string"


def slow(rows, least=10, top=2000):
    counts, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if any(100 * found.get(q, 0) >= 50 * a for q in found if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "ÄB", "ä", "x\x1cy", "n/a", "z" * 300, "'s"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = "".join(words[min(int(rng.expovariate(0.15)), len(words) - 1)] + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(rng.randrange(120)))
        rows.append((i, text + " new york city. " * rng.randrange(3) + "a a a a", rng.choice(["en", "de", None, "und"]), "x", "y"))
    rows += [(100, None, "en", "x", "y"), (101, "", "en", "x", "y"), (102, "...", "xx", "x", "y"), (None, "the cat sat " * 4000, "en", "x", "y")]
    return rows + rows[:5]


def result(df):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize(
    "parameters",
    [{}, {"trie_phrases": 3}, {"vocabulary": 12}, {"vocabulary": 1, "trie_phrases": 1}, {"sample_words": 50, "top": 7}],
)
def test_against_brute_force(spark, parameters):
    rows = made(2)
    want = slow(rows, top=parameters.get("top", 2000))
    assert len(want) > 20
    assert result(co.mine_collocations(spark.createDataFrame(rows, ROWS).repartition(4), **parameters)) == want


def test_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(co, "ROW_IDS", 50)
    monkeypatch.setattr(co, "HELD", 64)
    rows = made(5)
    assert result(co.mine_collocations(spark.createDataFrame(rows, ROWS), trie_phrases=10)) == slow(rows)


def test_empty_table(spark):
    assert co.mine_collocations(spark.createDataFrame([], ROWS)).count() == 0


def test_huge_counts_stay_exact(spark):
    big = 3_000_000_000_000
    candidates = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, k int, a long")
    counts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 7)], "lang string, phrase string, f long")
    row = co._scored(candidates, counts).first()
    assert row["score"] == 1000000 * big * big // ((big + 1) * (big + 7)) == 999999


@pytest.mark.parametrize("k", [2, 3])
def test_trie_accepts_its_phrases_and_no_other(k):
    rng = np.random.default_rng(k)
    n_words = 300
    phrases = np.unique(np.minimum(rng.zipf(1.3, (4000, k)) - 1, n_words - 1), axis=0)
    trie = co.DoubleArrayTrie(phrases, n_words)
    known = set(map(tuple, phrases.tolist()))
    ids = np.minimum(rng.zipf(1.3, 20000) - 1, n_words - 1)
    ids[rng.random(len(ids)) < 0.05] = -1
    states = trie.run(ids)
    for i, s in enumerate(states.tolist()):
        phrase = tuple(ids[i : i + k].tolist())
        assert (s >= 0) == (phrase in known)
        if s >= 0:
            key = 0
            for w in phrase:
                key = key << co.WORD_BITS | w
            assert trie.keys[s] == key
    assert len(trie.check) < 20 * len(phrases) + 4 * n_words


def test_bitmap(spark):
    values = [0, 1, 32767, 32768, 5_000_000, co.BITMAP_SIZE - 1]
    bits = co._collect_bitmap(spark.createDataFrame([(v,) for v in values], "h long"))
    found = co._has(bits, np.arange(co.BITMAP_SIZE))
    assert np.flatnonzero(found).tolist() == values


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert result(queries.op13_collocations(spark, SF001)) == slow(rows)
