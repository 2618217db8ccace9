"""Quality rules and toxicity: counts against brute force, forests and chains on planted cases, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from drainrules.llm import quality, queries, toxicity

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize(
    "text",
    ["", " \n ", "a", "a b c d e a b c d e", "a a a a a a a", "x\nx\n x\nx\n\n\n", "## é\x0b漢 <b>\x1cz|", "a b c d e f a b c d e f a b c d e " * 9],
)
def test_counts(text):
    assert quality.rule_counts(text)[:5] == slow_counts(text)


def test_query_counts_and_base_rules(spark):
    rows = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d["doc_id"]], slow_counts(d["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_forest_rejects_bad_and_keeps_good(spark):
    rows = queries.op3_quality_rules(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def slow_path(tree, row):
    feature, value, left, right, depth, _ = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] if row[feature[node]] < value[node] else right[node]
    return depth[node]


def test_forest_scores_are_those_of_single_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    x[:, 2] = 0
    x[7] += 9
    forest = quality.fit_forest(x, trees=30, rows_per_tree=64)
    score, _ = forest.judge(x)
    c = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    for i in range(0, 400, 37):
        assert score[i] == pytest.approx(2 ** (-np.mean([slow_path(t, x[i]) for t in forest.trees]) / c))
    assert score.argmax() == 7


def test_quality_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (None, 1)], "doc_id long, quality int")
    rows = quality.judge_quality(odd_docs, labels).collect()
    assert sorted((r["doc_id"] or -1) for r in rows if r["kept"]) == [-1, 4, 4, 5]
    assert len(rows) == 10
    left = quality.keep_good(odd_docs, labels)
    assert left.columns == odd_docs.columns and left.count() == 4
    assert quality.judge_quality(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels).count() == 0
    assert quality.judge_quality(odd_docs, labels.limit(0)).where("kept").count() == 4


def planted(n):
    rng = np.random.default_rng(n)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic = i % 5 == 0
        if toxic:
            words[3:5] = rng.choice(["vile", "nasty", "hateful"], 2)
        rows.append((i, " ".join(words), int(i % 7 != 0), int(toxic)))
    return rows


def test_chain_on_planted_words(spark):
    rows = planted(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = df.where("doc_id < 300").select("doc_id", "quality", "toxic")
    chain = toxicity.fit_toxicity(df, labels, queries.toxicity_categories(), "toxic")
    found = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(df, chain).collect()}
    assert all(found[i] == bool(t) for i, _, _, t in rows if i >= 300)
    left = toxicity.keep_nontoxic(df.withColumn("toxic", F.lit("clash")), chain)
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, _, _, t in rows if not t]


def test_out_of_fold_probabilities_do_not_see_their_row():
    rng = np.random.default_rng(2)
    x = np.eye(60, dtype=np.float32)  # a word of its own for each row: only memory could tell
    y = rng.integers(0, 2, (60, 2)).astype(float)
    _, inner = toxicity.fit_chain(x, y, np.arange(60) % 5, penalty=0.01)
    assert abs(np.corrcoef(inner[:, 0], y[:, 0])[0, 1]) < 0.6 and inner[:, 0].std() < 0.2


def test_logistic_matches_gradient_zero():
    rng = np.random.default_rng(4)
    x = (rng.random((300, 12)) < 0.3).astype(np.float32)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=12))))).astype(float)
    w = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(x.T @ (p - y) + toxicity.PENALTY * w[1:]).max() < 1e-2


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    chain = toxicity.fit_toxicity(docs, labels.where(~part), queries.toxicity_categories(), "toxic")
    rows = toxicity.score_toxicity(docs, chain).withColumnRenamed("toxic", "found").join(labels.where(part), "doc_id").collect()
    clean = [r["found"] for r in rows if r["toxic"] == 0]
    toxic = [r["found"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.05 and np.mean(toxic) > 0.6


def test_toxicity_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        chain = toxicity.fit_toxicity(odd_docs, some, queries.toxicity_categories(), "toxic")
        assert toxicity.score_toxicity(odd_docs, chain).where("not toxic").count() == 10
        assert toxicity.keep_nontoxic(odd_docs, chain).columns == odd_docs.columns
        assert toxicity.score_toxicity(no_docs, chain).count() == 0
    assert toxicity.score_toxicity(odd_docs, toxicity.fit_toxicity(no_docs, labels, queries.toxicity_categories(), "toxic")).count() == 10


@pytest.mark.parametrize("one_id", ["1", "2", "3", "4", "7", "CAST(null AS long)", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END"])
def test_hash_sample_of_repeated_ids_is_full(spark, one_id):
    from drainrules.llm.common import hash_sample

    df = spark.range(3000).selectExpr(f"{one_id} AS doc_id", "id AS n")
    assert hash_sample(df, 100, F.xxhash64("doc_id", F.lit(11)), "n").count() == 100
    assert hash_sample(df, 5000, F.xxhash64("doc_id"), "n").count() == 3000
    assert hash_sample(df.limit(0), 100, F.xxhash64("doc_id"), "n").count() == 0


def test_quality_of_documents_that_share_an_id(spark):
    texts = [" ".join(f"word{(i * j) % 97}" for j in range(1, 40)) for i in range(300)] + ["### $$$ *** " * 20 + " ".join(f"a{j}" for j in range(60))] * 3
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    rows = quality.judge_quality(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int"), trees=20, rows_per_tree=16).collect()
    assert len(rows) == 303 and len({r["score"] for r in rows}) > 3


def test_one_id_on_many_rows_trains_once(spark, monkeypatch):
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, y, fold, penalty: (seen.append(len(x)), fit(x, y, fold, penalty))[1])
    rows = planted(400)
    docs = spark.createDataFrame([(i if i < 200 else 5, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 200], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_toxicity(docs, labels, queries.toxicity_categories(), "toxic", max_train=150)
    assert seen == [150] and toxicity.score_toxicity(docs, chain).count() == 400
