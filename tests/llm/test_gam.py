"""Quality classifier: tables against plain sums, planted interactions, held-out accuracy, odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drainrules.llm import gam, queries

SF01 = "/root/testdata/sf0.01"


def slow_features(text):
    words = text.encode().split()
    if not words:
        return [0.0] * len(gam.FEATURES)
    chars = [bytes([b]) for b in text.encode() if b not in b" \t\n\x0b\x0c\r"]
    share = lambda of, n: sum(c in of for c in chars) / n
    letters = sum(c.isalpha() for c in chars) + sum(c[0] > 127 for c in chars) / 2
    upper = sum(c.isupper() for c in chars) + sum(t in "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ" for t in text)
    n, lines = len(words), [line for line in text.encode().split(b"\n") if line.split()]
    ones = lambda s: [bytes([b]) for b in s]
    return [
        np.log(n + 1), len(chars) / n, np.log(1 + max(map(len, words))), upper / max(1, letters), share(ones(b"0123456789"), len(chars)),
        share(ones(b"#*$%&|<>"), n), share(ones(b"!?"), n), share(ones(b".,;:"), n), share(ones(b"\"'()[]{}/\\=+-_~^@`"), n),
        share(ones(range(128, 256)), len(chars)), share(ones([*range(9), *range(14, 32), 127]), len(chars)), len(set(words)) / n,
        sum(words[i] == words[i + 1] for i in range(n - 1)) / n, len({(words[i], words[i + 1]) for i in range(n - 1)}) / max(1, n - 1),
        len(set(lines)) / len(lines), np.log(1 + n / len(lines)), sum(w.isalpha() for w in words) / n,
    ]


@pytest.mark.parametrize("text", ["", " \n\t", "a", "One two, two! ÄÖ é | *** x1 \x01\x7f\n\none\none\n (q) 'z' ?", "ab " * 500, "漢字 \x1c b"])
def test_features(text):
    assert gam.text_features(text) == pytest.approx(slow_features(text))


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.zeros(n)], axis=1)
    part = rng.integers(0, 5, n)
    return x, part, rng


def test_score_is_a_sum_of_table_entries():
    x, part, rng = made(2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] + 2 * (x[:, 0] * x[:, 1] > 0))))).astype(float)
    model = gam.fit_gam(x, y, part, cycles=40, pairs=2)
    assert model.planes
    score = model.score(x)
    for r in range(0, 2000, 131):
        z = model.bias
        at = [sum(v >= e for e in model.edges[f]) for f, v in enumerate(x[r])]
        for f, b in enumerate(at):
            z += model.lines[f][b]
        for (i, j), table in model.planes.items():
            z += table[model.coarse[i][at[i]], model.coarse[j][at[j]]]
        assert score[r] == pytest.approx(1 / (1 + np.exp(-z)))


def test_interactions_are_found():
    x, part, rng = made(6000, 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing that one feature alone could tell
    new, _, _ = made(2000, 2)
    want = (new[:, 0] > 0) ^ (new[:, 1] > 0)
    alone = gam.fit_gam(x, y, part, pairs=0).score(new) > 0.5
    both = gam.fit_gam(x, y, part, pairs=1)
    assert (alone == want).mean() < 0.6 and list(both.planes) == [(0, 1)] and ((both.score(new) > 0.5) == want).mean() > 0.9


def test_line_tree_finds_the_best_cut():
    rng = np.random.default_rng(5)
    for _ in range(20):
        g, h, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(0, 30, 9).astype(float)
        got = gam.line_tree(g, h, n, leaves=2)
        options = [(0.0, np.full(9, -g.sum() / (h.sum() + gam.RIDGE)))]
        for c in range(1, 9):
            if min(n[:c].sum(), n[c:].sum()) >= gam.LEAST_ROWS:
                left, right = (g[:c].sum(), h[:c].sum()), (g[c:].sum(), h[c:].sum())
                gain = sum(a * a / (b + gam.RIDGE) for a, b in (left, right)) - g.sum() ** 2 / (h.sum() + gam.RIDGE)
                options.append((gain, np.concatenate([np.full(c, -left[0] / (left[1] + gam.RIDGE)), np.full(9 - c, -right[0] / (right[1] + gam.RIDGE))])))
        assert got == pytest.approx(max(options, key=lambda o: o[0])[1])


def test_plane_tree_finds_the_best_cuts():
    rng = np.random.default_rng(6)
    g, h, n = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1, np.full((4, 5), 9.0)
    score = lambda a, b: a.sum() ** 2 / (b.sum() + gam.RIDGE)
    best = 0.0
    for tg, th in ((g, h), (g.T, h.T)):
        for c in range(1, tg.shape[0]):
            total = -score(g, h)
            for rows in (slice(0, c), slice(c, None)):
                total += max(score(tg[rows, :k], th[rows, :k]) + score(tg[rows, k:], th[rows, k:]) for k in range(1, tg.shape[1]))
            best = max(best, total)
    gain, steps = gam.plane_tree(g, h, n)
    assert gain == pytest.approx(best) and steps.shape == g.shape and len(np.unique(steps)) <= 4


def test_held_out_accuracy_and_labels_unseen(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, SF01).collect()}
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(held) > 40
    assert np.mean([r["predicted"] for q, r in held if q == 1]) > 0.97 and np.mean([r["predicted"] for q, r in held if q == 0]) < 0.3
    spoilt = labels.withColumn("quality", F.when(gam.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = gam.score_quality(docs, gam.fit_quality_gam(docs, spoilt)).collect()
    assert all(r["score"] == pytest.approx(rows[r["doc_id"]]["score"]) for r in again)


def test_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (None, 1), (5, 1), (1, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        model = gam.fit_quality_gam(odd_docs, some)
        rows = gam.score_quality(odd_docs, model).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
        assert gam.score_quality(no_docs, model).count() == 0
    assert {r["score"] for r in rows} == {0.5}
    assert gam.score_quality(odd_docs, gam.fit_quality_gam(no_docs, labels)).count() == 10


def test_one_id_on_many_rows_is_one_training_row(spark):
    docs = spark.range(500).selectExpr("CASE WHEN id < 400 THEN 3 ELSE id END AS doc_id", "concat('word', id, ' and more words') AS text")
    labels = spark.range(500).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    model = gam.fit_quality_gam(docs, labels, max_train=50)
    assert gam.score_quality(docs, model).count() == 500
