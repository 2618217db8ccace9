"""SimHash near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from drainrules import session
from drainrules.llm import components, queries, simhash
from drainrules.llm.components import connected_components

SF001 = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint_equals_spark_and_brute_force(spark):
    for text in ("", "  ", "One", "one TWO", "a b c", "A b c d e f g É ü", "x " * 50 + "y z\n\n w"):
        assert unsigned(simhash.fingerprint(text)) == slow_fingerprint(text)
    assert unsigned(simhash.fingerprint("one two three")) == unsigned(spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    near = np.concatenate([base, *[base ^ np.int64(1 << int(rng.integers(63))) ^ np.int64(1 << int(rng.integers(63))) for _ in range(3)]])
    got = simhash.within_radius(near[:100], near, radius)
    want = np.array([[bin(unsigned(int(a)) ^ unsigned(int(b))).count("1") <= radius for b in near] for a in near[:100]])
    assert (got == want).all()
    far = np.array([0, -1], dtype=np.int64)
    assert simhash.within_radius(far[:1], far[1:], radius) is None


@pytest.mark.parametrize("chunk_rows", [4, 4096])
def test_components_equal_brute_force(spark, chunk_rows):
    rnd = random.Random(chunk_rows)
    prints = []
    for _ in range(40):
        p = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):  # chains
            prints.append(p)
            for _ in range(rnd.randint(0, 3)):
                p ^= 1 << rnd.randrange(64)
    prints += [0x1234 ^ (1 << b) for b in range(64)]  # one large bucket around a centre that is not there
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    ids = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["doc_id"] for r in simhash.fingerprint_components(ids, chunk_rows=chunk_rows).collect()}
    roots = slow_components(prints)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert got == {p: least[r] for p, r in zip(signed, roots, strict=True)}


def test_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    rnd = random.Random(1)
    rnd.shuffle(edges)
    roots = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(7, 60), 7), 3: 3}


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in queries.op10_simhash(spark, SF001).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    prints = [slow_fingerprint(t) for _, t in docs]
    roots = slow_components(prints)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, docs[i][0])
    for (doc_id, _), p, r in zip(docs, prints, roots, strict=True):
        assert rows[doc_id]["fingerprint"] == f"{p:016x}" and rows[doc_id]["component_id"] == least[r]


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in simhash.simhash_duplicates(odd_docs).collect()]
    zero = [r for r in rows if r[1] == 0]
    assert sorted((r[0] or -1, r[2]) for r in zero) == [(-1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(r[2] for r in rows if r[0] in (4, 5)) == [4, 4, 4]
    assert len(rows) == 10 and sum(r[0] is None and r[2] is None for r in rows) == 1
    assert simhash.simhash_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    left = simhash.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 1, 4, 6, 7]
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "some text of a few words", 7, 8), (2, "some text of a few words", 9, 10)], "doc_id long, text string, __fp int, __fp_ int")
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "some text of a few words", 7, 8)]


def test_small_tables_have_few_files(spark, monkeypatch):
    files = {}

    def written(module):
        def keep(df, name, put=module.materialize):
            table = put(df, name)
            files.setdefault(name, []).append(len(table.inputFiles()))
            return table

        monkeypatch.setattr(module, "materialize", keep)

    written(simhash)
    written(components)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(150)]
    docs = spark.createDataFrame([(2 * i + k, t + " end" * k) for i, t in enumerate(texts) for k in range(2)], "doc_id long, text string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = simhash.simhash_duplicates(docs)
        assert found.rdd.getNumPartitions() == 1
        rows = {r["doc_id"]: (r["fp"], r["component_id"]) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files["simhash-prints"] == files["simhash-links"] == [1] and set(files["labels"]) == {1}
    prints = [rows[i][0] for i in range(300)]
    roots, least = slow_components([unsigned(p) for p in prints]), {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert [rows[i][1] for i in range(300)] == [least[r] for r in roots] and len(least) < 300


def test_large_tables_keep_their_partitions(spark):
    assert session.few_files(spark.range(0, 100, 1, 10), 9 * session.FILE_ROWS + 1).rdd.getNumPartitions() == 10
    assert session.few_files(spark.range(0, 100, 1, 10), 2 * session.FILE_ROWS).rdd.getNumPartitions() == 2
    assert session.few_files(spark.range(0, 100, 1, 10), 0).rdd.getNumPartitions() == 1
