"""Prefix trie of conversations: against brute force on odd, hot and long conversations, however the work is cut."""

import hashlib
import random
import re
import zlib

import pytest

from drainrules.llm import prefix_trie as pt
from drainrules.llm import queries

SF001 = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string, key string"


def plain(rows):
    """``{conv_id: [(role, text), ...]}`` by the stated order."""
    step = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    found = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", step(r))):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def rebuilt(convs, every=20):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (c % every if c >= 0 else -(-c % every))
        out[c] = convs.get(lender, [])[:h] + own[h:]
    return out


def slow_trie(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=lambda n: -len(n)):
        below = [totals[k] for k in kids.get(node, ())]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        totals[node] = (sum(b[0] for b in below) if below else 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -(10**9), len(m), len(kids.get(n, ())), *totals[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, ())))).encode()).hexdigest())
        for n, m in members.items()
    )


def rows_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in df.select(*names).collect())


def made(seed, n=120):
    rng = random.Random(seed)
    texts = [None, "", "a b", "a  b", "c", "d e f\x0bg \x1c", "Ä ö", "x" * 3000]
    rows = []
    for c in range(-3, n):
        for t in range(rng.choice((1, 2, 3, 5))):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None)), texts[1] if t == 0 and c % 3 else rng.choice(texts), "x", "y"))
    rows += [(77, t, "user", f"turn {t % 7}", "x", "y") for t in range(400)]  # a very long one, and a copy of it that goes on
    rows += [(78, t, "user", f"turn {t % 7}", "x", "y") for t in range(410)]
    rows += [(500 + c, t, "user", "same", "x", "y") for c in range(60) for t in range(3)]  # copies
    rows += [(900, 1, "user", "again", "x", "y")] * 50  # repeated rows
    rows += [(None, 1, "user", "nobody", "x", "y"), (901, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit_turns, queue_rows", [(None, pt.QUEUE_ROWS), (40, 7), (5, 1), (10**9, 3)])
def test_against_brute_force(spark, unit_turns, queue_rows):
    rows = made(3)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    steps = pt.turn_steps(df)
    assert rows_of(pt.prefix_trie(steps, unit_turns, queue_rows)) == slow_trie(plain(rows))


def test_rebuilt_against_brute_force(spark):
    rows = made(4, 300)
    df = spark.createDataFrame(rows, TURNS)
    found = pt.prefix_trie(pt.borrow_openings(pt.turn_steps(df)), 30)
    assert rows_of(found) == slow_trie(rebuilt(plain(rows)))


def test_conversation_over_many_tasks(spark):
    """A conversation that fills most of the table is cut over tasks; its keys are put together."""
    rows = [(5, t, "user", f"turn {t}", "x", "y") for t in range(3000)] + [(9, t, "user", f"turn {t}", "x", "y") for t in range(2000)]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    steps = pt.turn_steps(df)
    parts = steps.where("pos > 0").groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in parts} == {5: 3000, 9: 2000}
    keys = pt.prefix_keys(steps)
    assert keys.select("depth", "key").distinct().count() == 3001
    found = {(r["conv_id"], r["depth"]): r for r in pt.prefix_trie(steps, 500, 10).collect()}
    assert len(found) == 3001 and found[5, 0]["n_convs"] == 2 and found[5, 0]["n_leaves"] == 1 and found[5, 0]["saved_tokens"] == 4000
    assert found[5, 2000]["ends_sha256"] == hashlib.sha256(b"9").hexdigest() and found[5, 2001]["n_convs"] == 1


def test_ends_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "END_IDS", 4)
    rows = [(c, 0, "user", "hi", "x", "y") for c in range(101)]
    found = pt.prefix_trie(pt.turn_steps(spark.createDataFrame(rows, TURNS)))
    ends = {r["depth"]: r["ends_sha256"] for r in found.collect()}
    assert ends == {0: pt.EMPTY_SHA256, 1: hashlib.sha256(",".join(map(str, range(101))).encode()).hexdigest()}


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert pt.prefix_trie(pt.borrow_openings(pt.turn_steps(none))).count() == 0
    assert pt.prefix_trie(pt.turn_steps(none)).count() == 0


def test_queue_spills_and_keeps_order(tmp_path):
    rng = random.Random(1)
    sent = [((rng.randrange(40), bytes([rng.randrange(3)])), (i,)) for i in range(2000)]
    queue = pt.SpillingQueue(str(tmp_path / "runs"), limit=30)
    for address, row in sent:
        queue.push(address, row)
    assert len(queue.heap) <= 30 and queue.files
    for address in sorted({a for a, _ in sent}):
        assert sorted(queue.take(address)) == sorted(r for a, r in sent if a == address)
    queue.close()
    assert not list((tmp_path / "runs").iterdir())


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, SF001)) == slow_trie(rebuilt(plain(rows)))
