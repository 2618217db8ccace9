"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node of depth d stands for a distinct sequence of first d turns ``(role, text)``; the conversations that start with it
are its members, and its smallest member and depth name it.  The root (depth 0) has all conversations.

**Keys.**  A turn is the SHA-256 of role and text (its *step*).  The key of a prefix is a polynomial of its steps modulo
the prime 2**127 - 1, so the key of a prefix can be put together from keys of its parts: turns are dealt by ranges of
``(conv_id, order)``, each task computes the keys of its own range, and the driver, which sees one row per task, carries the
key of a conversation that runs over several tasks from one to the next.  No conversation has to fit a task.

**Totals.**  What a node sums over its subtree reaches it by time-forward processing: nodes are sorted by falling depth
(Spark's external sort), and each hands its totals to its parent through a priority queue, which writes sorted runs to the shared
folder when it holds more than ``QUEUE_ROWS`` messages.  The message is the child's finished row, so that the parent, when its
turn comes, also gives it the parent's name.

**Shards.**  The weight of a node is the number of turns of its members from its depth on.  Nodes over a weight limit are heavy;
the others form units, whole subtrees below heavy nodes, and units are dealt to the tasks (shards) by hash.  A popular
opening is heavy, so its subtree is spread over many shards.  Sums of the units' roots per heavy parent (an ordinary
aggregate) then enter one more time-forward pass over the heavy nodes alone: for each depth at most turns / limit of them.

Nulls and odd input: rows with a null conv_id belong to no conversation and are left out; null turns come first; null roles and
texts are empty; rows of one conversation and turn follow in the order of role and step; repeated rows are turns of their
own; an empty table gives no rows, not even a root; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import map_arrow, shared_filesystem, shuffle_partitions
from drainrules.session import materialize, scratch_path

PRIME = (1 << 127) - 1
BASE = 0x3F5A1C77E2B94D0683CA5512F09E7D4B  # any fixed number below the prime
QUEUE_ROWS = 200_000  # messages a queue holds in memory
LEAST_UNIT = 256  # units are not cut finer than this many turns
UNITS_PER_TASK = 4
BROADCAST_NODES = 50_000  # heavy nodes are broadcast up to this many
END_IDS = 8192  # conversation ids in a piece of a node's list of ends
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
ROOT_KEY = bytes(16)

STEPS = "conv_id long, pos int, n_steps int, step binary, words long"
NODES = (
    "conv_id long, depth int, key binary, parent_key binary, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, unit_root boolean"
)


# ---------------------------------------------------------------- steps
def _in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)


def turn_steps(conversations: DataFrame) -> DataFrame:
    """``STEPS`` of every conversation: its turns numbered from 1, and one row at 0 that stands for the conversation itself."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("step"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        )
        .withColumn("row", F.monotonically_increasing_id())  # equal rows, too, are dealt over ranges
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for c in batch.column(0).to_pylist():
                conv, n = c, n + 1 if c == conv else 1
                at.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int32()), batch.column(1), batch.column(2)],
                names=["conv_id", "part", "at", "step", "words"],
            )

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("step"), F.col("row")]
    dealt = _in_ranges(turns, order).select("conv_id", "step", "words")
    numbered = materialize(map_arrow(dealt, number, "conv_id long, part int, at int, step binary, words long"), "turns")
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()
    before, conv, n = [], None, 0
    for r in ends:  # one row per task
        carried = n if r["first"] == conv else 0
        if carried:
            before.append((r["part"], conv, carried))
        conv, n = r["last"]["conv_id"], r["last"]["at"] + (carried if r["last"]["conv_id"] == r["first"] else 0)
    offsets = numbered.sparkSession.createDataFrame(before, "part int, conv_id long, carried int")
    placed = numbered.join(F.broadcast(offsets), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("carried", F.lit(0))).alias("pos"), "step", "words"
    )
    lengths = placed.groupBy("conv_id").agg(F.max("pos").alias("n_steps"))
    return _with_starts(placed.join(lengths, "conv_id"), lengths)


def _with_starts(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    starts = lengths.select("conv_id", F.lit(0).alias("pos"), "n_steps", F.lit(None).cast("binary").alias("step"), F.lit(0).cast("long").alias("words"))
    return steps.select(*starts.columns).unionByName(starts)


def borrow_openings(steps: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on the opening of another one, as ``STEPS``.

    Conversation c begins with the first h turns of conversation ``c - c % every`` (all if it has fewer, none if it is not
    there), then come its own turns after its first h; h is the unsigned CRC-32 of its decimal id modulo ``most``.
    """
    steps = materialize(steps, "steps")
    lengths = steps.where("pos = 0").select("conv_id", F.col("n_steps").alias("n_own"))
    opening = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    wanted = lengths.select("conv_id", "n_own", opening.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("from_id"))
    lenders = steps.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(
        F.col("conv_id").alias("from_id"), "pos", "step", "words", F.col("n_steps").alias("n_from"))
    plan = (
        wanted.join(lenders.where("pos = 0").select("from_id", "n_from"), "from_id", "left")
        .withColumn("got", F.least("h", F.coalesce("n_from", F.lit(0))))
        .withColumn("n_steps", F.col("got") + F.greatest(F.lit(0), F.col("n_own") - F.col("h")))
    )
    plan = materialize(plan, "openings")
    borrowed = plan.join(lenders.where("pos > 0").drop("n_from"), "from_id").where("pos <= h").select("conv_id", "pos", "n_steps", "step", "words")
    own = steps.where("pos > 0").drop("n_steps").join(plan, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "n_steps", "step", "words")
    return _with_starts(borrowed.unionByName(own), plan.select("conv_id", "n_steps"))


# ---------------------------------------------------------------- prefix keys
def _bytes(key: int) -> bytes:
    return key.to_bytes(16, "big")


def prefix_keys(steps: DataFrame) -> DataFrame:
    """``(conv_id, depth, key, parent_key, words, n_steps)`` of every prefix of every conversation, the empty one included."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, key = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys, parents = [], []
            for c, step in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != conv:
                    conv, key = c, 0
                parents.append(None if step is None else _bytes(key))
                if step is not None:
                    key = (key * BASE + int.from_bytes(step[:16], "big") + 1) % PRIME
                keys.append(_bytes(key))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(keys), pa.int32()), batch.column(1), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column(4), batch.column(2)],
                names=["conv_id", "part", "depth", "key", "parent_key", "words", "n_steps"],
            )

    schema = "conv_id long, part int, depth int, key binary, parent_key binary, words long, n_steps int"
    dealt = _in_ranges(steps.select("conv_id", "pos", "n_steps", "step", "words"), [F.col("conv_id"), F.col("pos")])
    found = materialize(map_arrow(dealt, local, schema), "prefix-keys")
    ends = (
        found.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "key")).alias("last")).orderBy("part").collect()
    )
    carries, conv, key, depth = [], None, 0, 0
    for r in ends:  # one row per task
        last, mine = r["last"], int.from_bytes(r["last"]["key"], "big")
        if r["first"] == conv:
            carries.append((r["part"], conv, _bytes(key), depth))
            if last["conv_id"] == conv:
                mine = (key * pow(BASE, last["depth"] - depth, PRIME) + mine) % PRIME
        conv, key, depth = last["conv_id"], mine, last["depth"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys, parents = [], []
            for depth, key, parent, carried, after in zip(columns[1], columns[2], columns[3], columns[6], columns[7], strict=True):
                start, power = int.from_bytes(carried, "big"), pow(BASE, depth - after - 1, PRIME)
                parents.append(_bytes((start * power + int.from_bytes(parent, "big")) % PRIME))
                keys.append(_bytes((start * power * BASE + int.from_bytes(key, "big")) % PRIME))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column(4), batch.column(5)],
                names=["conv_id", "depth", "key", "parent_key", "words", "n_steps"],
            )

    if not carries:
        return found.drop("part")
    carried = F.broadcast(found.sparkSession.createDataFrame(carries, "part int, conv_id long, carried binary, after int"))
    put_together = map_arrow(found.join(carried, ["part", "conv_id"]).drop("part"), carry, schema.replace("part int, ", ""))
    return found.join(carried, ["part", "conv_id"], "left_anti").drop("part").unionByName(put_together)


# ---------------------------------------------------------------- time-forward processing
class SpillingQueue:
    """A priority queue of messages ``(address, row)`` that keeps at most ``limit`` of them in memory.

    The rest lies in sorted runs in ``folder`` (the shared one), read back block by block, and removed at the end.
    """

    BLOCK = 4096

    def __init__(self, folder: str, limit: int = QUEUE_ROWS):
        self.folder, self.limit = folder, limit
        self.heap: list[tuple] = []
        self.fronts: list[tuple] = []  # (first message of a run, run number, the rest of the run)
        self.files: list[str] = []
        self.n = 0

    def push(self, address: tuple, row: tuple) -> None:
        self.n += 1
        heapq.heappush(self.heap, (address, self.n, row))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        system, root = shared_filesystem(self.folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/run-{uuid.uuid4().hex}"
        with system.open_output_stream(path) as out:
            for i in range(0, len(self.heap), self.BLOCK):
                data = pickle.dumps(self.heap[i : i + self.BLOCK])
                out.write(struct.pack("<q", len(data)) + data)
        self.files.append(path)
        self.heap = []
        self._advance(len(self.files), self._read(path))

    def _read(self, path: str) -> Iterator[tuple]:
        system, _ = shared_filesystem(self.folder)
        with system.open_input_stream(path) as f:
            while head := f.read(8):
                yield from pickle.loads(f.read(struct.unpack("<q", head)[0]))

    def _advance(self, run: int, rest: Iterator[tuple]) -> None:
        first = next(rest, None)
        if first is not None:
            heapq.heappush(self.fronts, (first, run, rest))

    def take(self, address: tuple) -> Iterator[tuple]:
        """The rows sent to ``address``, which must not lie before any address taken earlier."""
        while True:
            run = bool(self.fronts) and (not self.heap or self.fronts[0][0] < self.heap[0])
            top = self.fronts[0][0] if run else self.heap[0] if self.heap else None
            if top is None or top[0] != address:
                return
            if run:
                _, number, rest = heapq.heappop(self.fronts)
                self._advance(number, rest)
            else:
                heapq.heappop(self.heap)
            yield top[2]

    def close(self) -> None:
        self.fronts = []
        if self.files:
            system, _ = shared_filesystem(self.folder)
            for path in self.files:
                system.delete_file(path)


def time_forward(nodes: Iterable[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Rows of ``NODES`` from nodes in order of falling depth, then key.

    A node is ``(conv_id, depth, key, parent_key, n_convs, words, unit_root, children, leaves, saved)``; the last three
    are sums of children that are not among the nodes.  Rows of unit roots have no parent's name yet.
    """
    for conv_id, depth, key, parent_key, n_convs, words, unit_root, children, leaves, saved in nodes:
        for child in queue.take((-depth, key)):
            children, leaves, saved = children + 1, leaves + child[7], saved + child[8]
            yield (*child[:4], conv_id, *child[5:])
        row = (conv_id, depth, key, parent_key, None, n_convs, children, leaves if children else 1, saved + (n_convs - 1) * words, unit_root)
        if unit_root:
            yield row
        else:
            queue.push((1 - depth, parent_key), row)


def _totals(nodes: DataFrame, queue_rows: int) -> DataFrame:
    """``NODES`` of nodes whose units lie whole in their partitions."""
    folder = scratch_path(nodes.sparkSession, "trie-queue")
    ordered = nodes.sortWithinPartitions(F.col("depth").desc(), "key").select(
        "conv_id", "depth", "key", "parent_key", "n_convs", "words", "unit_root", "children", "leaves", "saved")
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, held = SpillingQueue(folder, queue_rows), []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [()] * len(kinds)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        try:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for row in time_forward(rows, queue):
                held.append(row)
                if len(held) >= 10_000:
                    yield batch_of()
            yield batch_of()
        finally:
            queue.close()

    return map_arrow(ordered, run, NODES)


# ---------------------------------------------------------------- ends
def _end_digests(keys: DataFrame) -> DataFrame:
    """``(depth, key, ends_sha256)`` of the nodes at which conversations end.

    Ids are sorted over ranges, so a node at which a third of them ends is cut into many tasks; a digest is a
    chain, so its pieces (``END_IDS`` ids each) then pass one task, one after the other.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, rows = None, [], []

        def piece() -> None:
            if ids:
                rows.append((*node, ids[0], ",".join(map(str, ids)).encode()))
                ids.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            rows.clear()
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["depth", "key", "first", "ids"])

        for batch in batches:
            for depth, key, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, key) != node or len(ids) >= END_IDS:
                    piece()
                    node = (depth, key)
                ids.append(conv_id)
            yield batch_of()
        piece()
        yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, chain, rows = None, hashlib.sha256(), []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.string()), strict=True)], names=["depth", "key", "ends_sha256"])

        for batch in batches:
            for depth, key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, key) != node:
                    if node is not None:
                        rows.append((*node, chain.hexdigest()))
                    node, chain = (depth, key), hashlib.sha256(ids)
                else:
                    chain.update(b"," + ids)
            yield batch_of()
        if node is not None:
            rows.append((*node, chain.hexdigest()))
        yield batch_of()

    ends = keys.where("depth = n_steps").select("depth", "key", "conv_id")
    pieces = map_arrow(_in_ranges(ends, [F.col("depth"), F.col("key"), F.col("conv_id")]), cut, "depth int, key binary, first long, ids binary")
    dealt = pieces.repartition(shuffle_partitions(keys.sparkSession), "depth", "key").sortWithinPartitions("depth", "key", "first")
    return map_arrow(dealt.select("depth", "key", "ids"), digest, "depth int, key binary, ends_sha256 string")


# ---------------------------------------------------------------- the trie
def prefix_trie(steps: DataFrame, unit_turns: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``unit_turns`` is the weight over which a node is heavy (default: a part of all turns that gives each task several units).
    """
    spark = steps.sparkSession
    parts = shuffle_partitions(spark)
    keys = materialize(prefix_keys(steps), "trie-keys")
    # Each conversation has a prefix once at most, so rows are members; hot prefixes are combined before the shuffle.
    nodes = materialize(
        keys.groupBy("depth", "key").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"),
            F.first("parent_key").alias("parent_key"), F.sum(F.col("n_steps") - F.col("depth") + 1).alias("weight"),
        ),
        "trie-nodes",
    )
    limit = unit_turns or max(LEAST_UNIT, keys.count() // (UNITS_PER_TASK * parts))
    none = F.lit(0).cast("long")
    heavy = materialize(nodes.where(F.col("weight") > limit), "trie-heavy")
    small = heavy.count() <= BROADCAST_NODES
    bounded = F.broadcast if small else (lambda df: df)
    # The first prefix of a conversation that is not heavy is the root of its unit.
    units = (
        keys.join(bounded(heavy.select("depth", "key")), ["depth", "key"], "left_anti")
        .groupBy("conv_id").agg(F.min(F.struct("depth", "key")).alias("unit"))
    )
    light = nodes.where(F.col("weight") <= limit).join(units, "conv_id")
    dealt = (
        light.withColumn("unit_root", F.col("depth") == F.col("unit.depth"))
        .withColumns({"children": none, "leaves": none, "saved": none})
        .repartition(parts, F.col("unit.key"))
    )
    shards = materialize(_totals(dealt, queue_rows), "trie-shards")
    roots = shards.where("unit_root")
    sums = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = (
        heavy.join(sums, ["depth", "key"], "left")
        .withColumns({c: F.coalesce(F.col(c), none) for c in ("children", "leaves", "saved")})
        .withColumn("unit_root", F.col("depth") == 0)
    )
    parents = heavy.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    named = roots.join(bounded(parents), ["depth", "parent_key"], "left").withColumn("parent_conv_id", F.col("above")).drop("above")
    found = shards.where("not unit_root").unionByName(named).unionByName(_totals(top.repartition(1), queue_rows))
    return found.join(_end_digests(keys), ["depth", "key"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
