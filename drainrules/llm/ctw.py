"""Context-tree weighting over bytes: counts of contexts in, one table of log probabilities out.

A byte is eight binary decisions down a tree of 255 nodes.  For each node there is a context tree over
the preceding bytes, of depth ``depth``: a context's Krichevsky-Trofimov estimate is mixed
half and half with the product of its children (one per earlier byte), from the deepest contexts up
to the empty one.  The predictive probability weighs all depths on the path of a position by
their share in that mixture.

Two forms:

* the whole tree, for any input: only nodes that some byte passes are held, as sorted keys (``leaf_nodes``, ``climb``,
  ``descend``), and the levels below one context are weighed apart from all others.  Where a node was not
  met in a context, its weight stays with the longest context that met it;
* a table for one process (``weigh``): contexts with at least ``share`` of all counted bytes are expanded, what falls into
  the others is pooled in one leaf under their parent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

START = END = b"\xff"  # no byte of UTF-8: stands before and after a text
CHUNK = 1024  # contexts weighed at once
_HALF = np.log(0.5)


def gram_codes(texts: list[bytes], depth: int) -> np.ndarray:
    """Codes of all bytes (and ends) of some texts, each under its ``depth`` bytes before: the byte itself is lowest."""
    joined = b"".join(START * depth + t + END for t in texts)
    ends = np.cumsum([depth + len(t) + 1 for t in texts])
    counted = np.ones(len(joined), dtype=bool)
    starts = np.concatenate(([0], ends[:-1]))
    for j in range(depth):
        counted[starts + j] = False
    joined += bytes(7)
    eight = np.ndarray(len(counted) - depth, dtype="<u8", buffer=joined, strides=(1,))  # from each byte on
    codes = eight[counted[depth:]].byteswap(inplace=True)
    codes >>= np.uint64(8 * (7 - depth))
    return codes


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2), by Stirling's series after a shift by 8."""
    x = n + 0.5
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_factorial(n: np.ndarray) -> np.ndarray:
    """log n!"""
    y = n + 9.0
    product = np.ones_like(y)
    for k in range(1, 9):
        product *= n + k
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def node_counts(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(contexts, 255)`` zeros and ones of the binary nodes, breadth first, of ``(contexts, 256)`` byte counts."""
    zeros, ones = [], []
    for level in range(8):
        halves = byte_counts.reshape(len(byte_counts), 1 << level, 2, 128 >> level).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def _estimate(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log KT probability of the counts, and KT's next probability of a one, by node."""
    a, b = node_counts(byte_counts)
    a, b = a.astype(float), b.astype(float)
    log_p = log_gamma_half(a) + log_gamma_half(b) - np.log(np.pi) - log_factorial(a + b)
    return log_p, (b + 0.5) / (a + b + 1)


def byte_log10(ones: np.ndarray) -> np.ndarray:
    """``(contexts, 256)`` log10 probabilities of bytes from their nodes' probabilities of a one."""
    out = np.zeros((len(ones), 1))
    at = 0
    for level in range(8):
        p = ones[:, at : at + (1 << level)]
        at += 1 << level
        out = np.stack((out + np.log10(1 - p), out + np.log10(p)), axis=2).reshape(len(ones), 2 << level)
    return out


@dataclass
class Tree:
    """``contexts[d]``: sorted codes of the expanded contexts of d bytes; ``rows[d]``: their first row of ``table``."""

    depth: int
    contexts: list[np.ndarray]
    rows: list[int]
    table: np.ndarray

    def children(self) -> np.ndarray:
        """``(rows, 256)``: the row of a context that goes one byte further back, or -1."""
        if not hasattr(self, "_children"):
            out = np.full(self.table.shape, -1, dtype=np.int32)
            for d in range(1, self.depth + 1):
                codes = self.contexts[d]
                parent = np.searchsorted(self.contexts[d - 1], codes & np.uint64((1 << 8 * (d - 1)) - 1))
                oldest = (codes >> np.uint64(8 * (d - 1))).astype(np.int64)
                out[self.rows[d - 1] + parent, oldest] = self.rows[d] + np.arange(len(codes), dtype=np.int32)
            self._children = out.reshape(-1)
        return self._children

    def log10_probability(self, data: bytes) -> float:
        """log10 probability of the bytes and the end, each after the bytes before it."""
        d, child = self.depth, self.children()
        b = np.frombuffer(START * d + data + END, dtype=np.uint8).astype(np.int32)
        now = b[d:]
        row = child[b[d - 1 : -1]] if d else np.zeros(len(now), dtype=np.int32)
        live = np.flatnonzero(row >= 0)
        row[row < 0] = 0
        for k in range(2, d + 1):
            further = child[(row[live] << 8) + b[d - k + live]]
            hit = further >= 0
            live = live[hit]
            row[live] = further[hit]
        return float(self.table.reshape(-1)[(row << 8) + now].sum(dtype=np.float64))


def _children_sum(at: np.ndarray, values: np.ndarray, parents: int) -> np.ndarray:
    """Rows of ``values`` summed by parent."""
    out = np.zeros((parents, values.shape[1]), dtype=values.dtype)
    np.add.at(out, at, values)
    return out


def weigh(levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The tree of ``(sorted context codes, (contexts, 256) byte counts)`` per depth, the empty context first.

    A code holds the latest byte lowest, so a context's parent is its code without the highest byte.  Contexts are taken
    ``CHUNK`` at a time: beside the counts and the result only each node's share of its own estimate is held.
    """
    deepest = len(levels) - 1
    parent = [None] + [np.searchsorted(levels[d - 1][0], levels[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, deepest + 1)]

    def expanded(d: int) -> np.ndarray | None:
        """Counts in the children of each context of a depth."""
        if d == deepest or not len(levels[d + 1][0]):
            return None
        return _children_sum(parent[d + 1], levels[d + 1][1], len(levels[d][0]))

    def below(d: int, rows: slice, inside: np.ndarray | None, has: np.ndarray) -> np.ndarray:
        """Counts of the contexts that are not expanded: those of the context itself where no child is."""
        counts = levels[d][1][rows].astype(float)
        return counts if inside is None else counts - np.where(has[rows, None], inside[rows], 0)

    shares: list[np.ndarray] = [np.zeros((len(c), 255), dtype=np.float32) for c, _ in levels]  # of a node's own estimate
    parents: list[np.ndarray] = [np.zeros(len(c), dtype=bool) for c, _ in levels]
    weighted = np.zeros((0, 255))
    for d in range(deepest, -1, -1):
        n = len(levels[d][0])
        product, inside = None, expanded(d)
        if inside is not None:
            parents[d][parent[d + 1]] = True
            product = _children_sum(parent[d + 1], weighted, n)
        weighted = np.zeros((n, 255))
        for first in range(0, n, CHUNK):
            rows = slice(first, first + CHUNK)
            log_e, _ = _estimate(levels[d][1][rows])
            weighted[rows] = log_e
            if product is not None:
                log_other, _ = _estimate(below(d, rows, inside, parents[d]))
                has = parents[d][rows, None]
                weighted[rows] = np.where(has, _HALF + np.logaddexp(log_e, product[rows] + log_other), log_e)
                shares[d][rows] = np.where(has, np.exp(np.minimum(0, _HALF + log_e - weighted[rows])), 0)
    total = sum(len(c) for c, _ in levels)
    table, starts, start = np.zeros((total, 256), dtype=np.float32), [], 0
    fixed, free = np.zeros((1, 255), dtype=np.float32), np.ones((1, 255), dtype=np.float32)
    for d in range(deepest + 1):
        if d:
            fixed, free = fixed[parent[d]], free[parent[d]]
        inside = expanded(d)
        for first in range(0, len(levels[d][0]), CHUNK):
            rows = slice(first, first + CHUNK)
            _, kt = _estimate(levels[d][1][rows])
            _, rest = _estimate(below(d, rows, inside, parents[d]))
            mine = fixed[rows] + free[rows] * shares[d][rows] * kt
            left = free[rows] * (1 - shares[d][rows])
            table[start + first : start + first + len(kt)] = byte_log10(mine + left * rest)
            fixed[rows], free[rows] = mine, left
        starts.append(start)
        start += len(levels[d][0])
    return Tree(deepest, [c for c, _ in levels], starts, table)


_SMALL = 1 << 12
_SMALL_HALF, _SMALL_FACTORIAL = log_gamma_half(np.arange(_SMALL)), log_factorial(np.arange(_SMALL))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log KT probability of some zeros and ones."""
    total = zeros + ones
    if (big := np.flatnonzero(total >= _SMALL)).size:
        small = np.minimum(total, _SMALL - 1)
        out = _SMALL_HALF[np.minimum(zeros, small)] + _SMALL_HALF[np.minimum(ones, small)] - _SMALL_FACTORIAL[small]
        out[big] = log_gamma_half(zeros[big]) + log_gamma_half(ones[big]) - log_factorial(total[big])
    else:
        out = _SMALL_HALF[zeros] + _SMALL_HALF[ones] - _SMALL_FACTORIAL[total]
    return out - np.log(np.pi)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal neighbours, and the group of each place."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


@dataclass
class Level:
    """Binary nodes of contexts of one depth; a key is a context's code with the node (from 1, breadth first) as lowest byte."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    share: np.ndarray  # of a node's own estimate in its mixture
    parent: np.ndarray  # place of the same node in the next shorter context


def leaf_nodes(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, zeros, ones)`` of the nodes on the paths of bytes (sorted codes and counts), and ``(8, codes)`` places of each path."""
    byte = codes & 255
    parts, places, start = [], [], 0
    for level in range(8):
        keys = codes - byte + (1 << level) + (byte >> (8 - level))
        first, group = _groups(keys)
        total, ones = np.add.reduceat(n, first), np.add.reduceat(n * (byte >> (7 - level) & 1), first)
        parts.append((keys[first], total - ones, ones))
        places.append(group + start)
        start += len(first)
    return *(np.concatenate(p) for p in zip(*parts, strict=True)), np.stack(places)


def climb(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray | None, deepest: int, shortest: int) -> tuple[list[Level], tuple[np.ndarray, ...]]:
    """Levels from depth ``deepest`` to ``shortest``, and ``(keys, zeros, ones, product)`` of the depth before that.

    ``product`` is the log of the product of the nodes' weighted children; None where contexts end.
    """
    levels = []
    for d in range(deepest, shortest - 1, -1):
        own = log_kt(zeros, ones)
        weighted = own if product is None else _HALF + np.logaddexp(own, product)
        share = np.exp(np.minimum(0, _HALF + own - weighted)) if product is not None else np.ones(len(own))
        above = keys & ((1 << 8 * d) - 1) if d else keys
        order = np.argsort(above, kind="stable")
        first, group = _groups(above[order])
        parent = np.empty(len(order), dtype=np.int64)
        parent[order] = group
        levels.append(Level(keys, zeros, ones, share, parent))
        keys, zeros, ones, product = above[order[first]], *(np.add.reduceat(v[order], first) for v in (zeros, ones, weighted))
    return levels, (keys, zeros, ones, product)


def descend(levels: list[Level], fixed: np.ndarray, free: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures at the deepest of the levels, from those of the depth before the shortest.

    A one has probability ``fixed + free * last``: what shorter contexts fixed, the weight they left, the estimate of the longest.
    """
    for level in reversed(levels):
        fixed, free, last = fixed[level.parent], free[level.parent], last[level.parent]
        total = level.zeros + level.ones
        kt = (level.ones + 0.5) / (total + 1)
        met = total > 0
        fixed = np.where(met, fixed + free * level.share * kt, fixed)
        free = np.where(met, free * (1 - level.share), free)
        last = np.where(met, kt, last)
    return fixed, free, last


def path_log10(codes: np.ndarray, places: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probabilities of the bytes of codes from their nodes' probabilities of a one."""
    byte = codes & 255
    out = np.zeros(len(codes))
    for level in range(8):
        p = one[places[level]]
        out += np.log10(np.where(byte >> (7 - level) & 1, p, 1 - p))
    return out
