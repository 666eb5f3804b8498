"""Hierarchical index over 128-bit fingerprints in Gray order, for joins within a Hamming distance.

Fingerprints sorted by Gray rank (their position in the reflected Gray sequence) have neighbours that share many bits.
Runs of FAN neighbours are factored into a node that holds the bits on which all of them agree (mask and pattern); FAN
nodes make a node of the next level, and so on. Two nodes can be compared on the bits that both hold: the differences
found there count for all pairs below. Going down, each level adds the differences on bits that it newly holds, and a
pair of groups is left as soon as the sum is above the radius.

`forest` is that index over a table of rows that carry a key besides: the masked pattern of the topmost nodes, on which no
difference is allowed. All trees of a batch are built and descended together, level by level, from their roots; there is no
other way to a pair, however small a tree is. `join` is the same between two sets of fingerprints."""

from __future__ import annotations

from collections import Counter

import numpy as np

BITS = 128
FAN = 8
#: Pairs of nodes that are opened at once.
OPEN = 8192
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
U1 = np.uint64(1)
Words = tuple[np.ndarray, np.ndarray]


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> Words:
    """Position of each codeword in the Gray sequence (its prefix XOR), as two words."""
    hi, lo = hi.copy(), lo.copy()
    for s in (1, 2, 4, 8, 16, 32):
        hi ^= hi >> np.uint64(s)
        lo ^= lo >> np.uint64(s)
    return hi, lo ^ (np.uint64(0) - (hi & U1))


def gray_code(hi: np.ndarray, lo: np.ndarray) -> Words:
    """The codeword at each position."""
    return hi ^ (hi >> U1), lo ^ ((lo >> U1) | ((hi & U1) << np.uint64(63)))


def levels(hi: np.ndarray, lo: np.ndarray, height: int) -> list[tuple[np.ndarray, ...]]:
    """Nodes by level, the fingerprints first: (pattern hi, lo, mask hi, lo). hi, lo: in Gray order."""
    full = np.full(len(hi), ONES)
    out = [(hi, lo, full, full)]
    for _ in range(height):
        hi, lo, mhi, mlo = out[-1]
        first = np.arange(0, len(hi), FAN)
        own = np.repeat(first, np.diff(np.append(first, len(hi))))
        same_hi = np.bitwise_and.reduceat(mhi & mhi[own] & ~(hi ^ hi[own]), first)
        same_lo = np.bitwise_and.reduceat(mlo & mlo[own] & ~(lo ^ lo[own]), first)
        out.append((hi[first], lo[first], same_hi, same_lo))
    return out


def _differences(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, seen: Words) -> tuple[np.ndarray, Words]:
    """Differences on bits that both nodes hold and that were not compared above; all bits compared so far."""
    hi, lo = a[2][i] & b[2][j], a[3][i] & b[3][j]
    d = np.bitwise_count((a[0][i] ^ b[0][j]) & hi & ~seen[0]).astype(np.int16) + np.bitwise_count((a[1][i] ^ b[1][j]) & lo & ~seen[1])
    return d, (hi, lo)


def join(a: Words, b: Words | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all fingerprints of a and b within the radius; b None: of a with itself, i < j. Both in Gray order."""
    own = b is None
    n = max(len(a[0]), 0 if own else len(b[0]))
    height = 0
    while n > FAN:
        n, height = -(-n // FAN), height + 1
    ta = levels(*a, height)
    tb = ta if own else levels(*b, height)
    i, j = np.meshgrid(np.arange(len(ta[-1][0])), np.arange(len(tb[-1][0])), indexing="ij")
    i, j = i.ravel(), j.ravel()
    if own:
        i, j = i[i <= j], j[i <= j]
    none = np.zeros(len(i), np.uint64)
    d, seen = _differences(ta[-1], i, tb[-1], j, (none, none))
    stack = [(height, i, j, d, seen)]
    found = []
    steps = np.arange(FAN)
    while stack:
        level, i, j, d, seen = stack.pop()
        ok = d <= radius
        if own:
            ok &= (i < j) if level == 0 else (i <= j)
        i, j, d, seen = i[ok], j[ok], d[ok], (seen[0][ok], seen[1][ok])
        if level == 0:
            found.append((i, j))
            continue
        for at in range(0, len(i), OPEN):
            part = slice(at, at + OPEN)
            ci = (i[part, None, None] * FAN + steps[None, :, None]).repeat(FAN, 2).ravel()
            cj = (j[part, None, None] * FAN + steps[None, None, :]).repeat(FAN, 1).ravel()
            above = np.arange(at, min(at + OPEN, len(i))).repeat(FAN * FAN)
            ok = (ci < len(ta[level - 1][0])) & (cj < len(tb[level - 1][0]))
            if own:
                ok &= ci <= cj
            ci, cj, above = ci[ok], cj[ok], above[ok]
            more, now = _differences(ta[level - 1], ci, tb[level - 1], cj, (seen[0][above], seen[1][above]))
            total = d[above] + more
            keep = total <= radius
            stack.append((level - 1, ci[keep], cj[keep], total[keep], (now[0][keep], now[1][keep])))
    return np.concatenate([x for x, _ in found]) if found else np.empty(0, int), np.concatenate([y for _, y in found]) if found else np.empty(0, int)


def _grow(tree: np.ndarray, nodes: tuple[np.ndarray, ...], loose: int | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The next level: runs of at most FAN nodes of a tree, which end too where neighbours differ on more than `loose` bits. (first child of each, its tree, its bits)"""
    hi, lo, mhi, mlo = nodes
    new = np.append(True, tree[1:] != tree[:-1])
    if loose is not None:
        new[1:] |= np.bitwise_count(hi[1:] ^ hi[:-1]) + np.bitwise_count(lo[1:] ^ lo[:-1]) > loose
    run = np.flatnonzero(new)
    place = np.arange(len(tree)) - np.repeat(run, np.diff(np.append(run, len(tree))))
    begin = np.flatnonzero(place % FAN == 0)
    own = np.repeat(begin, np.diff(np.append(begin, len(tree))))
    same_hi = np.bitwise_and.reduceat(mhi & mhi[own] & ~(hi ^ hi[own]), begin)
    same_lo = np.bitwise_and.reduceat(mlo & mlo[own] & ~(lo ^ lo[own]), begin)
    return begin, tree[begin], (hi[begin], lo[begin], same_hi, same_lo)


def forest(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int, seen_groups: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs of rows of a tree within the radius. tree: of each row; rows are sorted by tree and Gray rank.

    The lowest groups are runs of rows that differ little from their neighbours, so that they hold many bits. seen_groups counts
    `groups`, pairs of groups that were met, `left`, those of them that their accumulated differences excluded before any pair of rows
    below was looked at, and `pairs`, pairs of rows that were compared."""
    count = Counter() if seen_groups is None else seen_groups
    if not len(tree):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    full = np.full(len(hi), ONES)
    levels = [(None, (hi, lo, full, full))]
    loose: int | None = min(radius, BITS // 5)
    while True:
        begin, tree, nodes = _grow(tree, levels[-1][1], loose)
        levels.append((np.append(begin, len(levels[-1][1][0])), nodes))
        if loose is None and (tree[1:] != tree[:-1]).all():
            break
        loose = None
    i = j = np.arange(len(tree))
    d, seen = np.zeros(len(i), np.int16), (nodes[2], nodes[3])
    steps = np.arange(FAN)
    for top in range(len(levels) - 1, 0, -1):
        cuts, below, leaves = levels[top][0], levels[top - 1][1], top == 1
        out: list[tuple] = []
        for at in range(0, len(i), OPEN):
            x, y = i[at : at + OPEN], j[at : at + OPEN]
            ci, cj = cuts[x][:, None, None] + steps[:, None], cuts[y][:, None, None] + steps
            ok = (ci < cuts[x + 1][:, None, None]) & (cj < cuts[y + 1][:, None, None]) & ((ci < cj) if leaves else (ci <= cj))
            which, p, q = np.nonzero(ok)
            ci, cj, above = ci[which, p, 0], cj[which, 0, q], which + at
            more, now = _differences(below, ci, below, cj, (seen[0][above], seen[1][above]))
            total = d[above] + more
            keep = total <= radius
            count["pairs" if leaves else "groups"] += len(ci)
            count["left"] += 0 if leaves else len(ci) - int(keep.sum())
            out.append((ci[keep], cj[keep], total[keep].astype(np.int16), now[0][keep], now[1][keep]))
        i, j, d, hi, lo = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (i[:0], j[:0], d[:0], seen[0][:0], seen[1][:0])
        seen = (hi, lo)
    return i, j
