"""Deep-shallow sorting of strings of equal length.

All strings are first sorted by multikey quicksort to a shallow depth. Its characters are words of eight bytes; each
group is partitioned three ways by a pivot, and the part that equals the pivot goes on with the next word; the groups of
one round are partitioned at once. Groups that are still equal at the shallow depth have long common prefixes: each is
put in order by a blind trie, a Patricia trie of branching depths and bytes only. A string goes down it by its branching
bytes alone, is compared with the one leaf it reaches, and so finds where it differs from all of the group.
"""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 4


class BlindTrie:
    """Strings of n bytes, given as big-endian integers beside their bytes."""

    def __init__(self, n: int):
        self._n = n
        self._root: list | None = None  # a leaf: [-1, ids, bytes, int]; a branch: [depth, {byte: child}]

    def insert(self, i: int, s: bytes, value: int) -> None:
        if self._root is None:
            self._root = [-1, [i], s, value]
            return
        node = self._root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        lcp = self._n - ((node[3] ^ value).bit_length() + 7) // 8
        if lcp == self._n:
            node[1].append(i)
            return
        leaf, above, at = node, None, self._root
        while 0 <= at[0] < lcp:
            above, at = at, at[1][s[at[0]]]
        new = [-1, [i], s, value]
        if at[0] == lcp:
            at[1][s[lcp]] = new
            return
        branch = [lcp, {leaf[2][lcp]: at, s[lcp]: new}]
        if above is None:
            self._root = branch
        else:
            above[1][s[above[0]]] = branch

    def in_order(self) -> list[int]:
        out: list[int] = []
        stack = [self._root] if self._root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of keys within each group, groups ascending; a number for each run of equal rows, in order)."""
    n, depths = keys.shape
    order = np.argsort(group, kind="stable")
    first = np.ones(n, bool)
    first[1:] = group[order][1:] != group[order][:-1]
    depth = np.zeros(n, np.int64)
    while True:
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        open_ = (size > 1) & (depth[start] < depths)
        start, size = start[open_], size[open_]
        if not len(start):
            return order, np.cumsum(first)
        part = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(part)) + np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size)
        key = keys[order[at], depth[at]]
        a, b, c = (keys[order[x], depth[x]] for x in (start, start + size // 2, start + size - 1))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = part * 3 + (key >= pivot) + (key > pivot)
        by = np.argsort(side, kind="stable")
        order[at], side = order[at][by], side[by]
        depth[at] += side % 3 == 1
        first[at] = np.append(True, side[1:] != side[:-1])


def deep_shallow_sort(group: np.ndarray, strings: np.ndarray, shallow_words: int = SHALLOW_WORDS) -> np.ndarray:
    """The order of the rows of strings (uint8, rows of equal length) within each group, groups ascending."""
    n, width = strings.shape
    if n < 2:
        return np.arange(n)
    words = min(shallow_words, -(-width // 8))
    shallow = np.zeros((n, 8 * words), np.uint8)
    shallow[:, : min(width, 8 * words)] = strings[:, : 8 * words]
    order, label = multikey_quicksort(group, shallow.view(">u8").astype(np.uint64))
    first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    for a, b in zip(first.tolist(), np.append(first[1:], n).tolist()):
        if b - a > 1 and width > 8 * shallow_words:
            trie = BlindTrie(width)
            for i in order[a:b].tolist():
                s = strings[i].tobytes()
                trie.insert(i, s, int.from_bytes(s, "big"))
            order[a:b] = trie.in_order()
    return order


def neighbour_lcp(group: np.ndarray, strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it in the order; -1 for the first of a group."""
    out = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 1 << 16):
        here, before = order[a : a + (1 << 16)], order[a - 1 : a - 1 + len(order[a : a + (1 << 16)])]
        differ = strings[here] != strings[before]
        lcp = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
        out[a : a + len(here)] = np.where(group[here] == group[before], lcp, -1)
    return out
