"""Runs of a sequence of numbers by the tandem-repeat method of Gusfield and Stoye.

1. Lempel-Ziv blocks: each is the longest piece that also starts further left. A square whose occurrence is leftmost
   lies over a border of blocks, so extensions to both sides of the borders give squares that cover, for each kind
   of square, its leftmost occurrence.
2. These are put on the edges of the suffix tree where their text ends. From each, a walk by suffix links turns the square
   by one place at a time (aw aw to wa wa) until that isn't in the text or was seen: then all kinds of squares are on the tree.
3. The leaves below a kind are its occurrences. Occurrences at neighbouring places with one period are one run.

Only squares of primitive roots are followed, so a run has its smallest period, and occurrences are O(n log n). The suffix
tree comes from suffix ranks by doubling: ranks[k] are equal where 2**k numbers are, so they also answer, exactly, how
far two places agree to the right and to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Suffixes:
    """ranks[k][i] for the 2**k numbers from i on (those over the end are alone); order and rank of the suffixes; lcp[x] of order[x - 1] and order[x]."""

    text: np.ndarray
    ranks: list[np.ndarray]
    order: np.ndarray
    lcp: np.ndarray

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and j on agree, i being unequal to j; both up to the text's length."""
        i, j, at = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += same
            j += same
        return i - at

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers up to i and j, themselves included, agree, i being unequal to j; -1 is before the first."""
        i, j, at = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            held = (a >= 0) & (b >= 0)
            same = (held & (self.ranks[k][np.where(held, a, 0)] == self.ranks[k][np.where(held, b, 0)])).astype(np.int64) << k
            i -= same
            j -= same
        return at - i


def suffixes(text: np.ndarray) -> Suffixes:
    n = len(text)
    values, now = np.unique(text, return_inverse=True)
    # one more entry, which equals no other
    ranks = [np.append(now, -1).astype(np.int32)]
    many = len(values)
    while many < n:
        step = 1 << (len(ranks) - 1)
        later = np.zeros(n, np.int64)
        later[: n - step] = now[step:] + 1
        values, now = np.unique(now * np.int64(n + 1) + later, return_inverse=True)
        many = len(values)
        ranks.append(np.append(now, -1).astype(np.int32))
    order = np.empty(n, np.int64)
    order[now] = np.arange(n)
    out = Suffixes(text, ranks, order, np.zeros(n, np.int64))
    if n > 1:
        out.lcp[1:] = out.right(order[:-1], order[1:])
    return out


def blocks(s: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the text's length."""
    n = len(s.order)
    order, rank = s.order.tolist(), s.ranks[-1].tolist()
    # suffixes leave a list in sorted order from the last place on, so those beside one are those that start further left
    before, after = list(range(-1, n)), list(range(1, n + 2))
    common = s.lcp.tolist() + [0, 0]
    longest = [0] * n
    for i in range(n - 1, -1, -1):
        x = rank[i]
        p, q = before[x], after[x]
        a, b = common[x], common[q] if q < n else 0
        longest[i] = a if a > b else b
        if q < n:
            common[q] = a if a < b else b
            before[q] = p
        if p >= 0:
            after[p] = q
    found, i = [], 0
    while i < n:
        found.append(i)
        i += longest[i] or 1
    return np.array([*found, n], np.int64)


def _each(low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... counts[i] numbers of each."""
    return np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)


def covering(s: Suffixes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares of primitive roots that cover the leftmost occurrence of each kind; begin: from blocks."""
    n, text = len(s.text), s.text
    if len(begin) < 3:
        return begin[:0], begin[:0]
    h, h1 = begin[:-1], begin[1:]
    size = h1 - h
    starts, periods = [], []
    # squares that are centred in a block and reach into the next
    some = h1 < n
    k = _each(np.ones(some.sum(), np.int64), size[some])
    to = np.repeat(h1[some], size[some])
    use = text[to] == text[to - k]
    k, to = k[use], to[use]
    q = to - k
    ahead, back = s.right(to, q), s.left(to - 1, q - 1)
    good = ahead + back >= k
    starts.append(np.maximum(q - back, q - k + 1)[good])
    periods.append(k[good])
    # squares that begin left of a block and are centred in it
    both = size + np.append(size[1:], 0)
    both = np.minimum(both, n - 1 - h)
    some = (h > 0) & (both > 0)
    k = _each(np.ones(some.sum(), np.int64), both[some])
    at, stop = np.repeat(h[some], both[some]), np.repeat(h1[some], both[some])
    use = text[at] == text[at + k]
    k, at, stop = k[use], at[use], stop[use]
    ahead, back = s.right(at, at + k), s.left(at - 1, at + k - 1)
    start = np.maximum(at - back, at - k + 1)
    good = (ahead + back >= k) & (back > 0) & (start + k <= stop)
    starts.append(start[good])
    periods.append(k[good])
    start, period = np.concatenate(starts), np.concatenate(periods)
    pairs = np.unique(start * np.int64(n + 1) + period)
    start, period = pairs // (n + 1), pairs % (n + 1)
    whole = primitive(s, start, period)
    return start[whole], period[whole]


def primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the roots of squares aren't powers."""
    if not len(period):
        return np.zeros(0, bool)
    least = np.arange(int(period.max()) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            some = least[p * p :: p]
            some[some == np.arange(p * p, len(least), p)] = p
    out, rest = np.ones(len(period), bool), period.copy()
    while True:
        i = np.flatnonzero(out & (rest > 1))
        if not len(i):
            return out
        p = least[rest[i]]
        d = period[i] // p
        out[i] = s.right(start[i], start[i] + d) < 2 * period[i] - d
        rest[i] //= p


class Tree:
    """The suffix tree: nodes 0 to n - 1 are the suffixes by place, the others inner ones, `top` the root."""

    def __init__(self, s: Suffixes):
        n, lcp, order = len(s.order), s.lcp.tolist(), s.order.tolist()
        self.n = n
        depth, low, high, inner = [0], [0], [n - 1], [0] * n  # of inner nodes; inner[x]: the one that divides order[x - 1] from order[x]
        parent = [0] * n
        up = [-1]
        stack = [0]
        last = order[0]
        for x in range(1, n + 1):
            common = lcp[x] if x < n else 0
            child, left = last, x - 1
            is_leaf = True
            while depth[stack[-1]] > common:
                v = stack.pop()
                high[v] = x - 1
                if is_leaf:
                    parent[child] = n + v
                else:
                    up[child] = n + v
                child, left, is_leaf = v, low[v], False
            v = stack[-1]
            if depth[v] < common:
                v = len(depth)
                depth.append(common)
                low.append(left)
                high.append(-1)
                up.append(-1)
                stack.append(v)
            if is_leaf:
                parent[child] = n + v
            else:
                up[child] = n + v
            if x < n:
                inner[x] = v
                last = order[x]
        self.top = n
        self.parent = np.array(parent + up)
        self.depth = np.concatenate([n - np.arange(n), np.array(depth)])
        rank = s.ranks[-1][:n].astype(np.int64)
        self.low = np.concatenate([rank, np.array(low)])
        self.high = np.concatenate([rank, np.array(high)])
        # the leftmost place below each node, and the inner nodes' suffix links, by range minima
        self.least = np.concatenate([np.arange(n), s.order[_range_min(s.order, np.array(low), np.array(high))]])
        self.link = np.full(len(self.depth), self.top)
        cut = np.full(len(depth), -1)
        cut[inner[1:]] = np.arange(1, n)
        v = np.flatnonzero((cut > 0) & (np.array(depth) > 0))
        if len(v):
            a, b = rank[s.order[cut[v] - 1] + 1], rank[s.order[cut[v]] + 1]
            self.link[n + v] = n + np.array(inner)[_range_min(s.lcp, a + 1, b)]
        nodes = np.flatnonzero(self.parent >= 0)
        over = self.parent[nodes]
        word = s.text[s.order[self.low[nodes]] + self.depth[over]]
        self.child = dict(zip(zip(over.tolist(), word.tolist(), strict=True), nodes.tolist(), strict=True))


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the leftmost least value from a to b, both included, is."""
    table = [np.arange(len(values))]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        x, y = table[-1][:-step], table[-1][step:]
        table.append(np.where(values[y] < values[x], y, x))
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level):
        i = level == k
        x, y = table[k][a[i]], table[k][b[i] - (1 << int(k)) + 1]
        out[i] = np.where(values[y] < values[x], y, x)
    return out


def vocabulary(s: Suffixes, t: Tree, start: np.ndarray, period: np.ndarray) -> list[tuple[int, int]]:
    """node below which, and period with which, each kind of square of a primitive root occurs; start, period: from covering."""
    parent, depth, least, link, child, text = t.parent.tolist(), t.depth.tolist(), t.least.tolist(), t.link.tolist(), t.child, s.text.tolist()
    top = t.top
    seen: set[tuple[int, int]] = set()
    placed: list[tuple[int, int]] = []
    order = np.lexsort((-period, start))
    node, place = -1, -1
    for i, k in zip(start[order].tolist(), period[order].tolist(), strict=True):
        if i != place:
            node = place = i
        while node != top and least[node] == i and depth[parent[node]] >= 2 * k:
            node = parent[node]
        if least[node] == i and (node, k) not in seen:  # else it occurs further left, where another one covers it
            seen.add((node, k))
            placed.append((node, k))
    for v, k in placed:
        while True:
            i, u, goal = least[v], parent[v], 2 * k - 1
            a = text[i]
            x = link[u] if u != top else top
            y = x
            while depth[y] < goal:
                x, y = y, child[y, text[i + 1 + depth[y]]]
            if depth[y] == goal:
                y = child.get((y, a), -1)
                if y < 0:
                    break
            elif text[least[y] + goal] != a:
                break
            v = y
            if (v, k) in seen:
                break
            seen.add((v, k))
    return list(seen)


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period (the smallest) of all runs of at least two periods, by start and period."""
    none = np.zeros(0, np.int64)
    if len(text) < 2:
        return none, none, none
    text = np.asarray(text, np.int64)
    s = suffixes(np.append(text, text.max() + 1))  # an end that occurs once, so that no suffix begins another
    start, period = covering(s, blocks(s))
    if not len(start):
        return none, none, none
    t = Tree(s)
    kinds = vocabulary(s, t, start, period)
    node, k = np.array([v for v, _ in kinds]), np.array([k for _, k in kinds])
    many = t.high[node] - t.low[node] + 1
    at, k = s.order[_each(t.low[node], many)], np.repeat(k, many)
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    new = np.append(True, (np.diff(k) != 0) | (np.diff(at) != 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, period = at[first], k[first]
    length = at[last] - start + 2 * period
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]
