"""Re-Pair grammars over sequences of ids.

The most frequent pair of adjacent symbols is replaced by a nonterminal until no pair occurs twice. Pairs whose numbers
of occurrences lie between two powers of two are replaced together, the more frequent first where they overlap.

All occurrences of a pair arise when the younger of its symbols is made and can only be lost later. So each pair's
positions are listed once, lists are checked against the sequence when their turn comes, and a replacement costs time
for its own neighbours only.
"""

from __future__ import annotations

import numpy as np

_NEVER = np.iinfo(np.int32).max


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes starts[i] to starts[i] + counts[i] - 1, for all i in a row."""
    shift = (starts - (np.cumsum(counts) - counts)).astype(np.int32)
    return np.arange(int(counts.sum()), dtype=np.int32) + np.repeat(shift, counts)


class _Pairs:
    """A sequence as a linked list, with the positions of its repeated pairs by power of two of their number."""

    def __init__(self, ids: np.ndarray, first: int, least: int):
        n = self.n = len(ids)
        self.first, self.least = first, least
        self.sym = np.full(n + 2, -1, np.int32)  # the last two stand beyond both ends
        self.sym[:n] = ids
        self.next = np.arange(1, n + 3, dtype=np.int32)
        self.back = np.arange(-1, n + 1, dtype=np.int32)
        self.next[n:], self.back[0] = n, n + 1
        self.order = np.full(n + 2, _NEVER, np.int32)
        self.fresh = np.zeros(n + 2, bool)
        self.rules: list[np.ndarray] = []
        self.count = 0
        self.levels: list[list[tuple]] = [[] for _ in range(max(2, n.bit_length() + 1))]

    def listed(self, at: np.ndarray) -> int:
        """List the pairs that start at these positions; how many pairs occur often enough."""
        a, b = self.sym[at], self.sym[self.next[at]]
        width, deep = (self.first + self.count).bit_length(), self.n.bit_length()
        key = a.astype(np.uint64) << np.uint64(width) | b.astype(np.uint64)
        if 2 * width + deep <= 64:
            packed = key << np.uint64(deep) | at.astype(np.uint64)
            packed.sort()
            key, at = packed >> np.uint64(deep), (packed & np.uint64((1 << deep) - 1)).astype(np.int32)
        else:
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(key)))
        often = counts >= self.least
        key = key[starts[often]]
        pair = np.stack([key >> np.uint64(width), key & np.uint64((1 << width) - 1)], 1).astype(np.int32)
        self._file(at, starts[often], counts[often], counts[often], pair)
        return len(pair)

    def _file(self, at, starts, counts, times, pair) -> None:
        """File each list under the power of two of its number of occurrences."""
        if not len(starts):
            return
        level = np.frexp(times.astype(np.float64))[1] - 1
        for x in np.unique(level).tolist():
            own = level == x
            self.levels[x].append((at, starts[own], counts[own], pair[own]))

    def step(self, level: int) -> None:
        """Replace the pairs filed under a level that are still as frequent; file the others lower."""
        parts, self.levels[level] = self.levels[level], []
        pair = np.concatenate([p[3] for p in parts])
        counts = np.concatenate([p[2] for p in parts])
        at = np.concatenate([p[0][_ranges(p[1], p[2])] for p in parts])
        a, b = pair[:, 0], pair[:, 1]
        holds = (self.sym[at] == np.repeat(a, counts)) & (self.sym[self.next[at]] == np.repeat(b, counts))
        times = held = np.add.reduceat(holds, np.cumsum(counts) - counts, dtype=np.int64)
        at, which = at[holds], np.repeat(np.arange(len(pair)), held)
        odd = np.int32(0)
        if (a == b).any():  # in a run of one symbol every second occurrence goes first
            run = np.zeros(len(at), bool)
            run[1:] = (which[1:] == which[:-1]) & (self.next[at[:-1]] == at[1:])
            i = np.arange(len(at))
            odd = ((i - np.maximum.accumulate(np.where(run, 0, i))) & 1).astype(np.int32)
            times = np.bincount(which[odd == 0], minlength=len(pair))
        now = times >= max(self.least, 1 << level)
        later = (times >= self.least) & ~now
        starts = np.cumsum(held) - held
        self._file(at, starts[later], held[later], times[later], pair[later])
        if not now.any():
            return
        rank = np.full(len(pair), -1, np.int32)
        best = np.flatnonzero(now)
        rank[best[np.lexsort((b[best], a[best], -times[best]))]] = np.arange(len(best))
        mine = np.repeat(now, held)
        at, which = at[mine], which[mine]
        chosen = self._disjoint(at, 2 * rank[which] + (odd[mine] if odd.ndim else odd))
        at, which = at[chosen], which[chosen]
        used = np.bincount(which, minlength=len(pair)) >= 2
        keep = used[which]
        at, which = at[keep], which[keep]
        name = np.zeros(len(pair), np.int32)
        order = np.flatnonzero(used)
        order = order[np.argsort(rank[order])]
        name[order] = self.first + self.count + np.arange(len(order))
        self.rules.append(pair[order])
        self.count += len(order)
        self._replace(at, name[which])

    def _disjoint(self, at: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Indexes of a largest set of positions whose pairs don't overlap, lower orders first."""
        own, back, ahead = self.order, self.back[at], self.next[at]
        own[at] = order
        left, out = np.arange(len(at)), []
        while len(left):
            p, x, y = at[left], back[left], ahead[left]
            won = (own[p] < own[x]) & (own[p] < own[y])
            out.append(left[won])
            own[x[won]] = own[y[won]] = _NEVER
            own[p[won]] = _NEVER
            left = left[~won]
            left = left[own[at[left]] != _NEVER]
        return np.concatenate(out) if out else left

    def _replace(self, at: np.ndarray, name: np.ndarray) -> None:
        gone = self.next[at]
        after = self.next[gone]
        self.sym[at], self.sym[gone] = name, -1
        self.next[at], self.back[after] = after, at
        before = self.back[at]
        self.fresh[at] = True
        left = before[(self.sym[before] >= 0) & ~self.fresh[before]]
        right = at[self.sym[self.next[at]] >= 0]
        self.fresh[at] = False
        self.listed(np.concatenate([left, right]))

    def live(self) -> np.ndarray:
        return np.flatnonzero(self.sym[: self.n] >= 0).astype(np.int32)


def compress(ids: np.ndarray, first: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule r is the pair that symbol first + r stands for; ids are below first.

    Ends when no pair of symbols occurs ``least`` times (2 at least) without overlap.
    """
    least = max(2, least)
    pairs = _Pairs(ids, first, least)
    while True:
        at, before = pairs.live(), pairs.count
        if len(at) < 2 * least or not pairs.listed(at[:-1]):
            break
        for level in range(len(pairs.levels) - 1, 0, -1):
            while pairs.levels[level]:
                pairs.step(level)
        if pairs.count == before:
            break
    rules = np.concatenate(pairs.rules) if pairs.rules else np.empty((0, 2), np.int32)
    return rules.astype(np.int64), pairs.sym[pairs.live()].astype(np.int64)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to; a rule's parts come before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < first else out[a - first]) + (1 if b < first else out[b - first]))
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of the symbols' expansion. sizes are the rules' lengths.

    Nonterminals are replaced by their pairs, all at once, until none is left; what lies outside isn't followed.
    """
    size = lambda x: np.where(x < first, 1, sizes[np.maximum(x - first, 0)]) if len(sizes) else np.ones(len(x), np.int64)
    n = size(symbols)
    at = np.cumsum(n) - n - start
    stop = (int(n.sum()) if stop is None else stop) - start
    out = np.zeros(max(0, stop), np.int64)
    while len(symbols):
        inside = (at < stop) & (at + n > 0)
        symbols, at = symbols[inside], at[inside]
        done = symbols < first
        out[at[done]] = symbols[done]
        left, at = symbols[~done] - first, at[~done]
        a, b = rules[left, 0], rules[left, 1]
        at = np.concatenate([at, at + size(a)])
        symbols = np.concatenate([a, b])
        n = size(symbols)
    return out
