"""Suffix sorting by induction with capped common-prefix values, through disk-backed queues.

The string is a numpy array of small symbols. Suffixes are of type S or L; S suffixes right after an L suffix (S*) are sorted first: an
induction over unsorted S* suffixes sorts their substrings, these are named, and the string of names is ranked in turn.
Inducing all L suffixes upwards and all S suffixes downwards then only moves tuples (place, common prefix with the tuple before)
through a queue whose priority is the first symbol; within a symbol tuples leave in the order they came. The queue keeps a
bounded part in memory and the rest in files. A tuple's common prefix is one more than the least common prefix between its two sources.

Order and prefixes are exact up to `depth` symbols, which is all that a search for repeats of that length needs.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

import numpy as np

#: Bytes of tuples that a queue keeps in memory.
QUEUE_BYTES = 64 << 20


class SymbolQueue:
    """Tuples by symbol, first in first out within a symbol; over `limit` bytes they wait in one file for each symbol."""

    def __init__(self, limit: int | None = None):
        self.limit = QUEUE_BYTES if limit is None else limit
        self.held, self.parts, self.folder, self.spilled = 0, {}, None, set()

    def push(self, symbol: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((places, prefixes))
        self.held += places.nbytes + prefixes.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp(prefix="queue-")
        for symbol, parts in self.parts.items():
            for k, name in enumerate(("places", "prefixes")):
                with open(os.path.join(self.folder, f"{symbol}.{name}"), "ab") as out:
                    for part in parts:
                        out.write(part[k].tobytes())
            self.spilled.add(symbol)
        self.parts, self.held = {}, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.parts.pop(symbol, [])
        self.held -= sum(p.nbytes + q.nbytes for p, q in parts)
        places, prefixes = [p for p, _ in parts], [q for _, q in parts]
        if symbol in self.spilled:
            self.spilled.discard(symbol)
            for kind, into, name in ((np.int32, places, "places"), (np.uint8, prefixes, "prefixes")):
                at = os.path.join(self.folder, f"{symbol}.{name}")
                into.insert(0, np.fromfile(at, kind))
                os.remove(at)
        if not places:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return (places[0], prefixes[0]) if len(places) == 1 else (np.concatenate(places), np.concatenate(prefixes))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, True)


def _between(prefixes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least prefix in each range left + 1 .. right, by a table of powers of two."""
    size = right - left
    level = np.zeros(len(size), np.int64)
    table, out, span, k = prefixes, np.empty(len(size), np.uint8), 1, 0
    level = np.frexp(size.astype(np.float64))[1] - 1
    top = int(level.max(initial=0))
    while True:
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[left[own] + 1], table[right[own] - span + 1])
        if k == top:
            return out
        table = np.minimum(table[:-span], table[span:])
        span, k = span * 2, k + 1


class _Induction:
    def __init__(self, t: np.ndarray, depth: int):
        n = len(t)
        self.t, self.n, self.depth = t, n, depth
        change = np.flatnonzero(t[1:] != t[:-1])
        ends = np.r_[change, n - 1]
        self.run = (np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n) + 1).astype(np.int32)
        after = np.minimum(np.arange(n) + self.run, n - 1)
        self.small = t < t[after]  # type S
        self.small[n - 1] = True
        star = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.star = star.astype(np.int32)
        self.symbols = np.unique(t).tolist()

    def _send(self, queue: SymbolQueue, places, prefixes, wanted, carry: bool) -> None:
        """Pushes the predecessors of the scanned places that `wanted` marks, by their symbols."""
        at = np.flatnonzero(wanted)
        if not len(at):
            return
        before = places[at] - 1
        symbol = self.t[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        new = np.ones(len(at), np.uint8)
        if carry:
            follow = np.ones(len(at), bool)
            follow[cuts] = False
            k = np.flatnonzero(follow)
            if len(k):
                new[k] = np.minimum(_between(prefixes, at[k - 1], at[k]), self.depth - 1) + 1
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            queue.push(int(symbol[a]), before[a:b], new[a:b])

    def _runs(self, places, prefixes, symbol: int, carry: bool):
        """A symbol's tuples and all that follow from them within the symbol, round by round."""
        all_places, all_prefixes, k = [], [], 0
        while len(places):
            if k:
                prefixes[0] = min(k, self.depth)
            else:
                prefixes[0] = 0
            all_places.append(places)
            all_prefixes.append(prefixes)
            at = np.flatnonzero((places > 0) & (self.t[places - 1] == symbol))
            if not len(at):
                break
            new = np.ones(len(at), np.uint8)
            if carry and len(at) > 1:
                new[1:] = np.minimum(_between(prefixes, at[:-1], at[1:]), self.depth - 1) + 1
            places, prefixes, k = places[at] - 1, new, k + 1
        if not all_places:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate(all_places), np.concatenate(all_prefixes)

    def induce(self, stars: np.ndarray, prefixes: np.ndarray | None, emit: Callable[[np.ndarray, np.ndarray, int], None]) -> None:
        """From S* suffixes in ascending order (with prefixes, or None) to all suffixes: emit gets each symbol's suffixes in
        descending order with the prefix to the one before and the number of S suffixes, which come first."""
        carry = prefixes is not None
        if prefixes is None:
            prefixes = np.zeros(len(stars), np.uint8)
        heads = self.t[stars]
        queue, kept = SymbolQueue(), SymbolQueue()
        try:
            for c in self.symbols:
                places, lcp = self._runs(*queue.pop(c), c, carry)
                a, b = np.searchsorted(heads, [c, c + 1])
                own, own_lcp = stars[a:b], prefixes[a:b].copy()
                if len(own):
                    own_lcp[0] = min(self.run[places[-1]], self.run[own[0]], self.depth) if len(places) else 0
                if len(places):
                    kept.push(c, places, lcp)
                scanned, lcp = np.concatenate([places, own]), np.concatenate([lcp, own_lcp])
                before = self.t[scanned - 1]
                self._send(queue, scanned, lcp, (scanned > 0) & (before > c), carry)
            for c in reversed(self.symbols):
                places, lcp = self._runs(*queue.pop(c), c, carry)
                if c == self.t[self.n - 1] and self.n - 1 not in places[-1:]:
                    places, lcp = np.r_[places, np.int32(self.n - 1)], np.r_[lcp, np.uint8(0)]
                up, up_lcp = kept.pop(c)
                down, down_lcp = up[::-1], np.zeros(len(up), np.uint8)
                if len(up):
                    down_lcp[1:] = up_lcp[1:][::-1]
                    down_lcp[0] = min(self.run[places[-1]], self.run[down[0]], self.depth) if len(places) else 0
                scanned, scanned_lcp = np.concatenate([places, down]), np.concatenate([lcp, down_lcp])
                emit(scanned, scanned_lcp, len(places))
                before = self.t[scanned - 1]
                self._send(queue, scanned, scanned_lcp, (scanned > 0) & (before < c), carry)
        finally:
            queue.close()
            kept.close()


def _equal_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, capped at depth; four symbols of 16 bits are compared at once."""
    padded = np.concatenate([t, np.zeros(depth + 8, t.dtype)]).astype("<u2")
    four = np.ndarray((len(padded) - 3,), "<u8", padded, strides=(2,))
    out, live, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live) and done < depth:
        differ = four[a[live] + done] ^ four[b[live] + done]
        low = differ & (~differ + np.uint64(1))
        k = np.where(differ == 0, 4, (np.frexp(low.astype(np.float64))[1] - 1) // 16)
        out[live] += k
        live, done = live[k == 4], done + 4
    return np.minimum(out, depth)


def _ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, as far as `depth` names tell: by doubling the names that a rank stands for, over
    the suffixes that still share a rank. A rank is the place of its group's first suffix."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    key, span = names[order], 1
    live = order
    base = np.zeros(n, np.int64)  # the place that each live suffix's group begins at
    while len(live):
        new = np.r_[True, (key[1:] != key[:-1]) | (base[1:] != base[:-1])]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(live)])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        offset = at - first[np.searchsorted(first, at, side="right") - 1]
        rank[live] = (base[at] + offset)[group]
        keep = (size > 1)[group]
        live = live[keep]
        if span >= depth or not len(live):
            break
        after = live + span
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        base = rank[live]
        turn = np.argsort(base * (n + 2) + key, kind="stable")
        live, key, base, span = live[turn], key[turn], base[turn], span * 2
    return np.argsort(rank, kind="stable")


def repeats(t: np.ndarray, depth: int) -> np.ndarray:
    """For each place of t whether the `depth` symbols there also start at another place. t ends with a symbol 0 that is nowhere
    else; depth is at most 254."""
    found = np.zeros(len(t), bool)
    if len(t) < 2:
        return found
    own = _Induction(t, depth)
    star = own.star
    is_star = np.zeros(len(t), bool)
    is_star[star] = True
    # substrings of S*, sorted by an induction from unsorted S*
    order: list[np.ndarray] = []

    def take(places, _, n_small):
        order.append(places[:n_small][is_star[places[:n_small]]])

    first = star[np.argsort(t[star], kind="stable")]
    own.induce(first, None, take)
    order_ = np.concatenate(order)[::-1]
    # equal neighbours get one name: same length and same symbols
    length = np.empty(len(t), np.int64)
    length[star] = np.diff(np.r_[star, len(t) - 1]) + 1
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(t), 0x9E3779B97F4A7C15, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * powers[: len(t)])]
    a, b = order_[:-1].astype(np.int64), order_[1:].astype(np.int64)
    la, lb = length[a], length[b]
    stop_a, stop_b = np.minimum(a + la, len(t)), np.minimum(b + lb, len(t))
    wider = np.maximum(a, b)
    same = (la == lb) & ((sums[stop_a] - sums[a]) * powers[wider - a] == (sums[stop_b] - sums[b]) * powers[wider - b])
    name = np.empty(len(t), np.int64)
    name[order_] = np.r_[0, np.cumsum(~same)]
    # the S* suffixes in order: a name stands for one symbol or more
    stars = star[_ranks(name[star], depth)]
    lcp = np.zeros(len(stars), np.uint8)
    lcp[1:] = _equal_prefix(t, stars[1:].astype(np.int64), stars[:-1].astype(np.int64), depth)

    def mark(places, prefixes, _):
        hit = np.flatnonzero(prefixes >= depth)
        found[places[hit]] = True
        found[places[hit - 1]] = True

    own.induce(stars, lcp, mark)
    return found
