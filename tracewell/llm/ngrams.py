"""Language-model scores from an Elias-Fano n-gram trie of order three.

Counting: each task folds its trigrams (u, v, w) into distinct ones with counts and sends them, packed, to the shard that the middle word v
names, so that all that p(w | u v) and p(w | v) need meets in one place. A shard lays out four levels, each one Elias-Fano sequence:

- words: the hashes of its middle words, with exact counts and back-off weights;
- successors: for each word the fingerprints of the words after it, with quantised discounted probabilities;
- contexts: for each word the fingerprints of the words before it, with quantised back-off weights;
- trigrams: for each context the words after it, each as its rank among the successors of the context's last word, with quantised
  discounted probabilities. Ranks are small where a word has few successors, which keeps this level, the largest, compact.

A level's sequence is monotone because each entry is offset by its parent's place, so a successor is found by one select on the upper bits
and a short walk. p(w|uv) = own(uvw) + backoff(uv) * p(w|v), p(w|v) = own(vw) + backoff(v) * p(w), with absolute discounts; pairs and
triples seen once are kept. A context that was never seen leaves the lower order as it is. Start marks go before a text, an end mark after it.

A word that a large share of all tokens are is hot: its triples are dealt to several shards by the word before it, while its pairs go to its
own shard. Which words are hot is read off every 64th text and decides only where entries lie, never what they are.

In corpora up to MODEL_BYTES tasks write shards as files in the shared folder and workers map all of them (from a remote folder they read them).
Above, texts stand in compressed blocks of about BLOCK_BYTES; the distinct triples of a block, of its held-out texts too, go to their shards once; the
task that lays out a shard answers them from it with the trie's one-byte codes, in their order, so that answers need no keys when they meet
their block again. Both ways give equal results.

Edge cases: null and empty texts are one end mark; without training texts every count is 0 and all scores follow from the formulas;
very long texts are read whole; repeated rows score equally; null ids count for fold 0; extra columns are not read. Words are told apart by 64
bits, pairs and triples by 32 bits of their other words (40 in corpora of SMALL_CHARS characters or more): of a word with n
successors one in 2**32 / n unseen words is taken for one of them.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zstd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, fold

#: Absolute discount of both orders.
DISCOUNT = 0.75
#: Steps of a quantised log10 value of one byte: 0 to 8.5 below 1.
STEPS = 30
#: Characters of the corpus, for each of which the trie takes about a byte, up to which workers map all of it.
MODEL_BYTES = 1 << 30
#: Tokens that a task holds before it folds and sends them, and tokens scored at a time.
FOLD_TOKENS, SCORE_TOKENS = 2_000_000, 1_000_000
#: Bytes of text in a block.
BLOCK_BYTES = 12_000_000
#: Characters of the corpus for each shard.
SHARD_CHARS = 8_000_000
#: A word is hot from this share of a shard's fair part of the tokens; at most HOT_SPLIT shards hold its triples.
HOT_SHARDS, HOT_SPLIT = 2.0, 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes of the marks; words that hash to them are moved by two.
START, END = 1, 2
#: Bits of the fingerprints in pairs and triples, the upper bits of a word's hash: fewer up to a corpus of SMALL_CHARS characters.
FINGERPRINTS, SMALL_CHARS = (32, 40), 1 << 37
_pack, _unpack = zstd.ZstdCompressor(level=1), zstd.ZstdDecompressor()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's lower-cased words and the end mark."""
    words = (text or "").encode().translate(_LOWER).split()
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[out <= END] += np.uint64(END)
    return np.append(out, np.uint64(END))


def triples(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both words before each token of the texts, and the token."""
    w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, hashes)])[:-1]
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:] = w[:-1]
    v[starts] = START
    u[1:] = v[:-1]
    u[starts] = START
    return u, v, w


def _spread(u: np.ndarray) -> np.ndarray:
    """A second hash of the word before, for the shards of hot words."""
    x = u * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def homes(v: np.ndarray, bits: int) -> np.ndarray:
    return (v >> np.uint64(64 - bits)).astype(np.int64)


def shards_of(u: np.ndarray, v: np.ndarray, bits: int, hot: dict[int, int]) -> np.ndarray:
    """The shard of each triple's context: that of v, moved by u if v is hot."""
    at = homes(v, bits)
    for word, parts in hot.items():
        own = np.flatnonzero(v == np.uint64(word))
        at[own] = (at[own] + (_spread(u[own]) % np.uint64(parts)).astype(np.int64)) % (1 << bits)
    return at


def local(v: np.ndarray, shard: int, bits: int, hot: np.ndarray) -> np.ndarray:
    """Keys of words within a shard: their lower bits at home; the words that are hot elsewhere come behind, numbered. hot: sorted."""
    rest = np.uint64(64 - bits)
    own = v & ((np.uint64(1) << rest) - np.uint64(1))
    if not len(hot):
        return own
    return np.where((v >> rest) == np.uint64(shard), own, (np.uint64(1) << rest) + np.searchsorted(hot, v).astype(np.uint64))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Places where a new run of equal keys begins, in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grouped(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that goes up in the upper half of v and puts equal triples, and most equal contexts, next to each other, by one sort; and the places of
    its runs of equal triples. Triples whose keys collide may make a run twice, which costs a lookup and changes nothing."""
    mixed = lambda x: x * np.uint64(0x9E3779B97F4A7C15)
    key = ((v >> np.uint64(36)) << np.uint64(36)) | ((mixed(u) >> np.uint64(44)) << np.uint64(16)) | (mixed(w) >> np.uint64(48))
    order = np.argsort(key)
    return order, _runs(v[order], u[order], w[order])


def _folded(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray | None):
    """Distinct (v, u, w) in order, with the sums of their counts."""
    order = np.lexsort((w, u, v))
    v, u, w = v[order], u[order], w[order]
    at = _runs(v, u, w)
    count = np.diff(np.r_[at, len(v)]) if count is None else np.add.reduceat(count[order], at) if len(at) else count[:0]
    return v[at], u[at], w[at], count


def _cut(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _wide(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _blob(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, fp: int) -> bytes:
    """Sorted triples, packed: each word and each context once."""
    words, contexts = _runs(v), _runs(v, u)
    sizes = [np.diff(np.r_[words, len(v)]), np.diff(np.r_[contexts, len(v)]), count]
    head = np.array([len(words), len(contexts), len(v)], "<u8").tobytes()
    return b"".join((head, v[words].astype("<u8").tobytes(), _cut(u[contexts], fp // 8), _cut(w, fp // 8), _pack.compress(np.concatenate(sizes).astype("<u4").tobytes())))


def _unblob(raw: bytes, fp: int):
    n = np.frombuffer(raw, "<u8", 3).tolist()
    ends = 24 + np.cumsum([0, 8 * n[0], *(k * (fp // 8) for k in n[1:])])
    words, contexts, w = (np.frombuffer(raw[a:b], np.uint8) for a, b in zip(ends, ends[1:]))
    sizes = np.frombuffer(_unpack.decompress(raw[ends[-1] :]), "<u4").astype(np.int64)
    cut = lambda x: _wide(x.reshape(-1, fp // 8), fp // 8)
    return np.repeat(words.view("<u8"), sizes[: n[0]]), np.repeat(cut(contexts), sizes[n[0] : n[0] + n[1]]), cut(w), sizes[n[0] + n[1] :]


#: For each byte and rank the place of its set bit of that rank (8 if it has fewer).
_IN_BYTE = np.array([[([b for b in range(8) if x >> b & 1] + [8] * 8)[r] for r in range(8)] for x in range(256)], np.uint8).ravel()


class EliasFano:
    """A monotone sequence: low bytes as they are, upper parts as gaps in a bit vector with a directory of its words. Low parts of five bytes stand as four and
    one, so that searches read whole numbers."""

    WIDTHS = (0, 1, 2, 4, 5)

    def __init__(self, low: np.ndarray, last: np.ndarray, words: np.ndarray, ones: np.ndarray, n: int, width: int):
        self.low, self.last, self.words, self.ones, self.n, self.width = low, last, words, ones, n, width
        self.bits, self.cut = np.uint64(8 * width), np.uint64((1 << (8 * width)) - 1)

    @staticmethod
    def kind(width: int) -> str:
        return {0: "u1", 1: "u1", 2: "<u2", 4: "<u4", 5: "<u4"}[width]

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """universe: an upper bound of the values. The width of the low parts is the one that takes least space."""
        n = len(values)
        width = min(cls.WIDTHS, key=lambda b: 8 * b * n + 1.1 * (n + (universe >> (8 * b))))
        values = values.astype("<u8")
        high = values >> np.uint64(8 * width)
        bits = np.zeros((n + (universe >> (8 * width)) + 2 + 63) // 64 * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.uint32)].astype("<u4")
        main = values >> np.uint64(8) if width == 5 else values
        low = (main & np.uint64((1 << (8 * min(width, 4))) - 1)).astype(cls.kind(width)) if width else np.zeros(0, np.uint8)
        return cls(low, values.astype(np.uint8) if width == 5 else np.zeros(0, np.uint8), words, ones, n, width)

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the bit with a rank (from 0) among ones or zeros."""
        counts = self.ones if one else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(counts, rank, side="right") - 1
        bits = self.words[word]
        raw = (bits if one else ~bits).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(raw), axis=1, dtype=np.uint8)
        left = (rank - counts[word]).astype(np.uint8)
        byte = (upto <= left[:, None]).sum(1, dtype=np.int64)
        rows = np.arange(len(word))
        left -= np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0).astype(np.uint8)
        return word * 64 + byte * 8 + _IN_BYTE[raw[rows, byte].astype(np.int64) * 8 + left]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        out = self.low[at].astype(np.uint64)
        return (out << np.uint64(8)) | self.last[at] if self.width == 5 else out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at places."""
        if not len(at):
            return np.zeros(0, np.uint64)
        high = self._select(at, True) - at
        return (high.astype(np.uint64) << self.bits) | self._lows(at)

    def _starts(self, high: np.ndarray) -> np.ndarray:
        """The first place whose upper part is at least `high`."""
        out = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high > 0)
        out[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        return out

    def _lengths(self, high: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many values from their starts have an upper part: the ones from there to the next zero, in a window of 64 bits, else by a select."""
        bit = start + high
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        after = np.where(word + 1 < len(self.words), self.words[np.minimum(word + 1, len(self.words) - 1)], np.uint64(0))
        window = (self.words[word] >> shift) | np.where(shift > 0, after << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        rest = ~window
        out = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        full = np.flatnonzero(rest == 0)
        if len(full):
            out[full] = self._starts(high[full] + 1) - start[full]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of values, or -1."""
        out = np.full(len(values), -1)
        high = values >> self.bits
        top = len(self.words) * 64 - self.n - 1
        live = np.flatnonzero(high < np.uint64(max(top, 0))) if self.n else np.zeros(0, np.int64)
        if not len(live):
            return out
        # equal upper parts share one select
        first = _runs(high[live])
        own, times = high[live][first].astype(np.int64), np.diff(np.r_[first, len(live)])
        head = self._starts(own)
        sizes = self._lengths(own, head)
        start, stop = np.repeat(head, times), np.repeat(head + sizes, times)
        low = values[live] & self.cut
        if not self.width:
            out[live] = np.where(start < stop, start, -1)
            return out
        main = (low >> np.uint64(8)).astype("<u4") if self.width == 5 else low.astype(self.low.dtype)
        # long ranges that many values share are searched one by one, the others together
        ends = first + times
        long = np.flatnonzero((sizes >= 256) & (times >= 16))
        at, rest = start.copy(), np.ones(len(live), bool)
        for k in long.tolist():
            a, b, lo = int(first[k]), int(ends[k]), int(head[k])
            at[a:b] = lo + np.searchsorted(self.low[lo : lo + int(sizes[k])], main[a:b])
            rest[a:b] = False
        rest = np.flatnonzero(rest & (start < stop))
        at[rest] = self._lower_bound(main[rest], start[rest], stop[rest])
        while len(live):  # low parts that agree in the first four bytes are walked
            same = (at < stop) & (self.low[np.minimum(at, self.n - 1)] == main)
            hit = same if self.width < 5 else same & (self.last[np.minimum(at, self.n - 1)] == low.astype(np.uint8))
            out[live[hit]] = at[hit]
            if self.width < 5:
                break
            more = same & ~hit
            live, at, stop, main, low = live[more], at[more] + 1, stop[more], main[more], low[more]
        return out

    def _lower_bound(self, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first place of each range whose low part is not below the wanted one."""
        at, size = start.copy(), stop - start
        rows = np.arange(len(at))
        now, left, key = at, size, wanted
        while len(rows):
            half = (left + 1) >> 1
            less = self.low[now + half - 1] < key
            now = np.where(less, now + half, now)
            left = np.where(less, left - half, half - 1)
            at[rows] = now
            live = left > 0
            if not live.all():
                rows, now, left, key = rows[live], now[live], left[live], key[live]
        return at


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-12)) * STEPS), 0, 255).astype(np.uint8)


_VALUES = 10.0 ** (-np.arange(256) / STEPS)


def levels(triple_parts: list[tuple], pair_parts: list[tuple], shard: int, bits: int, fp: int, hot: np.ndarray, discount: float) -> bytes:
    """A shard's file, from its triples (v, u, w, count) and the pairs (v, 0, w, count) of hot words that it is the home of. Elsewhere a hot
    word has no counts: its successors there only number the triples."""
    cat = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64 if k == 3 else np.uint64)
    hashes, parts_v = cat(triple_parts, 0), cat(pair_parts, 0)
    v, u, w, c = _folded(local(hashes, shard, bits, hot), *(cat(triple_parts, k) for k in (1, 2, 3)))
    hot_keys = local(hot, shard, bits, hot)
    # the distinct pairs: those of the triples and those that were sent as such
    pv, pw, pc = local(parts_v, shard, bits, hot), cat(pair_parts, 2), cat(pair_parts, 3)
    own_words = v[_runs(v)]
    words = np.union1d(own_words, pv) if len(pv) else own_words
    vi = np.repeat(np.searchsorted(words, own_words), np.diff(np.r_[_runs(v), len(v)]))
    keys = np.concatenate([_joint(vi, w, fp), _joint(np.searchsorted(words, pv), pw, fp)])
    counts = np.concatenate([np.where(np.isin(v, hot_keys), 0, c) if len(hot) else c, pc])
    turn = np.argsort(keys)
    first = _runs(keys[turn])
    pairs, pc = keys[turn][first], np.add.reduceat(counts[turn], first) if len(first) else counts
    pair_of = np.empty(len(keys), np.int64)
    pair_of[turn] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    pair_of = pair_of[: len(v)]
    owner = (pairs >> np.uint64(fp)).astype(np.int64)
    n_after = np.bincount(owner, minlength=len(words))
    at = np.r_[0, np.cumsum(n_after)[:-1]] if len(words) else np.zeros(0, np.int64)
    # a hot word has no counts but at home
    totals = np.bincount(owner, pc, len(words)).astype(np.int64)
    kinds = np.bincount(owner, pc > 0, len(words))
    own2 = (pc - discount) / np.maximum(totals[owner], 1)
    # contexts and triples, by the place of their word
    ctx = _runs(v, u)
    cv, cu = vi[ctx], u[ctx]
    size = np.diff(np.r_[ctx, len(v)])
    total3 = np.add.reduceat(c, ctx) if len(ctx) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(ctx)), size)
    n_before = np.bincount(cv, minlength=len(words))
    inner = np.arange(len(ctx)) - np.repeat(np.r_[0, np.cumsum(n_before)[:-1]], n_before) if len(ctx) else np.zeros(0, np.int64)
    rank = pair_of - at[cv[which]] if len(v) else np.zeros(0, np.int64)
    base = np.r_[0, np.cumsum(n_before * n_after)]
    key3 = base[cv[which]] + inner[which] * n_after[cv[which]] + rank if len(v) else np.zeros(0, np.int64)
    n = len(words)
    efs = [
        EliasFano.build(words, (1 << (64 - bits)) + len(hot)), EliasFano.build(pairs, n << fp), EliasFano.build(_joint(cv, cu, fp), n << fp),
        EliasFano.build(key3.astype(np.uint64), int(base[-1])),
        EliasFano.build(np.r_[0, np.cumsum(n_after)].astype(np.uint64), len(pairs)), EliasFano.build(np.r_[0, np.cumsum(n_before)].astype(np.uint64), len(ctx)),
        EliasFano.build(base.astype(np.uint64), int(base[-1])),
    ]
    parts = [x for ef in efs for x in (ef.low, ef.last, ef.words, ef.ones)] + [
        totals.astype("<u8"), np.minimum(1.0, discount * kinds / np.maximum(totals, 1)).astype("<f4"), np.where(pc > 0, _code(own2), 255).astype(np.uint8),
        _code(discount * size / np.maximum(total3, 1)), _code((c - discount) / np.maximum(total3[which], 1)),
    ]
    head = [x for ef in efs for x in (ef.n, ef.width)]
    out = []
    for x in parts:
        data = x.tobytes()
        head.append(len(data))
        out.append(data + b"\0" * (-len(data) % 8))
    return np.array(head, "<u8").tobytes() + b"".join(out)


def _print(x: np.ndarray, fp: int) -> np.ndarray:
    """Fingerprints of hashes."""
    return x >> np.uint64(64 - fp)


def _joint(owner: np.ndarray, x: np.ndarray, fp: int) -> np.ndarray:
    """Keys of a level: the parent's place, then the fingerprint of the word."""
    return (owner.astype(np.uint64) << np.uint64(fp)) | x


class Shard:
    """A shard read from mapped bytes."""

    EFS, ARRAYS = 7, 33

    def __init__(self, raw: np.ndarray, number: int, bits: int, fp: int, hot: np.ndarray):
        self.size, self.number, self.bits, self.fp, self.hot = len(raw), number, bits, fp, hot
        n = 2 * self.EFS + self.ARRAYS
        head = raw[: 8 * n].view("<u8").tolist()
        at, parts = 8 * n, []
        for size in head[2 * self.EFS :]:
            parts.append(raw[at : at + size])
            at += size + (-size % 8)
        make = lambda k: EliasFano(
            parts[4 * k].view(EliasFano.kind(head[2 * k + 1])), parts[4 * k + 1], parts[4 * k + 2].view("<u8"), parts[4 * k + 3].view("<u4"), head[2 * k], head[2 * k + 1]
        )
        self.words, self.successors, self.contexts, self.triples, self.after, self.before, self.base = map(make, range(self.EFS))
        rest = parts[4 * self.EFS :]
        self.counts, self.backoff2, self.own2, self.backoff3, self.own3 = rest[0].view("<u8"), rest[1].view("<f4"), *rest[2:]

    def pairs(self, v: np.ndarray, w: np.ndarray):
        """For pairs in runs of v: the place of v and of the pair, the count of v, its back-off weight and the pair's own probability."""
        place = self._places(v)
        count, backoff, own, hit = np.zeros(len(v), np.int64), np.ones(len(v)), np.zeros(len(v)), np.full(len(v), -1)
        ok = np.flatnonzero(place >= 0)
        at = place[ok]
        count[ok] = self.counts[at]
        backoff[ok] = np.where(count[ok] > 0, self.backoff2[at], 1.0)
        hit[ok] = self.successors.find(_joint(at, _print(w[ok], self.fp), self.fp))
        seen = np.flatnonzero(hit >= 0)
        codes = self.own2[hit[seen]]
        own[seen] = np.where(codes < 255, _VALUES[codes], 0.0)
        return place, hit, count, backoff, own

    def contexts_of(self, u: np.ndarray, v: np.ndarray, place: np.ndarray, hit: np.ndarray):
        """For triples in runs of v and u, with the places of v and of (v, w): the back-off weight of (u, v) and the triple's own probability."""
        backoff, own = np.ones(len(v)), np.zeros(len(v))
        new = _runs(v, u)
        ctx = np.full(len(new), -1)
        ok = np.flatnonzero(place[new] >= 0)
        ctx[ok] = self.contexts.find(_joint(place[new][ok], _print(u[new][ok], self.fp), self.fp))
        ctx = np.repeat(ctx, np.diff(np.r_[new, len(v)]))
        ok = np.flatnonzero(ctx >= 0)
        backoff[ok] = _VALUES[self.backoff3[ctx[ok]]]
        ok = np.flatnonzero((ctx >= 0) & (hit >= 0))
        if not len(ok):
            return backoff, own
        new = _runs(place[ok])
        words, back = place[ok][new], np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(ok)]))
        after = self.after.access(np.r_[words, words + 1]).astype(np.int64)
        start, fan = after[: len(words)], after[len(words) :] - after[: len(words)]
        inner = ctx[ok] - self.before.access(words).astype(np.int64)[back]
        key = self.base.access(words).astype(np.int64)[back] + inner * fan[back] + (hit[ok] - start[back])
        found = self.triples.find(key.astype(np.uint64))
        own[ok[found >= 0]] = _VALUES[self.own3[found[found >= 0]]]
        return backoff, own

    def _places(self, v: np.ndarray):
        new = _runs(v)
        found = self.words.find(local(v[new], self.number, self.bits, self.hot))
        return np.repeat(found, np.diff(np.r_[new, len(v)]))


class Trie:
    """The shards of a folder; they are opened when they are first asked, and at most `keep` of them stay open."""

    def __init__(self, uri: str, bits: int, fp: int, hot: dict[int, int], keep: int = 1 << 30):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.bits, self.fp, self.hot, self.keep, self.open = bits, fp, hot, keep, OrderedDict()
        self.words = np.array(sorted(hot), np.uint64)

    def shard(self, k: int) -> Shard | None:
        if k not in self.open:
            at = f"{self.path}/{k}.trie"
            if self.fs.get_file_info(at).type != pafs.FileType.File:
                made = None
            elif isinstance(self.fs, pafs.LocalFileSystem):
                made = Shard(np.asarray(np.memmap(at, np.uint8, "r")), k, self.bits, self.fp, self.words)
            else:
                with self.fs.open_input_file(at) as f:
                    made = Shard(np.frombuffer(f.read(), np.uint8), k, self.bits, self.fp, self.words)
            self.open[k] = made
            if len(self.open) > self.keep:
                self.open.popitem(last=False)
        self.open.move_to_end(k)
        return self.open[k]

    def _each(self, shard: np.ndarray):
        """Shards and the rows that ask them; rows of a shard keep their order."""
        if len(shard) and (shard[1:] < shard[:-1]).any():
            order = np.argsort(shard, kind="stable")
        else:
            order = np.arange(len(shard))
        at = _runs(shard[order])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
            found = self.shard(int(shard[order[a]]))
            if found is not None:
                yield found, order[a:b]

    def pair_values(self, u, v, w):
        """Per triple in runs of v: the count of v, its back-off weight and the pair's own probability."""
        return self._values(homes(v, self.bits), u, v, w, True, False)[:3]

    def context_values(self, u, v, w):
        """Per triple in runs of v and u: the back-off weight of (u, v) and the triple's own probability."""
        return self._values(shards_of(u, v, self.bits, self.hot), u, v, w, False, True)[3:]

    def _values(self, shard, u, v, w, pairs: bool, contexts: bool):
        out = [np.zeros(len(v), np.int64), np.ones(len(v)), np.zeros(len(v)), np.ones(len(v)), np.zeros(len(v))]
        for found, rows in self._each(shard):
            place, hit, *got = found.pairs(v[rows], w[rows])
            if pairs:
                for x, y in zip(out, got):
                    x[rows] = y
            if contexts:
                for x, y in zip(out[3:], found.contexts_of(u[rows], v[rows], place, hit)):
                    x[rows] = y
        return out

    def lookup(self, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        """Per triple: the count of v, and the weights a, b of p(w|uv) = a + b * p(w). Equal triples are looked up once."""
        order, at = _grouped(v, u, w)
        u1, v1, w1 = (x[order[at]] for x in (u, v, w))
        home = homes(v1, self.bits)
        count, back, own, back3, own3 = self._values(home, u1, v1, w1, True, not self.hot)
        if self.hot:
            back3, own3 = self.context_values(u1, v1, w1)
        times = np.diff(np.r_[at, len(order)])
        out = []
        for x in (count, own3 + back3 * own, back3 * back):
            y = np.empty(len(v), x.dtype)
            y[order] = np.repeat(x, times)
            out.append(y)
        return out


@lru_cache(maxsize=1)
def _trie(uri: str, bits: int, fp: int, hot: tuple) -> Trie:
    return Trie(uri, bits, fp, dict(hot))


def _count(rows: DataFrame, bits: int, fp: int, hot: dict[int, int]) -> DataFrame:
    """Packed distinct triples of the training rows by shard, and packed pairs of hot words by home: (shard, pairs, blob)."""

    def run(batches):
        held, size = [], 0

        def sent():
            u, v, w = triples(held)
            order, at = _grouped(v, u, w)
            u, v, w, count = u[order[at]], v[order[at]], w[order[at]], np.diff(np.r_[at, len(order)])
            shard, got = shards_of(u, v, bits, hot), []
            if hot:  # pairs of hot words go to their homes, their triples where the word before sends them
                mine = np.flatnonzero(np.isin(v, np.array(list(hot), np.uint64)))
                own = _folded(v[mine], np.zeros(len(mine), np.uint64), _print(w[mine], fp), count[mine])
                home = homes(own[0], bits)
                got += [(k, True, _blob(*(x[home == k] for x in own), fp)) for k in np.unique(home).tolist()]
                turn = np.argsort(shard, kind="stable")
                u, v, w, count, shard = u[turn], v[turn], w[turn], count[turn], shard[turn]
            u, w = _print(u, fp), _print(w, fp)
            cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
            got += [(k, False, _blob(v[a:b], u[a:b], w[a:b], count[a:b], fp)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            for k in range(0, len(got), 32):
                cols = list(zip(*got[k : k + 32]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()))], ["shard", "pairs", "blob"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(word_hashes(text))
                size += len(held[-1])
                if size >= FOLD_TOKENS:
                    yield from sent()
                    held, size = [], 0
        if held:
            yield from sent()

    return rows.mapInArrow(run, "shard int, pairs boolean, blob binary")


def hot_words(rows: DataFrame, bits: int) -> dict[int, int]:
    """Hashes of words whose share of the tokens of every 64th text is that of HOT_SHARDS shards or more, with the shards for their
    triples. Only words of one share each can be so frequent, so the result is bounded by the number of shards."""
    some = rows.where(F.pmod(F.xxhash64("_text"), F.lit(64)) == 0)
    words = some.select(F.explode(F.split(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    total = words.count()
    out = {}
    for r in words.groupBy("w").count().where(F.col("count") >= HOT_SHARDS * total / (1 << bits)).collect():
        parts = min(HOT_SPLIT, 1 << bits, round(r["count"] / total * (1 << bits)))
        if parts > 1:
            out[int(word_hashes(r["w"])[0])] = parts
    return out


def score_documents(
    df: DataFrame, text: str = "text", key: str = "doc_id", parts: int = 5, held: int = 1, discount: float = DISCOUNT, model_bytes: int = MODEL_BYTES,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """For each row: key, held_out (its fold is `held`), n_tokens, n_known, train_tokens, base_score (unigrams) and score (the
    trie's log10 probability). The model learns from rows that are not held out."""
    spark = df.sparkSession
    space = Workspace(spark, "ngrams")
    rows = df.select(F.col(key).alias("_id"), (fold(F.col(key), parts) == held).alias("_held"), F.col(text).cast("string").alias("_text"))
    chars = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    bits = max(4, (chars // shard_chars).bit_length())
    train = rows.where("not _held").select("_text")
    hot = hot_words(train, bits)
    uri, fp = space.folder("trie"), FINGERPRINTS[chars >= SMALL_CHARS]

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        k, pairs = int(shard["shard"].iloc[0]), shard["pairs"].to_numpy()
        blobs = [_unblob(x, fp) for x in shard["blob"]]
        raw = levels([b for b, p in zip(blobs, pairs) if not p], [b for b, p in zip(blobs, pairs) if p], k, bits, fp, np.array(sorted(hot), np.uint64), discount)
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        new = f"{path}/{k}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:  # a task that runs twice writes the same bytes
            out.write(raw)
        fs.move(new, f"{path}/{k}.trie")
        return pd.DataFrame([_sizes(Shard(np.frombuffer(raw, np.uint8), k, bits, fp, np.array(sorted(hot), np.uint64)), k)], columns=SIZES)

    if chars <= model_bytes:
        built = _count(train, bits, fp, hot).groupBy("shard").applyInPandas(build, ", ".join(f"{x} long" for x in SIZES))
        built, scored = space.save("sizes", built), partial(_by_map, rows, uri, bits, fp, tuple(sorted(hot.items())))
    else:
        built, scored = _by_blocks(space, rows, bits, fp, hot, discount)
    _, types, tokens, texts = (x or 0 for x in built.agg(*map(F.sum, SIZES)).first())
    spark._jvm.System.gc()  # the triples' shuffle is not read again: Spark deletes the files of shuffles that the driver has collected
    # the end mark is never a middle word: it is counted by the texts
    total, vocabulary = tokens + texts, types + int(texts > 0)
    norm = float(np.log10(total + 0.5 * (vocabulary + 1)))
    return scored(texts, norm).select(
        F.col("_id").alias(key), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


#: Columns of scores, and of the sizes of shards.
SCORED, SIZES = ["_id", "_held", "n_tokens", "n_known", "base_score", "score"], ["size", "n_types", "n_tokens", "n_texts"]


def _sizes(made: Shard, number: int) -> tuple[int, int, int, int]:
    """SIZES of a shard: its bytes, kinds of words, words, and texts (they are counted at their start marks, in the first shard)."""
    counts = made.counts.astype(np.int64)
    start = made.words.access(np.arange(made.words.n)) == START if number == 0 else np.zeros(len(counts), bool)
    real = (counts > 0) & ~start
    return made.size, int(real.sum()), int(counts[real].sum()), int(counts[start].sum())


def _sums(hashes: list[np.ndarray], count: np.ndarray, a: np.ndarray, b: np.ndarray, texts: int, norm: float):
    """Per text the numbers of tokens and known ones, the unigrams' score and the trie's, from what Trie.lookup gives for its tokens."""
    # the count of a token is that of the middle word it is next; the last token of a text is the end mark
    starts = np.cumsum([0, *map(len, hashes)])
    c = np.empty(len(count), np.int64)
    c[:-1] = count[1:]
    c[starts[1:] - 1] = texts
    unigram = np.log10(c + 0.5) - norm
    cut = starts[:-1]
    sums = (np.add.reduceat(x, cut) for x in ((c > 0).astype(np.int64), unigram, np.log10(a + b * 10.0**unigram)))
    return (np.diff(starts), *sums)


def _by_map(rows: DataFrame, uri: str, bits: int, fp: int, hot: tuple, texts: int, norm: float) -> DataFrame:
    """Scores with the whole trie open in every worker."""
    def run(batches):
        trie, waiting, size = _trie(uri, bits, fp, hot), [], 0

        def done():
            hashes = [h for _, own in waiting for h in own]
            cuts, total = [0], 0
            for k, h in enumerate(hashes):  # at most SCORE_TOKENS at a time, or one text
                total += len(h)
                if total >= SCORE_TOKENS:
                    cuts.append(k + 1)
                    total = 0
            cuts = [*cuts, len(hashes)]
            parts = [_sums(hashes[a:b], *trie.lookup(*triples(hashes[a:b])), texts, norm) for a, b in zip(cuts, cuts[1:]) if b > a]
            cols = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * 4
            at = 0
            for batch, own in waiting:
                ends = [pa.array(x[at : at + len(own)], t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                at += len(own)
                yield pa.RecordBatch.from_arrays([*batch, *ends], names=SCORED)

        for batch in batches:
            hashes = [word_hashes(t) for t in batch.column(2).to_pylist()]
            waiting.append(((batch.column(0), batch.column(1)), hashes))
            size += sum(map(len, hashes))
            if size >= SCORE_TOKENS:
                yield from done()
                waiting, size = [], 0
        yield from done()

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"_id {kind}, _held boolean, n_tokens long, n_known long, base_score double, score double")


class Questions:
    """The distinct triples of some texts in the order of their shards, how often they are in texts to learn from, and the same of the pairs of hot words. It follows from
    the texts alone, so that answers come back in its order without keys."""

    def __init__(self, hashes: list[np.ndarray], held: np.ndarray, bits: int, fp: int, hot: dict[int, int]):
        u, v, w = triples(hashes)
        order, at = _grouped(v, u, w)
        self.fp, self.order, self.times = fp, order.astype(np.int32), np.diff(np.r_[at, len(v)]).astype(np.int32)
        u, v, w = (x[order[at]] for x in (u, v, w))
        count = np.add.reduceat(np.repeat(~held, list(map(len, hashes)))[order], at, dtype=np.int64)
        shard = shards_of(u, v, bits, hot)
        turn = np.argsort(shard, kind="stable")
        self.turn, self.v, self.u, self.w, self.count = turn.astype(np.int32), v[turn], _print(u[turn], fp), _print(w[turn], fp), count[turn]
        self.cuts = self._cuts(shard[turn])
        # pairs of hot words go to their homes, their triples where the word before sends them
        self.mine = np.flatnonzero(np.isin(self.v, np.array(list(hot), np.uint64))) if hot else np.zeros(0, np.int64)
        v, w = self.v[self.mine], self.w[self.mine]
        turn = np.lexsort((w, v))
        at = _runs(v[turn], w[turn])
        self.pair_of = np.empty(len(v), np.int64)
        self.pair_of[turn] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(v)]))
        self.pv, self.pw = v[turn][at], w[turn][at]
        self.pair_count = np.add.reduceat(self.count[self.mine][turn], at) if len(at) else self.count[:0]
        self.pair_cuts = self._cuts(homes(self.pv, bits))

    @staticmethod
    def _cuts(shard: np.ndarray) -> list[tuple[int, int, int]]:
        at = _runs(shard)
        return list(zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shard)]))

    def sent(self):
        """Packed questions: (shard, pairs, blob)."""
        for k, a, b in self.cuts:
            yield k, False, _blob(self.v[a:b], self.u[a:b], self.w[a:b], self.count[a:b], self.fp)
        for k, a, b in self.pair_cuts:
            yield k, True, _blob(self.pv[a:b], np.zeros(b - a, np.uint64), self.pw[a:b], self.pair_count[a:b], self.fp)

    def lookup(self, answers: dict[tuple[int, bool], bytes]):
        """Per token what Trie.lookup gives, from the answers by (shard, pairs)."""
        values = lambda n: (np.zeros(n, np.int64), np.ones(n), np.zeros(n))
        three, back3, own3 = values(len(self.v)), np.ones(len(self.v)), np.zeros(len(self.v))
        for k, a, b in self.cuts:
            *got, back3[a:b], own3[a:b] = _unpacked(answers[k, False], self.v[a:b], self.u[a:b])
            for x, y in zip(three, got):
                x[a:b] = y
        two = values(len(self.pv))
        for k, a, b in self.pair_cuts:
            for x, y in zip(two, _unpacked(answers[k, True], self.pv[a:b], np.zeros(b - a, np.uint64))):
                x[a:b] = y
        for x, y in zip(three, two):
            x[self.mine] = y[self.pair_of]
        count, back, own = three
        out = []
        for x in (count, own3 + back3 * own, back3 * back):
            grouped, y = np.empty(len(x), x.dtype), np.empty(len(self.order), x.dtype)
            grouped[self.turn] = x
            y[self.order] = np.repeat(grouped, self.times)
            out.append(y)
        return out


def _seen(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, 255 for none."""
    return np.where(p > 0, np.minimum(_code(p), 254), 255).astype(np.uint8)


def _packed(v, u, count, back, own, back3, own3) -> bytes:
    """Answers to a blob in its order: own probabilities and back-off weights as the codes that they have in the trie, the latter once a context or word."""
    words, contexts = _runs(v), _runs(v, u)
    parts = _seen(own), _seen(own3), _code(back3[contexts]), count[words].astype("<u8"), back[words].astype("<f4")
    return _pack.compress(b"".join(x.tobytes() for x in parts))


def _unpacked(raw: bytes, v: np.ndarray, u: np.ndarray):
    raw, at, out = _unpack.decompress(raw), 0, []
    words, contexts = _runs(v), _runs(v, u)
    for n, kind in ((len(v), "u1"), (len(v), "u1"), (len(contexts), "u1"), (len(words), "<u8"), (len(words), "<f4")):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    own, own3 = (np.where(x < 255, _VALUES[x], 0.0) for x in out[:2])
    spread = lambda x, at: np.repeat(x, np.diff(np.r_[at, len(v)]))
    return spread(out[3].astype(np.int64), words), spread(out[4].astype(np.float64), words), own, spread(_VALUES[out[2]], contexts), own3


def _blocks(space: Workspace, rows: DataFrame) -> tuple[str, DataFrame]:
    """The rows in files of about BLOCK_BYTES of text, so that they are read twice in one order; their folder and a table of their names. A task that runs
    twice gives its files other names, and the table has those of one run."""
    uri = space.folder("blocks")

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        waiting, size = [], 0

        def done():
            table, name = pa.Table.from_batches(waiting).combine_chunks(), uuid.uuid4().int >> 65
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_stream(out, table.schema, options=options) as to:
                to.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64())], ["block"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at, before = 0, 0
            while at < len(ends):
                stop = min(int(np.searchsorted(ends, before + BLOCK_BYTES - size)) + 1, len(ends))
                waiting.append(batch.slice(at, stop - at))
                size, at, before = size + int(ends[stop - 1]) - before, stop, int(ends[stop - 1])
                if size >= BLOCK_BYTES:
                    yield done()
                    waiting, size = [], 0
        if waiting:
            yield done()

    return uri, space.save("names", rows.mapInArrow(run, "block long"))


def _block(uri: str, name: int, *args) -> tuple[pa.Table, list[np.ndarray], Questions]:
    """A block's rows, the hashes of their words and their questions."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{path}/{name}") as f:
        table = pa.ipc.open_stream(f).read_all()
    hashes = [word_hashes(t) for t in table.column(2).to_pylist()]
    return table, hashes, Questions(hashes, table.column(1).to_numpy(), *args)


def _by_blocks(space: Workspace, rows: DataFrame, bits: int, fp: int, hot: dict[int, int], discount: float) -> tuple[DataFrame, Callable[[int, float], DataFrame]]:
    """The same scores without files of shards: the triples of a block's texts, to learn from or not, go to their shards once; the task that lays out a shard answers them from
    it, in their order; and answers meet their block. Gives the sizes of the shards, and the scores from the number of texts and the norm."""
    uri, names = _blocks(space, rows)
    n = max(1, min(names.count(), 10_000))

    def ask(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                got = list(_block(uri, name, bits, fp, hot)[2].sent())
                for k in range(0, len(got), 32):
                    shard, pairs, blob = zip(*got[k : k + 32])
                    cols = [pa.array([name] * len(shard), pa.int64()), pa.array(shard, pa.int32()), pa.array(pairs), pa.array(blob, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["block", "shard", "pairs", "blob"])

    def answer(asked: pa.Table) -> pa.Table:
        shard, pairs = asked["shard"][0].as_py(), asked["pairs"].to_pylist()
        blobs, words = [_unblob(x, fp) for x in asked["blob"].to_pylist()], np.array(sorted(hot), np.uint64)
        learn = lambda kind: [tuple(x[b[3] > 0] for x in b) for b, p in zip(blobs, pairs) if p == kind]
        raw = levels(learn(False), learn(True), shard, bits, fp, words, discount)
        made = Shard(np.frombuffer(raw, np.uint8), shard, bits, fp, words)
        whole = lambda x: x << np.uint64(64 - fp)
        v, u, w = (np.concatenate([b[k] for b in blobs]) for k in range(3))
        place, hit, *two = made.pairs(v, whole(w))
        three = made.contexts_of(whole(u), v, place, hit)
        cuts = np.cumsum([0, *(len(b[0]) for b in blobs)])
        packed = [_packed(*(x[a:b] for x in (v, u, *two, *three))) for a, b in zip(cuts, cuts[1:])]
        sizes = [pa.array([x] + [0] * (len(blobs) - 1), pa.int64()) for x in _sizes(made, shard)]
        return pa.table([asked["block"], asked["shard"], asked["pairs"], pa.array(packed, pa.binary()), *sizes], [*asked.schema.names, *SIZES])

    sizes = ", ".join(f"{x} long" for x in SIZES)
    kinds = "block long, shard int, pairs boolean, blob binary"
    asked = names.coalesce(1).repartition(n).mapInArrow(ask, kinds).repartition(min(1 << bits, 4096), "shard")
    answers = space.save("answers", asked.groupBy("shard").applyInArrow(answer, f"{kinds}, {sizes}"))
    ids = dict(rows.dtypes)["_id"]

    def scored(texts: int, norm: float) -> DataFrame:
        def run(own: pa.Table) -> pa.Table:
            table, hashes, questions = _block(uri, own["block"][0].as_py(), bits, fp, hot)
            got = dict(zip(zip(own["shard"].to_pylist(), own["pairs"].to_pylist()), own["blob"].to_pylist()))
            cols = zip(_sums(hashes, *questions.lookup(got), texts, norm), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))
            return pa.table([table.column(0), table.column(1), *(pa.array(x, t) for x, t in cols)], SCORED)

        own = answers.select("block", "shard", "pairs", "blob").repartition(min(n, 4096), "block").groupBy("block")
        return own.applyInArrow(run, f"_id {ids}, _held boolean, n_tokens long, n_known long, base_score double, score double")

    return answers, scored
