"""Quality rules: exact document counts, fixed base rules, and gradient-boosted trees over document statistics.

The trees are grown by second-order boosting on binned features; chosen features are monotone (more symbols, repeats,
capitals or bars never raise the verdict). A forest is flattened into numpy node arrays, so that a batch of rows is scored by
a few gathers for each level.

Edge cases: null and empty texts have no words (all counts 0, base_failed, not kept); very long texts are counted whole;
repeated rows get equal results; labels that are null or name no document are ignored; without labels of both classes the
verdict keeps whatever the base rules keep; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and their direction: -1, a higher value never raises quality; 0, free.
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "bangs": -1,
    "bars": -1, "digits": 0, "stops": 0, "distinct": 0, "line_words": 0,
}
#: Rows of labelled documents that a fit takes at most (those with the smallest hashes of their ids).
FIT_ROWS = 20_000
#: Share of good documents that a fitted verdict may refuse.
REFUSED_GOOD = 0.005

_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")


def _windows(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and the number of distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    m = len(seen)
    if len(ids) < 4 or len(ids) == m:
        return 0, m
    keys = ids[:-1] * m + ids[1:]
    if m > 2_000_000:
        keys = np.unique(keys, return_inverse=True)[1]
    keys = keys[:-1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= again
    return int(covered.sum()), m


def counts_of(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts of COUNTS and the values of FEATURES."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        symbols = sum(raw.count(x) for x in _SYMBOLS)
        return (0, 0, symbols, 0, 0), [0.0] * len(FEATURES)
    tally = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(tally.sum() - tally[128:192].sum())
    word_chars = chars - int(tally[_SPACES].sum())
    symbols = int(tally[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats, distinct = _windows(words)
    short = sum(len(w) <= 3 for w in words)
    return (n, word_chars, symbols, dups, repeats), [
        float(np.log1p(n)), word_chars / n, symbols / word_chars, dups / len(lines), repeats / n,
        float(tally[65:91].sum()) / word_chars, float(tally[33]) / n, float(tally[124]) / n,
        float(tally[48:58].sum()) / word_chars, short / n, distinct / n, n / len(lines),
    ]


@dataclass
class Forest:
    """Trees as node arrays [tree, node]; a leaf's children are itself. threshold is for the margin."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float
    threshold: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[t, at]] <= self.cut[t, at]
                at = np.where(goes_left, self.left[t, at], self.right[t, at])
            total += self.value[t, at]
        return total


def fit_forest(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
    l2: float = 4.0, least: int = 10,
) -> Forest:
    """Second-order boosting of logistic loss. signs: 1 or -1 for monotone features. A split that breaks a sign is refused, and
    its halves are bounded by the middle of their values."""
    rows, cols = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(cols)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(cols)], 1)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(rows, base)
    size = 2 ** (depth + 1) - 1
    out = Forest(
        np.zeros((trees, size), np.int64), np.zeros((trees, size)), np.tile(np.arange(size), (trees, 1)),
        np.tile(np.arange(size), (trees, 1)), np.zeros((trees, size)), depth, base,
    )
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        todo = [(0, np.arange(rows), -np.inf, np.inf, 0)]
        while todo:
            node, own, low, high, level = todo.pop()
            g, h = grad[own].sum(), hess[own].sum()
            value = float(np.clip(g / (h + l2), low, high))
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(own) >= 2 * least:
                for j in range(cols):
                    n_bins = len(edges[j]) + 1
                    b = binned[own, j]
                    gl = np.cumsum(np.bincount(b, grad[own], n_bins))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[own], n_bins))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=n_bins))[:-1]
                    if not len(gl):
                        continue
                    vl = np.clip(gl / (hl + l2), low, high)
                    vr = np.clip((g - gl) / (h - hl + l2), low, high)
                    gain = (gl * vl - (hl + l2) * vl**2 / 2) + ((g - gl) * vr - (h - hl + l2) * vr**2 / 2)
                    gain = gain - (g * value - (h + l2) * value**2 / 2)
                    allowed = (nl >= least) & (len(own) - nl >= least) & (signs[j] * (vr - vl) >= 0)
                    gain = np.where(allowed, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            if best[1] < 0:
                out.value[t, node] = rate * value
                margin[own] += rate * value
                continue
            _, j, k, vl, vr = best
            out.feature[t, node], out.cut[t, node] = j, edges[j][k]
            out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
            goes = binned[own, j] <= k
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[j]]
            todo.append((2 * node + 1, own[goes], *bounds[0], level + 1))
            todo.append((2 * node + 2, own[~goes], *bounds[1], level + 1))
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          fit_rows: int = FIT_ROWS, refused_good: float = REFUSED_GOOD) -> Forest | None:
    """A forest from at most fit_rows labelled documents; None without both classes. The verdict's threshold is the highest
    margin up to 0 that refuses at most refused_good of the good rows."""
    chosen = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_key").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_key").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)
    )
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def make():
        return lambda texts: [[counts_of(t)[1] for t in texts]]

    got = map_texts(rows.select("_key", "_text", "_y"), "_text", [("_x", "array<double>")], make)
    fitted = got.select("_key", "_y", "_x").orderBy("_key", "_x").limit(2 * fit_rows).collect()
    y = np.array([r["_y"] for r in fitted], float)
    if len(np.unique(y)) < 2:
        return None
    x = np.array([r["_x"] for r in fitted])
    forest = fit_forest(x, y, list(FEATURES.values()))
    good = np.sort(forest.margins(x)[y == 1])
    forest.threshold = min(0.0, float(good[int(refused_good * len(good))]))
    return forest


def judge(df: DataFrame, forest: Forest | None, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """Adds COUNTS, base_failed, quality_margin and kept; names renames them."""
    named = [(n, "long") for n in COUNTS] + [("base_failed", "boolean"), ("quality_margin", "double"), ("kept", "boolean")]
    named = [((names or {}).get(n, n), t) for n, t in named]

    def make():
        def run(texts):
            found = [counts_of(t) for t in texts]
            counts = list(zip(*(c for c, _ in found))) if found else [[]] * len(COUNTS)
            failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c, _ in found]
            margins = np.zeros(len(found))
            if forest is not None and found:
                margins = forest.margins(np.array([x for _, x in found]))
            bound = forest.threshold if forest is not None else 0.0
            kept = [not f and bool(m >= bound) for f, m in zip(failed, margins)]
            return [*counts, failed, margins, kept]

        return run

    return map_texts(df, text, named, make)
