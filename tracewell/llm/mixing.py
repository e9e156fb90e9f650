"""Mixing documents to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). The cells' weights are raked in turn to the target shares of each
marginal until all hold. A document is drawn with probability min(1, scale * target weight / tokens of its cell), where the scale
makes the expected tokens equal the budget; the draw is a hash of the document and the seed, so it repeats.

Topics are clusters of texts: spherical k-means over hashed counts of long words, damped by their logarithm, weighted by how rare a feature is in all texts and of unit
length. Weights and centres are fitted on all texts: their counts are written once, sparse, and each round is a pass over them that sends sums by centre to the driver (up
to DRIVER_TEXTS texts the driver makes the passes itself). Vectors are whole numbers of steps of 1 / ONE, so that sums, and with them topics, do not depend on
the order or the place of the rows. Every text goes to the centre nearest to it.

Raking runs on the driver up to DRIVER_CELLS cells and on tables above, by the same rule: until no marginal is off by more than CLOSE, or for
ROUNDS rounds. If it has not converged by then (targets that the cells cannot meet) it warns and says how far off it is.

Edge cases: null sources, languages and texts form cells of their own (text null: no tokens, topic 0); texts without long words have topic 0; a target for a
value that no document has is left out and the rest are scaled up; without documents or tokens nothing is drawn; rows that repeat id and text
are drawn together; documents without tokens are drawn with their cell's probability; an empty table gives an empty result; extra columns pass through, and
results get other names where columns have theirs.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, fresh, map_texts

#: Topics, hashed features, rounds of the fit, and texts up to which the driver makes its passes.
TOPICS, FEATURES, FIT_ROUNDS, DRIVER_TEXTS = 8, 512, 20, 4000
#: Steps of a unit vector's components, and texts whose features are packed together.
ONE, PACKED = 1 << 20, 32
#: Bytes from which a word is a feature.
LONG = 5
#: Cells that the driver rakes itself; above that the raking runs on tables.
DRIVER_CELLS = 100_000
#: Rounds of raking, and how close the marginals must come.
ROUNDS, CLOSE = 500, 1e-10


class RakingWarning(UserWarning):
    """Marginals that raking did not bring to their targets."""


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of a text's hashed long words, and the number of its words."""
    words = (text or "").lower().encode().split()
    hashed = [zlib.crc32(w) % FEATURES for w in words if len(w) >= LONG]
    return np.bincount(hashed, minlength=FEATURES), len(words)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in steps."""
    norm = np.sqrt((x**2).sum(-1, keepdims=True))
    return np.rint(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) * ONE)


def _units(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Texts as damped and weighted unit vectors."""
    return _unit(np.log1p(counts) * weights)


def _packed(x: np.ndarray) -> bytes:
    """Rows of whole numbers without their zeros."""
    row, at = np.nonzero(x)
    return b"".join(y.tobytes() for y in (np.array([len(x)], "<u4"), np.bincount(row, minlength=len(x)).astype("<u4"), at.astype("<u2"), x[row, at].astype("<u4")))


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", n, 4)
    total = int(sizes.sum())
    x = np.zeros((n, FEATURES))
    x[np.repeat(np.arange(n), sizes), np.frombuffer(raw, "<u2", total, 4 + 4 * n)] = np.frombuffer(raw, "<u4", total, 4 + 4 * n + 2 * total)
    return x


#: A pass: a function of packed rows that gives bytes, and what it gave for each part of the rows.
Pass = Callable[[Callable[[Iterable[bytes]], bytes]], list[bytes]]


def _sums(over: Pass, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums over all rows: of gives those of some rows."""

    def run(packs):
        total = np.zeros((size, FEATURES), np.int64)
        for raw in packs:
            total += of(_unpacked(raw)).astype(np.int64)
        return total.tobytes()

    return sum((np.frombuffer(x, np.int64).reshape(size, FEATURES) for x in over(run)), np.zeros((size, FEATURES), np.int64))


def _best(over: Pass, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The row with the largest score; among equal ones the largest bytes."""

    def run(packs):
        most = None
        for raw in packs:
            x = _unpacked(raw)
            by = score(x)
            top = np.flatnonzero(by == by.max())
            most = max((*([most] if most else []), *((float(by[k]), _packed(x[k : k + 1])) for k in top.tolist())))
        return np.array([most[0]]).tobytes() + most[1] if most else b""

    found = [(np.frombuffer(x, np.float64, 1)[0], x[8:]) for x in over(run) if x]
    return _unpacked(max(found)[1])[0]


def fit_topics(over: Pass, n: int, topics: int = TOPICS) -> np.ndarray:
    """Centres of clusters of n unit rows. The first centre is the mean's nearest row, each next one the row farthest from all, so the fit repeats."""
    if not n:
        return np.zeros((1, FEATURES))
    mean = _unit(_sums(over, lambda x: x.sum(0, keepdims=True), 1).astype(float))[0]
    centres = _best(over, lambda x: x @ mean)[None]
    while len(centres) < min(topics, n):
        now = centres
        centres = np.concatenate([centres, _best(over, lambda x: -(x @ now.T).max(1))[None]])  # noqa: B023
    for _ in range(FIT_ROUNDS):
        now = centres
        sums = _sums(over, lambda x: np.eye(len(now))[(x @ now.T).argmax(1)].T @ x, len(now))  # noqa: B023
        centres = np.where(sums.any(1, keepdims=True), _unit(sums.astype(float)), now)
        if np.allclose(centres, now, atol=1e-8 * ONE):
            break
    return centres


def with_topics(
    df: DataFrame, text: str = "text", names: tuple[str, str] = ("topic", "n_tokens"), topics: int = TOPICS, driver_texts: int = DRIVER_TEXTS,
) -> DataFrame:
    """Adds the topic of each text and the number of its words."""
    space = Workspace(df.sparkSession, "topics")

    def mapped(table: DataFrame, run) -> DataFrame:
        """run: from packed rows to pairs of a number and bytes."""

        def each(batches):
            for n, raw in run(x for batch in batches for x in batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([n], pa.int64())], ["_x", "_n"])

        return table.mapInArrow(each, "_x binary, _n long")

    def counted(texts):
        held = []
        for t in texts:
            x = features(t)[0]
            if x.any():
                held.append(x)
            if len(held) == PACKED:
                yield len(held), _packed(np.stack(held))
                held = []
        if held:
            yield len(held), _packed(np.stack(held))

    rows = space.save("counts", mapped(df.select(text), counted))
    n = rows.agg(F.sum("_n")).first()[0] or 0
    packs = [bytes(r["_x"]) for r in rows.select("_x").collect()] if n <= driver_texts else None

    def over(run):
        if packs is not None:
            return [run(packs)]
        return [bytes(r["_x"]) for r in mapped(rows, lambda found: [(0, run(found))]).select("_x").collect()]

    holding = _sums(over, lambda x: (x > 0).sum(0, keepdims=True), 1)[0]
    weights = np.log((n + 1) / (holding + 1)) + 0.1
    if packs is not None:
        packs = [_packed(_units(_unpacked(x), weights)) for x in packs]
    else:
        rows = space.save("units", mapped(rows.select("_x"), lambda found: ((0, _packed(_units(_unpacked(x), weights))) for x in found)))
    space.drop("counts")
    centres = fit_topics(over, n, topics)
    space.drop("units")

    def make():
        def run(texts):
            got = [features(t) for t in texts]
            if not got:
                return [], []
            x = np.stack([g for g, _ in got])
            of = (_units(x, weights) @ centres.T).argmax(1)
            return np.where(x.any(1), of, 0).astype(np.int32), [k for _, k in got]

        return run

    return map_texts(df, text, [(names[0], "int"), (names[1], "long")], make)


def _told(worst: float, close: float) -> None:
    if worst >= close:
        warnings.warn(f"raking stopped with marginals off by {worst:.3g}: the cells cannot meet the targets", RakingWarning, stacklevel=3)


def rake(cells: Mapping[tuple, float], targets: list[Mapping], rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple, float]:
    """Cell weights that have the marginal shares of targets (one mapping for each position of the keys, whole or partial
    sums scaled to 1) and the association of the cells' tokens. Warns if the marginals are off by close or more after all rounds."""
    weights = {k: float(v) for k, v in cells.items() if v > 0}
    total = sum(weights.values())
    if not total:
        return {}
    weights = {k: v / total for k, v in weights.items()}
    wanted = []
    for j, target in enumerate(targets):
        there = {k[j] for k in weights}
        shares = {x: float(target.get(x, 0.0)) for x in there}
        scale = sum(shares.values())
        wanted.append({x: s / scale for x, s in shares.items()} if scale else {x: 1 / len(there) for x in there})
    for _ in range(rounds):
        worst = 0.0
        for j, shares in enumerate(wanted):
            have: dict = defaultdict(float)
            for k, w in weights.items():
                have[k[j]] += w
            factor = {x: shares[x] / h if h > 0 else 0.0 for x, h in have.items()}
            worst = max(worst, max(abs(shares[x] - h) for x, h in have.items()))
            weights = {k: w * factor[k[j]] for k, w in weights.items()}
        if worst < close:
            break
    _told(worst if wanted else 0.0, close)
    return weights


def calibrate(cells: Mapping[tuple, float], weights: Mapping[tuple, float], budget: float) -> dict[tuple, float]:
    """Probabilities by cell: min(1, scale * weight / tokens), with the expected tokens equal to the budget (all of the weighted
    cells, if the budget is over their tokens)."""
    keys = [k for k in weights if weights[k] > 0]
    if not keys:
        return {}
    w, n = np.array([weights[k] for k in keys]), np.array([cells[k] for k in keys], float)
    budget = min(budget, n.sum())
    open_ = np.ones(len(keys), bool)
    while True:  # cells that reach 1 leave; the rest share what is left
        left = budget - n[~open_].sum()
        scale = left / w[open_].sum() if open_.any() else 0.0
        full = open_ & (scale * w >= n)
        if not full.any():
            break
        open_ &= ~full
    p = np.where(open_, np.minimum(1.0, scale * w / n), 1.0)
    return dict(zip(keys, p.tolist()))


def _rake_tables(cells: DataFrame, targets: list[Mapping | None], dims: list[str], budget: float, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """rake() and calibrate() on tables, for cell counts over DRIVER_CELLS, by the same rules. cells: those with tokens. Targets are tables too, tempered ones made
    of the cells. Adds _weight and _p."""
    space = Workspace(cells.sparkSession, "rake")
    spark = cells.sparkSession
    total = cells.agg(F.sum("_n")).first()[0] or 0
    now = space.save("w0", cells.withColumn("_weight", F.col("_n") / F.lit(float(total or 1))))
    wanted = []
    for j, dim in enumerate(dims):
        have = now.groupBy(dim).agg(F.sum("_n").alias("_n"))
        if targets[j] is None:
            shares = have.select(dim, F.pow(F.col("_n").cast("double"), F.lit(POWER)).alias("_t"))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[j].items()] or [("", 0.0)], f"{dim} string, _t double")
            shares = have.select(dim).join(given, dim, "left").fillna(0.0, ["_t"])
        sums = shares.agg(F.sum("_t"), F.count("*")).first()
        even = 1.0 / max(sums[1], 1)
        wanted.append(space.save(f"target{j}", shares.select(dim, (F.col("_t") / F.lit(sums[0]) if sums[0] else F.lit(even)).alias("_t"))))
    worst = 0.0
    for r in range(rounds):
        worst = 0.0
        for j, dim in enumerate(dims):
            have = space.save(f"have{r}_{j}", now.groupBy(dim).agg(F.sum("_weight").alias("_h")).join(wanted[j], dim))
            worst = max(worst, have.agg(F.max(F.abs(F.col("_h") - F.col("_t")))).first()[0] or 0.0)
            factor = have.select(dim, F.when(F.col("_h") > 0, F.col("_t") / F.col("_h")).otherwise(0.0).alias("_f"))
            now = now.join(factor, dim).withColumn("_weight", F.col("_weight") * F.col("_f")).drop("_f")
        now = space.save(f"w{r + 1}", now)
        for name in (f"w{r}", *(f"have{r}_{j}" for j in range(len(dims)))):
            space.drop(name)
        if worst < close:
            break
    _told(worst, close)
    # cells that reach 1 leave; the rest share what is left, as in calibrate()
    rows = now.where("_weight > 0")
    used = rows.agg(F.sum("_n")).first()[0] or 0
    budget, full, scale = min(budget, float(used)), F.lit(False), 0.0
    while used:
        s = rows.agg(F.sum(F.when(full, F.col("_n")).otherwise(0)), F.sum(F.when(~full, F.col("_weight")).otherwise(0.0)), F.sum(full.cast("long"))).first()
        scale = (budget - s[0]) / s[1] if s[1] else math.inf
        reach = F.lit(scale) * F.col("_weight") >= F.col("_n")
        if rows.where(full | reach).count() == s[2] or not s[1]:
            break
        full = full | reach
    p = F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.lit(scale) * F.col("_weight") / F.col("_n")))
    return now.withColumn("_p", F.when((F.col("_weight") > 0) & F.lit(bool(used)), p).otherwise(0.0))


#: Power of the tokens that a tempered target is in proportion to.
POWER = 0.5


def tempered(cells: Mapping[tuple, float], position: int, power: float = POWER) -> dict:
    """Target shares in proportion to a power of the tokens: small sources gain, large ones lose."""
    have: dict = defaultdict(float)
    for k, v in cells.items():
        have[k[position]] += v
    scale = sum(v**power for v in have.values()) or 1.0
    return {x: v**power / scale for x, v in have.items()}


def mix(
    df: DataFrame, targets: list[Mapping | None] | None = None, share: float = 0.5, seed: int = 11, source: str = "source",
    lang: str = "lang", text: str = "text", key: str = "doc_id", tabled: DataFrame | None = None,
    driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS,
) -> tuple[DataFrame, dict[str, str]]:
    """Adds topic, n_tokens, weight, probability and kept to each row; the mapping names the columns that carry them. targets:
    shares by source, language and topic (None: tempered); share: the part of all tokens to draw."""
    out = {n: fresh(df, n) for n in ("topic", "n_tokens", "weight", "probability", "kept", "u")}
    rows = tabled if tabled is not None else with_topics(df, text, (out["topic"], out["n_tokens"]))
    dims = [fresh(df, f"_dim{j}") for j in range(3)]
    rows = rows.withColumns({
        dims[0]: F.coalesce(F.col(source).cast("string"), F.lit("\0")),
        dims[1]: F.coalesce(F.col(lang).cast("string"), F.lit("\0")),
        dims[2]: F.col(out["topic"]).cast("string"),
    })
    grouped = rows.groupBy(*dims).agg(F.sum(out["n_tokens"]).alias("_n"))
    got = grouped.limit(driver_cells + 1).collect()
    total = float(sum(r["_n"] or 0 for r in got))
    targets = list(targets or [None] * 3)
    if len(got) <= driver_cells:
        cells = {tuple(r[d] for d in dims): float(r["_n"] or 0) for r in got}
        targets = [t if t is not None else tempered(cells, j) for j, t in enumerate(targets)]
        weights = rake(cells, targets, rounds)
        odds = calibrate(cells, weights, share * total)
        made = [(*k, weights.get(k, 0.0), odds.get(k, 0.0)) for k in cells]
        table = df.sparkSession.createDataFrame(made, ", ".join(f"{d} string" for d in dims) + ", _weight double, _p double")
        table = F.broadcast(table)  # at most driver_cells rows
    else:
        cells = Workspace(df.sparkSession, "cells").save("cells", grouped)
        total = cells.agg(F.sum("_n")).first()[0]
        table = _rake_tables(cells.where("_n > 0"), targets, dims, share * total, rounds).select(*dims, "_weight", "_p")
    seen = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.lit("|"), F.xxhash64(F.col(text) if text in rows.columns else F.lit(0)))
    u = (F.shiftrightunsigned(seen, 11).cast("double") + 0.5) / F.lit(float(2**53))
    joined = rows.join(table, dims, "left").withColumns({
        out["weight"]: F.coalesce("_weight", F.lit(0.0)), out["probability"]: F.coalesce("_p", F.lit(0.0)),
    })
    joined = joined.withColumn(out["kept"], u < F.col(out["probability"])).drop(*dims, "_weight", "_p")
    return joined, out
