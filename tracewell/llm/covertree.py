"""Exact top-k inner products by dual-tree search over cover trees.

A cover tree has levels: a node of level i has a data point as its centre and covers its points within 2**i; its children, at the level below, are centred
on points over 2**(i-1) apart from each other (the first is the node's own centre, so levels are nested) and cover within 2**(i-1). Levels at which a node has
only its own centre are passed over. A node that more than FAN children would have to cover is a leaf: its points are too far apart in too many
directions for any ball to separate them, and it is scored by one product.

One index spans the data. Its upper part is a cover tree of a bounded sample (SAMPLE vectors, those with the smallest hashes), whose nodes are cut where they get small;
every row goes to the nearest of their centres, and true radii are aggregated over all rows, so bounds hold whatever the sample. Queries are indexed with
the same centres. Each group of queries first searches the part it lies in, which gives its worst kth score. Then pairs of a query group and a part whose bound on
the inner product (from centres and covering radii) is below that score are dropped before anything is shuffled, and only the others meet, block by block, where
the trees below are walked in pairs of nodes under the same rule.

Scores are exact: float products while all sums stay below 2**53, else integer products; vectors whose products could leave 63 bits are refused with an
error, never wrapped. Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors meet only
vectors of equal length; fully equal rows count once; a query's own id is never its answer; fewer than k others: all of them; ties go to the smaller id; equal
vectors are one point of a block with its k + 1 smallest ids; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, ship

#: Most children of a node, and most points of a leaf that is not split.
FAN, LEAF = 64, 48
#: Vectors in a block of queries and in a block of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Vectors of the sample that the upper part is built of, and most parts.
SAMPLE, PARTS = 8192, 256
_SLACK = 1e-9


class CoverTree:
    """Nodes over points (rows of x) in tree order; node i holds points start[i]:stop[i], is centred on point centre[i] and covers within radius[i] (the true
    radius, at most 2**level[i])."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.x, self.order = x, np.arange(len(x))
        self.start, self.stop, self.radius, self.level, self.centre, self.children = [], [], [], [], [], []
        square = (x**2).sum(1)

        def gaps(own: np.ndarray, point: int) -> np.ndarray:
            d = square[own] - 2 * (x[own] @ x[point]) + square[point]
            near = np.flatnonzero(d < 1e-6 * (square[own] + square[point]))  # cancellation: computed again as a difference
            if len(near):
                d[near] = ((x[own[near]] - x[point]) ** 2).sum(1)
            return np.sqrt(np.maximum(d, 0.0))

        todo = [(0, len(x), 0, -1)] if len(x) else []
        while todo:
            start, stop, centre, parent = todo.pop()
            own = self.order[start:stop]
            away = gaps(own, centre)
            radius = float(away.max())
            me = len(self.start)
            self.start.append(start)
            self.stop.append(stop)
            self.radius.append(radius * (1 + _SLACK) + _SLACK)
            self.level.append(math.ceil(math.log2(radius)) if radius > 0 else -1074)
            self.centre.append(centre)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if stop - start <= leaf or radius == 0:
                continue
            # the own centre, then the farthest point, until all lie within half the level's reach: picks are over that apart
            reach = 2.0 ** (self.level[me] - 1)
            group, picks = np.zeros(len(own), np.int64), [centre]
            near = away.copy()
            while near.max() > reach and len(picks) <= fan:
                pick = int(own[near.argmax()])
                far = gaps(own, pick)
                group = np.where(far < near, len(picks), group)
                near = np.minimum(near, far)
                picks.append(pick)
            if len(picks) > fan:
                continue
            turn = np.argsort(group, kind="stable")
            self.order[start:stop] = own[turn]
            at = start
            for pick, size in zip(picks, np.bincount(group, minlength=len(picks)).tolist()):
                if size:
                    todo.append((at, at + size, pick, me))
                at += size
        self.radius = np.array(self.radius)
        self.points = x[self.centre] if self.centre else np.zeros((0, x.shape[1]))
        self.norm = np.sqrt((self.points**2).sum(1))

    def cut(self, most: int) -> list[int]:
        """Nodes that partition the points: the largest are opened while there are fewer than most."""
        open_ = [0] if self.start else []
        while True:
            grown = [(self.stop[i] - self.start[i], i) for i in open_ if self.children[i]]
            if not grown:
                return open_
            _, i = max(grown)
            if len(open_) - 1 + len(self.children[i]) > most:
                return open_
            open_.remove(i)
            open_ += self.children[i]


def bound(q: np.ndarray, rq: np.ndarray, x: np.ndarray, rx: np.ndarray) -> np.ndarray:
    """An upper bound of the inner products of two balls, with room for rounding."""
    dots = q @ x.T
    nq, nx = np.sqrt((q**2).sum(-1)), np.sqrt((x**2).sum(-1))
    slack = np.multiply.outer(rq, nx) + np.multiply.outer(nq, rx) + np.multiply.outer(rq, rx)
    return dots + slack + 1e-6 * (1 + np.abs(dots) + slack)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; an error if they could leave 63 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top >= 2**63:
        raise ValueError("inner products of these vectors do not fit into 63 bits")
    return a @ b.T


def search(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None, count: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query of two blocks of integer vectors: scores, ids and the number found. floor: scores that a query has k answers of already;
    worse candidates may be left out. count: gets the number of pairs that were scored."""
    low = np.iinfo(np.int64).min
    best, names = np.full((len(q), k), low), np.full((len(q), k), np.iinfo(np.int64).max)
    if not len(q) or not len(x):
        return best, names, np.zeros(len(q), np.int64)
    # equal vectors are one point with its k + 1 smallest ids
    by_id = np.argsort(x_ids, kind="stable")
    x, x_ids = x[by_id], x_ids[by_id]
    points, which = np.unique(x, axis=0, return_inverse=True)
    which = which.ravel()
    turn = np.argsort(which, kind="stable")
    place = np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(np.bincount(which))[:-1]], np.bincount(which))
    turn = turn[place <= k]
    owner, owned = which[turn], x_ids[turn]
    first = np.searchsorted(owner, np.arange(len(points) + 1))
    single = len(owner) == len(points)
    qt, xt = CoverTree(q.astype(np.float64)), CoverTree(points.astype(np.float64))
    base = np.full(len(q), low) if floor is None else np.asarray(floor, np.int64)
    kth = base[qt.order].copy()  # in the order of qt
    todo = [(math.inf, 0, 0)]
    while todo:
        top, a, b = todo.pop()
        if top < kth[qt.start[a] : qt.stop[a]].min():
            continue
        q_parts, x_parts = qt.children[a], xt.children[b]
        if q_parts and (not x_parts or qt.radius[a] >= xt.radius[b]):
            tops = bound(qt.points[q_parts], qt.radius[q_parts], xt.points[[b]], xt.radius[[b]])[:, 0]
            pairs = [(float(t), c, b) for t, c in zip(tops, q_parts)]
        elif x_parts:
            tops = bound(qt.points[[a]], qt.radius[[a]], xt.points[x_parts], xt.radius[x_parts])[0]
            pairs = [(float(t), a, c) for t, c in zip(tops, x_parts)]
        else:
            rows, own = qt.order[qt.start[a] : qt.stop[a]], xt.order[xt.start[b] : xt.stop[b]]
            if count is not None:
                count.append(len(rows) * len(own))
            _score(q, q_ids, points, rows, own, first, owned, single, k, best, names, kth, qt.start[a])
            continue
        todo.extend(sorted(pairs))  # the most promising pair is walked first
    return best, names, (best > low).sum(1)


def _score(q, q_ids, points, rows, own, first, owned, single, k, best, names, kth, at, piece: int = 2048) -> None:
    """Scores the points of two leaves and merges them into the answers of the queries."""
    low = np.iinfo(np.int64).min
    for a in range(0, len(rows), 512):
        mine = rows[a : a + 512]
        for b in range(0, len(own), piece):
            part = own[b : b + piece]
            scores = product(q[mine], points[part])
            live = np.flatnonzero((scores >= kth[at + a : at + a + len(mine), None]).any(1))
            if not len(live):
                continue
            if single:
                cols, ids = np.arange(len(part)), owned[first[part]]
            else:
                cols = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
                ids = np.concatenate([owned[first[p] : first[p + 1]] for p in part])
            who = mine[live]
            s, n = scores[live][:, cols], np.broadcast_to(ids, (len(live), len(ids)))
            s = np.where(n == q_ids[who, None], low, s)
            if s.shape[1] > 4 * k:  # only what reaches the kth of its own row, ties included, is sorted
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                width = int((s >= edge[:, None]).sum(1).max())
                keep = np.argsort(-np.where(s >= edge[:, None], s, low).astype(np.float64), axis=1, kind="stable")[:, :width] if np.abs(s[s > low]).max(initial=0) < 2**53 else np.argsort(~s, axis=1, kind="stable")[:, :width]
                s, n = np.take_along_axis(s, keep, 1), np.take_along_axis(n, keep, 1)
            s, n = np.concatenate([best[who], s], 1), np.concatenate([names[who], n], 1)
            pick = np.lexsort((n, ~s), axis=-1)[:, :k]
            best[who], names[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(n, pick, 1)
            kth[at + a + live] = np.maximum(kth[at + a + live], best[who, k - 1])


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        F.coalesce(vector, F.array().cast("array<double>")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    )


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 1), np.int64)


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, sample: int = SAMPLE, parts: int = PARTS, stats: dict | None = None,
) -> DataFrame:
    """query_id, rank, the candidate's key and score (inner product of floor(scale * component)) of each row that is_query holds for,
    against all rows but its own. stats: gets the numbers of block pairs that there are and that were searched."""
    spark = df.sparkSession
    ship(spark)
    space = Workspace(spark, "covertree")
    doubles = F.col(vector).cast("array<double>")
    whole = F.transform(doubles, lambda v: F.when(F.abs(v * F.lit(scale)) < 2.0**62, F.floor(v * F.lit(scale))).otherwise(F.raise_error(F.lit("a component is out of range")).cast("long")))
    rows = df.where(F.col(key).isNotNull() & _finite(doubles)).select(
        F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).distinct().withColumn("dim", F.size("v"))
    rows = space.save("rows", rows)
    # the upper part of the index, of a bounded sample for each length
    total = rows.count()
    span = min(1.0, 2.0 * sample / max(total, 1))  # few more than the sample takes, so no task gets more than a multiple of it
    near = rows.where(F.xxhash64("id", "v") <= F.lit(min(2**63 - 1, int(-(2**63) + span * 2**64))))
    picked = near.withColumn("_n", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id", "v"), "id"))).where(F.col("_n") <= sample)
    heads = {}
    for dim, own in picked.select("dim", "v").toPandas().groupby("dim"):
        x = np.unique(np.stack(own["v"].to_numpy()).astype(np.float64), axis=0) if dim else np.zeros((1, 0))
        tree = CoverTree(x, leaf=max(LEAF, len(x) // parts))
        heads[int(dim)] = x[[tree.centre[i] for i in tree.cut(parts)]]

    def centres(dim: int) -> np.ndarray:  # lengths too rare for the sample are one part around the origin
        return heads.get(dim, np.zeros((1, dim)))

    def placed(batches):
        for b in batches:
            part, away = np.zeros(len(b), np.int64), np.zeros(len(b))
            for dim, at in b.groupby("dim").indices.items():
                x, c = np.stack(b["v"].to_numpy()[at]).astype(np.float64), centres(int(dim))
                d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
                part[at] = d.argmin(1)
                away[at] = np.sqrt(((x - c[part[at]]) ** 2).sum(1))
            yield b.assign(part=part.astype(np.int32), away=away)

    rows = space.save("placed", rows.mapInPandas(placed, "id long, v array<long>, asks boolean, dim int, part int, away double"))
    sizes = rows.groupBy("dim", "part").agg(
        F.count("*").alias("n"), F.max("away").alias("r"), F.sum(F.col("asks").cast("long")).alias("nq"), F.max(F.when(F.col("asks"), F.col("away"))).alias("rq")
    ).collect()  # fmt: skip  # at most `parts` rows for each length of vectors
    known = {(s["dim"], s["part"]): s for s in sizes}
    blocks = lambda n, most: max(1, -(-n // most))
    table = [(s["dim"], s["part"], blocks(s["n"], candidate_block), blocks(s["nq"] or 0, query_block)) for s in sizes]
    if not table or not any(s["nq"] for s in sizes):
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    dealt = rows.join(F.broadcast(spark.createDataFrame(table, "dim int, part int, nc int, ng int")), ["dim", "part"])
    dealt = dealt.withColumns({"block": F.pmod(F.xxhash64("id"), "nc").cast("int"), "group": F.pmod(F.xxhash64("id", F.lit(5)), "ng").cast("int")})
    queries, candidates = dealt.where("asks").select("id", "v", "dim", F.col("part").alias("qp"), "group"), dealt.select("id", "v", "dim", "part", "block")
    by = ["dim", "qp", "group", "part", "block"]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q_ids, floor = q["id"].to_numpy(), q["kth"].to_numpy() if "kth" in q else None
        best, names, found = search(_stack(q["v"]), q_ids, _stack(c["v"]), c["id"].to_numpy(), k, floor)
        took = np.arange(k)[None, :] < found[:, None]
        return pd.DataFrame({"query_id": np.repeat(q_ids, found), "vec_id": names[took], "score": best[took]})

    def met(pairs: DataFrame, asked: DataFrame, name: str) -> DataFrame:
        """Answers of the pairs (dim, qp, group, part, block) of query groups and candidate blocks."""
        small = F.broadcast(pairs) if pairs.count() <= 200_000 else pairs
        left, right = asked.join(small, ["dim", "qp", "group"]), candidates.join(small, ["dim", "part", "block"])
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides come from one table
        got = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return space.save(name, got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))

    # home first: the first block of the part that a group lies in
    home = [(d, p, g, p, 0) for d, p, _, ng in table if known[d, p]["nq"] for g in range(ng)]
    schema = "dim int, qp int, group int, part int, block int"
    first = met(spark.createDataFrame(home, schema), queries, "home")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("id", "kth")
    floor = F.coalesce("kth", F.lit(np.iinfo(np.int64).min).cast("long"))
    asked = space.save("asked", queries.join(kth, "id", "left").withColumn("kth", floor))
    worst = asked.groupBy("dim", "qp", "group").agg(F.min("kth").alias("worst"))

    def survivors(batches):
        for b in batches:
            out = []
            for dim, qp, group, least in zip(b["dim"], b["qp"], b["group"], b["worst"]):
                others = [(p, n) for d, p, n, _ in table if d == dim]
                c = centres(int(dim))
                mine = c[[qp]]
                tops = bound(mine, np.array([known[dim, qp]["rq"] + _SLACK]), c[[p for p, _ in others]], np.array([known[dim, p]["r"] + _SLACK for p, _ in others]))[0]
                out += [(dim, qp, group, p, i) for (p, n), t in zip(others, tops) if t >= least for i in range(n) if (p, i) != (qp, 0)]
            yield pd.DataFrame(out, columns=["dim", "qp", "group", "part", "block"]).astype(np.int32)

    left = space.save("left", worst.mapInPandas(survivors, schema))
    if stats is not None:
        stats["searched"], stats["all"] = left.count() + len(home), sum(n for *_, n, _ in table) * len(home)
    rest = met(left, asked, "rest")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")
