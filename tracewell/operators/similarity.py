"""Similarity joins by exact cosines, within blocks of a key or over all pairs.

Edge cases: null vectors, and those of length 0 or with a null component, have no cosine and meet nothing; vectors of unequal lengths have none either;
repeated rows meet each other as often as they stand; an empty table gives no pairs; extra columns are only carried where `keep` says so."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block at most, about; vectors under which blocks are not made smaller for the sake of more tasks; cosines computed at once.
BLOCK_ROWS, LEAST_ROWS, TILE = 4_096, 500, 1 << 19


def blocked_cosine(df: DataFrame, key: str, vector: str, block: str, least: float) -> DataFrame:
    """(block, a, b, cosine) of the pairs a < b within a block with a cosine over a bound; vectors are normalised once, before
    the join."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = df.select(F.col(key).alias("k"), F.col(block).alias("blk"), F.transform(v, lambda x: F.try_divide(x, norm)).alias("u"))
    left, right = unit.select("blk", F.col("k").alias("a"), F.col("u").alias("x")), unit.select("blk", F.col("k").alias("b"), F.col("u").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return left.join(right, "blk").where("a < b").withColumn("cosine", F.round(dot, 6)).where(F.col("cosine") > least).select(F.col("blk").alias(block), "a", "b", "cosine")


def all_cosine(
    df: DataFrame, key: str, vector: str, least: float, rows: int = BLOCK_ROWS, keep: tuple[str, ...] = (), by: Column | None = None,
    floors: dict[tuple[int, int], float] | None = None, top: str | None = None,
) -> DataFrame:
    """(a, b, cosine) of all pairs a < b with a cosine (of six digits) over a bound. Vectors are dealt to blocks of about `rows`, and every two blocks meet once, as
    products of matrices in Arrow workers, so no pair is left out and no task holds more than two blocks and one tile of their pairs. Cosines that a product of
    matrices leaves too near the middle of two roundings are summed again in the order of the components. keep: columns carried along as a_ and b_.
    by, floors: other bounds for the pairs of two classes (in either order); an infinite one leaves the pairs of its classes out. top: a column of which only the
    highest pairs of each two values, block by block and tile by tile, are returned, so that their maxima are those of all pairs."""
    n_all, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-n_all // rows), min(-(-n_all // LEAST_ROWS), math.isqrt(4 * cores) + 1))
    kind = df.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    classes = F.lit(None).cast("long") if by is None else by.cast("long")
    held = df.select(F.col(key).alias("k"), v.alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"), classes.alias("class"), *(F.col(c).alias(f"keep_{c}") for c in keep), *([F.col(top).alias("top")] if top else []))
    held = held.where(F.col("k").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    held = held.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    groups = n * (n + 1) // 2
    held = held.repartition(max(groups, min(4 * groups, 200)), "i", "j")  # by number: small blocks make many pairs
    fields = [T.StructField("a", df.schema[key].dataType), T.StructField("b", df.schema[key].dataType), T.StructField("cosine", T.DoubleType())]
    fields += [T.StructField(f"{x}_{c}", df.schema[c].dataType) for x in "ab" for c in keep]
    return held.groupBy("i", "j").applyInArrow(_meeting(float(least), keep, floors or {}, top is not None, TILE), T.StructType(fields))


def _meeting(least: float, keep: tuple[str, ...], floors: dict[tuple[int, int], float], top: bool, tile: int):
    """The function of two blocks; it names nothing of this module, so workers need not have it."""
    listed = sorted({c for pair in floors for c in pair})

    def codes(column) -> np.ndarray:
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def unrounded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dot, p, q = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for d in range(x.shape[1]):
            dot, p, q = dot + x[:, d] * y[:, d], p + x[:, d] * x[:, d], q + y[:, d] * y[:, d]
        return dot / np.sqrt(p * q)

    def rounded(c: np.ndarray) -> np.ndarray:
        whole = np.trunc(v := c * 1e6)
        return (whole + np.where(np.abs(v - whole) >= 0.5, np.copysign(1.0, v), 0.0)) / 1e6

    def meet(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        one = lambda name: table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)
        keys, lists, own = one("k"), one("v"), one("own").to_numpy()
        order = keys.to_numpy() if pa.types.is_integer(keys.type) else pc.rank(keys, tiebreaker="dense").to_numpy()
        sizes, flat, starts = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        kinds = np.full(len(keys), -1)
        if listed:
            named = one("class")
            for c, name in enumerate(listed):
                kinds[pc.fill_null(pc.equal(named, name), False).to_numpy(zero_copy_only=False)] = c
        tops = codes(one("top")).astype(np.int64) if top else None
        carried = [one(f"keep_{c}") for c in keep]
        left, right = of[0].as_py(), of[1].as_py()
        names = ["a", "b", "cosine", *(f"{x}_{c}" for x in "ab" for c in keep)]

        def batch(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
            a, b = pa.array(a), pa.array(b)
            return pa.RecordBatch.from_arrays([keys.take(a), keys.take(b), pa.array(cosine), *(c.take(x) for x in (a, b) for c in carried)], names)

        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            raw = flat[starts[at][:, None] + np.arange(size)].astype(np.float64)
            with np.errstate(all="ignore"):
                norm = np.sqrt((raw * raw).sum(1))
                some = ~(norm == 0)
                at, raw, unit = at[some], raw[some], raw[some] / norm[some, None]
            parts = {}
            for side in {left, right}:
                for c in np.unique(kinds[at]):
                    parts[side, int(c)] = np.flatnonzero((own[at] == side) & (kinds[at] == c))
            for (s, p), xs in parts.items():
                for (t, q), ys in parts.items():
                    same = s == t and p == q
                    if (s, t) != (left, right) or not len(xs) or not len(ys) or (left == right and p > q):
                        continue
                    pair = (listed[p] if p >= 0 else None, listed[q] if q >= 0 else None)
                    floor = floors.get(pair, floors.get(pair[::-1], least))
                    if floor == math.inf:
                        continue
                    step, most = max(1, tile // len(ys)), unit[ys]
                    for k in range(0, len(xs), step):
                        first = k if same else 0  # of a block's pairs with itself only those above the diagonal
                        with np.errstate(all="ignore"):
                            cosine = unit[xs[k : k + step]] @ most[first:].T
                        i, j = np.nonzero(~(cosine <= floor - 1e-6))
                        cosine = cosine[i, j]
                        if same:
                            i, j, cosine = i[j > i], j[j > i] + first, cosine[j > i]
                        i, j = xs[i + k], ys[j]
                        with np.errstate(all="ignore"):
                            near = np.flatnonzero(np.abs(np.abs(cosine * 1e6 % 1.0) - 0.5) < 1e-4)
                            for z in range(0, len(near), 1 << 16):
                                cosine[near[z : z + (1 << 16)]] = unrounded(raw[i[near[z : z + (1 << 16)]]], raw[j[near[z : z + (1 << 16)]]])
                            cosine = rounded(cosine)
                        i, j = at[i], at[j]
                        kept = ~(cosine <= floor) & (order[i] != order[j])
                        i, j, cosine = i[kept], j[kept], cosine[kept]
                        if top and len(i):
                            low, high = np.minimum(tops[i], tops[j]), np.maximum(tops[i], tops[j])
                            code = low * (len(keys) + 1) + high
                            by_code = np.lexsort((cosine, code))
                            last = by_code[np.append(np.flatnonzero(np.diff(code[by_code])), len(code) - 1)]
                            i, j, cosine = i[last], j[last], cosine[last]
                        if len(i):
                            before = order[i] < order[j]
                            yield batch(np.where(before, i, j), np.where(before, j, i), cosine)

    return meet
