"""Event sequences, pair statistics and path decoding.

Edge cases: null labels make no pairs; ratios whose denominator is 0 (weights that sum to 0, empty arrays) are null, and rows without a mean are their own
nearest; ties go by the columns that the caller names; repeated rows count as often as they stand; empty tables give empty results; extra columns
pass through where rows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_ids(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Zero-based rank of each row in its group."""
    return df.withColumn("order_id", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def edges(df: DataFrame, by: str, label: str, *order: str) -> DataFrame:
    """(source, target, n): consecutive labels of a group, unequal ones only."""
    after = F.lead(label).over(Window.partitionBy(by).orderBy(*order))
    pairs = df.select(F.col(label).alias("source"), after.alias("target")).where("target is not null and source <> target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


def pair_probability(pairs: DataFrame) -> DataFrame:
    """Each pair's share of its source's pairs."""
    total = pairs.groupBy("source").agg(F.sum("n").alias("_t"))
    return pairs.join(F.broadcast(total) if pairs.limit(10_001).count() <= 10_000 else total, "source").select(
        "source", "target", "n", F.round(F.col("n") / F.col("_t"), 6).alias("p")
    )


def weighted_location(df: DataFrame, keys: list[str], value: str, location: str) -> DataFrame:
    """Mean location by value."""
    return df.groupBy(*keys).agg(F.round(F.try_divide(F.sum(F.col(value) * F.col(location)), F.sum(value)), 4).alias("location"))


def closest(df: DataFrame, means: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """For each key the row whose place is nearest to the key's mean; min_by keeps a partial result a task."""
    gap = F.coalesce(F.round(F.abs(F.col(at) - F.col("location")), 4), F.lit(0.0))
    joined = df.join(means, keys)
    return joined.groupBy(*keys).agg(F.min_by(at, F.struct(gap, *ties)).alias(at), F.min(F.struct(gap.alias("g"), *ties)).alias("m")).select(*keys, at, F.col("m.g").alias("gap"))


def computed(df: DataFrame) -> DataFrame:
    """df with its columns computed once for each row: projections cannot be folded through a generator, so no later lambda repeats them."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def spread(places: Column) -> Column:
    """Population standard deviation of an array."""
    n = F.size(places)
    mean = F.try_divide(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), n)
    return F.sqrt(F.try_divide(F.aggregate(places, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n))


def sweep(df: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Rows once for each threshold they reach; decode them by (keys, threshold). Each row carries only the thresholds it passes, so nothing is
    crossed and then filtered."""
    passed = F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: t <= F.col(value))
    return df.withColumn("threshold", F.explode(passed))


def relative_rank(value: Column, places: Column) -> Column:
    """A value over the spread of its places (1 at least); without places over 1.5."""
    return F.when(F.size(places) == 0, value / 1.5).otherwise(value / F.greatest(F.lit(1.0), spread(F.array_distinct(places))))


def allowed(steps: DataFrame, by: str, step: str, order: str, pairs: DataFrame) -> DataFrame:
    """(by, n_steps, ok): whether every two neighbouring steps are among pairs (source, target), a small dimension table."""
    after = F.lead(step).over(Window.partitionBy(by).orderBy(order))
    rows = steps.select(by, F.col(step).alias("source"), after.alias("target")).join(F.broadcast(pairs.select("source", "target", F.lit(True).alias("_ok")).distinct()), ["source", "target"], "left")
    return rows.groupBy(by).agg(F.count("*").alias("n_steps"), F.bool_and(F.coalesce("_ok", F.col("target").isNull())).alias("ok"))


def without_repeated_bases(path: Column) -> Column:
    """Array of ids in order without those whose base (the part before a dot) came before."""
    base = lambda x: F.substring_index(x, ".", 1)
    return F.aggregate(path, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda y: base(y) == base(x)), kept).otherwise(F.concat(kept, F.array(x))))


def adding_tactics(path: Column, always_after: str | None = None) -> Column:
    """Array of (id, tactics) in order: steps that add a tactic to those before, and all steps after one with the tactic `always_after`."""
    kept = F.filter(path, lambda _: F.lit(False))

    def step(a: Column, x: Column) -> Column:
        new = F.size(F.array_except(x["tactics"], a["seen"])) > 0
        free = F.array_contains(a["seen"], always_after) if always_after else F.lit(False)
        return F.struct(F.array_union(a["seen"], x["tactics"]).alias("seen"), F.when(new | free, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(path, F.struct(F.array().cast("array<string>").alias("seen"), kept.alias("kept")), step, lambda a: a["kept"])


def neighbour_pairs(df: DataFrame, by: str, location: str, step: str, sentences: str, most: float = 5.0) -> DataFrame:
    """(by, source, target): steps of neighbouring occupied locations of a report, unequal and at most `most` mean sentences apart. Locations
    are numbered densely, so each meets only the next one."""
    mean = F.try_divide(F.aggregate(sentences, F.lit(0.0), lambda a, x: a + x), F.size(sentences))
    rows = df.select(by, F.dense_rank().over(Window.partitionBy(by).orderBy(location)).alias("_n"), F.col(step).alias("source"), mean.alias("_m"))
    nexts = rows.select(by, (F.col("_n") - 1).alias("_n"), F.col("source").alias("target"), F.col("_m").alias("_t"))
    return rows.join(nexts, [by, "_n"]).where((F.col("source") != F.col("target")) & (F.abs(F.col("_m") - F.col("_t")) <= most)).select(by, "source", "target").distinct()


def outstanding_place(picks: Column) -> Column:
    """The greatest place among the matched nodes (rank, place) of least rank; the greatest of all where ranks are equal or few."""
    best = F.array_min(F.transform(picks, lambda x: x["rank"]))
    return F.array_max(F.transform(F.filter(picks, lambda x: x["rank"] == best), lambda x: x["place"]))
