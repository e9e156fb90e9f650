"""Decoding of a report's alignments into an ordered path of techniques.

Alignments are rows (report, location, tech, value, order_ids, sentences[, picks]), keyword alignments rows of the same columns. Everything up to
the lists of each location is windows and joins by report; only the look-back, which reads its own output, folds over a report's locations.

Edge cases: null reports, techniques, values or places take no part; alignments without order ids or sentences are dropped like too wide ones; repeated rows
count as often as they stand; ties go to the row that the reference's order puts first (location, value downwards, `seq`); techniques whose values sum
to 0 have no mean and keep their first row; reports without rows that pass have an empty path; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.paths import computed, outstanding_place, relative_rank, spread

#: Fixed values of the decoder: least value, span limits, look-back, fewest locations, step of the second try.
THRESHOLD, WIDEST_LEAD, WIDEST_SPREAD, BACK, NEAR, FEWEST, RELAX_STEP = 0.87, 10.0, 2.0, 3, 5, 10, 0.05

_ITEM = "struct<value:double,turn:bigint,tech:string,location:int,mean:double>"


def mean(values: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def compact(alignments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Alignments that stay together (first place near the mean place, sentences close), with values cut at 1, from a threshold."""
    least, middle = F.array_min("order_ids"), mean(F.col("order_ids"))
    tight = (F.abs(least - middle) < WIDEST_LEAD) & (spread(F.col("sentences").cast("array<double>")) < WIDEST_SPREAD)
    held = alignments.where((F.size("order_ids") > 0) & (F.size("sentences") > 0)).where(tight)
    return held.withColumn("value", F.least(F.lit(1.0), F.col("value"))).where(F.col("value") >= threshold)


def phrase_ranks(
    labels: Column, source_verbs: Column, verbs: Column, mismatch: Column, strong: Column, phrase: Column
) -> Column:
    """The rank of a matched node: 0 only REGISTRY or VULNERABILITY, 0.2 both ends have verbs and no strong mismatch, 0.5 a strong verb, 2 only DATA, else
    the rank of its phrase. mismatch and strong are facts about the verbs (see labelling.verb_facts)."""
    only = lambda name: (F.size(labels) == 1) & (F.get(labels, F.lit(0)) == name)
    return (
        F.when(only("REGISTRY") | only("VULNERABILITY"), 0.0).when(source_verbs.isNotNull() & verbs.isNotNull() & ~mismatch, 0.2)
        .when(verbs.isNotNull() & strong, 0.5).when(only("DATA"), 2.0).otherwise(phrase.cast("double"))
    )


def unique_locations(alignments: DataFrame, criteria: str = "heuristic") -> DataFrame:
    """One row for each technique of a report, at its chosen location: that nearest to the mean of its locations by value, then the one of the
    highest relative rank. criteria: min or max order id, or heuristic (needs picks: array of (rank, place))."""
    order_ids = F.col("order_ids")
    at = {"min": lambda: F.array_min(order_ids), "max": lambda: F.array_max(order_ids), "heuristic": lambda: F.coalesce(outstanding_place(F.col("picks")), F.array_max(order_ids))}
    seq = "seq" if "seq" in alignments.columns else F.lit(0)
    by_report = Window.partitionBy("report")
    rows = alignments.withColumn("_seq", seq if isinstance(seq, Column) else F.col(seq))
    order = [F.col("location"), F.desc("value"), F.col("_seq"), F.col("tech"), F.array_join(F.transform("order_ids", lambda x: F.format_string("%012d", x.cast("long"))), ",")]
    rows = rows.withColumn("_turn", F.row_number().over(by_report.orderBy(*order))).withColumn("_at", at[criteria]())
    rows = rows.withColumn("_first", F.min("_turn").over(Window.partitionBy("report", "_at")))
    by_tech = Window.partitionBy("report", "tech")
    middle = F.try_divide(F.sum(F.col("value") * F.col("_at")).over(by_tech), F.sum("value").over(by_tech))
    gap = F.round(F.abs(F.col("_at") - middle), 9)
    choice = F.struct(F.coalesce(gap, F.lit(0.0)), -relative_rank(F.col("value"), order_ids), "_first", "_turn")
    rows = rows.withColumn("_choice", choice)
    seen = F.min(F.struct("_first", "_turn")).over(by_tech).alias("_seen")
    ranked = rows.select("*", seen, F.row_number().over(by_tech.orderBy("_choice")).alias("_no")).where("_no = 1")
    # techniques of one location stand in the order in which they were first met
    turn = F.row_number().over(by_report.orderBy("_at", "_seen"))
    return ranked.select("report", "tech", "value", F.col("_at").cast("int").alias("location"), "order_ids", "sentences", turn.cast("long").alias("turn"))


def lookback(lists: Column) -> Column:
    """The kept step of each of a report's positions, in order: (pos, item). lists: array of arrays of items (tech, location, ...), best first, one for each
    position. A technique with a dot always stays. Another is refused if a step kept at one of the three positions before, at most five places away, has
    its base; then the second of its list stands in, whatever it is, or nothing. Empty lists count as positions."""
    base = lambda t: F.substring_index(t, ".", 1)
    numbered = F.transform(lists, lambda x, i: F.struct(i.alias("pos"), x.alias("items")))

    def step(kept: Column, x: Column) -> Column:
        first, second = F.get(x["items"], F.lit(0)), F.get(x["items"], F.lit(1))
        near = lambda y: (y["pos"] >= x["pos"] - BACK) & (F.abs(y["item"]["location"] - first["location"]) <= NEAR)
        clash = F.exists(kept, lambda y: near(y) & (base(y["item"]["tech"]) == base(first["tech"])))
        took = F.when(F.contains(first["tech"], F.lit(".")) | ~clash, first).otherwise(second)
        return F.when(took.isNotNull(), F.concat(kept, F.array(F.struct(x["pos"].alias("pos"), took.alias("item"))))).otherwise(kept)

    none = F.filter(F.transform(numbered, lambda x: F.struct(x["pos"].alias("pos"), F.get(x["items"], F.lit(0)).alias("item"))), lambda _: F.lit(False))
    return F.aggregate(numbered, none, step)


def _path(lists: Column) -> Column:
    """The first two items of each list, by mean order id, each technique once."""
    def two(items: Column) -> Column:
        a, b = F.get(items, F.lit(0)), F.get(items, F.lit(1))
        both = F.when(a["mean"] <= b["mean"], F.array(a["tech"], b["tech"])).otherwise(F.array(b["tech"], a["tech"]))
        return F.when(F.size(items) == 0, F.array().cast("array<string>")).when(b.isNull(), F.array(a["tech"])).otherwise(both)

    return F.array_distinct(F.flatten(F.transform(lists, two)))


def decode(
    alignments: DataFrame, reports: DataFrame | None = None, keywords: DataFrame | None = None, preparation: DataFrame | None = None,
    threshold: float = THRESHOLD, topk: int = 1, criteria: str = "heuristic", relax: bool = True,
) -> DataFrame:
    """(report, best, topk, path): best array of (location, tech) with the look-back, topk array of (location, techs) from the threshold, path the
    techniques in order, from topk if relax, else from best. preparation: a table of techniques (tech) whose only platform is the preparation one; they go to
    location 0. keywords: the first row (by seq, then tech) of each location joins its location, unless the threshold is 1 or location 0 is taken."""
    rows = alignments.where("report is not null and tech is not null and value is not null and location is not null")
    reports = (reports if reports is not None else rows).select("report").where("report is not null").distinct()
    found = unique_locations(compact(rows, threshold), criteria)
    found = found.withColumn("key", F.col("location"))
    if preparation is not None:
        early = preparation.select("tech", F.lit(True).alias("_early")).distinct()
        found = found.join(F.broadcast(early) if early.limit(100_001).count() <= 100_000 else early, "tech", "left")
        found = found.withColumn("key", F.when(F.col("_early"), 0).otherwise(F.col("location"))).drop("_early")
    found = found.select("report", "key", "location", "tech", F.col("value").cast("double").alias("value"), "turn", mean(F.col("order_ids")).alias("mean"))
    # a location that all its techniques left is still a position
    positions = found.select("report", F.col("location").alias("key")).union(found.select("report", "key")).distinct()
    if keywords is not None and threshold != 1.0:
        k = keywords.where("report is not null and tech is not null and value is not null and location is not null")
        seq = F.col("seq") if "seq" in k.columns else F.lit(0)
        first = k.groupBy("report", F.col("location").cast("int").alias("key")).agg(F.min_by(F.struct("tech", F.col("value").cast("double").alias("value"), "order_ids"), F.struct(seq.alias("s"), "tech")).alias("k"))
        taken = found.where("key = 0").select("report", F.lit(0).alias("key")).distinct()
        first = first.join(taken, ["report", "key"], "left_anti")
        added = first.select("report", "key", F.col("key").alias("location"), "k.tech", "k.value", F.lit(1 << 40).cast("long").alias("turn"), F.coalesce(mean(F.col("k.order_ids")), F.col("key").cast("double")).alias("mean"))
        found = found.unionByName(added)
        positions = positions.union(added.select("report", "key")).distinct()
    item = F.struct((-F.col("value")).alias("value"), "turn", "tech", "location", "mean")
    lists = found.groupBy("report", "key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    lists = positions.join(lists, ["report", "key"], "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{_ITEM}>")))
    packed = lists.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("key", "items"))).alias("at"))
    packed = reports.join(packed, "report", "left").withColumn("at", F.coalesce("at", F.array().cast(f"array<struct<key:int,items:array<{_ITEM}>>>")))
    packed = computed(computed(packed.withColumn("lists", F.transform("at", lambda x: x["items"]))).withColumn("best", lookback(F.col("lists"))))
    chosen = F.transform("best", lambda b: F.struct(F.get(F.col("at"), b["pos"])["key"].alias("location"), b["item"]["tech"].alias("tech")))
    top = F.filter(F.transform("at", lambda x: F.struct(x["key"].alias("key"), F.filter(F.slice(x["items"], 1, topk), lambda y: -y["value"] >= threshold).alias("items"), F.size(x["items"]).alias("n"))), lambda x: x["n"] > 0)
    packed = computed(packed.withColumn("top", top))
    listed = F.transform("top", lambda x: x["items"]) if relax else F.transform("best", lambda b: F.array(b["item"]))
    techs = F.transform("top", lambda x: F.struct(x["key"].alias("location"), F.transform(x["items"], lambda y: y["tech"]).alias("techs")))
    packed = computed(packed.withColumn("listed", listed))
    return packed.select("report", chosen.alias("best"), techs.alias("topk"), _path(F.col("listed")).alias("path"))


def decode_reports(alignments: DataFrame, keywords: DataFrame | None = None, threshold: float = THRESHOLD, fewest: int = FEWEST, recode: bool = True, **options) -> DataFrame:
    """decode(), and reports of fewer than `fewest` best locations once more at a lower threshold, relaxed. Adds `relaxed`."""
    reports = alignments.select("report") if keywords is None else alignments.select("report").union(keywords.select("report"))
    reports = options.pop("reports", reports).distinct()
    first = decode(alignments, reports, keywords, threshold=threshold, **options).withColumn("relaxed", F.lit(False))
    if not recode:
        return first
    few = F.size("best") < fewest
    again = decode(alignments, reports, keywords, threshold=threshold - RELAX_STEP, **(options | {"relax": True}))
    renamed = again.select("report", *(F.col(c).alias(f"_{c}") for c in ("best", "topk", "path")))
    both = first.join(renamed, "report")
    return both.select("report", *(F.when(few, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("best", "topk", "path")), few.alias("relaxed"))


def without_preparation(techniques: DataFrame, preparation: DataFrame, by: str = "report") -> DataFrame:
    """(by, tech) without the preparation techniques, unless a group has no others."""
    marked = techniques.join(preparation.select("tech", F.lit(True).alias("_p")).distinct(), "tech", "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    others = marked.where("not _p").select(by).distinct().withColumn("_o", F.lit(True))
    return marked.join(others, by, "left").where("not _p or _o is null").select(by, "tech")


def similar_procedures(pairs: DataFrame, least: float = 0.90) -> DataFrame:
    """(source, target, f1) in both directions, of pairs (a, b, f1) from a least f1; of pairs that repeat the last (by seq, if there) stays."""
    seq = F.col("seq") if "seq" in pairs.columns else F.lit(0)
    rows = pairs.where(F.col("f1") >= least).select("a", "b", "f1", seq.alias("_s"))
    both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "f1", "_s"))
    return both.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.max_by("f1", F.struct("_s", "f1")).alias("f1"))


def best_procedures(matches: DataFrame, similar: DataFrame | None = None, topk: int = -1, threshold: float = 0.8) -> DataFrame:
    """(report, location, proc, score, rank): matches with their similar procedures at score times f1, from a threshold, the first topk (-1: all)."""
    rows = matches.select("report", "location", "proc", "score")
    if similar is not None:
        near = rows.join(similar.withColumnRenamed("source", "proc"), "proc").select("report", "location", F.col("target").alias("proc"), (F.col("score") * F.col("f1")).alias("score"))
        rows = rows.unionByName(near)
    order = Window.partitionBy("report", "location").orderBy(F.desc("score"), "proc")
    ranked = rows.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order))
    return ranked if topk < 0 else ranked.where(F.col("rank") <= topk)


def shown_techniques(matches: DataFrame, procedures: DataFrame, topk: int = 10, threshold: float = 0.8) -> DataFrame:
    """(report, location, techs): the techniques of the best procedures of each location, once each. procedures: (proc, tech)."""
    best = best_procedures(matches, None, topk, threshold).join(procedures.select("proc", "tech"), "proc")
    return best.groupBy("report", "location").agg(F.array_sort(F.collect_set("tech")).alias("techs"))


def decode_sweep(alignments: DataFrame, thresholds: list[float], keywords: DataFrame | None = None, drop_start: bool = True, **options) -> DataFrame:
    """(report, threshold, n_locations, path) for a list of thresholds; n_locations leaves location 0 out, path leaves out its technique. One plan a threshold:
    the thresholds are the caller's, not the data's."""
    out = None
    for t in thresholds:
        one = decode(alignments, None, keywords, threshold=t, **options).select(
            "report", F.lit(float(t)).alias("threshold"), F.size(F.filter("best", lambda b: b["location"] != 0)).alias("n_locations"),
            (F.filter("path", lambda p: ~F.exists("best", lambda b: (b["location"] == 0) & (b["tech"] == p))) if drop_start else F.col("path")).alias("path"),
        )
        out = one if out is None else out.unionByName(one)
    return out
