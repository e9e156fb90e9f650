"""Graph alignment scores: node and edge similarity, bounded candidate products and the winner's spanning rule.

Edge cases: nodes without labels share nothing and are never only one label; null contexts give a null similarity; a procedure no node of which has a
candidate is not scored; nodes without candidates stay unmatched; repeated candidates are candidates each; equal scores go by the rules named at
align(); empty tables give empty results; extra columns are not read."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.paths import computed

#: Fixed values of the scoring rules: base similarity with and without a common label, least similarity of a candidate, verb factors,
#: sentence distance factor.
COMMON, APART, LEAST = 0.4, 0.3, 0.8
STRONG_MISMATCH, WEAK_SMALL, WEAK_LARGE, SENTENCE = 0.3, 0.5, 0.8, 0.3
MOST_CANDIDATES, MOST_TUPLES = 30, 20_000


def _sole(labels: Column, name: str) -> Column:
    return (F.size(labels) == 1) & F.coalesce(F.get(labels, F.lit(0)) == name, F.lit(False))


def label_rule(left: Column, right: Column, left_pronoun: Column, right_pronoun: Column, strict: bool = False, both_malware: Column | None = None) -> Column:
    """What node_similarity takes from the labels alone: base, barred, same, actor, lifted. Where few labels meet many contexts it is computed once a pair of labels."""
    common = F.array_intersect(left, right)
    none = F.size(common) == 0
    base = F.when(none | ((F.size(common) == 1) & (F.get(common, F.lit(0)) == "OTHER")), F.lit(APART)).otherwise(F.lit(COMMON))
    either = lambda name: _sole(left, name) | _sole(right, name)
    both = lambda name: _sole(left, name) & _sole(right, name)
    barred = none & (either("VULNERABILITY") | either("USER") | (_sole(left, "ACTOR") & ~left_pronoun) | (_sole(right, "ACTOR") & ~right_pronoun))
    if strict:
        barred = none
    lifted = both("USER") | both("VULNERABILITY") | both("REGISTRY")
    same = F.array_contains(left, "FUNCTION") & F.array_contains(right, "FUNCTION") & both_malware if strict and both_malware is not None else F.lit(False)
    actor = both("ACTOR") & ~left_pronoun & ~right_pronoun
    return F.struct(base.alias("base"), barred.alias("barred"), same.alias("same"), actor.alias("actor"), lifted.alias("lifted"))


def ruled_similarity(rule: Callable[[str], Column], context: Column) -> Column:
    """Similarity by the parts of a label_rule and the cosine of the phrases."""
    v = rule("base") + (1 - rule("base")) * context
    out = (
        F.when(rule("barred"), 0.0).when(rule("same"), 1.0).when(v > LEAST, v)
        .when(rule("actor") & (v < 0.95), 0.95)
        .when(rule("lifted") & (v > 0.5) & (v < LEAST), v + 0.2).otherwise(v)
    )
    return F.least(F.lit(1.0), out)


def node_similarity(left: Column, right: Column, context: Column, left_pronoun: Column, right_pronoun: Column, strict: bool = False, both_malware: Column | None = None) -> Column:  # noqa: E501
    """Similarity of two nodes by their label arrays and the cosine of their phrases (0 to 1). strict: nodes without a common label have none, and two FUNCTION
    nodes that both name malware (both_malware) are the same."""
    rule = label_rule(left, right, left_pronoun, right_pronoun, strict, both_malware)
    return ruled_similarity(lambda part: rule[part], context)


def least_context(left: str, right: str, score: float) -> float:
    """A bound of the context for node_similarity over a score: nodes of which each has one label and is no pronoun exceed it only with a context over the bound,
    which is -2 if any context will do and infinite if none will."""
    apart = left != right
    if apart and {left, right} & {"VULNERABILITY", "USER", "ACTOR"}:
        return math.inf if score >= 0 else -2.0
    if left == right == "ACTOR" and score < 0.95:
        return -2.0
    base = APART if apart or left == "OTHER" else COMMON
    least = min(score, max(0.5, score - 0.2)) if not apart and left in ("USER", "VULNERABILITY", "REGISTRY") else score
    return (least - base) / (1 - base) - 1e-6 if least >= base else -2.0


def verb_factor(has_report: Column, has_procedure: Column, strong: Column, similar: Column, mismatch: Column, n_nodes: Column) -> Column:
    """How well the verbs of an edge agree; null if the procedure's edge has none."""
    weak = F.when(n_nodes <= 2, WEAK_SMALL).otherwise(WEAK_LARGE)
    return (
        F.when(~has_procedure, None).when(~has_report, F.when(strong, STRONG_MISMATCH).otherwise(weak)).when(similar, 1.0)
        .when(n_nodes <= 2, WEAK_SMALL).when(mismatch, STRONG_MISMATCH).otherwise(WEAK_LARGE)
    )


def sentence_distance(order_a: Column, order_b: Column, sentence_a: Column, sentence_b: Column, user: Column) -> Column:
    """1, plus a factor for each sentence between, plus a little for far places in one sentence; halved for users."""
    gap, same = F.abs(order_a - order_b), sentence_a == sentence_b
    near = F.when(same & (gap > 20), 0.15).when(same & (gap > 10), 0.1).otherwise(0.0)
    out = 1 + SENTENCE * F.abs(sentence_a - sentence_b) + near
    return F.when(user, out / 2).otherwise(out)


def edge_similarity(source: Column, target: Column, distance: Column, factor: Column) -> Column:
    """Geometric mean of the ends' similarities over their distance, tempered by the verb factor."""
    e = F.sqrt(source * target) / distance
    mixed = F.sqrt(e * factor)
    return F.when(factor.isNull(), e).otherwise(F.least(F.lit(1.0), F.when(((factor < 1) & (e > factor)) | (factor >= 1), mixed).otherwise(e)))


def candidate_tuples(nodes: DataFrame, group: str, node: str, candidates: str, most: int = MOST_TUPLES, each: int = MOST_CANDIDATES, rank: Callable[[Column], Column] | None = None) -> DataFrame:  # noqa: E501
    """(group, tuple, picks): the first `most` combinations of the nodes' candidates (the last node's vary fastest). At most `each` candidates a node take part,
    of more the best by rank (highest first), else the first: both limits are the search's own. The beginnings of combinations are built in the group's row, node
    by node and only as many as the limit leaves room for; only the last node's candidates are rows of compiled code. Groups are dealt to tasks by their number,
    as small groups make many rows."""
    chosen = F.slice(candidates, 1, each)
    if rank is not None:
        best = F.array_sort(F.transform(candidates, lambda x, i: F.struct((-rank(x)).alias("r"), i.alias("i"), x.alias("x"))))
        chosen = F.when(F.size(candidates) > each, F.transform(F.slice(best, 1, each), lambda y: y["x"])).otherwise(F.col(candidates))
    session = nodes.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 8 * session.sparkContext.defaultParallelism)
    packed = nodes.select(group, F.struct(F.col(node).alias("node"), chosen.alias("c")).alias("_n")).repartition(n, group)
    kind = packed.schema["_n"].dataType["c"].dataType
    ordered = packed.groupBy(group).agg(F.array_sort(F.collect_list("_n")).alias("_ns"))
    lists = computed(ordered.select(group, F.transform("_ns", lambda x: F.when(F.size(x["c"]) > 0, x["c"]).otherwise(F.array(F.lit(None).cast(kind.elementType)))).alias("_cs")))
    after = lambda i: F.aggregate(F.slice("_cs", i + 2, F.size("_cs")), F.lit(1).cast("long"), lambda a, c: F.least(a * F.size(c), F.lit(most).cast("long")))
    sized = lists.select(group, F.element_at("_cs", -1).alias("_last"), F.transform(F.slice("_cs", 1, F.size("_cs") - 1), lambda c, i: F.struct(c.alias("c"), F.ceil(most / after(i)).cast("int").alias("room"))).alias("_before"))
    longer = lambda begun, x: F.slice(F.flatten(F.transform(begun, lambda p: F.transform(x["c"], lambda y: F.concat(p, F.array(y))))), 1, x["room"])
    begun = F.aggregate("_before", F.array(F.array().cast(kind)), longer)
    rows = sized.select(group, "_last", F.posexplode(begun).alias("_no", "_begun")).select(group, "_no", "_begun", F.size("_last").alias("_n"), F.posexplode("_last").alias("_at", "_pick"))
    at = F.col("_no").cast("long") * F.col("_n") + F.col("_at")
    return rows.select(group, at.alias("tuple"), F.concat("_begun", F.array("_pick")).alias("picks")).where(F.col("tuple") < most)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a column named twice in a lambda would be computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spanning_score(score: Column, sentences: Column, complete: Column) -> Column:
    """A score over the spread of its sentences (whole numbers); 0 if a node is unmatched. The sums are whole, so equal spreads are equal."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(sentences, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
                       lambda a: F.when(a["n"] == 0, 0.0).otherwise(F.sqrt(a["n"] * a["q"] - a["s"] * a["s"]) / a["n"]))
    return F.when(~complete, 0.0).otherwise(bound(sums, lambda spread: F.when(spread == 0, score).otherwise(score / spread)))


def hops(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(a, b, hops): undirected distances up to `most` between nodes, by joining one edge a round; pairs keep only their least."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    found = nodes.select(F.col("a"), F.col("a").alias("b"), F.lit(0).alias("hops"))
    reach = found
    for k in range(1, most + 1):
        step = reach.where(F.col("hops") == k - 1).select("a", F.col("b").alias("m")).join(both.withColumnsRenamed({"a": "m"}), "m")
        reach = reach.union(step.select("a", "b", F.lit(k).alias("hops"))).groupBy("a", "b").agg(F.min("hops").alias("hops"))
    return reach


def align(
    procedure_nodes: DataFrame, procedure_edges: DataFrame, candidates: DataFrame, distances: DataFrame, most: int = MOST_TUPLES, each: int = MOST_CANDIDATES
) -> DataFrame:
    """Scores every procedure graph that has a candidate in a report and picks its best combination.

    procedure_nodes (proc, node, labels), procedure_edges (proc, source, target, factor; factor null: no verbs), candidates (report, proc, node, at, sentence,
    similarity; `at` is the report node's order id), distances (report, a, b, distance; missing pairs are 100 apart, 1 if a = b).
    Returns (report, proc, score, ats, sentences, location, n_good): ats and sentences of the matched nodes that are not only ACTOR or OTHER, in the
    order of the procedure's nodes, location their greatest at.

    Scores of edges are computed once a pair of candidates by joins, so a combination is a sum of array items; combinations are numbers in
    one row, never rows. `most` and `each` are limits of the search itself, so rows of a pair stay small whatever the corpus."""
    key = ["report", "proc"]
    rank = F.struct((-F.col("similarity")).alias("s"), "at", "sentence", "similarity")
    every = candidates.groupBy(*key, "node").agg(F.array_sort(F.collect_list(rank)).alias("c"))
    cut = F.when(F.size("c") > each, F.slice("c", 1, each)).otherwise(F.array_sort("c", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)))
    lists = every.select(*key, "node", cut.alias("c"))
    found = lists.select(*key).distinct()
    plain = lambda name: (F.size("labels") == 1) & (F.get("labels", F.lit(0)) == name)
    kinds = procedure_nodes.select("proc", "node", (plain("ACTOR") | plain("OTHER")).alias("plain"), plain("ACTOR").alias("actor"), "labels")
    nodes = found.join(kinds, "proc").join(lists, [*key, "node"], "left")
    packed = nodes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("node", "plain", "actor", "c"))).alias("ns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))

    side = lambda end: lists.join(kinds.select("proc", "node", "actor"), ["proc", "node"]).select(
        *key, F.col("node").alias(end), F.col("actor").alias(f"{end}_actor"), F.posexplode("c").alias(f"{end}_no", f"{end}_c")
    )
    pairs = found.join(procedure_edges.select("proc", "source", "target", "factor"), "proc").join(side("source"), [*key, "source"]).join(side("target"), [*key, "target"])
    pairs = pairs.withColumns({"a": F.col("source_c.at"), "b": F.col("target_c.at")}).join(distances, ["report", "a", "b"], "left")
    far = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("distance", F.lit(100.0)))
    distance = F.when(F.col("source_actor") | F.col("target_actor"), F.least(F.lit(1.0), far)).otherwise(far)
    scored = pairs.withColumn("e", edge_similarity(F.col("source_c.similarity"), F.col("target_c.similarity"), distance, F.col("factor")))
    cells = scored.groupBy(*key, "source", "target").agg(F.array_sort(F.collect_list(F.struct("source_no", "target_no", "e"))).alias("cells"))
    places = procedure_nodes.select("proc", "node").distinct()
    held = procedure_edges.select("proc", "source", "target").join(places.withColumnRenamed("node", "source"), ["proc", "source"], "left_semi")
    held = held.join(places.withColumnRenamed("node", "target"), ["proc", "target"], "left_semi")
    edges = found.join(held, "proc").join(cells, [*key, "source", "target"], "left").groupBy(*key).agg(F.collect_list(F.struct("source", "target", "cells")).alias("es"))
    rows = packed.join(edges, key, "left").withColumn("es", F.coalesce("es", F.filter(F.col("es"), lambda _: F.lit(False)), F.array().cast(edges.schema["es"].dataType)))

    sizes = F.transform("ns", lambda x: F.greatest(F.coalesce(F.size(x["c"]), F.lit(0)), F.lit(1)).cast("long"))
    stride = lambda i: F.aggregate(F.slice("sizes", i + 2, F.size("sizes")), F.lit(1).cast("long"), lambda a, s: F.least(a * s, F.lit(most).cast("long")))
    rows = rows.withColumn("sizes", sizes).withColumn("strides", F.transform("sizes", lambda _, i: stride(i)))
    rows = rows.withColumn("total", F.aggregate("sizes", F.lit(1).cast("long"), lambda a, s: F.least(a * s, F.lit(most).cast("long"))))
    place = lambda n: F.array_position(F.transform("ns", lambda x: x["node"]), n).cast("int") - 1
    rows = rows.withColumn("es", F.transform("es", lambda x: F.struct(place(x["source"]).alias("s"), place(x["target"]).alias("t"), x["cells"].alias("cells"))))

    matched = F.filter("ns", lambda x: x["c"].isNotNull())
    rows = computed(rows.withColumns({"n_plain": F.size(F.filter(matched, lambda x: x["plain"])), "complete": F.size(matched) == F.size("ns")}))
    choice = lambda t, i: F.pmod(F.floor(t / F.get("strides", i)), F.get("sizes", i)).cast("int")

    def scored_picks(picks: Column, t: Column) -> Column:
        good = F.filter(picks, lambda x: x["c"].isNotNull() & ~x["plain"])
        of_nodes = F.aggregate(good, F.lit(0.0), lambda a, x: a + x["c"]["similarity"]) / F.greatest(F.size("ns") - F.col("n_plain"), F.lit(1))
        cell = lambda e: F.get(e["cells"], choice(t, e["s"]) * F.get("sizes", e["t"]).cast("int") + choice(t, e["t"]))["e"]
        of_edges = F.when(F.size("es") == 0, 0.0).otherwise(F.aggregate("es", F.lit(0.0), lambda a, e: a + F.coalesce(cell(e), F.lit(0.0))) / F.size("es"))
        said = F.transform(F.filter(picks, lambda x: x["c"].isNotNull() & ~x["actor"]), lambda x: x["c"]["sentence"].cast("double"))
        return F.struct(F.least(F.lit(1.0), (of_nodes + of_edges) / 2).alias("score"), said.alias("said"))

    def one(t: Column) -> Column:
        picks = F.transform("ns", lambda x, i: F.struct(x["plain"].alias("plain"), x["actor"].alias("actor"), F.get(x["c"], choice(t, i)).alias("c")))
        ranked = lambda v: F.struct(v["score"].alias("score"), spanning_score(v["score"], v["said"], F.col("complete")).alias("span"), (-t).alias("before"), t.alias("t"))
        return bound(bound(picks, lambda p: scored_picks(p, t)), ranked)

    rows = computed(rows.withColumn("all", F.transform(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), one)))
    rows = computed(rows.withColumn("top", F.array_max(F.transform("all", lambda x: x["score"]))))
    rivals = F.filter("all", lambda x: (x["score"] == F.col("top")) | (x["score"] > 0.95))
    first = F.array_max(F.transform(rivals, lambda x: F.struct(x["span"], x["score"], x["before"], x["t"])))
    last = F.array_max(F.transform("all", lambda x: F.struct(x["score"], x["t"])))
    rows = rows.withColumn("t", F.when(F.col("top") > LEAST, first["t"]).otherwise(last["t"])).withColumn("score", F.get("all", F.col("t").cast("int"))["score"])
    picks = F.filter(F.transform("ns", lambda x, i: F.struct(x["plain"].alias("plain"), F.get(x["c"], choice(F.col("t"), i)).alias("c"))), lambda x: x["c"].isNotNull() & ~x["plain"])
    out = rows.withColumn("picks", picks)
    ats = F.transform("picks", lambda x: x["c"]["at"])
    return out.select(*key, "score", ats.alias("ats"), F.transform("picks", lambda x: x["c"]["sentence"]).alias("sentences"), F.array_max(ats).alias("location"), F.size("picks").alias("n_good"), "labels")


#: Words of a conditional or explaining text, as parts of words too.
CONDITIONS = ["if", "when", "where", "how", "why", "who"]


def accepted(aligned: DataFrame, least: float = LEAST, texts: DataFrame | None = None) -> DataFrame:
    """Alignments over the least score, but for those with fewer than two good nodes whose procedures hold only actors and users, or (texts: (proc, text,
    n_sentences)) whose procedures are one sentence with a conditional or explaining word."""
    if texts is not None:
        said = F.lower("text")
        told = texts.select("proc", ((F.col("n_sentences") == 1) & said.rlike("|".join(CONDITIONS))).alias("_if"))
        aligned = aligned.join(told, "proc", "left").where(~(F.coalesce("_if", F.lit(False)) & (F.col("n_good") < 2))).drop("_if")
    actors = (F.size("labels") == 2) & (F.size(F.array_except("labels", F.array(F.lit("ACTOR"), F.lit("USER")))) == 0)
    return aligned.where((F.col("score") > least) & ~((F.col("n_good") < 2) & actors)).drop("labels")
