"""Techniques rolled up from their procedures' graphs, phrase similarity tables, pair statistics and evaluation.

Edge cases: null keys and labels take no part; empty tables give empty results; a ratio without a denominator is null (0 where the reference says so); repeated
rows count as often as they stand where a count is meant, once where a set is; ties go to the smaller id; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.preprocessing import true_texts

#: Labels that are no features, tactics whose techniques' names are no phrases, the form of a vulnerability's number.
PLAIN = ["ACTOR", "OTHER"]
UNNAMED_TACTICS = ["TA0007", "TA0009"]
VULNERABILITY_ID = r"(?i)\b(cve\-[0-9]{4}\-[0-9]{4,6})\b"
#: Threshold whose measures carry over to 1, where nothing is predicted any more.
LAST_THRESHOLD = 0.99


def procedures_by_technique(procedures: DataFrame) -> DataFrame:
    """(tech_id, procedures, platforms): ids in their order (pos) and the platforms of the first."""
    return procedures.groupBy("tech_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("procedures"), F.min_by("platforms", F.struct("pos", "id")).alias("platforms")
    )


def is_named(tech_id: Column, name: Column, tactics: Column) -> Column:
    """Whether a technique's own name is one of its phrases: a sub-technique of one word, of none of the two unnamed tactics."""
    return F.contains(tech_id, F.lit(".")) & ~F.contains(name, F.lit(" ")) & ~F.arrays_overlap(tactics, F.array(*map(F.lit, UNNAMED_TACTICS)))


def _members(techs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (tech_id, doc, node_id, texts, labels) that an edge of a technique's procedure touches, each once a procedure; texts as they are meant."""
    own = techs.select("tech_id", F.explode("procedures").alias("doc")).distinct()
    ends = edges.select("doc", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    replaced = F.col("replaced") if "replaced" in nodes.columns else F.create_map().cast("map<string,string>")
    rows = nodes.select("doc", "node_id", F.array_distinct(true_texts(F.col("texts"), replaced)).alias("texts"), F.array_distinct("labels").alias("labels"))
    return own.join(rows, "doc").join(ends, ["doc", "node_id"], "left_semi")


def technique_nodes(techs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tech_id, label, count, texts): the texts of a technique's nodes by label, and their number."""
    rows = _members(techs, nodes, edges).select("tech_id", "texts", F.explode("labels").alias("label")).where("label is not null")
    return rows.groupBy("tech_id", "label").agg(F.sum(F.size("texts")).alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("texts")))).alias("texts"))


def technique_phrases(techs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tech_id, best_phrases): vulnerability numbers, the name of a named technique, and the texts that hold it (lower case, not of nodes that are only DATA)."""
    named = is_named(F.col("tech_id"), F.col("name"), F.col("tactics"))
    info = techs.select("tech_id", "name", "procedures", named.alias("named"))
    rows = _members(techs, nodes, edges).join(info.select("tech_id", "name", "named"), "tech_id")
    only_data = (F.size("labels") == 1) & (F.get("labels", F.lit(0)) == "DATA")
    holds = lambda t: F.regexp_like(t, F.concat(F.lit(r"(?i)\b"), F.col("name"), F.lit(r"\b")))
    said = F.concat(
        F.filter("texts", lambda t: t.rlike(VULNERABILITY_ID)),
        F.when(F.col("named") & ~only_data, F.transform(F.filter("texts", holds), F.lower)).otherwise(F.array().cast("array<string>")),
    )
    found = rows.select("tech_id", F.explode(said).alias("p")).union(info.where("named").select("tech_id", "name"))
    listed = found.groupBy("tech_id").agg(F.array_sort(F.collect_set("p")).alias("best_phrases"))
    return info.select("tech_id").join(listed, "tech_id", "left").select("tech_id", F.coalesce("best_phrases", F.array().cast("array<string>")).alias("best_phrases"))


def technique_edges(techs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tech_id, source, target, count): pairs of unequal labels at the ends of the edges of a technique's procedures."""
    labels = _members(techs, nodes, edges).select("tech_id", "doc", "node_id", "labels")
    a, b = (labels.select("tech_id", "doc", F.col("node_id").alias(end), F.col("labels").alias(f"{end}_l")) for end in ("source", "target"))
    rows = edges.select("doc", "source", "target").join(a, ["doc", "source"]).join(b, ["tech_id", "doc", "target"])
    pairs = rows.select("tech_id", F.explode("source_l").alias("source"), "target_l").select("tech_id", "source", F.explode("target_l").alias("target"))
    return pairs.where("source <> target").groupBy("tech_id", "source", "target").agg(F.count("*").alias("count"))


def technique_verbs(techs: DataFrame, edges: DataFrame) -> DataFrame:
    """(tech_id, verb, count) over the edges of a technique's procedures."""
    own = techs.select("tech_id", F.explode("procedures").alias("doc")).distinct()
    return own.join(edges.select("doc", "verb").where("verb is not null"), "doc").groupBy("tech_id", "verb").agg(F.count("*").alias("count"))


def features(label_counts: DataFrame) -> DataFrame:
    """(tech_id, features): labels by their counts downwards, without ACTOR and OTHER."""
    rows = label_counts.where(~F.col("label").isin(PLAIN)).groupBy("tech_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "label"))).alias("f"))
    return rows.select("tech_id", F.col("f.label").alias("features"))


def phrase_set(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phrase): the distinct meant texts of nodes (texts, or text where a node has no others)."""
    texts = F.coalesce("texts", F.array("text")) if "text" in nodes.columns else F.col("texts")
    replaced = F.col("replaced") if "replaced" in nodes.columns else F.create_map().cast("map<string,string>")
    return nodes.select(*keys, F.explode(true_texts(texts, replaced)).alias("phrase")).distinct()


def most_alike(left: DataFrame, right: DataFrame, cosines: DataFrame, block: list[str] | None = None) -> DataFrame:
    """(left, right, context): the highest cosine of any two texts of left (left, texts) and right (right, texts), 0 at least; pairs without a known
    cosine are left out, as theirs is 0. cosines (a, b, cosine), each pair once, in either order; equal texts have 1."""
    on = block or []
    l = left.select(*on, "left", F.explode("texts").alias("a")).distinct()
    r = right.select(*on, "right", F.explode("texts").alias("b")).distinct()
    both = cosines.select("a", "b", "cosine").union(cosines.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).where("cosine > 0 and a <> b").distinct()
    found = l.join(both, "a").join(r, [*on, "b"]).select("left", "right", "cosine")
    same = l.withColumnRenamed("a", "t").join(r.withColumnRenamed("b", "t"), [*on, "t"]).select("left", "right", F.lit(1.0).alias("cosine"))
    return found.unionByName(same).groupBy("left", "right").agg(F.max("cosine").alias("context"))


def accumulated(nodes: DataFrame, edges: DataFrame, matches: DataFrame, edge_matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graphs with what their absorbed partners say: texts, labels and verbs of matched nodes, and verbs of matched edges in either direction. matches: (doc,
    node_id, other, other_node), each node of a doc at most once a partner."""
    partner = nodes.select(F.col("doc").alias("other"), F.col("node_id").alias("other_node"), F.col("texts").alias("_t"), F.col("labels").alias("_l"), F.col("verbs").alias("_v"))
    told = matches.join(partner, ["other", "other_node"]).groupBy("doc", "node_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_t", "_l", "_v")))
    out = nodes.join(told, ["doc", "node_id"], "left")
    both = lambda a, b: F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    out = out.withColumns({"texts": both("texts", "_t"), "labels": both("labels", "_l"), "verbs": both("verbs", "_v")}).drop("_t", "_l", "_v")
    a = matches.select("doc", F.col("node_id").alias("source"), "other", F.col("other_node").alias("s"))
    b = matches.select("doc", F.col("node_id").alias("target"), "other", F.col("other_node").alias("t"))
    theirs = edges.select(F.col("doc").alias("other"), F.col("source").alias("s"), F.col("target").alias("t"), F.col("verb").alias("_verb"))
    theirs = theirs.union(theirs.select("other", F.col("t").alias("s"), F.col("s").alias("t"), "_verb")).distinct()
    met = edges.select("doc", "source", "target").distinct().join(a, ["doc", "source"]).join(b, ["doc", "target", "other"]).join(theirs, ["other", "s", "t"])
    verbs = met.groupBy("doc", "source", "target").agg(F.collect_set("_verb").alias("_w"))
    held = edges.join(verbs, ["doc", "source", "target"], "left")
    return out, held.withColumn("verbs", both(F.coalesce("verbs", F.array("verb")) if "verbs" in edges.columns else F.array("verb"), "_w")).drop("_w")


def pair_lookup(pairs: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """wanted (source, target) with a value of pairs, 0 where there is none."""
    return wanted.join(pairs.select("source", "target", value), ["source", "target"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def with_prior(pairs: DataFrame, prior: DataFrame) -> DataFrame:
    """(source, target, n): counts with prior ones added."""
    return pairs.select("source", "target", "n").unionByName(prior.select("source", "target", "n")).groupBy("source", "target").agg(F.sum("n").alias("n"))


def top_techniques(paths: DataFrame, k: int) -> DataFrame:
    """(tech, n): the k techniques that most paths (report, path) hold."""
    return paths.select(F.explode(F.array_distinct("path")).alias("tech")).groupBy("tech").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech").limit(k)


def top_pairs(pairs: DataFrame, k: int, source: str | None = None) -> DataFrame:
    """The k most frequent pairs, of one source if given."""
    rows = pairs if source is None else pairs.where(F.col("source") == source)
    return rows.orderBy(F.desc("n"), "source", "target").limit(k)


def evaluated(truth: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1, duplicates) of ids (by, id): ids of 0 take no part, hits are distinct ids in both, misses the predictions of -1, the
    rest of the truths is not found. Measures have three digits; f1 comes from the rounded ones. No predictions: all measures 0."""
    t = truth.where("id is not null and id <> 0").distinct().groupBy(*by).agg(F.collect_set("id").alias("t"))
    p = predicted.where("id is not null and id <> 0").groupBy(*by).agg(F.collect_list("id").alias("p"))
    rows = t.join(p, by, "full_outer")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(f"array<{dict(truth.dtypes)['id']}>")) for c in ("t", "p")})
    real = F.array_distinct(F.filter("p", lambda x: x != -1))
    rows = rows.withColumns({
        "tp": F.size(F.array_intersect("t", real)).cast("long"), "fp": F.size(F.filter("p", lambda x: x == -1)).cast("long"),
        "fn": F.size(F.array_except("t", real)).cast("long"), "duplicates": (F.size(F.filter("p", lambda x: x != -1)) - F.size(real)).cast("long"),
    })
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(F.col("tp"), F.col(a) + F.col(b)), 3), F.lit(0.0))
    rows = rows.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    f1 = F.coalesce(F.bround(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 3), F.lit(0.0))
    return rows.select(*by, "tp", "fp", "fn", "precision", "recall", f1.alias("f1"), "duplicates")


def mean_f1(scores: DataFrame, total: int) -> DataFrame:
    """The sum of f1 over a number of reports that the caller states."""
    return scores.agg((F.sum("f1") / F.lit(total)).alias("f1"))


def macro_average(scores: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1, f2) of scores (report, threshold, precision, recall, f1): means over reports, f2 from the averaged precision and
    recall. At threshold 1 the precision of LAST_THRESHOLD stays, recall and f1 are 0."""
    t = F.round("threshold", 3)
    last = F.max(F.when(t == LAST_THRESHOLD, F.col("precision"))).over(Window.partitionBy("report"))
    rows = scores.withColumn("_t", t).withColumn("_last", last)
    end = F.col("_t") == 1.0
    rows = rows.select(F.col("_t").alias("threshold"), F.when(end, F.coalesce("_last", F.lit(0.0))).otherwise(F.col("precision")).alias("precision"),
                       *(F.when(end, 0.0).otherwise(F.col(c)).alias(c) for c in ("recall", "f1")))
    means = rows.groupBy("threshold").agg(*(F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")))
    return means.withColumn("f2", F.coalesce(F.round(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 3), F.lit(0.0)))


def nearest_thresholds(lengths: DataFrame, scores: DataFrame) -> DataFrame:
    """(report, optimal, ratio): the threshold whose path (report, threshold, n) has the length nearest to the report's attacks (tp + fn), averaged over equal
    ones; ratio: half the difference of the lengths at the least and the greatest threshold."""
    rows = lengths.join(scores.select("report", (F.col("tp") + F.col("fn")).alias("attacks")), "report").withColumn("gap", F.abs(F.col("n") - F.col("attacks")))
    best = rows.groupBy("report").agg(F.min("gap").alias("least"), F.min_by("n", "threshold").alias("a"), F.max_by("n", "threshold").alias("z"))
    optimal = rows.join(best, "report").where("gap = least").groupBy("report").agg(F.avg("threshold").alias("optimal"))
    return optimal.join(best.select("report", (F.abs(F.col("a") - F.col("z")) / 2).alias("ratio")), "report")


def overall_threshold(nearest: DataFrame, scores: DataFrame) -> DataFrame:
    """(optimal, average_duplicate, average_ratio, tolerated): means over reports by their f1, three digits; tolerated is a tenth of duplicates by ratio."""
    rows = nearest.join(scores.select("report", "f1", "duplicates"), "report")
    by_f1 = lambda c: F.try_divide(F.sum(F.col(c) * F.col("f1")), F.sum("f1"))
    sums = rows.agg(by_f1("optimal").alias("o"), by_f1("duplicates").alias("d"), by_f1("ratio").alias("r"))
    return sums.select(F.round("o", 3).alias("optimal"), F.round("d", 3).alias("average_duplicate"), F.round("r", 3).alias("average_ratio"), F.round(F.try_divide(F.col("d"), F.col("r")) * 0.1, 3).alias("tolerated"))
