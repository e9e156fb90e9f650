"""Labelled event graphs: nodes and edges from events, and nodes merged within their documents.

A document's graph is a handful of rows, so merging folds over the arrays of one document; documents are spread over tasks by their key.

Edge cases: null ends of events make no node; null or empty labels count as unlabelled; repeated events are one edge (the last one's), repeated nodes one
node; ties go to the smaller node id; empty tables give empty graphs; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a sentence's elements stand below this; a node's id is sentence * SPAN + element.
SPAN = 1000
FIRST_PERSON, PRONOUNS = ["I", "we", "We"], ["it", "they", "any"]
#: Prepositions whose objects carry no verb.
PLACES = ["in", "on", "at", "for", "inside", "of"]


def graph_nodes(events: DataFrame, doc: str, sentence: str) -> DataFrame:
    """(doc, node_id, text, labels, verbs, sentence): both ends of events (sub, obj, sub_id, obj_id, sub_label, obj_label, verb, seq); the first
    mention names the node, verbs come from those it is an object of."""
    end = lambda side, turn: F.struct(
        (F.col(sentence) * SPAN + F.col(f"{side}_id")).alias("node_id"), F.col(side).alias("text"), F.col(f"{side}_label").alias("labels"),
        F.struct("seq", F.lit(turn).alias("turn")).alias("at"), (F.when(~F.col("verb").isin(PLACES), F.col("verb")) if side == "obj" else F.lit(None).cast("string")).alias("verb"),
    )
    ends = events.select(doc, sentence, F.explode(F.array(end("sub", 0), end("obj", 1))).alias("e")).select(doc, sentence, "e.*").where(~F.col("text").isin(FIRST_PERSON))
    first = F.min_by(F.struct("text", "labels"), "at").alias("_f")
    out = ends.groupBy(doc, "node_id", sentence).agg(first, F.array_sort(F.collect_set("verb")).alias("verbs"))
    return out.select(doc, "node_id", F.col("_f.text").alias("text"), F.col("_f.labels").alias("labels"), "verbs", sentence)


def graph_edges(events: DataFrame, doc: str, sentence: str) -> DataFrame:
    """(doc, source, target, verb, verb_index, flag): the last event between two nodes stays; first persons take no part."""
    rows = events.where(~F.col("sub").isin(FIRST_PERSON) & ~F.col("obj").isin(FIRST_PERSON)).select(
        doc, (F.col(sentence) * SPAN + F.col("sub_id")).alias("source"), (F.col(sentence) * SPAN + F.col("obj_id")).alias("target"), "verb", "verb_index", "flag", "seq"
    )
    last = rows.groupBy(doc, "source", "target").agg(F.max_by(F.struct("verb", "verb_index", "flag"), "seq").alias("_l"))
    return last.select(doc, "source", "target", "_l.verb", "_l.verb_index", "_l.flag")


def components(links: DataFrame, doc: str, a: str, b: str) -> DataFrame:
    """(doc, node, main): nodes that links join, with the smallest of their component. One pass over a document's links: each gives the greater
    of two components the label of the lesser."""
    rows = links.where(F.col(a) != F.col(b)).groupBy(doc).agg(F.array_sort(F.collect_set(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))).alias("_l"))
    ids = F.array_sort(F.array_distinct(F.concat(F.transform("_l", lambda x: x["a"]), F.transform("_l", lambda x: x["b"]))))
    start = F.transform(ids, lambda n: F.struct(n.alias("node"), n.alias("main")))

    def join(state: Column, link: Column) -> Column:
        main = lambda n: F.filter(state, lambda s: s["node"] == n)[0]["main"]
        both = F.array(main(link["a"]), main(link["b"]))
        low, high = F.array_min(both), F.array_max(both)
        pair = F.struct(low.alias("low"), high.alias("high"))
        return F.flatten(F.transform(F.array(pair), lambda p: F.transform(state, lambda s: F.struct(s["node"].alias("node"), F.when(s["main"] == p["high"], p["low"]).otherwise(s["main"]).alias("main")))))

    return rows.select(doc, F.explode(F.aggregate("_l", start, join)).alias("_s")).select(doc, "_s.node", "_s.main")


def actor_merges(nodes: DataFrame, doc: str, least: int = 3) -> DataFrame:
    """(doc, node, main): nodes that are only ACTOR go into the first of them that is no pronoun, in graphs of more than `least` nodes that have
    one."""
    only = (F.size("labels") == 1) & (F.get("labels", F.lit(0)) == "ACTOR")
    rows = nodes.groupBy(doc).agg(F.count("*").alias("n"), F.min(F.when(only & ~F.coalesce(F.lower("text").isin(PRONOUNS), F.lit(False)), F.col("node_id"))).alias("main"), F.collect_list(F.when(only, F.col("node_id"))).alias("_a"))
    return rows.where((F.col("n") > least) & F.col("main").isNotNull()).select(doc, F.explode("_a").alias("node"), "main")


def merge_nodes(nodes: DataFrame, merges: DataFrame, doc: str) -> DataFrame:
    """(doc, node_id, text, texts, labels, verbs, ids): merged nodes take the main node's text and all texts, labels and verbs."""
    to = merges.select(doc, F.col("node").alias("node_id"), "main")
    rows = nodes.join(to, [doc, "node_id"], "left").withColumn("main", F.coalesce("main", "node_id"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy(doc, "main").agg(
        F.min_by("text", F.struct(F.col("node_id") != F.col("main"), "node_id")).alias("text"), F.array_sort(F.collect_set("text")).alias("texts"),
        every("labels").alias("labels"), every("verbs").alias("verbs"), F.array_sort(F.collect_list("node_id")).alias("ids"),
    ).withColumnRenamed("main", "node_id")


def merge_edges(edges: DataFrame, merges: DataFrame, doc: str) -> DataFrame:
    """Edges between main nodes; loops go, and of parallel ones that with the smallest ends before merging stays."""
    out = edges
    for end in ("source", "target"):
        to = merges.select(doc, F.col("node").alias(end), F.col("main").alias(f"_{end}"))
        out = out.join(to, [doc, end], "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    rest = [c for c in edges.columns if c not in (doc, "source", "target")]
    kept = out.where("_source <> _target").groupBy(doc, "_source", "_target").agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), F.struct("source", "target")).alias("_k"))
    return kept.select(doc, F.col("_source").alias("source"), F.col("_target").alias("target"), *(f"_k.{c}" for c in rest))


def connected_nodes(nodes: DataFrame, edges: DataFrame, doc: str) -> DataFrame:
    """Edges with both ends in nodes; a graph with two or more nodes and no such edge gets one between its first two."""
    ids = nodes.select(doc, "node_id")
    real = edges.select(doc, "source", "target", "verb").join(ids.withColumnRenamed("node_id", "source"), [doc, "source"], "left_semi")
    real = real.join(ids.withColumnRenamed("node_id", "target"), [doc, "target"], "left_semi").select(doc, "source", "target", "verb")
    pairs = nodes.groupBy(doc).agg(F.min("node_id").alias("source"), F.count("*").alias("_n")).where("_n >= 2")
    lone = pairs.join(real.select(doc).distinct(), doc, "left_anti")
    second = nodes.join(lone.select(doc, "source"), doc).where("node_id > source").groupBy(doc, "source").agg(F.min("node_id").alias("target"))
    return real.unionByName(second.select(doc, "source", "target", F.lit("any").alias("verb")))


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size("labels") > 0)


def undirected(edges: DataFrame, doc: str) -> DataFrame:
    """Both directions of every edge, once."""
    turned = edges.select(doc, F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.select(doc, "source", "target").union(turned).distinct()
