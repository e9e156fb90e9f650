"""From events to the graphs of reports and procedures: placeholders of entities, mention chains, merges in their order, pruning and stages.

Reports merge actors and equivalences and get their edges before pruning; procedures merge mention chains and conjuncts too and get their edges after it.

Edge cases: null documents and texts take no part; documents without events have no graph; nodes with no labels count as unlabelled; repeated events are one
edge; ties go to the smaller node id; empty tables give empty graphs; extra columns of events are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import graphs, labelling

#: Words that a chain replaces, those that stay themselves, and ends of texts that name a purpose.
MENTION_WORDS = ["it", "they", "them", "he", "she", "him", "her", "this", "that", "these", "those", "itself", "themselves", "himself", "herself"]
REFLEXIVES = ["itself", "themselves", "himself", "herself"]
PERSONS = ["them", "they", "it", "he", "she", "her", "him"]
BARE = ["it", "they", "any"]
PURPOSE = r"(?i)(lateral movement|initial access|execution|exfiltration|escalation|evasion|discovery|collection|credential access|persistence)$"


def _first_replaced(text: Column, old: Column, new: Column) -> Column:
    at = F.locate(old, text) if isinstance(old, str) else F.expr("0") + F.position(old, text)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def entity_placeholders(text: Column, patterns: Iterable[str]) -> Column:
    """struct(text, n, found): entities that patterns find, one pattern after the other. Those of more than one word become ENTITYn, numbered on; others lose
    their code marks. found: array of (placeholder, text)."""
    kind = "struct<text:string,n:int,found:array<struct<placeholder:string,text:string>>>"
    state = F.struct(text.alias("text"), F.lit(0).alias("n"), F.array().cast("array<struct<placeholder:string,text:string>>").alias("found")).cast(kind)

    def one(acc: Column, entity: Column) -> Column:
        real = F.replace(F.regexp_replace(entity, "</?code>", ""), F.lit("`"), F.lit(""))
        name = F.concat(F.lit("ENTITY"), acc["n"].cast("string"))
        several = F.size(F.filter(F.split(real, r"\s+"), lambda w: w != "")) > 1
        return F.struct(
            _first_replaced(acc["text"], entity, F.when(several, name).otherwise(real)).alias("text"), (acc["n"] + several.cast("int")).alias("n"),
            F.when(several, F.concat(acc["found"], F.array(F.struct(name.alias("placeholder"), real.alias("text"))))).otherwise(acc["found"]).alias("found"),
        )

    for p in patterns:
        hits = F.filter(F.transform(F.regexp_extract_all(state["text"], F.lit(p), F.lit(0)), lambda x: F.trim(x)), lambda h: h != "")
        state = F.aggregate(hits, state, one)
    return state


def with_placeholders(texts: DataFrame, patterns: Iterable[str], lexicon: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, text, replaced): texts with their entities as placeholders. ENTITYn of the patterns take the label of their phrase, <LABEL>n stand for the strong
    spans of a lexicon, longest first, numbered on. replaced: map from placeholder to (text, label). Null texts are empty."""
    rows = texts.select(key, entity_placeholders(F.coalesce(F.col(text), F.lit("")), patterns).alias("e"))
    rows = rows.select(key, F.explode(F.array("e")).alias("e"))
    entities = rows.select(key, F.explode("e.found").alias("f")).select(key, F.col("f.placeholder").alias("placeholder"), F.col("f.text").alias("phrase"))
    told = labelling.label_phrases(entities, lexicon).groupBy(key).agg(F.collect_list(F.struct("placeholder", F.struct(F.col("phrase").alias("text"), "label").alias("v"))).alias("named"))
    spans = labelling.special_spans(rows.select(key, F.col("e.text").alias("t")), lexicon, key, "t")
    spans = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("s") - F.col("e")).alias("n"), "s", "text", "label"))).alias("spans"))
    out = rows.join(told, key, "left").join(spans, key, "left")
    pair = "struct<placeholder:string,v:struct<text:string,label:string>>"
    start = F.struct(F.col("e.text").alias("text"), F.col("e.n").alias("n"), F.coalesce("named", F.array().cast(f"array<{pair}>")).alias("found")).cast(f"struct<text:string,n:int,found:array<{pair}>>")

    def one(acc: Column, x: Column) -> Column:
        name = F.concat(x["label"], acc["n"].cast("string"))
        found = F.struct(name.alias("placeholder"), F.struct(F.trim(x["text"]).alias("text"), x["label"].alias("label")).alias("v"))
        return F.struct(_first_replaced(acc["text"], x["text"], name).alias("text"), (acc["n"] + 1).alias("n"), F.concat(acc["found"], F.array(found)).alias("found"))

    none = F.array().cast("array<struct<n:int,s:int,text:string,label:string>>")
    done = out.select(key, F.explode(F.array(F.aggregate(F.coalesce("spans", none), start, one))).alias("d"))
    return done.select(key, F.col("d.text").alias("text"), F.map_from_entries("d.found").alias("replaced"))


def chain_merges(nodes: DataFrame, mentions: DataFrame, doc: str, groups: dict[str, list[str]], strong: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(merges (doc, node, main), relabelled (doc, node_id, labels)) of mention chains (doc, chain, seq, node_id, pos, size). A chain's main mention is its first proper
    noun, else its first noun, else its first of size 1, that is a node. Others merge into it, but for reflexives, nodes that are only OTHER where the main one is
    not (pronouns excepted), and pronouns that a strong verb acts on, which take the main one's labels."""
    at = mentions.join(nodes.select(doc, "node_id", "text", "labels", "verbs"), [doc, "node_id"])
    rank = F.struct(F.when(F.col("pos") == "PROPN", 0).when(F.col("pos") == "NOUN", 1).otherwise(2).alias("r"), "seq", "node_id", "labels")
    main = at.where("size = 1").groupBy(doc, "chain").agg(F.min(rank).alias("m")).select(doc, "chain", F.col("m.node_id").alias("main"), F.col("m.labels").alias("main_labels"))
    rows = at.join(main, [doc, "chain"]).where("node_id <> main")
    low = F.lower("text")
    only_other = (F.size("labels") == 1) & F.array_contains("labels", "OTHER")
    apart = only_other & ~F.array_contains("main_labels", "OTHER") & ~low.isin(MENTION_WORDS)
    person = low.isin(PERSONS) & labelling.strong_verbs(F.coalesce("verbs", F.array().cast("array<string>")), groups, strong)
    rows = rows.where(~apart & ~low.isin(REFLEXIVES))
    first = lambda df, *c: df.groupBy(doc, "node_id").agg(F.min_by(F.struct(*c), "chain").alias("x"))
    merges = first(rows.where(~person), "main").select(doc, F.col("node_id").alias("node"), F.col("x.main").alias("main"))
    relabelled = first(rows.where(person), "main_labels").select(doc, "node_id", F.col("x.main_labels").alias("labels"))
    return merges, relabelled


def combined_merges(doc: str, *merges: DataFrame) -> DataFrame:
    """(doc, node, main) of several merge tables (doc, node, main) at once: what any of them joins is one node, whose main one is the smallest that
    merges into no other, else the smallest."""
    links = merges[0].select(doc, "node", "main")
    for m in merges[1:]:
        links = links.union(m.select(doc, "node", "main"))
    links = links.where("node <> main").distinct()
    parts = graphs.components(links, doc, "node", "main").select(doc, "node", F.col("main").alias("part"))
    moved = links.select(doc, "node", F.lit(True).alias("moved")).distinct()
    ranked = parts.join(moved, [doc, "node"], "left").groupBy(doc, "part").agg(F.min(F.struct(F.coalesce("moved", F.lit(False)).alias("moved"), "node")).alias("m"))
    return parts.join(ranked.select(doc, "part", F.col("m.node").alias("main")), [doc, "part"]).select(doc, "node", "main")


def equivalences(edges: DataFrame, nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, node, main): the targets of edges that say two nodes are the same (flag 1) go into their sources, but for reflexive sources."""
    said = nodes.select(doc, F.col("node_id").alias("source"), "text")
    rows = edges.where("flag = 1").join(said, [doc, "source"]).where(~F.lower("text").isin(REFLEXIVES))
    return rows.select(doc, F.col("target").alias("node"), F.col("source").alias("main"))


def pruned(nodes: DataFrame, doc: str, report: bool, malware: Iterable[str] = ()) -> DataFrame:
    """Merged nodes (doc, node_id, text, texts, labels, verbs, ids) as a graph keeps them: bare pronouns are ACTORs; ANY goes unless others merged into it. Procedures
    lose nodes that name a purpose, and a first node (of several) that is malware is an ACTOR. Reports without a node 0 and an actor get the node 0, attacker."""
    bare = F.lower("text").isin(BARE)
    rows = nodes.withColumn("labels", F.when(bare, F.array(F.lit("ACTOR"))).otherwise(F.array_sort(F.array_distinct("labels"))))
    rows = rows.where(~((F.col("text") == "ANY") & (F.size("ids") <= 1)))
    if not report:
        rows = rows.where(~F.coalesce(F.col("text").rlike(PURPOSE), F.lit(False)))
        own = Window.partitionBy(doc)
        first = (F.col("node_id") == F.min("node_id").over(own)) & (F.count("*").over(own) > 1) & F.col("text").isin(list(malware))
        return rows.withColumn("_first", first).withColumn("labels", F.when(F.col("_first"), F.array(F.lit("ACTOR"))).otherwise(F.col("labels"))).drop("_first")
    acted = rows.where("node_id = 0 or array_contains(labels, 'ACTOR')").select(doc).distinct()
    alone = nodes.select(doc).distinct().join(acted, doc, "left_anti")
    empty = F.array().cast("array<string>")
    pseudo = {"node_id": F.lit(0), "text": F.lit("attacker"), "texts": F.array(F.lit("attacker")), "labels": F.array(F.lit("ACTOR")), "verbs": empty, "ids": F.array(F.lit(0))}
    kinds = dict(rows.dtypes)
    return rows.unionByName(alone.select(doc, *(v.cast(kinds[c]).alias(c) for c, v in pseudo.items() if c in kinds)), allowMissingColumns=True)


def event_graph(
    events: DataFrame, doc: str, sentence: str, report: bool = True, mentions: DataFrame | None = None, conjuncts: DataFrame | None = None, malware: Iterable[str] = (),
    groups: dict[str, list[str]] | None = None, strong: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each document's events (sub, obj, sub_id, obj_id, sub_label, obj_label, verb, verb_index, flag, seq). mentions (procedures): chains of
    chain_merges; conjuncts (procedures): (doc, node, main) of conjoined phrases, main the head of the chain."""
    nodes, edges = graphs.graph_nodes(events, doc, sentence), graphs.graph_edges(events, doc, sentence)
    merges = []
    if not report and mentions is not None:
        own, relabelled = chain_merges(nodes, mentions, doc, groups or {}, strong)
        new = relabelled.withColumnRenamed("labels", "_l")
        nodes = nodes.join(new, [doc, "node_id"], "left").withColumn("labels", F.coalesce("_l", "labels")).drop("_l")
        merges.append(own)
    merges += [graphs.actor_merges(nodes, doc), equivalences(edges, nodes, doc)]
    if not report and conjuncts is not None:
        merges.append(conjuncts.select(doc, "node", "main"))
    one = combined_merges(doc, *merges)
    joined, linked = graphs.merge_nodes(nodes, one, doc), graphs.merge_edges(edges.where("flag <> 1 or flag is null"), one, doc)
    kept = pruned(joined, doc, report, malware)
    return (kept, graphs.connected_nodes(joined, linked, doc)) if report else (kept, graphs.connected_nodes(kept, linked, doc))


def usable(nodes: DataFrame, edges: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Procedure graphs without unlabelled nodes; graphs without nodes or without edges are rejected."""
    held = nodes.where(F.size("labels") > 0)
    good = held.select(doc).distinct().join(edges.select(doc).distinct(), doc, "left_semi")
    return held.join(good, doc, "left_semi"), edges.join(good, doc, "left_semi")


def procedure_text(text: Column) -> Column:
    """A procedure's text; one that begins with "can" is told of "It"."""
    return F.when(text.startswith("can"), F.concat(F.lit("It "), text)).otherwise(text)


def edge_deviation(edges: DataFrame, doc: str) -> DataFrame:
    """(doc, deviation): the sample deviation of a graph's edge places; null for a single edge."""
    return edges.groupBy(doc).agg(F.stddev_samp("verb_index").alias("deviation"))


def by_location(aligned: DataFrame, procedure_nodes: DataFrame, least_nodes: int = 2) -> DataFrame:
    """(report, location, alignments): the alignments of procedures of at least least_nodes nodes, best first."""
    large = procedure_nodes.groupBy("proc").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_nodes).select("proc")
    rows = aligned.join(large, "proc", "left_semi")
    item = F.struct((-F.col("score")).alias("s"), "proc", "score", "ats", "sentences")
    listed = rows.groupBy("report", "location").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return listed.select("report", "location", F.transform("a", lambda x: F.struct(x["proc"].alias("proc"), x["score"].alias("score"), x["ats"].alias("ats"), x["sentences"].alias("sentences"))).alias("alignments"))


def label_place(matched: Column, features: Column) -> Column:
    """The smallest place among nodes (place, labels) that share a label with a technique's features; null without one."""
    return F.array_min(F.transform(F.filter(matched, lambda x: F.arrays_overlap(x["labels"], features)), lambda x: x["place"]))


class Stages:
    """Named stages over tables of one folder: a stage whose table is there is read, another is made, written and read back, so a run that ends early is
    taken up where it stopped. fresh: stages that are made again in any case."""

    def __init__(self, spark: SparkSession, folder: str, fresh: Iterable[str] = ()):
        self.spark, self.folder, self.fresh, self.seconds = spark, folder.rstrip("/"), set(fresh), {}

    def _done(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage. seconds[name] is the time that making it took."""
        import time

        at = f"{self.folder}/{name}"
        if name in self.fresh or not self._done(name):
            began = time.time()
            make().write.mode("overwrite").parquet(at)
            self.seconds[name] = time.time() - began
            self.fresh.discard(name)
        return self.spark.read.parquet(at)
