"""The knowledge base: bundles of techniques and relationships, lookups, and stage tables read and written as JSON lines or Parquet.

A bundle is one JSON object with an array `objects`; its rows are exploded once and every view is a filter or an equi-join over them.

Edge cases: bundles whose objects lack a field read as null there (an explicit schema decides, not the data); revoked and deprecated objects are left
out; null ids and references join nothing; repeated objects give one row each unless a result says distinct; an empty bundle gives empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a bundle's objects.
OBJECT = (
    "struct<type:string,id:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,relationship_type:string,source_ref:string,target_ref:string,"
    "external_references:array<struct<source_name:string,external_id:string,url:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "x_mitre_platforms:array<string>,x_mitre_aliases:array<string>,x_mitre_shortname:string>"
)
#: Source of a technique's own id among its references.
OWN_SOURCE = "mitre-attack"
NODE = "struct<id:bigint,contracted:int,meta:struct<id:bigint,text:string,texts:array<string>,label:array<string>,verbs:array<string>,sent_index:int,type:string>>"
EDGE = "struct<id:string,source:bigint,dest:bigint,verb:string,verbs:array<string>,index:bigint>"
#: Schemas of stage tables.
GRAPHS = (
    f"id string, tech_id string, text string, graph_nodes array<{NODE}>, graph_edges array<{EDGE}>, replacement_mapper map<string,struct<text:string,label:string>>, "
    "sentences array<struct<id:int,text:string>>"
)
TECHNIQUES = (
    "id string, tech_id string, tech_name string, best_phrases array<string>, tactics array<string>, features array<string>, locations array<string>, procedures array<string>, "
    "graph_nodes array<struct<id:int,label:string,count:bigint,texts:array<string>>>, graph_edges array<struct<id:string,source:int,dest:int,count:bigint>>, verbs map<string,bigint>"
)


def bundle_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row for each object of a bundle."""
    return spark.read.schema(f"objects array<{OBJECT}>").json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")


def _live(objects: DataFrame) -> DataFrame:
    return objects.where("not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)")


def own_id(references: Column) -> Column:
    """The id that the knowledge base itself gave; null without one."""
    return F.get(F.filter(references, lambda r: (r["source_name"] == OWN_SOURCE) & r["external_id"].isNotNull()), F.lit(0))["external_id"]


def techniques(objects: DataFrame) -> DataFrame:
    """(stix_id, tech_id, name, tactics, platforms) of the techniques that are not revoked, sub-techniques included."""
    rows = _live(objects.where("type = 'attack-pattern'")).select(
        F.col("id").alias("stix_id"), own_id(F.col("external_references")).alias("tech_id"), "name",
        F.transform("kill_chain_phases", lambda k: k["phase_name"]).alias("tactics"), F.col("x_mitre_platforms").alias("platforms"),
    )
    return rows.where("tech_id is not null")


def parents(objects: DataFrame) -> DataFrame:
    """(tech_id, parent_id): each sub-technique's parent, of the subtechnique-of relationships; the smallest if there are several."""
    ids = techniques(objects).select("stix_id", "tech_id")
    links = _live(objects.where("type = 'relationship' and relationship_type = 'subtechnique-of'")).select("source_ref", "target_ref")
    sub = links.join(ids.select(F.col("stix_id").alias("source_ref"), "tech_id"), "source_ref")
    both = sub.join(ids.select(F.col("stix_id").alias("target_ref"), F.col("tech_id").alias("parent_id")), "target_ref")
    return both.groupBy("tech_id").agg(F.min("parent_id").alias("parent_id"))


def family(techs: DataFrame, parent_of: DataFrame) -> DataFrame:
    """techs with is_sub, is_parent, is_childless (neither) and children (their ids in order)."""
    below = parent_of.groupBy(F.col("parent_id").alias("tech_id")).agg(F.array_sort(F.collect_set("tech_id")).alias("children"))
    out = techs.join(parent_of, "tech_id", "left").join(below, "tech_id", "left")
    return out.withColumns({
        "is_sub": F.col("parent_id").isNotNull(), "is_parent": F.col("children").isNotNull(),
        "is_childless": F.col("parent_id").isNull() & F.col("children").isNull(), "children": F.coalesce("children", F.array().cast("array<string>")),
    })


def uses(objects: DataFrame, target: str | None = None) -> DataFrame:
    """Relationships of the type uses; target: only those that point to one id."""
    rows = objects.where("type = 'relationship' and relationship_type = 'uses'")
    return rows if target is None else rows.where(F.col("target_ref") == target)


def procedure_texts(objects: DataFrame) -> DataFrame:
    """(tech_id, platforms, id, description): one procedure for each use of a technique that is known."""
    rows = uses(objects).where("startswith(target_ref, 'attack-pattern')").select("id", "description", F.col("target_ref").alias("stix_id"))
    return rows.join(techniques(objects).select("stix_id", "tech_id", "platforms"), "stix_id").select("tech_id", "platforms", "id", "description")


def reference_urls(objects: DataFrame, source: str | None = None) -> DataFrame:
    """(id, urls) of the relationships with references. Without source: all of them, with the URLs of those that use a technique and an empty list for
    others; with source (campaign): only uses of techniques by such an object."""
    has = objects.where("type = 'relationship' and external_references is not null")
    use = F.expr("relationship_type = 'uses' and startswith(target_ref, 'attack-pattern')")
    urls = F.transform("external_references", lambda r: r["url"])
    if source is None:
        return has.select("id", F.when(use, urls).otherwise(F.array().cast("array<string>")).alias("urls"))
    return has.where(use & F.startswith("source_ref", F.lit(source))).select("id", urls.alias("urls"))


def all_urls(objects: DataFrame) -> DataFrame:
    """(url): the distinct URLs of all uses."""
    rows = uses(objects).where("external_references is not null").select(F.explode("external_references.url").alias("url"))
    return rows.where("url is not null").distinct()


def url_list(urls: DataFrame, order: str = "url") -> DataFrame:
    """(id, url, type): URLs numbered from 0 in order, pdf by their ending, else html. The number comes from counts by range, so no task sees all rows."""
    ranged = urls.select("url").where("url is not null").repartitionByRange(F.col("url")) if order == "url" else urls.where("url is not null").repartitionByRange(F.col(order))
    part = ranged.sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    part = part.select("url", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = sizes.select("_p", F.coalesce(F.expr("sum(_n) over (order by _p rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("_b"))
    kind = F.when(F.col("url").endswith(".pdf") | F.col("url").endswith(".PDF"), "pdf").otherwise("html")
    return part.join(before, "_p").select((F.col("_b") + F.col("_i")).alias("id"), "url", kind.alias("type"))


def aliases(objects: DataFrame, kind: str, once: bool) -> DataFrame:
    """(name): names and aliases of the objects of a type (malware, tool); once: without repeats."""
    rows = objects.where(F.col("type") == kind).select(F.explode(F.concat(F.array("name"), F.coalesce("x_mitre_aliases", F.array().cast("array<string>")))).alias("name"))
    rows = rows.where("name is not null")
    return rows.distinct() if once else rows


def with_tactic(tactics: DataFrame, wanted: list[str]) -> DataFrame:
    """(tech_id): techniques of a table (tech_id, tactics) that have any of the tactics."""
    return tactics.where(F.arrays_overlap("tactics", F.array(*map(F.lit, wanted)).cast("array<string>"))).select("tech_id")


def platform_mention(text: Column) -> Column:
    """What stands between the first [E1] and [/E1], trimmed; null without them."""
    found = F.regexp_extract(text, r"\[E1\](.*?)\[/E1\]", 1)
    return F.when(text.rlike(r"\[E1\].*?\[/E1\]"), F.trim(found))


def associations(sheet: DataFrame, tactics: DataFrame) -> DataFrame:
    """(source, target, n) of annotated relations (id, text, type): the target is the mention in the text, a tactic stands for all its techniques; type 0
    counts the pair backwards, 1 forwards, 2 both ways, 3 not. Unequal pairs only."""
    rows = sheet.select(F.col("id").alias("s"), platform_mention(F.col("text")).alias("t"), F.col("type").alias("k")).where("s is not null and t is not null and k in (0, 1, 2)")
    of = tactics.select(F.explode("tactics").alias("t"), "tech_id").where("startswith(t, 'TA')")
    plain = rows.where("not startswith(t, 'TA')").select("s", "t", "k")
    named = rows.join(of, "t").select("s", F.col("tech_id").alias("t"), "k")
    ahead, back = F.struct(F.col("s").alias("source"), F.col("t").alias("target")), F.struct(F.col("t").alias("source"), F.col("s").alias("target"))
    ways = F.when(F.col("k") == 1, F.array(ahead)).when(F.col("k") == 0, F.array(back)).otherwise(F.array(ahead, back))
    pairs = plain.union(named).where("s <> t").select(F.explode(ways).alias("p")).select("p.*")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


def tactic_pairs(pairs: DataFrame, tactics: DataFrame) -> DataFrame:
    """(source, target): distinct pairs of unequal tactics of associated techniques; a target that is a tactic stands for itself. Pairs are made
    distinct by the arrays of tactics first, of which there are few."""
    t = tactics.select("tech_id", "tactics")
    rows = pairs.select("source", "target").join(t.select(F.col("tech_id").alias("source"), F.col("tactics").alias("a")), "source")
    rows = rows.join(t.select(F.col("tech_id").alias("target"), F.col("tactics").alias("b")), "target", "left")
    rows = rows.select("a", F.when(F.startswith("target", F.lit("TA")), F.array("target")).otherwise(F.col("b")).alias("b")).where("b is not null").distinct()
    return rows.select(F.explode("a").alias("source"), "b").select("source", F.explode("b").alias("target")).where("source <> target").distinct()


def allowed_tactics(combinations: DataFrame) -> DataFrame:
    """(source, target) of (first, second, status): 0 both ways, 1 forwards, 2 backwards."""
    ahead, back = F.struct(F.col("first").alias("source"), F.col("second").alias("target")), F.struct(F.col("second").alias("source"), F.col("first").alias("target"))
    ways = F.when(F.col("status") == 0, F.array(ahead, back)).when(F.col("status") == 1, F.array(ahead)).when(F.col("status") == 2, F.array(back))
    return combinations.select(F.explode(ways).alias("p")).select("p.*").distinct()


def graphs(spark: SparkSession, path: str, least_nodes: int = 2, techs: list[str] | None = None) -> DataFrame:
    """Stored graphs (JSON lines or a folder of JSON objects, one a line) with at least least_nodes nodes, of the given techniques."""
    rows = spark.read.schema(GRAPHS).json(path).where(F.size("graph_nodes") >= least_nodes)
    return rows if techs is None else rows.where(F.col("tech_id").isin(techs))


def technique_files(spark: SparkSession, folder: str) -> DataFrame:
    """Techniques of a folder, one JSON object a file, T*.json."""
    return spark.read.schema(TECHNIQUES).option("pathGlobFilter", "T*.json").json(folder, multiLine=True)


def technique_phrases(techs: DataFrame) -> DataFrame:
    """(tech_id, phrases): the distinct texts of a technique's nodes that are neither ACTOR nor OTHER."""
    own = F.filter("graph_nodes", lambda n: ~n["label"].isin("ACTOR", "OTHER"))
    return techs.select("tech_id", F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda n: n["texts"])))).alias("phrases"))


def graph_tables(rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Stored graphs as relations: nodes (doc, node_id, text, texts, labels, verbs, sentence) and edges (doc, source, target, verb, verbs)."""
    n = rows.select(F.col(key).alias("doc"), F.explode("graph_nodes").alias("n"))
    nodes = n.select(
        "doc", F.col("n.id").alias("node_id"), F.col("n.meta.text").alias("text"), F.coalesce("n.meta.texts", F.array("n.meta.text")).alias("texts"),
        F.col("n.meta.label").alias("labels"), F.coalesce("n.meta.verbs", F.array().cast("array<string>")).alias("verbs"), F.col("n.meta.sent_index").alias("sentence"),
    )
    e = rows.select(F.col(key).alias("doc"), F.explode("graph_edges").alias("e"))
    edges = e.select("doc", F.col("e.source").alias("source"), F.col("e.dest").alias("target"), F.col("e.verb").alias("verb"), F.coalesce("e.verbs", F.array("e.verb")).alias("verbs"))
    return nodes, edges


def stored_graphs(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Relations as stored graphs, the other way round: nodes and edges of graph_tables, texts (doc, tech_id, text)."""
    meta = F.struct(F.col("node_id").alias("id"), "text", "texts", F.col("labels").alias("label"), "verbs", F.col("sentence").cast("int").alias("sent_index"), F.lit(None).cast("string").alias("type"))
    n = nodes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").cast("long").alias("id"), F.lit(0).alias("contracted"), meta.alias("meta")))).cast(f"array<{NODE}>").alias("graph_nodes"))
    ends = F.concat_ws("_", F.col("source").cast("string"), F.col("target").cast("string"))
    e = edges.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(ends.alias("id"), "source", F.col("target").alias("dest"), "verb", "verbs", F.lit(None).cast("long").alias("index")))).cast(f"array<{EDGE}>").alias("graph_edges"))
    out = texts.join(n, "doc", "left").join(e, "doc", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    return out.select(F.col("doc").alias("id"), "tech_id", "text", none("graph_nodes", NODE), none("graph_edges", EDGE))


def write_lines(df: DataFrame, path: str, by: list[str] | None = None, codec: str | None = "gzip", append: bool = False) -> None:
    """A table as JSON lines, in folders by columns if given."""
    out = df.write.mode("append" if append else "overwrite")
    out = out.option("compression", codec) if codec else out
    (out.partitionBy(*by) if by else out).json(path)


def log_events(events: DataFrame, path: str) -> None:
    """Appends (sub, verb, obj) of events to a log of JSON lines."""
    write_lines(events.select("sub", "verb", "obj"), path, append=True, codec=None)


def matches_with_texts(matches: DataFrame, procedures: DataFrame) -> DataFrame:
    """matches (report, location, proc, ...) with the procedures' texts (proc, tech, text); matches of unknown procedures keep null."""
    return matches.join(procedures.select("proc", "tech", F.col("text").alias("procedure_text")), "proc", "left")


def node_caption(text: Column, texts: Column, labels: Column) -> Column:
    """A node for display: its text, other texts and labels on lines of their own."""
    return F.concat_ws(" \n ", text, F.array_join(F.array_except(texts, F.array(text)), " \n "), F.array_join(labels, ", "))


def technique_tactics(techs: DataFrame) -> DataFrame:
    """(tech_id, tactics) in one sorted array a technique, for writing as a lookup."""
    return techs.select("tech_id", F.explode("tactics").alias("t")).groupBy("tech_id").agg(F.array_sort(F.collect_set("t")).alias("tactics"))


def procedure_techniques(procedures: DataFrame) -> DataFrame:
    """(proc, tech): the lookup from a procedure to its technique; of repeats the smallest."""
    return procedures.groupBy(F.col("id").alias("proc")).agg(F.min("tech_id").alias("tech"))
