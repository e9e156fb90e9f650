"""Placeholders, mention chains, merges, pruning, stages and streams on hand-made rows."""

from pyspark.sql import functions as F

from tracewell.operators import graphs, report_graphs, techniques
from tracewell.streaming import events as stream_events

NODES = "doc string, node_id int, text string, labels array<string>, verbs array<string>"


def test_placeholders(spark):
    lexicon = spark.createDataFrame([("DIRECTORY", "strong_regex", r"c:\\\w+"), ("NETWORK", "strong_special", "10.0.0.1"), ("DATA", "keyword", "temp file")], "label string, kind string, term string")
    df = spark.createDataFrame([(1, "ran `my temp file` then `x` at C:\\win and 10.0.0.1, or `a temp file`"), (2, None), (3, "")], "doc int, text string")
    got = {r.doc: r for r in report_graphs.with_placeholders(df, [r"`[^`]*`"], lexicon).collect()}
    assert got[1].text == "ran ENTITY0 then x at DIRECTORY3 and NETWORK2, or ENTITY1"
    assert {k: (v.text, v.label) for k, v in got[1].replaced.items()} == {
        "ENTITY0": ("my temp file", "DATA"), "ENTITY1": ("a temp file", "DATA"), "NETWORK2": ("10.0.0.1", "NETWORK"), "DIRECTORY3": ("C:\\win", "DIRECTORY")
    }
    assert got[2].text == "" and got[3].text == "" and not got[3].replaced


def test_chains(spark):
    nodes = spark.createDataFrame([
        ("d", 1, "Foo", ["ACTOR"], []), ("d", 2, "it", ["OTHER"], ["use"]), ("d", 3, "them", ["OTHER"], ["delete"]), ("d", 4, "itself", ["OTHER"], []), ("d", 5, "a thing", ["OTHER"], []), ("d", 6, "the group", ["ACTOR"], []),
    ], NODES)
    mentions = spark.createDataFrame([("d", 1, k, n, pos, 1) for k, (n, pos) in enumerate([(2, "PRON"), (6, "NOUN"), (1, "PROPN"), (3, "PRON"), (4, "PRON"), (5, "NOUN"), (9, "PROPN")])], "doc string, chain int, seq int, node_id int, pos string, size int")
    merges, relabelled = report_graphs.chain_merges(nodes, mentions, "doc", {"delete": ["delete"]}, ["delete"])
    assert sorted((r.node, r.main) for r in merges.collect()) == [(2, 1), (6, 1)]
    assert [(r.node_id, r.labels) for r in relabelled.collect()] == [(3, ["ACTOR"])]
    more = spark.createDataFrame([("d", 1, 5), ("e", 1, 2)], "doc string, node int, main int")
    got = sorted((r.doc, r.node, r.main) for r in report_graphs.combined_merges("doc", merges, more).collect())
    assert got == [("d", 1, 5), ("d", 2, 5), ("d", 5, 5), ("d", 6, 5), ("e", 1, 2), ("e", 2, 2)]


EVENTS = "doc string, sentence int, sub string, sub_id int, sub_label array<string>, verb string, verb_index int, obj string, obj_id int, obj_label array<string>, flag int, seq int"


def test_event_graphs(spark):
    rows = [
        ("d", 0, "Foo", 1, ["ACTOR"], "drop", 1, "file", 2, ["DATA"], 0, 0), ("d", 0, "file", 2, ["DATA"], "named", 2, "x.exe", 3, ["DATA"], 1, 1), ("d", 1, "it", 1, ["ACTOR"], "in", 1, "folder", 2, ["DIRECTORY"], 0, 2),
        ("d", 1, "ANY", 0, ["ACTOR"], "run", 2, "discovery", 4, ["OTHER"], 0, 3), ("e", 0, "host", 1, ["NETWORK"], "run", 1, "tool", 2, ["FUNCTION"], 0, 0), ("f", 0, "I", 1, ["USER"], "run", 1, "tool", 2, ["FUNCTION"], 0, 0),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    nodes, edges = report_graphs.event_graph(events, "doc", "sentence")
    got = {(r.doc, r.node_id): (r.text, r.texts, r.labels, r.verbs) for r in nodes.collect()}
    assert got["d", 1][1] == ["ANY", "Foo", "it"] and got["d", 2][1] == ["file", "x.exe"] and got["d", 1002][3] == []
    assert got["e", 0][0] == "attacker" and got["f", 0][2] == ["ACTOR"] and ("d", 1004) in got
    assert {(r.doc, r.source, r.target) for r in edges.collect()} == {("d", 1, 2), ("d", 1, 1002), ("d", 1, 1004), ("e", 1, 2)}
    procedure, linked = report_graphs.event_graph(events, "doc", "sentence", report=False, malware=["host"])
    names = {(r.doc, r.text): r.labels for r in procedure.collect()}
    assert ("d", "discovery") not in names and names["e", "host"] == ["ACTOR"] and ("e", "attacker") not in names
    held, kept = report_graphs.usable(procedure, linked, "doc")
    assert {r.doc for r in held.collect()} == {r.doc for r in kept.collect()} == {"d", "e"}
    assert report_graphs.event_graph(events.limit(0), "doc", "sentence")[0].count() == 0
    assert [r.deviation for r in report_graphs.edge_deviation(graphs.graph_edges(events, "doc", "sentence").where("doc = 'f'"), "doc").collect()] == []


def test_accumulation(spark):
    nodes = spark.createDataFrame([("a", 1, ["x"], ["ACTOR"], []), ("a", 2, ["y"], ["DATA"], ["use"]), ("b", 7, ["z"], ["USER"], ["run"]), ("b", 8, ["w"], ["DATA"], [])], "doc string, node_id int, texts array<string>, labels array<string>, verbs array<string>")
    edges = spark.createDataFrame([("a", 1, 2, "use"), ("b", 8, 7, "open")], "doc string, source int, target int, verb string")
    matches = spark.createDataFrame([("a", 1, "b", 7), ("a", 2, "b", 8)], "doc string, node_id int, other string, other_node int")
    n, e = techniques.accumulated(nodes, edges, matches)
    got = {(r.doc, r.node_id): (r.texts, r.labels, r.verbs) for r in n.collect()}
    assert got["a", 1] == (["x", "z"], ["ACTOR", "USER"], ["run"]) and got["a", 2] == (["w", "y"], ["DATA"], ["use"]) and got["b", 7][0] == ["z"]
    assert {(r.doc, r.source): r.verbs for r in e.collect()} == {("a", 1): ["open", "use"], ("b", 8): ["open"]}


def test_small_rules(spark):
    one = spark.range(1).select(
        report_graphs.procedure_text(F.lit("can run")).alias("a"), report_graphs.procedure_text(F.lit("runs")).alias("b"),
        report_graphs.label_place(F.expr("array(struct(5 as place, array('A') as labels), struct(3 as place, array('B') as labels))"), F.array(F.lit("A"))).alias("c"),
        techniques.is_named(F.lit("T1.1"), F.lit("Name"), F.array(F.lit("TA1"))).alias("d"), techniques.is_named(F.lit("T1.1"), F.lit("Name"), F.array(F.lit("TA0007"))).alias("e"),
    ).first()
    assert tuple(one) == ("It can run", "runs", 5, True, False)
    techs = spark.createDataFrame([("T1.1", "Loader", ["TA1"], ["p"]), ("T2", "Other", ["TA1"], ["p"])], "tech_id string, name string, tactics array<string>, procedures array<string>")
    nodes = spark.createDataFrame([("p", 1, ["A Loader here", "cve-2020-12345"], ["FUNCTION"]), ("p", 2, ["it"], ["ACTOR"])], "doc string, node_id int, texts array<string>, labels array<string>")
    edges = spark.createDataFrame([("p", 2, 1, "run")], "doc string, source int, target int, verb string")
    got = {r.tech_id: r.best_phrases for r in techniques.technique_phrases(techs, nodes, edges).collect()}
    assert got == {"T1.1": ["Loader", "a loader here", "cve-2020-12345"], "T2": ["cve-2020-12345"]}
    assert sorted((r.doc, r.phrase) for r in techniques.phrase_set(nodes, ["doc"]).collect()) == [("p", "A Loader here"), ("p", "attacker"), ("p", "cve-2020-12345")]
    paths = spark.createDataFrame([(["T1", "T2", "T1"],), (["T2"],)], "path array<string>")
    assert [tuple(r) for r in techniques.top_techniques(paths, 1).collect()] == [("T2", 2)]
    pairs = spark.createDataFrame([("a", "b", 3), ("a", "c", 5), ("b", "c", 9)], "source string, target string, n int")
    assert [tuple(r) for r in techniques.top_pairs(pairs, 1, "a").collect()] == [("a", "c", 5)]
    scores = spark.createDataFrame([("r", 0.5, 2)], "report string, f1 double, duplicates int")
    near = spark.createDataFrame([("r", 0.85, 4.0)], "report string, optimal double, ratio double")
    assert tuple(techniques.overall_threshold(near, scores).first()) == (0.85, 2.0, 4.0, 0.05)
    assert techniques.mean_f1(scores, 2).first()[0] == 0.25


def test_stages_are_taken_up(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    s = report_graphs.Stages(spark, str(tmp_path))
    assert s.run("a", lambda: make(3)).count() == 3 and "a" in s.seconds
    again = report_graphs.Stages(spark, str(tmp_path), fresh=["b"])
    assert again.run("a", lambda: make(4)).count() == 3 and again.run("b", lambda: make(5)).count() == 5
    assert made == [3, 5]


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_events.label_counts(stream).writeStream.format("memory").queryName("label_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r.start), r.label): r.n for r in spark.table("label_counts").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 01:00:00", "b"): 1}
