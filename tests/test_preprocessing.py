"""Line rules, enumerations, clauses and blocks on hand-made texts, and the knowledge base's files."""

import json

from pyspark.sql import functions as F

from tracewell.functions import preprocessing as P
from tracewell.sources import knowledge, reports

TOKEN = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int>>"


def test_enumerations(spark):
    docs = spark.createDataFrame([(1, "Intro\n\u2022 dropping a new file\n\u2022 two words\n\u2022 browses the web now\n\u2022 It runs a tool\n\ufb01le"), (2, None), (3, "")], "id int, text string")
    tok = lambda *w: [(i, *x) for i, x in enumerate(w)]
    parsed = spark.createDataFrame([
        (1, 1, tok(("dropping", "drop", "VERB", "ROOT", 0), ("a", "a", "DET", "det", 3), ("new", "new", "ADJ", "amod", 3), ("file", "file", "NOUN", "dobj", 0))),
        (1, 3, tok(("browses", "browse", "NOUN", "compound", 2), ("the", "the", "DET", "det", 2), ("web", "web", "NOUN", "ROOT", 2), ("now", "now", "ADV", "advmod", 2))),
        (1, 4, tok(("it", "it", "PRON", "nsubj", 1), ("runs", "run", "VERB", "ROOT", 1), ("a", "a", "DET", "det", 3), ("tool", "tool", "NOUN", "dobj", 1))),
    ], f"id int, line int, tokens {TOKEN}")
    got = {r.id: r.text for r in P.fixed_enumerations(docs, parsed, "id", "text").collect()}
    assert got[1] == "Intro\nAttacker can drop a new file\n\u2022 two words\nAttacker can browse the web now\n\u2022 It runs a tool\nfile" and got[2] is None and got[3] == ""


def test_sentences_and_nodes(spark):
    df = spark.createDataFrame([("ENTITY1", {"ENTITY1": "My File", "ENTITY2": "It"}), ("ENTITY2", {"ENTITY2": "It"}), ("They", {}), ("x", {})], "t string, m map<string,string>")
    assert [r[0] for r in df.select(P.true_text(F.col("t"), F.col("m"))).collect()] == ["my file", "attacker", "attacker", "x"]
    toks = [(0, "run", "run", "VERB", "ROOT", 0), (1, "it", "it", "PRON", "dobj", 0), (2, "when", "when", "ADV", "advmod", 3), (3, "started", "start", "VERB", "advcl", 0)]
    one = spark.createDataFrame([(toks,)], f"t {TOKEN}").select(P.adverbial_clauses(F.col("t")).alias("a"), P.joined_tokens(F.col("t")).alias("b"), P.lemma_of(F.lit("started"), F.col("t")).alias("c")).first()
    assert one.a == ["run it", "when started"] and one.b == "run it when started" and one.c == "start"
    sets = spark.createDataFrame([(["The File"], ["the files", "x"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in sets.select(P.most_similar(F.col("a"), F.col("b"))).collect()] == [0.941, 0.0]
    assert [r[0] for r in sets.select(P.any_stands_in(F.col("a"), F.array(F.lit("open the file now")))).collect()] == [True, False]


def test_blocks(spark):
    lines = ["Figure 1 a caption", "1. Introduction", "This line goes", "on here.", "\u2022 first item", "\u2022 second", "item ends.", "ALL CAPS", "Then a new one.", "lower after stop."]
    df = spark.createDataFrame([(lines,), ([],), (["only one."],)], "l array<string>")
    got = [r[0] for r in df.select(P.blocks(F.col("l"))).collect()]
    assert got[0] == ["1. Introduction", "This line goes on here.\n\u2022 first item\n\u2022 second item ends.", "ALL CAPS", "Then a new one. lower after stop."] and got[1] == [] and got[2] == ["only one."]
    page = "\n".join(["Head-\\nline"] + ["same"] * 6 + ["12", " kept "] + ["five"] * 5)
    made = spark.createDataFrame([(page,)], "t string").select(P.page_lines(F.col("t"))).first()[0]
    assert made == ["Head-", "line", "kept"] + ["five"] * 5
    groups = spark.createDataFrame([(["a" * 600, "b" * 300, "see:", "c" * 600, "2. Head\n" + "d" * 300],)], "l array<string>").select(P.grouped_blocks(F.col("l"))).first()[0]
    assert [len(x) for x in groups] == [901, 605, 308]
    prose = "The quick brown fox jumps over the lazy dog and then it goes on and on without an end"
    df = spark.createDataFrame([(prose, True), (prose, False), ("Figure 1. " + prose, True), ("Short one", True), ("Ends:", True), ("", True), (None, True)], "t string, e boolean")
    assert [tuple(r) for r in df.select(P.is_prose(F.col("t"), F.col("e")), P.is_good(F.col("t"), F.col("e"))).collect()] == [(True, True), (False, False), (False, False), (False, False), (False, True), (False, False), (False, False)]
    two = spark.createDataFrame([(f"{prose}\n\nNo",)], "t string").select(P.mostly_prose(F.col("t"), F.lit(True)), P.prose_lines(F.col("t"), F.lit(True))).first()
    assert tuple(two) == (False, prose)


def test_files(spark, tmp_path):
    ref = lambda i, source="mitre-attack": [{"source_name": source, "external_id": i, "url": f"http://{i}"}]
    objects = [
        {"type": "attack-pattern", "id": "attack-pattern--1", "name": "One", "external_references": ref("T1"), "x_mitre_platforms": ["PRE"], "kill_chain_phases": [{"kill_chain_name": "c", "phase_name": "x"}]},
        {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Two", "external_references": ref("other", "x") + ref("T1.001")}, {"type": "attack-pattern", "id": "attack-pattern--3", "name": "Old", "revoked": True, "external_references": ref("T3")},
        {"type": "relationship", "id": "r1", "relationship_type": "subtechnique-of", "source_ref": "attack-pattern--2", "target_ref": "attack-pattern--1"},
        {"type": "relationship", "id": "r2", "relationship_type": "uses", "source_ref": "campaign--1", "target_ref": "attack-pattern--2", "description": "does", "external_references": ref("a")},
    ]
    (tmp_path / "bundle.json").write_text(json.dumps({"objects": objects}))
    o = knowledge.bundle_objects(spark, str(tmp_path / "bundle.json"))
    assert sorted(r.tech_id for r in knowledge.techniques(o).collect()) == ["T1", "T1.001"]
    assert [tuple(r) for r in knowledge.parents(o).collect()] == [("T1.001", "T1")]
    assert [(r.tech_id, r.description) for r in knowledge.procedure_texts(o).collect()] == [("T1.001", "does")]
    assert knowledge.uses(o, "attack-pattern--2").count() == 1 and [r.url for r in knowledge.all_urls(o).collect()] == ["http://a"]
    node = {"id": 1, "contracted": 0, "meta": {"id": 1, "text": "x", "label": ["DATA"], "sent_index": 0}}
    graph = {"id": "p", "tech_id": "T1", "text": "t", "graph_nodes": [node, {**node, "id": 2}], "graph_edges": [{"id": "1_2", "source": 1, "dest": 2, "verb": "run"}]}
    (tmp_path / "g.jsonl").write_text(json.dumps(graph) + "\n" + json.dumps({**graph, "id": "q", "graph_nodes": [node]}) + "\n")
    rows = knowledge.graphs(spark, str(tmp_path / "g.jsonl"))
    nodes, edges = knowledge.graph_tables(rows)
    assert [(r.doc, r.node_id, r.texts) for r in nodes.orderBy("node_id").collect()] == [("p", 1, ["x"]), ("p", 2, ["x"])] and edges.first().verbs == ["run"]
    assert knowledge.graphs(spark, str(tmp_path / "g.jsonl"), techs=["T9"]).count() == 0
    back = knowledge.stored_graphs(nodes, edges, spark.createDataFrame([("p", "T1", "t")], "doc string, tech_id string, text string"))
    knowledge.write_lines(back, str(tmp_path / "out"), by=["tech_id"])
    again = knowledge.graph_tables(spark.read.schema(knowledge.GRAPHS).json(str(tmp_path / "out")))
    assert again[0].count() == 2 and again[1].first().source == 1
    knowledge.log_events(spark.createDataFrame([("a", "b", "c", 1)], "sub string, verb string, obj string, n int"), str(tmp_path / "log"))
    knowledge.log_events(spark.createDataFrame([("d", "e", "f", 1)], "sub string, verb string, obj string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "T1.json").write_text(json.dumps({"id": "T1", "tech_id": "T1", "graph_nodes": [{"id": 0, "label": "ACTOR", "count": 1, "texts": ["a"]}, {"id": 1, "label": "DATA", "count": 2, "texts": ["b", "b"]}]}))
    assert [tuple(r) for r in knowledge.technique_phrases(knowledge.technique_files(spark, str(tmp_path / "t"))).collect()] == [("T1", ["b"])]
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "r.json").write_text(json.dumps([{"id": "1", "text": "one"}, {"id": "2", "text": " "}]))
    assert [tuple(r) for r in reports.json_reports(spark, str(tmp_path / "reports")).collect()] == [("r", 0, "one")]
    (tmp_path / "p.csv").write_text("tech_id,platform,id,description\nT1,\"['Windows', 'macOS']\",i,d\nT2,[],j,e\n")
    assert [(r.id, r.platforms) for r in reports.procedures(spark, str(tmp_path / "p.csv"), ["T1"]).collect()] == [("i", ["Windows", "macOS"])]


def test_lookups(spark):
    techs = spark.createDataFrame([("T1", ["TA2", "TA1"]), ("T2", ["TA3"])], "tech_id string, tactics array<string>")
    assert [r.tech_id for r in knowledge.with_tactic(techs, ["TA1"]).collect()] == ["T1"]
    assert {r.tech_id: r.tactics for r in knowledge.technique_tactics(techs).collect()} == {"T1": ["TA1", "TA2"], "T2": ["TA3"]}
    combos = spark.createDataFrame([("a", "b", 0), ("c", "d", 1), ("e", "f", 2), ("g", "h", 3)], "first string, second string, status int")
    assert sorted(map(tuple, knowledge.allowed_tactics(combos).collect())) == [("a", "b"), ("b", "a"), ("c", "d"), ("f", "e")]
    matches = spark.createDataFrame([("r", 1, "p"), ("r", 2, "q")], "report string, location int, proc string")
    procs = spark.createDataFrame([("p", "T1", "text")], "proc string, tech string, text string")
    assert sorted((r.location, r.procedure_text) for r in knowledge.matches_with_texts(matches, procs).collect()) == [(1, "text"), (2, None)]
    assert [tuple(r) for r in knowledge.procedure_techniques(spark.createDataFrame([("p", "T2"), ("p", "T1")], "id string, tech_id string")).collect()] == [("p", "T1")]
    cap = spark.range(1).select(knowledge.node_caption(F.lit("a"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("X"))), knowledge.platform_mention(F.lit("no"))).first()
    assert tuple(cap) == ("a \n b \n X", None)
