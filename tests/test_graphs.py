"""Graphs, absorption, path folds and text folds on hand-made rows and against plain Python."""

import random

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import absorbing, graphs, paths


def test_components(spark):
    rng = random.Random(3)
    links = [(d, rng.randrange(30), rng.randrange(30)) for d in "abc" for _ in range(18)]
    want = {}
    for d in "abc":
        main = {n: n for _, a, b in links for n in (a, b)}
        for _ in range(40):
            for x, a, b in links:
                if x == d:
                    main[a] = main[b] = min(main[a], main[b])
        want |= {(d, n): main[n] for x, a, b in links if x == d and a != b for n in (a, b)}
    got = graphs.components(spark.createDataFrame(links, "doc string, a int, b int"), "doc", "a", "b").collect()
    assert {(r.doc, r.node): r.main for r in got} == want


def test_merges(spark):
    nodes = spark.createDataFrame(
        [("d", 1, "it", ["ACTOR"], ["run"]), ("d", 2, "Foo", ["ACTOR"], []), ("d", 3, "file", ["FILE"], ["open"]), ("d", 4, "log", ["FILE"], []), ("e", 1, "it", ["ACTOR"], [])],
        "doc string, node_id int, text string, labels array<string>, verbs array<string>",
    )
    merges = graphs.actor_merges(nodes, "doc")
    assert sorted((r.doc, r.node, r.main) for r in merges.collect()) == [("d", 1, 2), ("d", 2, 2)]
    got = {(r.doc, r.node_id): (r.text, r.texts, r.verbs, r.ids) for r in graphs.merge_nodes(nodes, merges, "doc").collect()}
    assert got["d", 2] == ("Foo", ["Foo", "it"], ["run"], [1, 2]) and len(got) == 4
    edges = spark.createDataFrame([("d", 1, 3, "open"), ("d", 2, 3, "read"), ("d", 1, 2, "be")], "doc string, source int, target int, verb string")
    assert [(r.source, r.target, r.verb) for r in graphs.merge_edges(edges, merges, "doc").collect()] == [(2, 3, "open")]
    far = spark.createDataFrame([("d", 3, 9, "x")], "doc string, source int, target int, verb string")
    assert [(r.doc, r.source, r.target, r.verb) for r in graphs.connected_nodes(nodes, far, "doc").collect()] == [("d", 1, 2, "any")]


def test_absorb(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    gone = {}
    for i in range(40):
        if i not in gone:
            for a, b in pairs:
                if a == i and b not in gone:
                    gone[b] = i
    got = absorbing.absorb(spark.createDataFrame(pairs, "a int, b int")).collect()
    assert {r.id: r.absorber for r in got} == gone
    assert absorbing.absorb(spark.createDataFrame([], "a int, b int")).collect() == []


def test_path_folds(spark):
    df = spark.createDataFrame([(["T1", "T2.1", "T1.3", "T2", "T3"],)], "p array<string>")
    assert df.select(paths.without_repeated_bases(F.col("p"))).first()[0] == ["T1", "T2.1", "T3"]
    steps = spark.createDataFrame([([("a", ["x"]), ("b", ["x"]), ("c", ["y"]), ("d", ["x"])],)], "p array<struct<id:string,tactics:array<string>>>")
    assert [x.id for x in steps.select(paths.adding_tactics(F.col("p"))).first()[0]] == ["a", "c"]
    assert [x.id for x in steps.select(paths.adding_tactics(F.col("p"), "y")).first()[0]] == ["a", "c", "d"]
    ranked = spark.createDataFrame([([(2.0, 9), (0.5, 3), (0.5, 4)],), ([(1.0, 2), (1.0, 7)],)], "p array<struct<rank:double,place:int>>")
    assert sorted(r[0] for r in ranked.select(paths.outstanding_place(F.col("p"))).collect()) == [4, 7]


def test_text_folds(spark):
    one = spark.createDataFrame([("ENTITY1 and ENTITY12", {"ENTITY1": "a", "ENTITY12": "b"})], "t string, m map<string,string>")
    assert one.select(T.restore(F.col("t"), F.col("m"))).first()[0] == "a and b"
    raw = spark.createDataFrame([("a\\nb- c\n\n\nd ",)], "t string")
    assert raw.select(T.unescaped(F.col("t"))).first()[0] == "a\nbc\nd"
