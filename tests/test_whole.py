"""Operators leave out no pair and no row."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tracewell import registry
from tracewell.operators import absorbing, alignment, similarity


def _cosine(x, y):
    return round(sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y), 6)


def test_all_pairs_meet_whatever_their_label(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, None, 1), (101, [0.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    want = sorted((i, j, _cosine(x, y)) for i, x, _ in rows for j, y, _ in rows if i < j and _cosine(x, y) > 0.3)
    got = sorted(tuple(r) for r in similarity.all_cosine(df, "vec_id", "embedding", 0.3, rows=7).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.QUERIES["phrase_cosine"](spark, str(tmp_path)).count() == len(want)


def test_candidate_product_keeps_what_the_search_keeps(spark, tmp_path):
    sizes = {"a": 5, "b": 31, "c": 4}
    events = [(100 * i + k, 1, e) for i, (e, n) in enumerate(sizes.items()) for k in range(n)] + [(1000 + k, 2, e) for e in "abcd" for k in range(13)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["candidate_product"](spark, str(tmp_path)).collect()
    want = itertools.product(range(5), range(100, 130), range(200, 204))
    assert [tuple(r.picks) for r in sorted(got, key=lambda r: r.tuple) if r.user_id == 1] == list(want)
    assert sum(r.user_id == 2 for r in got) == 20_000


def test_candidate_product_spreads_small_groups(spark):
    lists = {(g, n): [10 * n + k for k in range((g + n) % 4)] for g in range(40) for n in range(4)}
    nodes = spark.createDataFrame([(g, n, c if c or g % 2 else None) for (g, n), c in lists.items()], "g long, n int, c array<int>")
    found = alignment.candidate_tuples(nodes, "g", "n", "c", most=7, each=2)
    got = {}
    for r in found.collect():
        got.setdefault(r.g, {})[r.tuple] = tuple(r.picks)
    for g in range(40):
        want = list(itertools.product(*(lists[g, n][:2] or [None] for n in range(4))))[:7]
        assert [got[g][t] for t in range(len(got[g]))] == want
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4, "a few tasks make all combinations"


def test_cosines_are_products_of_blocks(spark):
    rng = random.Random(4)
    rows = [(f"v{i}", [rng.randint(-3, 3) / 1.0 for _ in range(3 + i % 2)], i % 4 or None) for i in range(120)] + [("v5", [1.0, 2.0, 2.0], 1), (None, [1.0, 0.0, 0.0], 1), ("w", [1.0, None, 2.0], 2)]
    df = spark.createDataFrame(rows, "id string, v array<float>, c long")
    good = [(i, x, c) for i, x, c in rows if i and None not in x and any(x)]
    want = sorted((i, j, _cosine(x, y), c, d) for i, x, c in good for j, y, d in good if i < j and len(x) == len(y) and _cosine(x, y) > 0.3)
    found = similarity.all_cosine(df, "id", "v", 0.3, rows=30, keep=("c",))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(w[0], w[1], w[3], w[4]) for w in sorted(want, key=repr)]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, sorted(want, key=repr)))
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString(), "pairs are rows of a join before their cosine is known"
    floors = {(1, 2): 0.9, (3, 3): float("inf")}
    held = similarity.all_cosine(df, "id", "v", 0.3, rows=30, keep=("c",), by=F.col("c"), floors=floors).collect()
    bound = lambda c, d: 0.9 if {c, d} == {1, 2} else 9.0 if c == d == 3 else 0.3
    assert sorted(map(repr, map(tuple, held))) == sorted(repr(g) for g in got if g[2] > bound(g[3], g[4]))
    tops, best = similarity.all_cosine(df, "id", "v", 0.3, rows=30, keep=("c",), top="c").collect(), {}
    for g in got:
        at = frozenset((g[3], g[4]))
        best[at] = max(best.get(at, 0), g[2])
    high = {}
    for r in tops:
        at = frozenset((r.a_c, r.b_c))
        high[at] = max(high.get(at, 0), r.cosine)
    assert high == best and len(tops) < len(got) and set(map(tuple, tops)) <= set(got)


def test_cosines_round_as_the_sql_does(spark):
    import duckdb

    rng = random.Random(7)
    rows = [(i, [rng.randint(1, 3) * 0.1 for _ in range(5)]) for i in range(150)] + [(200, [1.0, 0.0, 0.0, 0.0, 0.0]), (201, [0.0000005, 1.0, 0.0, 0.0, 0.0]), (202, [-0.3000005, (1 - 0.3000005**2) ** 0.5, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    con = duckdb.connect()
    con.execute("create table v (id bigint, v double[])")
    con.executemany("insert into v values (?, ?)", rows)
    want = con.sql("select a.id, b.id, round(list_cosine_similarity(a.v, b.v), 6) from v a join v b on a.id < b.id").fetchall()
    assert sorted(map(tuple, similarity.all_cosine(df, "id", "v", -2.0, rows=40).collect())) == sorted(want)


def _embedded(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_similar_expand_reads_its_pairs_once(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(50)] + [(100, None, 1), (101, [0.0] * 4, 1)]
    found = registry.QUERIES["similar_expand"](spark, _embedded(spark, tmp_path, rows))
    n = {i: sum(i != j and _cosine(x, y) > 0.3 for j, y, _ in rows[:50]) for i, x, _ in rows[:50]}
    assert sorted(map(tuple, found.collect())) == [(i, k + 1, 1.0) for i, k in n.items() if k]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_threshold_sweep_counts_pairs_without_labels(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], [None, 1, 2][i % 3]) for i in range(50)] + [(100, [1.0, None, 0.0, 0.0], 1)]
    got = registry.QUERIES["threshold_sweep"](spark, _embedded(spark, tmp_path, rows)).collect()
    pairs = [(_cosine(x, y), l is not None and l == m) for i, x, l in rows[:50] for j, y, m in rows[:50] if i < j]
    assert sorted(map(tuple, got)) == [(t, sum(c >= t for c, _ in pairs), sum(c >= t and same for c, same in pairs)) for t in (0.25, 0.3, 0.35, 0.4)]
    none = registry.QUERIES["threshold_sweep"](spark, _embedded(spark, tmp_path / "none", [(1, [1.0, 0.0], None), (2, [1.0, 0.1], None)])).collect()
    assert {(r.n, r.hits) for r in none} == {(1, 0)}


def test_absorb_goes_to_the_least_that_stays(spark):
    late = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 4), (3, 4)], "a long, b long")
    rng = random.Random(6)
    many = sorted({tuple(sorted(rng.sample(range(150), 2))) for _ in range(900)})
    gone = {}
    for a, b in many:
        if a not in gone:
            gone.setdefault(b, a)
    frame = spark.createDataFrame(many, "a long, b long")
    for most in (0, 100, 10_000):
        assert {r.id: r.absorber for r in absorbing.absorb(late, most).collect()} == {1: 0, 4: 2}
        assert {r.id: r.absorber for r in absorbing.absorb(frame, most).collect()} == gone


def test_node_candidates_join_by_the_least_context(spark, tmp_path):
    names = ["ACTOR", "USER", "TOOL", "OTHER", "VULNERABILITY"]
    cases = [(l, m, k / 200) for l in names for m in names for k in range(201)]
    score = alignment.node_similarity(F.array("l"), F.array("m"), F.col("c"), F.lit(False), F.lit(False))
    for least in (0.35, 0.55, 0.7, 0.96):
        over = spark.createDataFrame(cases, "l string, m string, c double").where(score > least).collect()
        assert over and all(r.c > alignment.least_context(r.l, r.m, least) for r in over)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], [*range(10), None, -3][i % 12]) for i in range(60)]
    found = registry.QUERIES["node_candidates"](spark, _embedded(spark, tmp_path, rows))
    label = lambda n: [["ACTOR", "USER", "TOOL", "FILE", "OTHER"][n % 5] if n is not None and n >= 0 else None]
    pairs = [(i, j, label(x[1]), label(y[1]), max(0.0, _cosine(x[0], y[0]))) for i, *x in rows for j, *y in rows if i < j]
    s = alignment.node_similarity(F.col("l"), F.col("m"), F.col("c"), F.lit(False), F.lit(False))
    want = spark.createDataFrame(pairs, "a long, b long, l array<string>, m array<string>, c double").select("a", "b", F.round(s, 7).alias("s")).where(s > 0.55).collect()
    got = sorted(map(tuple, found.collect()))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(map(tuple, want))] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, sorted(map(tuple, want))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect(array(" not in plan, "labels are compared once a pair of vectors"


def test_list_similarity_sends_the_highest_pairs_only(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 4) for i in range(80)]
    sent, all_cosine = [], similarity.all_cosine
    monkeypatch.setattr(similarity, "all_cosine", lambda *a, **k: sent.append(all_cosine(*a, **k)) or sent[-1])
    got = {(r.left, r.right): r.context for r in registry.QUERIES["list_similarity"](spark, _embedded(spark, tmp_path, rows)).collect()}
    want = {}
    for i, x, l in rows:
        for j, y, m in rows:
            if l != m:
                want[l, m] = max(want.get((l, m), 0), _cosine(x, y))
    assert got.keys() == want.keys() and all(abs(got[k] - c) < 2e-6 for k, c in want.items())
    assert sent[0].count() <= 10 * sent[0].rdd.getNumPartitions() and sent[0].count() < 500, "every pair over the bound is sent"
