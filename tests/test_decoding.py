"""The decoder against a plain walk over each report."""

import random
import statistics

from tracewell.operators import decoding

SCHEMA = "report int, location int, tech string, value double, order_ids array<int>, sentences array<int>, picks array<struct<rank:double,place:int>>, seq int"


def plain_unique(rows, criteria):
    temp = {}
    for x in rows:
        at = {"min": min, "max": max}.get(criteria, lambda _: max(p for r, p in x["picks"] if r == min(r for r, _ in x["picks"])))(x["order_ids"])
        temp.setdefault(at, []).append({**x, "location": at})
    by_tech = {}
    for items in temp.values():
        for x in items:
            by_tech.setdefault(x["tech"], []).append(x)
    out = {}
    for items in by_tech.values():
        mean = sum(x["value"] * x["location"] for x in items) / sum(x["value"] for x in items)
        gap = lambda x: round(abs(x["location"] - mean), 9)  # noqa: E731,B023
        best = [x for x in items if gap(x) == min(map(gap, items))]
        rank = lambda x: x["value"] / max(1, statistics.pstdev(set(x["order_ids"])))
        pick = sorted(best, key=rank, reverse=True)[0]
        out.setdefault(pick["location"], []).append(pick)
    return dict(sorted(out.items()))


def plain_decode(rows, keywords, early, t, topk, criteria, relax):
    kept = []
    for x in rows:
        if abs(min(x["order_ids"]) - statistics.fmean(x["order_ids"])) >= 10 or statistics.pstdev(x["sentences"]) >= 2:
            continue
        x = {**x, "value": min(1.0, x["value"])}
        if x["value"] >= t:
            kept.append(x)
    kept.sort(key=lambda x: (x["location"], -x["value"], x["seq"]))
    new = {}
    for k, items in plain_unique(kept, criteria).items():
        new.setdefault(k, [])
        for x in items:
            new.setdefault(0 if x["tech"] in early else k, []).append(x)
    if keywords and t != 1.0:
        for k, x in keywords.items():
            if not (k == 0 and 0 in new):
                new.setdefault(k, []).append(x)
    new = {k: sorted(v, key=lambda x: -x["value"]) for k, v in sorted(new.items())}
    best, at = {}, list(new)
    for i, k in enumerate(at):
        if not new[k]:
            continue
        first, before = new[k][0], [best[at[j]] for j in range(max(0, i - 3), i) if at[j] in best]
        clash = any(abs(first["location"] - y["location"]) <= 5 and y["tech"].split(".")[0] == first["tech"].split(".")[0] for y in before)
        if "." in first["tech"] or not clash:
            best[k] = first
        elif len(new[k]) > 1:
            best[k] = new[k][1]
    top = {k: [x for x in v[:topk] if x["value"] >= t] for k, v in new.items() if v}
    path = []
    for v in (top if relax else {k: [x] for k, x in best.items()}).values():
        two = v[:2]
        if len(two) == 2 and statistics.mean(two[0]["order_ids"]) > statistics.mean(two[1]["order_ids"]):
            two = two[::-1]
        path += [x["tech"] for x in two if x["tech"] not in path]
    return {k: x["tech"] for k, x in best.items()}, {k: [x["tech"] for x in v] for k, v in top.items()}, list(dict.fromkeys(path))


def _case(seed):
    rng, rows, keywords = random.Random(seed), [], []
    for report in range(6):
        for seq in range(rng.randint(0, 30)):
            start = rng.randint(0, 25)
            ids = [start + rng.randint(0, rng.choice([1, 4, 30])) for _ in range(rng.randint(1, 3))]
            tech = rng.choice(["T1", "T1.001", "T1.002", "T2", "T2.001", "T3", "T4", "T5"])
            picks = [(rng.choice([0.0, 0.5, 1.0]), i) for i in ids]
            rows.append({"report": report, "location": max(ids), "tech": tech, "value": rng.choice([0.8, 0.86, 0.87, 0.9, 0.95, 1.0, 1.1]),
                         "order_ids": ids, "sentences": [rng.randint(0, rng.choice([1, 9])) for _ in ids], "picks": picks, "seq": seq})
        for location in rng.sample(range(20), rng.randint(0, 4)):
            keywords.append({"report": report, "location": location, "tech": rng.choice(["T6", "T1", "T2.001"]), "value": 1.0,
                             "order_ids": [location], "sentences": [0], "picks": None, "seq": location})
    return rows, keywords


def test_decode(spark):
    for seed, (criteria, topk, relax, t) in enumerate([("heuristic", 1, True, 0.87), ("min", 2, True, 0.9), ("max", 2, False, 0.87), ("max", 1, False, 1.0)]):
        rows, keywords = _case(seed)
        df, kw = (spark.createDataFrame([tuple(x.values()) for x in part], SCHEMA) for part in (rows, keywords))
        early = spark.createDataFrame([("T4",)], "tech string")
        reports = spark.createDataFrame([(i,) for i in range(6)], "report int")
        got = {r.report: r for r in decoding.decode(df, reports, kw, early, t, topk, criteria, relax).collect()}
        for report in range(6):
            own = {k["location"]: k for k in sorted((k for k in keywords if k["report"] == report), key=lambda k: k["location"])}
            best, top, path = plain_decode([x for x in rows if x["report"] == report], own, {"T4"}, t, topk, criteria, relax)
            r = got[report]
            assert {b.location: b.tech for b in r.best} == best, (seed, report)
            assert {b.location: b.techs for b in r.topk} == top and r.path == path


def test_decode_again(spark):
    rows, _ = _case(9)
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    lower = {r.report: r.path for r in decoding.decode(df, threshold=decoding.THRESHOLD - 0.05).collect()}
    got = decoding.decode_reports(df, fewest=4).collect()
    first = {r.report: (len(r.best), r.path) for r in decoding.decode(df).collect()}
    assert any(r.relaxed for r in got) and all(r.path == (lower[r.report] if r.relaxed else first[r.report][1]) for r in got)
    assert all(r.relaxed == (first[r.report][0] < 4) for r in got)


def test_decode_edges(spark):
    assert decoding.decode_reports(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, None, 1.0, [0], [0], [(0.0, 0)], 0), (2, 0, "T1", 0.0, [0], [0], None, 0), (3, 1, "T1", 1.0, [], [], None, 0), (4, 2, "T1", 1.0, [2], [0], [(0.0, 2)], 0), (4, 2, "T1", 1.0, [2], [0], [(0.0, 2)], 0)]
    got = {r.report: r.path for r in decoding.decode(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in range(1, 5)], "report int"), threshold=0.0).collect()}
    assert got == {1: [], 2: ["T1"], 3: [], 4: ["T1"]}


def test_procedure_helpers(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.5)], "a string, b string, f1 double")
    similar = decoding.similar_procedures(pairs)
    assert sorted(map(tuple, similar.collect())) == [("a", "b", 0.95), ("b", "a", 0.95)]
    matches = spark.createDataFrame([(1, 0, "a", 0.9), (1, 0, "c", 0.7)], "report int, location int, proc string, score double")
    best = decoding.best_procedures(matches, similar, topk=2).collect()
    assert [(r.proc, round(r.score, 3), r["rank"]) for r in sorted(best, key=lambda r: r["rank"])] == [("a", 0.9, 1), ("b", 0.855, 2)]
    techs = spark.createDataFrame([("a", "T1"), ("c", "T2")], "proc string, tech string")
    assert [r.techs for r in decoding.shown_techniques(matches, techs).collect()] == [["T1"]]
    some = spark.createDataFrame([(1, "T1"), (1, "P"), (2, "P")], "report int, tech string")
    early = spark.createDataFrame([("P",)], "tech string")
    assert sorted(map(tuple, decoding.without_preparation(some, early).collect())) == [(1, "T1"), (2, "P")]
    rows, kw = _case(3)
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    sweep = decoding.decode_sweep(df, [0.8, 0.95, 1.0]).collect()
    want = {t: {r.report: r.path for r in decoding.decode(df, threshold=t).collect()} for t in (0.8, 0.95)}
    assert all(set(r.path) <= set(want[r.threshold][r.report]) for r in sweep if r.threshold in want)
