"""The alignment search against plain Python."""

import itertools
import math
import random
from statistics import pstdev

import pytest

from tracewell.operators import alignment

EACH, MOST = 3, 40


def _plain(nodes, edges, cands, dist):
    """(report, proc) -> score, ats of the best combination, by trying all of them."""
    out = {}
    for report, proc in sorted({c[:2] for c in cands}):
        ns = sorted((n, labels) for p, n, labels in nodes if p == proc)
        lists = []
        for n, _ in ns:
            mine = sorted((c[3:] for c in cands if c[:3] == (report, proc, n)), key=lambda c: c[0])
            if len(mine) > EACH:
                mine = sorted(mine, key=lambda c: (-c[2], c[0]))[:EACH]
            lists.append(mine or [None])
        place = {n: i for i, (n, _) in enumerate(ns)}
        plain = [labels in (["ACTOR"], ["OTHER"]) for _, labels in ns]
        actor = [labels == ["ACTOR"] for _, labels in ns]
        tried = []
        for picks in itertools.islice(itertools.product(*lists), MOST):
            good = [c for c, p in zip(picks, plain) if c and not p]
            gone = sum(1 for c, p in zip(picks, plain) if c and p)
            of_nodes = sum(c[2] for c in good) / max(1, len(ns) - gone)
            total, n = 0.0, 0
            for p, s, t, f in edges:
                if p != proc or s not in place or t not in place:
                    continue
                n += 1
                a, b = picks[place[s]], picks[place[t]]
                if a and b:
                    d = 1.0 if a[0] == b[0] else dist.get((report, a[0], b[0]), 100.0)
                    d = min(1.0, d) if actor[place[s]] or actor[place[t]] else d
                    e = math.sqrt(a[2] * b[2]) / d
                    if f is not None:
                        e = min(1.0, math.sqrt(e * f) if f >= 1 or e > f else e)
                    total += e
            score = min(1.0, (of_nodes + (total / n if n else 0.0)) / 2)
            said = [c[1] for c, x in zip(picks, actor) if c and not x]
            spread = pstdev(said) if said else 0
            span = 0.0 if None in picks else score if spread == 0 else score / spread
            tried.append((score, span, [c[0] for c in good]))
        top = max(s for s, _, _ in tried)
        if top > 0.8:
            rivals = sorted((x for x in tried if x[0] == top or x[0] > 0.95), key=lambda x: -x[0])
            best = max(rivals, key=lambda x: x[1])
        else:
            best = [x for x in tried if x[0] == top][-1]
        out[report, proc] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_align(spark, seed):
    rng = random.Random(seed)
    kinds = [["ACTOR"], ["OTHER"], ["FILE"], ["TOOL"], ["FILE", "TOOL"]]
    nodes = [(p, n, rng.choice(kinds)) for p in "pqrs" for n in range(rng.randint(2, 4))]
    held = [(p, n) for p, n, _ in nodes]
    edges = [(p, a, b, rng.choice([None, 0.3, 0.8, 1.0])) for p, a in held for b in range(5) if rng.random() < 0.5 and a != b]
    cands = [(r, p, n, at, at // 2, round(rng.uniform(0.81, 1), 3)) for r in "xyz" for p, n in held for at in range(8) if rng.random() < 0.4]
    dist = {(r, a, b): float(rng.randint(1, 3)) for r in "xyz" for a in range(8) for b in range(8) if a != b and rng.random() < 0.6}
    got = alignment.align(
        spark.createDataFrame(nodes, "proc string, node int, labels array<string>"), spark.createDataFrame(edges, "proc string, source int, target int, factor double"),
        spark.createDataFrame(cands, "report string, proc string, node int, at int, sentence int, similarity double"),
        spark.createDataFrame([(*k, d) for k, d in dist.items()], "report string, a int, b int, distance double"), MOST, EACH,
    ).collect()
    want = _plain(nodes, edges, cands, dist)
    assert {(r.report, r.proc) for r in got} == set(want)
    for r in got:
        score, _, ats = want[r.report, r.proc]
        assert abs(r.score - score) < 1e-9 and r.ats == ats, (r, want[r.report, r.proc])
