"""Hand-made cases of functions and operators."""

import random

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import voting
from tracewell.sources import reports


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_indel_ratio(spark):
    rng = random.Random(1)
    pairs = [("kitten", "sitting"), ("", ""), ("a", "")] + [tuple("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in "xy") for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        n = len(r.a) + len(r.b)
        assert abs(r.r - (2 * _lcs(r.a, r.b) / n if n else 1.0)) < 1e-12


def test_substitutions_are_ordered(spark):
    df = spark.createDataFrame([("that which of",)], "t string")
    assert df.select(T.substitute(F.col("t"), [("that", "which"), ("which", "x")])).first()[0] == "x x of"


def test_majority_abstains_on_ties(spark):
    votes = spark.createDataFrame([(1, "A", 2), (1, "B", 2), (2, "A", 3), (2, "B", 1)], "k int, label string, votes long")
    got = {r.k: r.label for r in voting.majority(votes, "k").collect()}
    assert got == {1: "OTHER", 2: "A"}


def test_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.txt").write_text("  ")
    got = reports.chunks(reports.text_reports(spark, str(tmp_path))).collect()
    assert [(r.report_id, r.chunk, r.text) for r in sorted(got, key=lambda r: r.chunk)] == [("a", 0, "one"), ("a", 2, "two")]


def test_page_sections(spark):
    df = spark.createDataFrame([(1, "x<h1>A</h1><p>b  c</p><script>1</script><h2 id=q>D</h2>e"), (2, None)], "page_id long, html string")
    got = sorted((r.page_id, r.section, r.text) for r in reports.page_sections(df).collect())
    assert got == [(1, 1, "A b c"), (1, 2, "D e")]
