"""Dictionary voting: weighted votes of labels for phrases, unique maximum wins.

Edge cases: null texts have no votes; an empty lexicon gives none; ties abstain; repeated rows of a key vote as often as they stand; repeated terms of a
lexicon add their weights; spans without a start or end are left alone by others; extra columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import words_in

#: Terms of a lexicon that become a literal map.
MAPPED = 5_000


def word_votes(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, votes): the weights of a lexicon's terms (label, term, weight) that stand in a text. A lexicon of up to MAPPED single words is held as
    a literal map, so texts are split once and nothing but hits is shuffled; a larger one is joined with the distinct words of each text."""
    rows = lexicon.select("label", "term", "weight").limit(MAPPED + 1).collect()
    if not rows or len(rows) > MAPPED:
        words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("term"))
        return words.join(lexicon.select("label", "term", "weight"), "term").groupBy(key, "label").agg(F.sum("weight").cast("long").alias("votes"))
    by_term: dict[str, list] = {}
    for r in rows:
        by_term.setdefault(r["term"], []).append(F.struct(F.lit(r["label"]).alias("label"), F.lit(r["weight"]).alias("w")))
    said = F.create_map(*(x for term, votes in by_term.items() for x in (F.lit(term), F.array(*votes))))
    votes = F.flatten(F.transform(words_in(F.col(text), by_term), lambda t: said[t]))
    found = texts.select(key, F.explode(votes).alias("h"))
    return found.groupBy(key, F.col("h.label").alias("label")).agg(F.sum("h.w").cast("long").alias("votes"))


def majority(votes: DataFrame, key: str, otherwise: str = "OTHER") -> DataFrame:
    """The label with most votes; a tie abstains."""
    top = votes.groupBy(key).agg(F.max("votes").alias("m"), F.collect_list(F.struct("votes", "label")).alias("all"))
    best = F.filter("all", lambda x: x["votes"] == F.col("m"))
    return top.select(key, F.when(F.size(best) == 1, best[0]["label"]).otherwise(otherwise).alias("label"), F.col("m").alias("votes"))


def spans_outermost(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, s, e) without those that lie in a longer one, or in an equal one with a smaller id. A maximum over the earlier starts
    decides, so no pairs are made."""
    order = Window.partitionBy(key).orderBy("s", F.desc("e"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("e").over(order)).where("_reach is null or _reach < e").drop("_reach")
