"""Quotation linking: quoted passages are traced to the messages they come from, and conversations are put in reply order.

Each line's quote level is its number of leading '>' marks. Runs of lines of one level are passages; a quoted passage, and each of
its lines, is normalised (lower case, white space collapsed) and hashed, and joined to the earliest message of the same conversation
that says the same at level 0, as a passage, a line or a whole. A message replies to the source of its quotes of the lowest level, of
those to the one most characters come from, then the latest; sources of which it quotes nothing but single short lines of longer
passages come after all others. Roots and depths follow by pointer doubling; the reply order is
(conversation, root, depth, turn). DataFrame and SQL functions only.

Edge cases: null and empty texts have no passages; a null conversation or turn is linked with nothing (a root of its own); a quote
without an earlier source stays unlinked (its lines still leave the clean text); repeated messages give one row each with equal
results; sources that say a passage twice count once, so a common line costs one row for each conversation; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, once

#: The quote marks that begin a line.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: Characters from which a normalised line counts as much as a passage; shorter ones are linked, but rank below.
LEAST_CHARS = 12

_BLOCKS = "array<struct<level:int,text:string,lines:array<string>>>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def with_blocks(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the runs of lines of one quote level of its texts: level, joined text and lines, without their marks. A run is a slice between two places where the
    level changes, so a text of many lines is read once."""
    marks = lambda line: F.regexp_extract(line, MARKS, 0)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n", -1)
    df = once(df, _raw=lines)
    df = once(df, _levels=F.transform("_raw", lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))), _lines=F.transform("_raw", lambda x: F.regexp_replace(x, MARKS, "")))
    df = once(df, _starts=F.filter(F.sequence(F.lit(0), F.size("_levels") - 1), lambda i: (i == 0) | (F.get("_levels", i) != F.get("_levels", i - 1))))
    until = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_levels"))
    cut = F.transform("_starts", lambda i, j: F.struct(F.get("_levels", i).alias("level"), F.slice("_lines", i + 1, until(j) - i).alias("lines")))
    df = once(df, _cut=cut)
    made = F.transform("_cut", lambda x: F.struct(x["level"].alias("level"), F.array_join(x["lines"], "\n").alias("text"), x["lines"].alias("lines")))
    return once(df, **{name: made.cast(_BLOCKS)}).drop("_raw", "_levels", "_lines", "_starts", "_cut")


def _passages(block: Column) -> Column:
    """Hash and length of a block and of each of its lines, without empty ones; sure: not a short line of a longer block."""
    made = lambda x, sure: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(normalised(x)).alias("n"), sure.alias("sure"))
    own = F.transform(block["lines"], lambda x: made(x, F.length(normalised(x)) >= LEAST_CHARS))
    return F.filter(F.concat(F.array(made(block["text"], F.lit(True))), own), lambda x: x["n"] > 0)


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each message: its keys and role, n_quotes (quoted passages), n_linked (passages and lines traced to a source), max_level,
    parent_turn, root_turn, depth and clean_text (level 0 lines only), in reply order."""
    space = Workspace(df.sparkSession, "quotes")
    rows = df.select(
        F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.xxhash64(F.col(conv).cast("string"), F.col(turn).cast("string"), F.lit("|"), F.col(text)).alias("m"),
    )
    rows = with_blocks(rows, "text", "blocks")
    own = F.filter("blocks", lambda b: b["level"] == 0)
    clean = F.array_join(F.transform(own, lambda b: b["text"]), "\n")
    parsed = space.save("parsed", rows.select(
        "c", "t", "role", "m", F.when(F.col("text").isNotNull(), F.trim(clean)).alias("clean"),
        F.filter("blocks", lambda b: b["level"] > 0).alias("quoted"),
        F.coalesce(F.array_max(F.transform("blocks", lambda b: b["level"])), F.lit(0)).alias("max_level"),
        F.array_distinct(F.concat(
            F.flatten(F.transform(own, lambda b: F.transform(_passages(b), lambda p: p["h"]))), F.array(F.xxhash64(normalised(clean)))
        )).alias("said"),
    ))
    quoting = parsed.where("size(quoted) > 0 and c is not null and t is not null").select("c", "t", "m", F.explode("quoted").alias("b"))
    quotes = quoting.select("c", "t", "m", F.col("b.level").alias("level"), F.explode(_passages(F.col("b"))).alias("p"))
    quotes = quotes.select("c", "t", "m", "level", F.col("p.h").alias("h"), F.col("p.n").alias("n"), F.col("p.sure").alias("sure"))
    quotes = space.save("quotes", quotes.groupBy("c", "t", "m", "level", "h").agg(F.max("n").alias("n"), F.max("sure").alias("sure")))
    asked = quotes.select("c", "h").distinct()
    said = parsed.where("c is not null and t is not null").select("c", "t", F.explode("said").alias("h"))
    sources = said.groupBy("c", "h").agg(F.min("t").alias("source")).join(asked, ["c", "h"], "left_semi")
    found = space.save("found", quotes.join(sources, ["c", "h"]).where("source < t").select("c", "t", "m", "level", "n", "sure", "source"))
    weighed = found.groupBy("c", "t", "m", "level", "source").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"), F.count("*").alias("k"))
    best = weighed.groupBy("c", "t", "m").agg(
        F.max_by("source", F.struct("sure", -F.col("level"), "n", "source")).alias("parent"), F.sum("k").alias("n_linked")
    )
    best = space.save("best", best)

    # root and depth by pointer doubling over the turns that have a parent
    up = best.groupBy("c", "t").agg(F.max("parent").alias("root"))
    up = space.save("up0", up.withColumn("depth", F.lit(1)))
    step = 0
    while True:
        over = up.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        new = up.join(over, (F.col("c") == F.col("c2")) & (F.col("root") == F.col("t2")), "left")
        step += 1
        new = space.save(f"up{step}", new.select("c", "t", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("r2").isNotNull().alias("moved")))
        space.drop(f"up{step - 1}")
        up, moved = new.drop("moved"), new.where("moved").limit(1).count()
        if not moved:
            break
    own_turn = parsed.join(best.select("m", F.col("c").alias("bc"), "parent", "n_linked"), "m", "left")
    done = own_turn.join(up.select(F.col("c").alias("uc"), F.col("t").alias("ut"), "root", "depth"), (F.col("bc") == F.col("uc")) & (F.col("t") == F.col("ut")), "left")
    return done.select(
        F.col("c").alias(conv), F.col("t").alias(turn), F.col("role").alias(role), F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level", F.col("parent").alias("parent_turn"),
        F.coalesce("root", "t").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.col("clean").alias("clean_text"),
    ).orderBy(conv, "root_turn", "depth", turn, "clean_text")
