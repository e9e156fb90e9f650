"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Each set gets two small collections of hash groups (GROUPS groups of WIDTH minhashes each). A table key joins one group of the
first collection with one of the second: GROUPS**2 tables from 2 * GROUPS * WIDTH minhashes. A pair of similarity 0.8 meets in no table
with a probability under 2 * (1 - 0.8**WIDTH)**GROUPS (7e-5 with the defaults); all others are compared on their full sets.

Documents of equal sets are one class from the start. Within a table's bucket each round compares one pivot with the members that are
not yet in its component, so a bucket of n classes costs n comparisons a round. After the rounds, members of different components that
still share a bucket are joined once for each pair, and those whose bitmaps allow a link are compared, so no link
between components is lost; pairs within a component are never made.

Edge cases: null texts and texts without words have an empty set and are linked with nothing; texts with fewer words than a
shingle are one shingle of all their words; repeated rows (equal ids) give one result for each row; rows with a null id
link others but have no component (null) and are kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, fresh, map_texts

#: Groups in each of the two collections, and minhashes in a group.
GROUPS, WIDTH = 10, 2
#: Rounds of pivot comparisons before the remaining pairs are compared.
PIVOT_ROUNDS = 2
#: Cells of the bitmaps that bound the common part of two sets from above.
CELLS = 4096
#: Classes whose ids are broadcast to fetch their sets; above that they are fetched by a shuffled join.
BROADCAST_CLASSES = 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words))], np.uint64)
    own = np.fromiter(map(digest, words), np.uint64, len(words))
    joined = own[: len(own) - size + 1].copy()
    for k in range(1, size):
        joined = _mix(joined * _M1 + own[k : len(own) - size + 1 + k] + np.uint64(k))
    return np.unique(joined)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def bands(found: np.ndarray, groups: int, width: int) -> np.ndarray:
    """One hash for each group of minhashes of a shingle set, by collection."""
    n = 2 * groups * width
    seeds = _mix(np.arange(1, n + 1, dtype=np.uint64) * _M2) | np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = _mix(found[at : at + 4096])
        low = np.minimum(low, (part[:, None] * seeds[None, :] ^ (part >> np.uint64(31))[:, None]).min(0))
    low = _mix(low).reshape(2, groups, width)
    band = low[:, :, 0]
    for k in range(1, width):
        band = _mix(band * _M1 + low[:, :, k])
    return band


def table_keys(found: np.ndarray, groups: int, width: int) -> np.ndarray:
    """The groups**2 table keys of a shingle set: each band of the first collection with each of the second."""
    band, table = bands(found, groups, width), np.arange(groups, dtype=np.uint64)
    first = _mix(band[0] + table * _M1)[:, None]
    second = _mix(band[1] + table * _M2)[None, :]
    return _mix(first * _M1 + second).ravel()


def cells(found: np.ndarray) -> np.ndarray:
    """A bitmap of CELLS bits (as longs) of the cells that a set's shingles fall into."""
    bits = np.zeros(CELLS, np.uint8)
    bits[(_mix(found ^ _M2) % np.uint64(CELLS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def labels(space: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """(id, label): the smallest reachable id, for each id of an edge table (a, b); by alternating stars to a fixed point."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, mark, step = space.save(f"{tag}0", now), None, 0
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours go to the smallest of the closed neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = space.save(f"{tag}{step}large", large)
        # smaller neighbours, and the id itself, go to the smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        fresh = space.save(f"{tag}{step}", moved.union(low.select("a", F.col("m").alias("b"))).distinct())
        space.drop(f"{tag}{step - 1}large")
        space.drop(f"{tag}{step - 1}")
        now, last = fresh, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last or not mark[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("label"))


def _compared(space: Workspace, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Sizes of the common and the joint set for distinct pairs (a, b) of classes."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    joined = joined.withColumn("inter", F.size(F.array_intersect("sa", "sb")))
    return space.save(name, joined.select("a", "b", "inter", (F.size("sa") + F.size("sb") - F.col("inter")).alias("joint")))


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def components(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, groups: int = GROUPS,
    width: int = WIDTH, rounds: int = PIVOT_ROUNDS, broadcast_classes: int = BROADCAST_CLASSES, with_groups: bool = False,
) -> DataFrame:
    """For each row: its key, n_shingles, component_id (the smallest key reachable over links of a similarity of percent or
    more) and kept (the key is that smallest one). with_groups adds text_hash (of the row's text), class (of its set; null without
    words) and group (one value for each component, null without words)."""
    space = Workspace(df.sparkSession, "neardup")
    base = df.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))

    def named(found: np.ndarray) -> int | None:
        """The id of a class: 64 bits of its set's digest."""
        return int.from_bytes(hashlib.md5(found.tobytes()).digest()[:8], "little", signed=True) if len(found) else None

    def make_rows():
        def run(texts):
            sets = [shingles(t, size) for t in texts]
            return [len(s) for s in sets], [named(s) for s in sets], [table_keys(s, groups, width).view(np.int64) if len(s) else None for s in sets]

        return run

    def make_sets():
        def run(texts):
            sets = [shingles(t, size) for t in texts]
            groups_of = [bands(s, groups, width).ravel().view(np.int64).astype(np.int32) for s in sets]
            return [named(s) for s in sets], [s.view(np.int64) for s in sets], groups_of, [cells(s) for s in sets]

        return run

    made = map_texts(base, "_text", [("n", "long"), ("class", "long"), ("keys", "array<long>")], make_rows)
    rows = space.save("rows", made.select("_id", F.xxhash64("_text").alias("_th"), "n", "class", "keys"))
    # one row of each class stands for it
    classes = rows.where("class is not null").groupBy("class").agg(F.min("_id").alias("_id"))
    classes = space.save("classes", classes)
    stand = classes.select(F.col("class").alias("c"), F.col("_id").alias("i"))
    keyed = rows.where("class is not null").join(stand, (F.col("class") == F.col("c")) & F.col("_id").eqNullSafe(F.col("i")), "left_semi")
    entries = keyed.select(F.col("class").alias("id"), F.explode("keys").alias("t"))
    shared = entries.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("t")
    buckets = space.save("buckets", entries.join(shared, "t").distinct())
    members = space.save("members", buckets.select("id").distinct())
    wanted = classes.join(members, classes["class"] == members["id"]).select(F.col("_id").alias("_w"), "id")
    if members.count() <= broadcast_classes:
        wanted = F.broadcast(wanted)
    texts = base.join(wanted, F.col("_id").eqNullSafe(F.col("_w"))).select("_text", "id")
    sets = map_texts(texts, "_text", [("class", "long"), ("set", "array<long>"), ("bands", "array<int>"), ("cells", "array<long>")], make_sets)
    sets = space.save("sets", sets.where("class = id").select("id", "set", "bands", "cells").dropDuplicates(["id"]))

    linked = F.col("inter") * 100 >= F.col("joint") * percent
    ids, tried, used = members.withColumn("label", F.col("id")), None, None
    for r in range(rounds):
        now = buckets.join(ids, "id")
        mixed = now.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("t")
        now = space.save(f"open{r}", now.join(mixed, "t"))
        choice = now if used is None else now.join(used, ["t", "id"], "left_anti")
        pivots = choice.groupBy("t").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id")).alias("p"))
        pivots = space.save(f"pivots{r}", pivots.select("t", F.col("p.id").alias("pid"), F.col("p.label").alias("plabel")))
        used = pivots.select("t", F.col("pid").alias("id")) if used is None else used.union(pivots.select("t", "pid"))
        pairs = now.join(pivots, "t").where("label != plabel").select(*_ordered("id", "pid")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        got = _compared(space, pairs, sets, f"compared{r}")
        tried = got if tried is None else tried.unionByName(got)
        ids = _relabelled(space, members, tried.where(linked).select("a", "b"), f"round{r}_")

    # what is left: members of one bucket in different components that were not both compared with its pivots. They meet in the first band
    # of the first collection that they share; the join lets through only pairs whose bitmaps allow a link
    now = buckets.join(ids, "id")
    mixed = now.groupBy("t").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_ids = now.join(mixed.where(F.expr(f"lo < hi and n > {rounds + 1}")).select("t"), "t").select("id", "label").distinct()
    rest = open_ids.join(sets, "id").select("id", "label", F.size("set").alias("n"), "bands", "cells")
    bits = F.aggregate("cells", F.lit(0), lambda acc, x: acc + F.bit_count(x))
    rest = space.save("rest", rest.withColumn("spare", F.col("n") - bits))
    rest = rest.select("*", F.posexplode(F.slice("bands", 1, groups)).alias("i", "band"))
    x, y = (rest.select(*(F.col(c).alias(s + c) for c in ("i", "band", "id", "label", "n", "bands", "cells", "spare"))) for s in "xy")
    equal = F.zip_with("xbands", "ybands", lambda p, q: p == q)
    first = F.array_position(equal, True) == F.col("xi") + 1
    second = F.array_contains(F.slice(equal, groups + 1, groups), True)
    most = F.least("xspare", "yspare") + F.aggregate(F.zip_with("xcells", "ycells", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda acc, v: acc + v)
    able = most * 100 >= (F.col("xn") + F.col("yn") - most) * percent
    close = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent
    wanted = (F.col("xid") < F.col("yid")) & (F.col("xlabel") != F.col("ylabel")) & close
    meet = (F.col("xi") == F.col("yi")) & (F.col("xband") == F.col("yband"))
    pairs = x.join(y, meet & F.when(wanted, F.when(first & second, able).otherwise(False)).otherwise(False))
    pairs = pairs.select(F.col("xid").alias("a"), F.col("yid").alias("b")).distinct()
    got = _compared(space, pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets, "compared_rest")
    ids = _relabelled(space, members, tried.unionByName(got).where(linked).select("a", "b"), "final_")

    grouped = classes.join(ids, classes["class"] == ids["id"], "left").select("class", "_id", F.coalesce("label", "class").alias("label"))
    least = grouped.groupBy("label").agg(F.min("_id").alias("c"))
    found = grouped.join(least, "label").select("class", "c", "label")
    out = rows.select("_id", "_th", "n", "class").join(found, "class", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("c", "_id"))
    return out.select(
        F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
        *([F.col("_th").alias("text_hash"), "class", F.col("label").alias("group")] if with_groups else []),
    )


def _relabelled(space: Workspace, members: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    found = labels(space, edges, tag)
    return space.save(f"{tag}ids", members.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label")))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_CLASSES, **options) -> DataFrame:
    """The rows that stay: one of each component, that with the smallest key (then set, then text). Rows go by key and text, never by
    key alone: of rows that repeat a key with texts of different components each component's own row stays. Of fully repeated texts
    of one key one row stays (the one with the smallest hash of all its columns). Rows with a null key or without words all stay.
    options: those of components()."""
    space = Workspace(df.sparkSession, "dedup")
    found = components(df, key=key, text=text, with_groups=True, **options)
    found = space.save("found", found.select(F.col(key).alias("_k"), F.col("text_hash").alias("_h"), "class", "group"))
    own = F.struct("_k", "class", "_h")
    grouped = found.where("group is not null and _k is not null")
    first = grouped.groupBy("group").agg(F.min(own).alias("_first"))
    marked = space.save("marked", grouped.join(first, "group").select("_k", "_h", (own == F.col("_first")).alias("_stays")))
    gone = marked.where("not _stays").select("_k", "_h").distinct()
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    hashed = fresh(df, "_th")
    rows = df.withColumn(hashed, F.xxhash64(F.col(text).cast("string")))
    out = rows.join(gone, (F.col(key) == F.col("_k")) & (F.col(hashed) == F.col("_h")), "left_anti")
    again = marked.where("_stays").groupBy("_k", "_h").count().where("count > 1").select("_k", "_h")
    if again.limit(1).count():  # only tables with repeated rows pay for this; a row that is no copy is not moved
        met = (F.col(key) == F.col("_k")) & (F.col(hashed) == F.col("_h"))
        order = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
        repeated = out.join(again, met, "left_semi").withColumn("_no", F.row_number().over(Window.partitionBy(key, hashed).orderBy(order)))
        out = out.join(again, met, "left_anti").unionByName(repeated.where("_no = 1").drop("_no"))
    return out.select(*df.columns)
