"""Removal of long strings that repeat within or across documents, by external induced suffix sorting of shards.

Windows that could repeat are found first: of the hashes of the (size - WINDOW + 1)-grams in a string of `size` bytes the least is its
anchor, and equal strings have equal anchors. Only strings whose anchor has two places or more go on. They are cut out as snippets
(runs of starts with one anchor), equal snippets become one, and the anchor names the shard, so equal strings meet.
A shard's snippets are one text whose suffixes are sorted by induction with common prefixes (see induced.py); neighbours with a common
prefix of `size` repeat. Each byte that a repeated string covers goes.

A text's digest stands for it: exact copies share one analysis, and all of a copied text of `size` bytes or more goes.

Edge cases: null texts are empty; texts shorter than `size` lose nothing; strings never cross documents; long runs of one byte are cut
into snippets of at most PIECE starts; repeated rows are copies of each other; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import induced
from tracewell.llm.common import Workspace

#: Grams that an anchor is chosen from (a power of two), most starts in a snippet, bytes of snippets in a shard.
WINDOW, PIECE, SHARD_BYTES = 128, 256, 3_000_000

_B = 0x9E3779B97F4A7C15
_EMPTY = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    up, down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(raw: bytes, k: int) -> np.ndarray:
    """Hashes of all k-grams."""
    n = len(raw)
    up, down = _powers(max(1 << 17, 1 << n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(7)) * up[:n], out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _least(h: np.ndarray, window: int) -> np.ndarray:
    span = 1
    while span < window:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return h


def anchors(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the string at each start, and the distinct (anchor, first and last place) table as rows."""
    h = _grams(raw, size - WINDOW + 1)
    least = _least(h, WINDOW)
    # a place is an anchor if its hash is the least of some window around it
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    span, top = 1, padded
    while span < WINDOW:
        top = np.maximum(top[:-span], top[span:])
        span *= 2
    at = np.flatnonzero(h == top)
    return least, np.stack([h[at], at.astype(np.uint64)])


def _mark(mapped: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(mapped):
        return np.zeros(len(values), bool)
    new = np.r_[True, values[1:] != values[:-1]]
    own = values[new]
    at = np.minimum(np.searchsorted(mapped, own), len(mapped) - 1)
    return (mapped[at] == own)[np.cumsum(new) - 1]


def _snippets(raw: bytes, size: int, known: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(anchor, start, number of starts, bytes) of the runs of starts whose anchor is in `known`."""
    least, _ = anchors(raw, size)
    live = np.flatnonzero(_mark(known, least))
    if not len(live):
        return []
    cut = np.r_[True, (live[1:] != live[:-1] + 1) | (least[live[1:]] != least[live[:-1]])]
    begin = np.flatnonzero(cut)
    out = []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(live)]):
        for k in range(a, b, PIECE):
            n = min(PIECE, b - k)
            start = int(live[k])
            out.append((int(least[start]), start, n, raw[start : start + n + size - 1]))
    return out


def _shard_repeats(blobs: list[bytes], counts: list[int], size: int) -> list[list[int]]:
    """For each snippet of a shard the starts that repeat, as runs [from, to, from, to, ...)."""
    pieces, places, at = [], [], 0
    for raw in blobs:
        places.append(at)
        pieces += [raw, b"\0"]
        at += len(raw) + 1
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    t = np.empty(len(joined) + 1, np.uint16)
    t[:-1] = joined.astype(np.uint16) + 2
    t[-1] = 0
    t[np.array([p + len(b) for p, b in zip(places, blobs)])] = 1
    hit = induced.repeats(t, size)
    out = []
    for p, n in zip(places, counts):
        own = np.diff(np.r_[0, hit[p : p + n].astype(np.int8), 0])
        out.append(np.stack([np.flatnonzero(own == 1), np.flatnonzero(own == -1)], 1).ravel().tolist())
    return out


def remove_repeats(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 200, with_kept: bool = False,
) -> DataFrame:
    """For each row: key, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with_kept adds the kept bytes of the
    texts that lose some but not all."""
    if not WINDOW < size <= 254:
        raise ValueError(f"size must be over {WINDOW} and at most 254")
    spark = df.sparkSession
    space = Workspace(spark, "passages")
    base = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    named = F.sha2("_text", 256)
    rows = space.save("rows", base.select("_id", named.alias("sha"), F.octet_length("_text").cast("long").alias("n_bytes")))

    def find(batches):
        """Per batch, the first and last place (as a hash of text and place) of each anchor."""
        for batch in batches:
            hashes, places = [], []
            for t in batch.column(0).to_pylist():
                raw = t.encode()
                if len(raw) < size:
                    continue
                _, found = anchors(raw, size)
                name = np.uint64(int.from_bytes(hashlib.md5(raw).digest()[:8], "little"))
                hashes.append(found[0])
                places.append(_mixed(name + found[1] * np.uint64(_B)))
            if not hashes:
                continue
            h, p = np.concatenate(hashes), np.concatenate(places)
            order = np.lexsort((p, h))
            h, p = h[order], p[order]
            a = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            z = np.r_[a[1:], len(h)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h[a], p[a], p[z])], ["h", "lo", "hi"])

    found = base.select("_text").mapInArrow(find, "h long, lo long, hi long")
    # signed order differs from that of the batches, but two places stay two places
    repeated = found.groupBy("h").agg(
        F.min(F.least("lo", "hi")).alias("lo"), F.max(F.greatest("lo", "hi")).alias("hi")
    ).where("lo != hi").select("h")
    repeated = space.save("anchors", repeated)
    cuts = space.save("cuts", _cut(base, repeated, size))

    parts = cuts.where("bytes is not null")
    snippets = parts.groupBy("sid").agg(
        F.first("h").alias("h"), F.first("n").alias("n"), F.first("bytes").alias("bytes"),
        F.min("place").alias("lo"), F.max("place").alias("hi"),
    )
    snippets = space.save("snippets", snippets.select("sid", "h", "n", "bytes", (F.col("lo") != F.col("hi")).alias("again")))
    total = snippets.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def sort_shard(shard: pd.DataFrame) -> pd.DataFrame:
        counts = shard["n"].tolist()
        runs = _shard_repeats(shard["bytes"].tolist(), counts, size)
        runs = [[0, n] if again else r for r, n, again in zip(runs, counts, shard["again"])]
        out = pd.DataFrame({"sid": shard["sid"].to_numpy(), "runs": runs})
        return out[out["runs"].map(len) > 0]

    dealt = snippets.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    sorted_ = space.save("sorted", dealt.groupBy("shard").applyInPandas(sort_shard, "sid long, runs array<int>"))
    hits = parts.select("sha", "sid", "start").join(sorted_, "sid")
    spans = hits.select("sha", F.transform("runs", lambda x: x + F.col("start")).alias("runs"))
    spans = spans.groupBy("sha").agg(F.collect_set("runs").alias("runs"))
    texts = cuts.where("bytes is null").select("sha", "text").dropDuplicates(["sha"])

    def keep(batches):
        for batch in batches:
            out = []
            for sha, t, runs in zip(*(c.to_pylist() for c in batch.columns)):
                raw = t.encode()
                # each run of starts covers up to size - 1 bytes more
                edge = np.zeros(len(raw) + 1, np.int32)
                for run in runs:
                    np.add.at(edge, run[::2], 1)
                    np.add.at(edge, np.array(run[1::2]) + size - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((sha, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["s", "removed", "spans", "kept_sha", "kept"])

    changed = texts.join(spans, "sha").select("sha", "text", "runs").mapInArrow(keep, "s string, removed long, spans long, kept_sha string, kept binary")
    copied = rows.groupBy("sha").count().where("count > 1").select(F.col("sha").alias("c"))
    out = rows.join(copied, F.col("sha") == F.col("c"), "left").join(changed, F.col("sha") == F.col("s"), "left")
    all_gone = F.col("c").isNotNull() & (F.col("n_bytes") >= size)
    cols = [
        F.col("_id").alias(key), "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    return out.select(*cols, *([F.when(~all_gone, F.col("kept")).alias("kept")] if with_kept else []))


_CUTS = "sha string, text string, h long, sid long, place long, start int, n int, bytes binary"


def _cut_rows(texts: list[str], known, size: int):
    """Rows of _CUTS: one for each snippet, and one with the text itself for each text that has any. known: a function of the row's
    number to the sorted anchors."""
    rows = []
    for k, t in enumerate(texts):
        raw = t.encode()
        if len(raw) < size:
            continue
        found = _snippets(raw, size, known(k))
        if not found:
            continue
        sha = hashlib.sha256(raw).hexdigest()
        name = int(sha[:16], 16)
        rows.append((sha, t, None, None, None, None, None, None))
        for h, start, n, piece in found:
            sid = int.from_bytes(hashlib.md5(piece + n.to_bytes(4, "little")).digest()[:8], "little", signed=True)
            place = (name + start * _B) % (1 << 64)
            rows.append((sha, None, h - (1 << 64) if h >> 63 else h, sid, place - (1 << 64) if place >> 63 else place, start, n, piece))
    return rows


def _batches(rows):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for k in range(0, len(rows), 4096):
        cols = list(zip(*rows[k : k + 4096]))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], [x.split()[0] for x in _CUTS.split(", ")])


def _cut(base: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """Snippets of the texts, each joined with its own repeated anchors; neither anchors nor texts pass through the driver."""
    named = base.select("_text", F.xxhash64("_text").alias("name"))

    def listed(batches):
        for batch in batches:
            names, hashes = [], []
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = t.encode()
                if len(raw) >= size:
                    hashes.append(np.unique(anchors(raw, size)[1][0]))
                    names.append(np.full(len(hashes[-1]), name, np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(hashes).view(np.int64))], ["name", "h"])

    own = named.mapInArrow(listed, "name long, h long").join(repeated, "h", "left_semi")
    own = own.groupBy("name").agg(F.collect_set("h").alias("hs"))
    rows = named.join(own, "name").select("_text", "hs")

    def run(batches):
        for batch in batches:
            hs = batch.column(1).to_pylist()
            yield from _batches(_cut_rows(batch.column(0).to_pylist(), lambda k: np.sort(np.array(hs[k], np.int64).view(np.uint64)), size))

    return rows.mapInArrow(run, _CUTS)
