"""Toxicity by compression distance: a text belongs to the class whose dictionary compresses it better.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A text is cut into overlapping windows of bytes; each
window is compressed with either dictionary, and the difference of the lengths tells how toxic it is. Thresholds on those
differences (how many windows reach them, and the largest) are calibrated by boosted trees on labelled rows that the
dictionaries did not see. The toxic dictionary is the ordinary one with the pieces added that toxic text is rich in, so that
only these make a difference. Windows stay below 63 bytes, from which the coder would start to recode literals.

Edge cases: null and empty texts have no windows and get the calibrated score of "no evidence"; very long texts are cut into
windows whole; repeated rows get equal scores; labels that are null or name no document are ignored; without labels of both
classes every score is 0; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Workspace, fold, map_texts
from tracewell.llm.quality import Forest, fit_forest

#: Labelled rows that a fit takes at most, of either class (those with the smallest hashes of their ids).
FIT_ROWS = 4_000
#: Bytes of ordinary text that one group trains a dictionary on.
GROUP_BYTES = 16_000_000
#: Bytes of a window, and from one window to the next.
WINDOW, STEP = 60, 36
#: Bytes of the ordinary dictionary, and those added for the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 16_384
#: Rounds, and bytes a round, of ordinary windows that look toxic and are added to the ordinary part of both.
HARD_ROUNDS, HARD_BYTES = 3, 12_000
#: Lengths of the word beginnings that toxic pieces are looked for among.
PIECES = (5, 6, 7)
#: A piece is toxic from this log-odds if chance alone gives as many toxic texts that hold it less often than this.
LEAST_ODDS, CHANCE = 3.2, 1e-7
#: Differences of compressed length that windows are counted by.
LEVELS = (1, 2, 3, 4, 5, 6)


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows that cover the whole text, in lower case; none for an empty text."""
    if not text:
        return []
    raw = b" " + " ".join(text.lower().split()).encode()
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STEP), STEP)]


def tail(c: int, n: int, share: float) -> float:
    """The chance that c or more of n independent draws of a share succeed."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(c, n + 1)] if 0 < share < 1 else [0.0]
    return min(1.0, math.fsum(map(math.exp, logs)))


def _word_pieces(text: str) -> set[bytes]:
    found = set()
    for word in text.lower().encode().split():
        word = b" " + word.rstrip(b".,;:!?")
        found.update(word[:k] for k in PIECES if len(word) >= k)
    return found


@dataclass
class Model:
    """Both dictionaries and the calibration; small, so it travels with the tasks."""

    ordinary: bytes
    toxic: bytes
    forest: Forest | None = None
    _pair: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _compressors(self):
        if self._pair is None:
            made = []
            for content in (self.ordinary, self.toxic):
                how = zstd.ZstdCompressionParameters(
                    window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=16,
                    strategy=zstd.STRATEGY_GREEDY, write_content_size=False,
                )
                own = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=how)
                made.append(zstd.ZstdCompressor(dict_data=own, compression_params=how).compress)
            self._pair = tuple(made)
        return self._pair

    def features(self, text: str | None) -> list[float]:
        ordinary, toxic = self._compressors()
        gaps = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
        n = len(gaps)
        top = [float(x) for x in np.sort(gaps)[::-1][:4]] + [0.0] * max(0, 4 - n)
        reached = [int((gaps >= k).sum()) for k in LEVELS]
        return [
            top[0], top[1], sum(top) / 4, float(gaps.mean()) if n else 0.0, math.log1p(n),
            *(math.log1p(x) for x in reached), *(x / max(n, 1) for x in reached),
        ]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.forest is None or not texts:
            return np.zeros(len(texts))
        margins = self.forest.margins(np.array([self.features(t) for t in texts]))
        return 1 / (1 + np.exp(-margins))


def _trained(samples: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little text to train on: it is the dictionary itself
        return b"".join(samples)[-ORDINARY_BYTES:]


def _ordinary(plain: DataFrame) -> bytes:
    """The ordinary dictionary, from all windows of the texts. Texts over GROUP_BYTES are dealt to groups, each of which trains one
    on its own windows; the last is trained on the content of those."""
    size = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    group = F.pmod(F.xxhash64("_key", "_text"), F.lit(-(-size // GROUP_BYTES) or 1))

    def run(part):
        part = part.sort_values(["_h", "_text"])
        return pd.DataFrame({"_d": [_trained([w for t in part["_text"] for w in windows(t)])]})

    found = plain.select("_h", "_text", group.alias("_g")).groupBy("_g").applyInPandas(run, "_d binary").collect()
    parts = sorted(bytes(r["_d"]) for r in found)
    if len(parts) < 2:
        return b"".join(parts)
    return _trained([d[i : i + WINDOW] for d in parts for i in range(0, len(d), WINDOW)])


def _hard(plain: DataFrame, model: Model) -> list[bytes]:
    """As many ordinary windows that look toxic as a round adds: those with the smallest hashes of all."""

    def make():
        def run(texts):
            ordinary, toxic = model._compressors()
            return [[[w for w in set(windows(t)) if len(ordinary(w)) - len(toxic(w)) >= 3] for t in texts]]

        return run

    found = map_texts(plain.select("_text"), "_text", [("_w", "array<binary>")], make).select(F.explode("_w").alias("w")).distinct()
    return [bytes(r["w"]) for r in found.orderBy(F.xxhash64("w"), "w").limit(HARD_BYTES // WINDOW).collect()]


def fit(rows: DataFrame) -> Model:
    """From whole texts with labels (_key, _text, _y; 1: toxic): a half of the keys gives the dictionaries, the other the
    calibration. Executors read the texts; the driver gets counts of pieces, dictionaries and features. Without both classes in
    either half there is no calibration and every score is 0."""
    rows = rows.withColumn("_h", F.xxhash64("_key", F.lit(7)))
    own, calibration = (rows.where(F.col("_h").bitwiseAND(F.lit(1).cast("long")) == k) for k in (0, 1))
    n = {0: 0, 1: 0} | {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
    if not n[1]:
        return Model(b"", b"")
    pieces = map_texts(own.select("_y", "_text"), "_text", [("_g", "array<binary>")], lambda: lambda texts: [[list(_word_pieces(t)) for t in texts]])
    seen = pieces.select("_y", F.explode("_g").alias("g")).groupBy("g").agg(F.sum("_y").alias("c"), F.sum(1 - F.col("_y")).alias("o"))
    # under the share of the class alone c of c + o texts are this likely to be toxic; the normal bound keeps what reaches the driver small
    share = n[1] / (n[0] + n[1])
    both = F.col("c") + F.col("o")
    far = F.col("c") - both * F.lit(share) >= 2.0 * F.sqrt(both * F.lit(share * (1 - share)))
    seen = {bytes(r["g"]): (r["c"], r["o"]) for r in seen.where(far & (F.col("c") >= 3)).collect()}
    odds = lambda c, o: math.log((c + 0.2) / (n[1] + 1) / ((o + 0.2) / (n[0] + 1)))
    rich = {g for g, (c, o) in seen.items() if odds(c, o) > LEAST_ODDS and tail(c, c + o, share) < CHANCE}
    added = b"".join(sorted(rich, key=lambda g: (seen[g][0], g)))[-TOXIC_BYTES:]
    plain = own.where("_y = 0")
    base = _ordinary(plain)
    model = Model(base, base + added)
    for _ in range(HARD_ROUNDS):  # ordinary windows that still look toxic join the ordinary part of both
        hard = _hard(plain, model)
        if not hard:
            break
        base = (b"".join(hard) + base)[-2 * ORDINARY_BYTES :]
        model = Model(base, base + added)
    bare = model
    made = map_texts(calibration.select("_key", "_y", "_text"), "_text", [("_x", "array<double>")], lambda: lambda texts: [[bare.features(t) for t in texts]])
    found = made.select("_key", "_y", "_x").orderBy("_key", "_x").collect()
    y = np.array([r["_y"] for r in found], float)
    if len(np.unique(y)) == 2:
        forest = fit_forest(np.array([r["_x"] for r in found]), y, [1, 1, 1, 1, 0, *[1] * (2 * len(LEVELS))], trees=60, depth=3, rate=0.15)
        model = Model(model.ordinary, model.toxic, forest)
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
          fit_rows: int = FIT_ROWS, parts: int = 5) -> Model:
    """A model from at most fit_rows labelled rows of either class, none of them of fold 0 of parts."""
    known = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_key").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_key"), parts) != 0))
        .groupBy("_key").agg(F.max("_y").alias("_y"))
    )
    order = [F.xxhash64("_key"), F.col("_key")]
    chosen = known.where("_y = 0").orderBy(*order).limit(fit_rows).union(known.where("_y = 1").orderBy(*order).limit(fit_rows))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    return fit(Workspace(docs.sparkSession, "toxicity-fit").save("rows", rows.where("_text is not null")))


def score_documents(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score (0 to 1, higher: likelier toxic) and predicted (1 from a score of 0.5)."""

    def make():
        def run(texts):
            scores = model.scores(texts)
            return scores, [int(s >= 0.5) for s in scores]

        return run

    return map_texts(df, text, list(zip(names, ("double", "int"))), make)
