"""The operators do the whole job: no text, row or pair is left out."""

import random
import zlib

import numpy as np

from tracewell.llm import queries, quoting, toxicity


def _held_accuracy(out, truth):
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ing", "on"]) for _ in range(3))
    rows = []
    for i in range(240):
        words = [word() for _ in range(3600)]
        if i % 2:
            words[3100:3600:50] = ["grumblefusk"] * 10
        rows.append((i, " ".join(words)))
    assert min(t.index("grumblefusk") for i, t in rows if i % 2) > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    truth = {i: i % 2 for i, _ in rows}
    marks = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    out = toxicity.score_documents(docs, toxicity.train(docs, marks)).collect()
    assert _held_accuracy(out, truth) > 0.95


def test_ngram_query_keeps_pairs_seen_once(spark, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    rows = [(learnt[0], "red fox"), (learnt[1], "blue cat"), (held[0], "red fox"), (held[1], "blue fox")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op7_ngram_scores(spark, str(tmp_path)).collect()}
    assert got[held[0]].base_score == got[held[1]].base_score
    assert got[held[0]].score > got[held[1]].score + 0.1


def test_short_quoted_lines_are_linked_below_longer_ones(spark):
    rows = [
        (1, 0, "Shall we meet?\nyes, please\nthen bring the map"), (1, 1, "> yes, please\nfine"), (1, 2, "> fine\nok"),
        (2, 0, "a long line that is quoted\nanother line"), (2, 1, "something else here\nno"), (2, 2, "> > a long line that is quoted\n> no\n> not said before\nwell"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in quoting.link(df).collect()}
    assert got[1, 1] == (0, 0, 1) and got[1, 2] == (1, 0, 2)
    assert got[2, 2] == (0, 0, 1)
