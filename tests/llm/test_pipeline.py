"""The pipeline on the smallest tables against plain Python, stage by stage; the draw of the mixing stage is checked for its budget."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import _base_spans, _components
from tracewell.llm import bpe, quality
from tracewell.llm.common import documents

SF = "/root/testdata/sf0.001"


def _redacted(text):
    out, at = [], 0
    for kind, start, stop in sorted(_base_spans(text), key=lambda x: x[1:]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    docs = documents(spark, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    forest = quality.train(docs, documents(spark, SF, "labels"))
    kept = {}
    for i, t in texts.items():
        counts, x = quality.counts_of(t)
        margin = forest.margins(np.array([x]))[0]
        if counts[0] >= 50 and 100 * counts[4] <= 50 * counts[0] and margin >= forest.threshold:
            kept[i] = t
    names, now, columns = [], docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF).cache()
        names.append({r.doc_id: r.text for r in now.collect()})
        assert now.columns == columns
    assert names[0] == kept
    groups = _components(list(kept.items()), 5, 80)
    first = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert names[1] == first
    assert names[2] == {i: _redacted(t) for i, t in first.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        ids = theirs.encode_ordinary(names[2][r.doc_id])
        assert r.n_tokens == len(ids) and list(r.token_ids) == ids and r.decoded_sha256 == hashlib.sha256(names[2][r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    words = {i: len(t.split()) for i, t in names[2].items()}
    share = sum(words[r.doc_id] for r in out) / sum(words.values())
    assert 0.25 < share < 0.75 and len({r.doc_id for r in out}) == len(out)


def test_stages_take_what_tables_hold(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing names, empty tables."""
    good = " ".join(f"word{i} and the other{i % 7} said so" for i in range(40)) + "."
    rows = [(i, good + f" number {i} " * (i % 3), "en", f"s{i % 2}", 5, 1.0, "k") for i in range(30)]
    rows += [(None, good, None, None, None, None, None), (40, None, "en", "s0", None, None, None), (41, "", "en", "s0", 0, 0.0, ""), (42, "long text here " * 60_000, "en", "s1", 1, 1.0, "k"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        got = out.collect()
        if name != "tokenise":
            assert out.columns == df.columns
        if name in ("personal_data", "tokenise"):
            assert len(got) == len(rows)
        if name == "near_duplicates":
            assert {r.doc_id for r in got} >= {None, 40, 41, 42} and sum(r.doc_id == 0 for r in got) <= 1
        assert stage(spark, df.limit(0), SF).count() == 0


def test_mix_sources_weighs_topics_of_all_texts(spark):
    """Texts of a topic so small that its tempered share is over its tokens all stay, though none of them is among the 4,000 texts of the smallest hashes."""
    rng = np.random.default_rng(7)
    vocab = [[f"{x}{i}word" for i in range(8)] for x in "abcd"]
    rows = [(i, " ".join(rng.choice(vocab[i % 3 if i < 8000 else 3], 12)), "en", "web") for i in range(8200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    early = {r.doc_id for r in docs.orderBy(F.xxhash64("text"), "text").limit(4100).select("doc_id").collect()}
    docs = docs.where(~F.col("doc_id").isin([i for i in early if i >= 8000])).cache()
    kept = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()}
    rare = {r.doc_id for r in docs.where("doc_id >= 8000").collect()}
    assert len(rare) > 50 and rare <= kept and len(kept) < 0.6 * docs.count()
