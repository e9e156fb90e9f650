"""The queries op1_ to op10_ and the pipeline, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, covertree, mixing, neardup, ngrams, passages, pii, quality, quoting, toxicity
from tracewell.llm.common import Workspace, documents, fold


def op1_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "bpe")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(docs, path, public_tokenizers.PATTERN).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "toxicity")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "quality")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    forest = quality.train(docs, documents(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).drop("text")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(documents(spark, sf_dir).select("doc_id", "text"), size=2)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "added")).alias("spans"),
    )


def op7_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.link(documents(spark, sf_dir, "conversations"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "mix")
    docs = documents(spark, sf_dir)
    counted = mixing.with_topics(docs.select("doc_id", "text", "source", "lang"))
    counted = counted.select("doc_id", F.xxhash64("text").alias("text"), "source", "lang", "topic", "n_tokens")
    slim = space.save("counted", counted)
    mixed, _ = mixing.mix(slim.drop("topic", "n_tokens"), tabled=slim)
    return mixed.drop("text")


QUERIES = {f.__name__: f for f in (
    op1_cover_tree_search, op2_byte_bpe, op3_toxicity, op4_quality_rules, op5_minhash_dedup, op6_personal_data, op7_ngram_scores, op8_repeated_passages, op9_quotation_linking, op10_mix_sources,
)}

ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
        ), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
}
