"""From raw documents to tokenised training data, in stages that each take and return whole tables.

All stages read only the columns they name and pass the others through, whatever their names; empty tables give empty tables; very long texts are read whole;
rows with a null doc_id take part like others unless a stage says otherwise."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, mixing, neardup, pii, quality
from tracewell.llm.common import Workspace, documents, fresh


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go. Null and empty texts have no words and go; equal texts share a verdict; without labels of both
    classes only the base rules decide."""
    Workspace(spark, "quality")
    forest = quality.train(docs, documents(spark, sf_dir, "labels"))
    names = {n: fresh(docs, n) for n in (*quality.COUNTS, "base_failed", "quality_margin", "kept")}
    return quality.judge(docs, forest, names=names).where(F.col(names["kept"])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more. It is the one with the smallest doc_id; rows that share a
    doc_id but not a group all stay; documents without words (null, empty) and rows with a null doc_id stay."""
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. Null texts stay null (n_chars null), empty ones empty; equal texts become equal."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, drawn to tempered shares of source, language and topic. Null sources and languages are cells of their own; rows that repeat id and text are
    drawn together; null and empty texts are drawn with their cell's probability."""
    mixed, names = mixing.mix(docs)
    return mixed.where(F.col(names["kept"])).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of ids and of decoded bytes. Null texts count as empty: no ids."""
    Workspace(spark, "bpe")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, with_ids=True).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: SQL cannot express the fitted forest, the minhash links, the raking or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    space, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = space.save(name, stage(spark, docs, sf_dir))
    return docs
