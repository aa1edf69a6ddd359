"""The corpus pipeline: toxicity, near duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm.base import Workspace
from tremolo.llm.bpe import bpe_digests
from tremolo.llm.decontaminate import decontaminate
from tremolo.llm.minhash import near_duplicates
from tremolo.llm.pii import replace_pii
from tremolo.llm.queries import VOCABULARY
from tremolo.llm.toxicity import fit_toxicity, reject_toxic


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject: those that score below 0.7.

    Null, empty and blank texts score as texts without evidence and stay; equal texts score alike, so
    repeated rows stay or go together. Rows without a doc_id are scored like others. Columns stay as
    they are, whatever their names; an empty table stays empty, and without labels nothing goes.
    """
    return reject_toxic(docs, fit_toxicity(docs, _labels(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that with the least doc_id.

    Repeated rows of a kept doc_id and text leave one row; rows that share a doc_id stand or fall
    together. Rows without a doc_id and texts without words have no group and stay.

    Of equal sets the least doc_id stays. Columns stay as they are, whatever their names; an empty
    table stays empty. Documents meet the ids that go, as they are fewer than those that stay.
    """
    ws = Workspace(spark)
    found = near_duplicates(docs.select("doc_id", "text"), k=5, threshold=(80, 100)).where("doc_id is not null and n_shingles > 0")
    decided = ws.save(found.groupBy("doc_id").agg(F.bool_or("kept").alias("keep"), F.count(F.lit(1)).alias("n")), "decided")
    gone = ws.save(decided.where("not keep").select("doc_id"), "gone")
    repeated = ws.save(decided.where("keep and n > 1").select("doc_id"), "repeated")
    once = docs.join(gone, "doc_id", "left_anti").join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null, empty and blank texts hold none and stay; repeated rows stay or go together, with or without
    a doc_id. An item that several documents hold removes them all. Columns stay as they are, whatever
    their names; an empty table stays empty, and an empty benchmark removes nothing.
    """
    return decontaminate(docs, _labels(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and n_chars counted anew.

    Null texts stay null and have a null n_chars; empty texts and texts without entities stay as they
    are; repeated rows stay and get equal texts, with or without a doc_id. Other columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    out = replace_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of their decoded text.

    A row for each row, repeated ones and those without a doc_id too; null and empty texts have no
    tokens. Other columns are ignored; an empty table gives an empty result.
    """
    return bpe_digests(docs, VOCABULARY)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: Compression lengths and merges have no SQL; tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again by the next."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = ws.save(out, f"{i}_{name}") if i < len(STAGES) - 1 else out
        if i > 1:
            ws.drop(f"{i - 2}_{STAGES[i - 2][0]}")
    return docs
