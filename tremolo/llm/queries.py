"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import oracles
from tremolo.llm.base import Workspace

#: The rules that the url query is defined by, and hosts that it lists as spam.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKLIST = ("spam-farm.example.org", "cheap-pills.example.com")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), RULES, BLOCKLIST)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.toxicity import fit_toxicity, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.warc import read_warc, write_warc

    uri = Workspace(spark).path("archive")
    write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=(85, 100))


def op5_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.rule_quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.pii import replace_pii

    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_warc, op4_minhash, op5_rlz_substrings, op6_templates, op7_rule_quality, op8_surrogates, op9_bpe, op10_quality_rules)}
ORACLES = {
    "op1_url_filter": oracles.url_filter(RULES, BLOCKLIST),
    "op3_warc": oracles.WARC,
    "op4_minhash": oracles.MINHASH,
    "op5_rlz_substrings": oracles.SUBSTRINGS,
    "op10_quality_rules": oracles.quality_rules(),
}
