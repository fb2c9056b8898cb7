"""The corpus operators' queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(f):
    QUERIES[f.__name__] = f
    return f


@_add
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import simhash

    return simhash.op10_simhash(table(spark, sf_dir, "documents"))


@_add
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import rules

    judged = rules.judge(table(spark, sf_dir, "documents"), rules.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@_add
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import gam

    return gam.op2_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_add
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import packing

    return packing.op7_best_fit_packing(table(spark, sf_dir, "documents"))


@_add
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import secrets

    return secrets.op3_secret_scans(table(spark, sf_dir, "documents"))


@_add
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import multiset

    return multiset.op4_document_fingerprints(table(spark, sf_dir, "documents"))


@_add
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import chat

    return chat.op5_chat_formatting(table(spark, sf_dir, "conversations"))


@_add
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import warc

    return warc.op1_warc(table(spark, sf_dir, "pages"))


ORACLE_SQL["op1_warc"] = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to FROM h
"""


@_add
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import html

    return html.op6_html_extraction(table(spark, sf_dir, "pages"))


@_add
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm import pieces

    return pieces.op8_sentencepiece(table(spark, sf_dir, "documents"))
