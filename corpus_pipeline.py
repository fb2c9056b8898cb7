"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

``run`` writes what a stage returns as Parquet in the shared folder and hands the reread table to the
next stage. All stages but the last return the columns of ``documents``; extra columns pass through the
first four untouched. Null texts count as empty: the first stage rejects them as too short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import gam, near, packing, rules, secrets
from heddle.llm.common import carried, keep, shared_dir, table

#: The classifier rejects documents that score below this.
LEAST_QUALITY = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = rules.judge(carried(docs, "doc_id", "text"), rules.trusted_ids(table(spark, sf_dir, "labels")))
    return keep(judged, "kept").select("__row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough; the model is fitted on ``documents``' labelled rows, which hold both labels."""
    model = gam.fit_labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return gam.with_score(carried(docs, "text"), model).where(F.col("score") >= LEAST_QUALITY).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return near.near_dedup(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced; n_chars follows the text."""
    found = secrets.scan(carried(docs, "text", "source", "n_chars"), secrets.fit_forest(secrets.labelled_findings(spark)))
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("secrets") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.op7_best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Hashes, a fitted model and a tokenizer can't be said in SQL; tests/llm holds the stages' operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
