"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, decontamination and packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read, settled
from millrace.llm.decision_list import filter_quality
from millrace.llm.drr_packing import pack, word_vocabulary
from millrace.llm.line_spread import NOT_BLANK, without_boilerplate
from millrace.llm.oph_minhash import drop_near_duplicates
from millrace.llm.suffix_decontam import drop_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from labels."""
    return filter_quality(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, short ones included; n_chars follows the text, and a text without words left goes."""
    out = without_boilerplate(docs, counted=NOT_BLANK).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked at 0.8 over five-word shingles."""
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a test item occurs."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048."""
    return pack(docs, word_vocabulary())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the learned list, the tokenizer or the packing: tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again by the next, and what it wrote on the way is dropped."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
