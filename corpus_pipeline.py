"""Corpus pipeline: five stages from raw documents to a mixed training set.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from quillstack.llm._spark import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject.  It learns from labelled rows that are still in ``docs``."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them repeat; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[changed.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate class."""
    return near_dup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), short=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, with the words of it that the mix takes."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dup", near), ("decontamination", benchmark), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Toxicity, near duplicates and decontamination are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
