"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, langid, near_dedup, packing, secrets
from graphloom.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not those without a letter (null and empty texts) or between two codewords.

    Repeated rows share a fate. Without labelled rows no language is known and all go; no rows give no rows.
    """
    model = langid.fit(docs.select("text", "lang"))
    judged = langid.identify(docs.select(*COLUMNS), model)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): that of the least id.

    Rows without words all stay. Rows that repeat an id, or have none, are compared
    each by its own text. No rows give no rows.
    """
    return near_dedup.deduplicate(docs.select(*COLUMNS), width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: no 8-word window of an item, and less than two short items.

    Texts without words stay, repeated rows share a fate; no rows give no rows.
    """
    found = decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where("wide_items = 0 and not contaminated").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; null texts stay null, repeated rows repeat; no rows give no rows."""
    return secrets.redact(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens; a null text is one end id, repeated rows are packed each."""
    return packing.pack(packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, min-hashing and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return docs
