"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept; :func:`run` writes every stage's
result as Parquet into the shared folder and reads it back for the next one, so that an executor lost
late costs the work of one stage at most. A stage's table goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwall.llm import lines, minhash, mixing, packing, quality_rules
from pitwall.llm.common import discard, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each fuzzy line stays; documents of which nothing is left go."""
    return lines.deduplicate_lines(docs, length_column="n_chars", drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs, size=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the tempered source, language and topic shares."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("mixing", mixture), ("packing", packed)]

#: Packing and the fuzzy joins cannot be expressed in SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
