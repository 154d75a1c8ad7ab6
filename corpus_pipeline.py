"""A corpus pipeline: five stages from raw documents to a training mix.

Each stage takes the documents that its predecessor kept and returns documents;
the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, line_dedup, minhash_dedup, mixing, quality_rules
from nearfield.llm._spark import checkpointed
from nearfield.sources.ship import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, each row by its own text; null and empty texts go too."""
    return quality_rules.keep_good(docs, _read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of two lines or more, or of one line of over 50 words, go, and documents of which no word is left.

    Rows of null doc_id keep their lines; rows that repeat a doc_id are one document.
    Documents that lose nothing stay as they are, wordless ones too.
    """
    ship(spark)
    out = line_dedup.dedup_lines(docs, window=2, long_words=51)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(columns).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, 0.8): the least doc_id.

    Rows that repeat the doc_id that stays, wordless rows and rows of null doc_id stay.
    """
    ship(spark)
    return minhash_dedup.drop_near_duplicates(docs, shingle_words=5, percent=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text."""
    return decontaminate.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how often each document is taken, and in how many words.

    Null texts have no words; rows that repeat a doc_id are drawn together.
    """
    ship(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", benchmarks),
    ("mixing", mix),
]

#: The learned rules, near-duplicate components and edit distances have no SQL form; tests check stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written before the next one reads it."""
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
