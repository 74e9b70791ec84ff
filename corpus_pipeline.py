"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of ``documents``. ``run`` applies them to the whole table, and
each stage's rows are written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.llm import common, decontaminate, jaccard, lines, packing, quality

NEAR_WORDS, NEAR_AT_LEAST, NEAR_OF = 5, 80, 100  # shingles of five words, similarity of 0.8 or more


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` follows the text; the columns and their types of ``like``."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; documents that the rules reject go."""
    return _sized(quality.clean(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document with no other text goes."""
    return _sized(lines.remove(docs, lines.repeats(docs)), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (null last) stays; other texts of that id stay too."""
    return jaccard.clean(docs, NEAR_WORDS, NEAR_AT_LEAST, NEAR_OF)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and placed in sequences: one row per piece, with its ids."""
    return packing.pack(docs.select("doc_id", "text"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
