"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Each stage takes the documents, all columns, and returns them; the last returns a row for each
piece of a document with its place in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from docloom.llm.common import discard, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity connect, the one with the smallest doc_id stays."""
    return jaccard_join.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in packed sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("best_fit", best_fit),
]

#: The isolation forest has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one has been written; the last stage checkpoints
    what it takes from its input."""
    docs = stored(STAGES[0][1](spark, table(spark, sf_dir, "documents", "doc_id"), sf_dir))
    for _, stage in STAGES[1:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
