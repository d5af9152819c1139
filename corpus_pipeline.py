"""Corpus preparation in stages: each takes (spark, docs, sf_dir) and what it returns is written and read again for the next.

Every stage takes any table with columns doc_id and text; other columns pass through all stages but the last. An
empty table passes through all of them. Null texts have no words, so the first stage rejects them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrary.llm.common import in_small_batches, settled, table
from vibrary.llm.decontaminate import contaminated
from vibrary.llm.jaccard import one_of_each, without
from vibrary.llm.lines import without_shared_lines
from vibrary.llm.packing import pack
from vibrary.llm.quality import good_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are probably bad by the rules' votes."""
    in_small_batches(spark)
    return good_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that ten documents or more share; n_chars follows the text."""
    in_small_batches(spark)
    kept = without_shared_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: by the general rule, shingles of five words and a similarity of 0.8."""
    in_small_batches(spark)
    return one_of_each(docs, percent=80, n=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    in_small_batches(spark)
    return without(docs, settled(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct(), "leaks"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    in_small_batches(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (f.__name__, f) for f in (quality_rules, line_dedup, near_duplicates, benchmark_decontamination, best_fit_packing)
]
#: Expectation-maximisation and packing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, name)
    return docs
