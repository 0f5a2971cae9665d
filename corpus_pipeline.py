"""A corpus pipeline: each stage's rows are written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontamination, language_id, line_dedup, near_duplicates, packing
from tracewright.llm.common import cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification (operator 8), fitted on the stage's own documents: those without a letter, or with too low a score, go."""
    return language_id.keep_known(docs, language_id.learn(docs))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 3): repeated lines go; so does a document that is left without any. n_chars follows the text."""
    return line_dedup.keep_lines(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (operator 4): one document of each class stays."""
    return near_duplicates.keep_first(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 9): contaminated documents go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (operator 1) of what is left."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", first_copies),
    ("decontamination", clean_of_benchmarks),
    ("packing", packed),
]

#: Language identification, signatures and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
