"""A training-corpus pipeline: each stage is one of the operators, written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillet.llm import line_dedup, mixing, packing, quality, simhash
from quillet.llm.queries import tokenizer_path
from quillet.llm.util import materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows that importance resampling rejects go."""
    return quality.selected_documents(docs, read(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines that stand on many sources go but for their first occurrence; copies of a text count once."""
    return line_dedup.without_boilerplate(docs, copies_once=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, then exact similarity of five-word shingles: one document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_classifier), ("lines", line_deduplication), ("near_duplicates", near_duplicates), ("mix", source_mix), ("pack", packed)]

#: The fingerprints' components, the hashed models and the tokenizer are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder: the pieces of packed sequences.

    An empty table, and one without any word, gives no rows. Null and blank texts are kept by the first two stages, become
    one document in the third and are not taken by the mix. Rows that repeat are one after the third stage; texts that
    differ under one id, and texts without an id, stay. Further columns pass all stages but the last, whatever their names.
    Texts of any length are taken whole. Without labels the first stage keeps everything.
    """
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
