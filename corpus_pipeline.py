"""The corpus pipeline: five stages from raw documents to files of token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame; all but the last return the columns of `documents`. run() writes each stage's rows as
Parquet below the shared folder and rereads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language_id, mixing, near_dedup, token_output
from sparkloom.llm.common import drop_stored, fold, inner, stored
from sparkloom.llm.queries import SOURCE_WEIGHTS, table, tokenizer_file


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a language (no text, or no letter in it) go; without labelled rows all stay.

    Null ids, repeated rows and ties stay as they are; other columns come along, whatever their names; an empty table stays empty.
    """
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    if model is None:
        return docs
    names = (inner("lang"), inner("score"), inner("words"))
    found = language_id.predict(docs, model, keep=docs.columns, names=names)
    return found.where(F.col(names[0]) != language_id.NONE).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group linked by similarity 0.8 or more on five-word shingles one document stays, the smallest doc_id.

    Documents without words and rows with a null doc_id stay; of rows that repeat a doc_id the first by content stays;
    texts of any length count whole; an empty table stays empty.
    """
    return near_dedup.deduplicate(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a benchmark item's passage go.

    Every row is judged by its own text, also those with null or repeated ids; null and empty texts stay; an empty
    benchmark leaves all rows, an empty table stays empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mixture takes it, not at all to twice.

    Texts without words are never taken; a null source is a source of its own; rows that agree in doc_id, source and size
    are taken alike; an empty table stays empty.
    """
    return mixing.mix(docs, SOURCE_WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids in coded files, and what these hold of each document.

    A null text is empty and has the end id alone; null ids come first; repeated rows follow one another; an empty table
    gives no files and no rows.
    """
    return token_output.encode_and_read_back(docs, tokenizer_file(), end_id=2)


STAGES = [("language_id", languages), ("near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("mixing", mixture), ("token_output", tokens)]

#: Trained models, hashing forests and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
