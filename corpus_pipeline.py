"""Corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents`` for the rows they keep:

1. language: rejects texts without a letter (null ones too) and those whose language is a guess;
2. toxicity: rejects texts predicted toxic;
3. near_dedup: keeps one document of each group of near copies, that of the least id;
4. decontamination: rejects documents that leak a benchmark item;
5. packing: returns the pieces of the training sequences.

Rows are judged one by one, by their own texts: a row that goes takes no other with it, even
one of the same id or of none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, scratch, stored
from tidemark.llm.decontamination import decontaminated
from tidemark.llm.language import UNDECIDED, identified
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import packed
from tidemark.llm.toxicity import scored

#: A language of less probability is a guess. Whole documents, even in mixed languages, are above it.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known. Their columns pass through the operator, so nothing is shuffled."""
    return identified(docs, carry=True).where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic."""
    return scored(docs, read(spark, sf_dir, "labels"), carry=True).where("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id (a null id comes last), of equal ids the first read."""
    number = "row_number"
    while number in docs.columns:
        number += "_"
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, id_col=number).select(number, "component_id")
    named = groups.join(rows.select(number, "doc_id"), number)
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", number)).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = named.join(kept, "component_id").where(F.col(number) != F.col(f"kept.{number}")).select(number)
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of the benchmark."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No stage has an SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents of ``sf_dir``.

    What a stage writes on its way is deleted once its rows are written, the rows of all stages
    but the last at the end.
    """
    docs = read(spark, sf_dir, "documents")
    with scratch(spark) as keep_last:
        for name, stage in STAGES:
            with scratch(spark) as keep:
                docs = (keep_last if stage is STAGES[-1][1] else keep)(stage(spark, docs, sf_dir), name)
    return docs
