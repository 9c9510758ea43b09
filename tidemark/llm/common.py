"""Helpers shared by the training-data operators.

Intermediate tables are those of ``tidemark.sources.tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.sources.tables import BATCH_ROWS, new_path, release, scratch, small_batches, stored

__all__ = ["BATCH_ROWS", "new_path", "partitions", "read", "release", "scratch", "small_batches", "stored", "training_fold", "with_row"]

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def training_fold(doc_id: str = "doc_id"):
    """True for rows that a model may learn from: crc32 of the id's text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def with_row(schema: str, docs: DataFrame, carry: bool = True) -> StructType:
    """``schema``, with a struct column ``row`` of all columns of ``docs`` behind it if they are carried."""
    fields = StructType.fromDDL(schema).fields
    return StructType([*fields, StructField("row", StructType(docs.schema.fields))] if carry else fields)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
