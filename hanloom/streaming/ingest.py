"""Incremental ingest of page rows: an extension beyond the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_pages(spark: SparkSession, path: str, schema: StructType, delay: str = "3 days") -> DataFrame:
    """A stream of page rows, each (doc_id, page_id, text) once within the watermark of its load time."""
    stream = spark.readStream.schema(schema).parquet(path)
    signed = stream.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return signed.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["doc_id", "page_id", "text_hash"])


def only_missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The batch form: rows whose output does not exist yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
