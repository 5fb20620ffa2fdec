"""Writers: stage documents, alignment lists and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """JSON, one folder for each document."""
    rows.write.partitionBy(key).mode("overwrite").json(path)


def alignment(pairs: DataFrame, path: str) -> None:
    """src, tgt and the score with four decimals, tab-separated with a header."""
    pairs.select(F.element_at(F.split("src", "/"), -1).alias("src_idx"), F.element_at(F.split("tgt", "/"), -1).alias("tar_idx"), F.format_string("%.4f", "score").alias("score")).write.mode("overwrite").csv(path, sep="\t", header=True)


def texts(rows: DataFrame, path: str) -> None:
    """One folder for each document and file name, with the text as written."""
    rows.select("doc_id", "file_name", F.col("text").alias("value")).write.partitionBy("doc_id", "file_name").mode("overwrite").text(path)


def vectors(rows: DataFrame, path: str, index: DataFrame, config: dict | None = None) -> None:
    """Vectors (doc_idx, chunk, vec), one folder for ranges of documents, with the metadata list and the configuration.

    A document of ``index`` (doc_idx, file_path) without vectors keeps its row of metadata, with no chunks.
    """
    rows.select("doc_idx", "chunk", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    chunks = rows.groupBy("doc_idx").agg(F.count("*").cast("int").alias("n_chunks"))
    meta = index.join(chunks, "doc_idx", "left").select("doc_idx", "file_path", F.concat(F.lit("vectors/"), F.col("doc_idx").cast("string")).alias("emb_file"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    meta.write.mode("overwrite").csv(f"{path}/metadata", sep="\t", header=True)
    settings = [(str(k), str(v)) for k, v in (config or {}).items()]
    rows.sparkSession.createDataFrame(settings, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def translations(rows: DataFrame, path: str) -> None:
    """A translation table (src_norm, tgt) as one JSON object for each part."""
    rows.groupBy(F.spark_partition_id().alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("src_norm", "tgt")))).alias("value")).select("value").write.mode("overwrite").text(path)


def summary(rows: DataFrame, path: str) -> None:
    """Counters of a run, which are one row, as JSON."""
    rows.coalesce(1).write.mode("overwrite").json(path)
