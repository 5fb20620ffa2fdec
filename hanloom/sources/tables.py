"""Readers of the pipeline's files: text corpora, stage documents in JSON, tab-separated pairs and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..session import keep

TRACE = S.ArrayType(S.StructType([S.StructField(n, t) for n, t in [("query_id", S.StringType()), ("query", S.StringType()), ("rank", S.IntegerType()), ("rerank_source", S.StringType()), ("requested_num_results", S.IntegerType()), ("source_block", S.StringType())]]))
KEYWORDS = "doc_id string, chunks array<struct<chunk_id:int,keywords:array<struct<word:string,score:double,pos:string>>>>"
HITS = "doc_id string, query_results array<struct<query_id:string,query:string,rerank_source:string,requested_num_results:int,urls:array<struct<source_block:string,rank:int,title:string,url:string,snippet:string>>>>"
PAGES = "doc_id string, pages array<struct<page_id:string,url:string,canonical_url:string,final_url:string,domain:string,title:string,html_title:string,status:string,http_status:int,content_type:string,content_kind:string,text_len:int,needs_ocr:boolean,error:string,text:string>>"
QUERIES = "doc_id string, results array<struct<query_id:string,query:string,rerank_source:string>>"
METADATA = "doc_idx bigint, file_path string, emb_file string, n_chunks int"


def corpus(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file_name, text): one row for each file; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def numbered(files: DataFrame) -> DataFrame:
    """The files with ``doc_idx``, their position in the order of names.

    Names are range-partitioned and counted by partition, so that no task sorts all of them.
    """
    placed = keep(files.repartitionByRange("file_name").sortWithinPartitions("file_name").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).orderBy("_part").collect()  # one row for each partition
    before = 0
    offsets = []
    for row in sizes:
        offsets.append((row["_part"], before - row["_first"]))
        before += row["n"]
    shift = files.sparkSession.createDataFrame(offsets, "_part int, _shift bigint")
    return placed.join(F.broadcast(shift), "_part").withColumn("doc_idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def with_metadata(pairs: DataFrame, index: DataFrame, column: str, name: str) -> DataFrame:
    """Pairs with the index of the file named in ``column`` as ``name``; pairs that name no file are dropped."""
    return pairs.join(index.select(F.col("file_name").alias(column), F.col("doc_idx").alias(name)), column)


def query_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, query_no, query_id, query, rerank_source) of query documents, without blank queries."""
    q = docs.select("doc_id", F.posexplode("results").alias("query_no", "q"))
    return q.select("doc_id", "query_no", "q.query_id", F.trim("q.query").alias("query"), F.coalesce("q.rerank_source", F.lit("")).alias("rerank_source")).where("query <> ''")


def vectors(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_idx, chunk, vec) of stored vectors, all or those of the indexes ``wanted`` (doc_idx); an index without vectors gives no row."""
    stored = spark.read.parquet(path)
    return stored if wanted is None else stored.join(wanted.select("doc_idx").distinct(), "doc_idx", "left_semi")


def lookup(index: DataFrame, doc_idx: int) -> str | None:
    """The file name of one index, None if there is none."""
    row = index.where(F.col("doc_idx") == doc_idx).select("file_name").first()
    return row[0] if row else None


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stage documents, one JSON object in each file, always with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def keyword_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, pos, word, score, tag) from nested keyword documents."""
    chunk = docs.select("doc_id", F.explode("chunks").alias("c"))
    return chunk.select("doc_id", F.col("c.chunk_id").alias("chunk"), F.posexplode("c.keywords").alias("pos", "k")).select("doc_id", "chunk", "pos", "k.word", "k.score", F.col("k.pos").alias("tag"))


def hit_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, query_no, query_id, query, rank, url, title, snippet): the addresses found, with non-empty queries only."""
    q = docs.select("doc_id", F.posexplode("query_results").alias("query_no", "q")).where(F.trim("q.query") != "")
    return q.select("doc_id", "query_no", "q.query_id", "q.query", F.explode("q.urls").alias("u")).select("doc_id", "query_no", "query_id", "query", "u.rank", "u.url", "u.title", "u.snippet")


def page_rows(docs: DataFrame) -> DataFrame:
    """One row for each page; a page without an id gets its position, four digits from 0001."""
    p = docs.select("doc_id", F.posexplode("pages").alias("i", "p"))
    return p.select("doc_id", F.coalesce("p.page_id", F.lpad((F.col("i") + 1).cast("string"), 4, "0")).alias("page_id"), *[F.col(f"p.{n}") for n in ("url", "canonical_url", "final_url", "domain", "title", "html_title", "status", "http_status", "content_type", "content_kind", "text_len", "needs_ocr", "error", "text")])


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt) of a tab-separated list without a header; blank and short lines are left out, each pair once."""
    return spark.read.csv(path, sep="\t", schema="src string, tgt string", quote="").where("src is not null and tgt is not null and trim(src) <> '' and trim(tgt) <> ''").select(F.trim("src").alias("src"), F.trim("tgt").alias("tgt")).distinct()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=METADATA)


def translations(spark: SparkSession, path: str) -> DataFrame:
    """(src_norm, tgt) from a JSON object of terms; an empty translation is a hit."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("src_norm", "tgt"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.text import normal_phrase

    return spark.read.text(path).select(normal_phrase(F.col("value")).alias("word")).where("word <> ''").distinct()
