"""The stages as one lazily composed plan, with a configuration for each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, dedup, pages, segments
from ..session import cut_lineage


@dataclass(frozen=True)
class CleanConfig:
    min_len: int = 500
    min_han: int = 100
    min_ratio: float = 0.60
    max_bytes: int | None = None
    annotations: str = "light"
    near: bool = False
    near_threshold: float = 0.85
    near_grams: int = 3


@dataclass(frozen=True)
class SegmentConfig:
    sentences: int = 1
    overlap: int = 0


@dataclass(frozen=True)
class AlignConfig:
    k_chunks: int = 5
    k_docs: int = 10
    trim: float = 0.7
    csls_k: int = 10
    k_out: int = 10
    threshold: float = 0.08
    mode: str = "m-m"


@dataclass(frozen=True)
class Pipeline:
    clean: CleanConfig = field(default_factory=CleanConfig)
    segment: SegmentConfig = field(default_factory=SegmentConfig)
    align: AlignConfig = field(default_factory=AlignConfig)

    def candidates(self, raw: DataFrame) -> DataFrame:
        """Fetched pages → cleaned, gated and de-duplicated candidates."""
        c = self.clean
        gated = pages.gate(pages.latest(raw), c.min_len, c.min_han, c.min_ratio, c.max_bytes, c.annotations).where("reason is null")
        rows = gated.select(
            F.concat_ws("/", "doc_id", "page_id").alias("global_id"), "doc_id", "page_id", "domain", "title", "html_title", F.col("clean").alias("text"), F.col("clean_len").alias("text_len"),
            F.col("han_chars_").alias("han_chars"), F.col("han_ratio_").alias("han_ratio"), T.traditional_score(F.col("clean")).alias("traditional_score"), F.col("hash").alias("content_hash"),
        )
        # What follows reads the cleaned texts several times.
        rows = cut_lineage(rows)
        kept = rows.join(dedup.exact(rows).where("kept = global_id").select("global_id"), "global_id")
        if c.near:
            kept = cut_lineage(kept)
            found = dedup.near(kept, "global_id", T.signature(F.col("text")), c.near_grams, c.near_threshold, dedup.quality_order(prefer_longer=True))
            kept = kept.join(found.where("keeper is null").select(F.col("node").alias("global_id")), "global_id")
        return kept

    def segments(self, docs: DataFrame, key: str) -> DataFrame:
        """Texts → (doc, chunk, vec) by sentence windows and the encoder."""
        han = T.count_of(F.col("text"), T.HAN) > T.count_of(F.col("text"), T.LATIN)
        window = T.windows(T.sentences(F.col("text"), han), self.segment.sentences, self.segment.overlap)
        rows = docs.select(F.col(key).alias("doc"), F.posexplode(window).alias("chunk", "text"))
        return segments.encoded(rows).select("doc", "chunk", "vec")

    def alignment(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """(src, dst, margin) of the documents that match."""
        c = self.align
        mode = "max" if c.mode == "m-m" else "avg"
        margins = align.margins(sources, targets, c.k_chunks, c.k_docs, mode, c.trim, c.csls_k, c.k_out)
        edges = align.edges_above(margins, c.threshold)
        return edges if c.mode == "m-m" else align.one_to_one(edges)
