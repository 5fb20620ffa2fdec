"""The registered queries of the text operators, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bilingual, leakage, lookalike, near_dup, page_body, personal, scan_repair, sentences, site_lines, tokenizer

#: The similarity that TESTDATA.md sets for near duplicates.
SIMILAR = 0.7


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_display_pairs(_candidates(spark, d), "global_id")


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonicalise(_candidates(spark, d), "global_id").select("global_id", F.col("canonical").alias("text")).distinct()


def _html(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where("content_kind = 'html'")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(_html(spark, d)).select("global_id", "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _html(spark, d)
    return site_lines.without_lines(rows, site_lines.repeated_lines(rows))


def _html_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("content_kind = 'html' and text is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return page_body.boilerplate_lines(_html_pages(spark, d))


def p3_body(spark: SparkSession, d: str) -> DataFrame:
    return page_body.main_body(_html_pages(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = bilingual.aligned_lines(table(spark, d, "source_text"), _candidates(spark, d), table(spark, d, "gold_pair"), table(spark, d, "translation_cache"))
    return found.select("tgt", "tgt_line", "src", "src_line").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.similar_pairs(_candidates(spark, d), "global_id", SIMILAR)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(_candidates(spark, d), "global_id", SIMILAR)


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where("content_kind = 'pdf'")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.scan_faults(_scans(spark, d), _candidates(spark, d))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired_text(_scans(spark, d), _candidates(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).where("content_kind is null or content_kind <> 'pdf'")
    return sentences.sentence_units(rows, "global_id").select("global_id", "sent_start")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_spans(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [p1_found, p1_canonical, p2_found, p2_clean, p3_found, p3_body, p4_found, p5_found, p5_groups, p6_found, p6_repaired, p7_found, p8_ids, p9_found, p10_found, p10_redacted]
    return {f.__name__: f for f in made}
