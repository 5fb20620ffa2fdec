"""Fetched pages: the latest good row, grouping by address, the gate, roll-ups and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U


def latest(pages: DataFrame) -> DataFrame:
    """One row for each (doc_id, page_id): a good one before a failed one, then the last fetched and loaded."""
    order = Window.partitionBy("doc_id", "page_id").orderBy(F.when(F.col("status") == "ok", 0).otherwise(1), F.col("fetched_at").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("url").asc_nulls_last())
    return pages.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def group_by_url(hits: DataFrame, doc: str = "doc_id", url: str = "url", order: str = "page_id") -> DataFrame:
    """(doc, canonical, first, n): rows of one document under one canonical address, by the first of them."""
    return hits.withColumn("canonical", U.canonical(F.col(url))).groupBy(doc, "canonical").agg(F.min(order).alias("first"), F.count("*").alias("n"))


def group_with_traces(hits: DataFrame, doc: str = "doc_id", url: str = "url", order: str = "page_id", traces: str = "source_queries") -> DataFrame:
    """(doc, canonical, url, title, snippet, source_block, first, traces): each canonical address with the attributes of its first row
    and the query traces of all of its rows, in order."""
    at = F.struct(order, *[F.col(c) for c in (url, "title", "snippet", "source_block")])
    keyed = hits.withColumn("canonical", U.canonical(F.col(url))).where("canonical <> ''")
    grouped = keyed.groupBy(doc, "canonical").agg(F.min(at).alias("f"), F.sort_array(F.collect_list(F.struct(order, F.col(traces).alias("t")))).alias("all"))
    rows = F.flatten(F.transform(F.filter("all", lambda x: x["t"].isNotNull()), lambda x: x["t"]))
    return grouped.select(doc, "canonical", *[F.col(f"f.{c}") for c in (url, "title", "snippet", "source_block")], F.col(f"f.{order}").alias("first"), rows.alias("traces"))


def early_stop(hits: DataFrame, count: int = 3) -> DataFrame:
    """Search rows (doc_id, query_no, rank, url) up to the query in which an address is seen ``count`` times."""
    keyed = hits.withColumn("key", U.early_stop_key(F.col("url")))
    running = Window.partitionBy("doc_id", "key").orderBy("query_no", "rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = keyed.withColumn("seen", F.count("*").over(running))
    cut = seen.where(F.col("seen") >= count).groupBy("doc_id").agg(F.min("query_no").alias("cut"))
    return keyed.join(cut, "doc_id", "left").where(F.col("cut").isNull() | (F.col("query_no") <= F.col("cut"))).drop("cut", "key")


def vertical_stats(text: Column) -> Column:
    """Line statistics of text that was set vertically: counts and the longest runs of one- and two-character lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"[{T.SPACE}]+", "")), lambda x: x != "")
    stat = F.transform(lines, lambda x: F.struct(F.length(x).alias("len"), T.count_of(x, T.HAN).alias("han")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("one"), F.lit(0).alias("short"), F.lit(0).cast("bigint").alias("len"), F.lit(0).alias("run1"), F.lit(0).alias("run2"), F.lit(0).alias("max1"), F.lit(0).alias("max2"))

    def step(s, x):
        one = (x["han"] == 1) & (x["len"] <= 2)
        short = (x["han"] >= 1) & (x["han"] <= 2) & (x["len"] <= 3)
        run1, run2 = F.when(one, s["run1"] + 1).otherwise(0), F.when(short, s["run2"] + 1).otherwise(0)
        return F.struct(
            (s["n"] + 1).alias("n"), (s["one"] + one.cast("int")).alias("one"), (s["short"] + short.cast("int")).alias("short"), (s["len"] + x["len"]).alias("len"),
            run1.alias("run1"), run2.alias("run2"), F.greatest(s["max1"], run1).alias("max1"), F.greatest(s["max2"], run2).alias("max2"),
        )

    return F.aggregate(stat, start, step)


def is_vertical(stats: Column, min_lines: int = 30, share: float = 0.6, mean: float = 3.0) -> Column:
    n = stats["n"]
    whole = ((stats["one"] >= share * n) | (stats["short"] >= share * n)) & (stats["len"] <= mean * n)
    return (n >= min_lines) & (whole | (stats["max1"] >= min_lines) | (stats["max2"] >= min_lines))


def gate(pages: DataFrame, min_len: int = 500, min_han: int = 100, min_ratio: float = 0.6, max_bytes: int | None = None, mode: str = "light", max_chars: int | None = None, skip_ocr: bool = True, vertical: dict | None = None, form: str | None = "NFC") -> DataFrame:
    """Pages with the cleaned text, its statistics and ``reason``: the first test failed, or null for a candidate."""
    shown = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    cleaned = pages.withColumn("clean", T.clean_for_export(shown if form != "NFKC" else T.nfkc(shown), mode))
    han, latin = T.count_of(F.col("clean"), T.HAN), T.count_of(F.col("clean"), T.LATIN)
    stats = cleaned.withColumns({"clean_len": F.length("clean"), "han_chars_": han, "latin_chars_": latin, "vertical": is_vertical(vertical_stats(F.col("clean")), **(vertical or {}))})
    stats = stats.withColumns({"han_ratio_": T.ratio(F.col("han_chars_"), F.col("latin_chars_")), "signature": T.signature(F.col("clean"))})
    blank = T.strip(F.coalesce(F.col("text"), F.lit(""))) == ""
    reason = (
        F.when(F.coalesce("status", F.lit("")) != "ok", "status_not_ok")
        .when(F.coalesce("needs_ocr", F.lit(False)) & F.lit(skip_ocr), "needs_ocr")
        .when(blank, "empty_text")
        .when(F.octet_length("clean") > max_bytes if max_bytes else F.lit(False), "file_too_large")
        .when(F.col("vertical"), "vertical_ocr_text")
        .when(F.col("clean_len") < min_len, "text_too_short")
        .when(F.col("han_chars_") < min_han, "too_few_han_chars")
        .when(F.col("han_ratio_") < min_ratio, "low_han_ratio")
        .when(F.col("signature") == "", "empty_han_signature")
    )
    return stats.withColumns({"reason": reason, "hash": F.sha1("signature")})


def rollup(pages: DataFrame) -> DataFrame:
    """Counters of each document's pages."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("num_pages"), F.count_if(F.col("status") == "ok").alias("num_ok"), F.count_if(F.coalesce("status", F.lit("")) != "ok").alias("num_error"),
        F.count_if(F.coalesce("needs_ocr", F.lit(False))).alias("num_needs_ocr"), F.sum(F.coalesce(F.size("assets"), F.lit(0))).alias("num_assets"),
    )


#: A file name, and the shorter titles tried where it would be longer.
LONGEST_NAME, TITLE_TIERS = 180, (55, 30, 12)


def manifest(candidates: DataFrame) -> DataFrame:
    """Kept candidates numbered within their document in the order of the export, with a file name.

    A name that would be too long takes a shorter title with a hash of the whole one, then a still shorter one.
    """
    local = Window.partitionBy("doc_id").orderBy("page_id", "domain", "content_hash", "global_id")
    whole = F.coalesce(F.when(F.col("html_title") != "", F.col("html_title")), F.when(F.col("title") != "", F.col("title")), "doc_id")
    numbered = candidates.withColumn("local_no", F.row_number().over(local))
    title = T.without_site(whole)

    def name(longest: int, hashed: bool) -> Column:
        shown = T.safe_filename(title, longest)
        shown = F.concat(shown, F.lit("-"), F.substring(F.sha1(whole), 1, 6)) if hashed else shown
        return F.concat(F.concat_ws("__", F.lpad(F.col("local_no").cast("string"), 4, "0"), shown, T.safe_filename(F.coalesce("domain", F.lit("unknown")), 45), F.substring("content_hash", 1, 10)), F.lit(".txt"))

    tiers = [name(n, k > 0) for k, n in enumerate(TITLE_TIERS)]
    chosen = F.when(F.length(tiers[0]) <= LONGEST_NAME, tiers[0]).when(F.length(tiers[1]) <= LONGEST_NAME, tiers[1]).otherwise(tiers[2])
    return numbered.select("doc_id", "local_no", "global_id", chosen.alias("file_name"))


def target_links(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, tgt, link): the address of each target's page, empty where it is not known."""
    named = candidates.where("txt_path is not null").select(F.element_at(F.split("txt_path", "/"), -1).alias("name"), F.coalesce("final_url", "canonical_url", "url", F.lit("")).alias("link"))
    # File systems change the form of names, so they are compared in one.
    known = named.groupBy(T.nfkc(F.col("name")).alias("_key")).agg(F.min("link").alias("link"))
    wanted = pairs.select("src", "tgt").distinct().withColumn("_key", T.nfkc(F.col("tgt")))
    return wanted.join(known, "_key", "left").select("src", "tgt", F.coalesce("link", F.lit("")).alias("link"))
