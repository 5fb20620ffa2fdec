"""The registered queries of the core operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import align, dedup, keywords, pages
from ..sources import tables
from ..session import keep, table

#: Least margin of an edge in the queries; the given vectors are hubs of each other, so it is lower than the default.
THRESHOLD = 0.0


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "candidate").dropDuplicates(["global_id"])


def _latest(s: SparkSession, d: str) -> DataFrame:
    return pages.latest(table(s, d, "pages"))


# --- text -----------------------------------------------------------------------------------


def text_stats(s, d):
    han, latin = T.count_of(F.col("text"), T.HAN), T.count_of(F.col("text"), T.LATIN)
    rows = _documents(s, d).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), han.alias("han"), latin.alias("latin"), T.traditional_score(F.coalesce("text", F.lit(""))).alias("ts"))
    return rows.select("doc_id", "chars", "han", "latin", F.round(T.ratio(F.col("han"), F.col("latin")), 6).alias("han_ratio"), F.round(T.ratio(F.col("latin"), F.col("han")), 6).alias("latin_ratio"), F.round("ts", 6).alias("traditional_score"))


def clean_text_export(s, d):
    return _documents(s, d).select("doc_id", T.clean_for_export(F.col("text")).alias("text"))


def clean_text_aggressive(s, d):
    return _documents(s, d).select("doc_id", T.clean_for_export(F.col("text"), "aggressive").alias("text"))


def clean_text_keyword(s, d):
    return _documents(s, d).where("text is not null").select("doc_id", T.clean_for_keywords(F.col("text")).alias("text"))


def _sentences(s, d):
    rows = _documents(s, d).where("text is not null")
    han = T.count_of(F.col("text"), T.HAN) > T.count_of(F.col("text"), T.LATIN)
    return rows.select("doc_id", T.sentences(F.col("text"), han).alias("units"))


def sentence_split(s, d):
    return _sentences(s, d).select("doc_id", F.posexplode("units").alias("pos", "sentence"))


def sentence_windows(s, d):
    return _sentences(s, d).select("doc_id", F.posexplode(T.windows(F.col("units"), 8, 2)).alias("pos", "window"))


def token_windows(s, d):
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), f"[{T.SPACE}]+"), lambda x: x != "")
    return _documents(s, d).select("doc_id", F.posexplode(T.windows(tokens, 100, 50)).alias("pos", "window"))


def signatures(s, d):
    return _candidates(s, d).where("text is not null").select("global_id", F.sha1(T.signature(F.col("text"))).alias("han_hash"), F.sha1(T.signature(F.col("text"), T.LATIN)).alias("latin_hash"))


# --- pages ----------------------------------------------------------------------------------


def pages_latest(s, d):
    return _latest(s, d).select("doc_id", "page_id", "status", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


def line_run_stats(s, d):
    stats = _candidates(s, d).where("text is not null").select("global_id", pages.vertical_stats(F.col("text")).alias("v"))
    return stats.select("global_id", *[F.col(f"v.{a}").cast("bigint").alias(b) for a, b in [("n", "n_lines"), ("one", "one_lines"), ("short", "short_lines"), ("len", "letters"), ("max1", "run_one"), ("max2", "run_short")]])


def _gated(s, d):
    return pages.gate(_latest(s, d), min_len=150, min_han=100, min_ratio=0.6)


def page_gate(s, d):
    return _gated(s, d).select("doc_id", "page_id", F.coalesce("reason", F.lit("candidate")).alias("reason"), F.length("clean").alias("chars"), F.col("han_chars_").alias("han"))


def page_rollup(s, d):
    return pages.rollup(_latest(s, d))


def funnel_summary(s, d):
    kept = F.col("reason").isNull()
    return _gated(s, d).agg(F.count("*").alias("pages"), F.count_if(kept).alias("candidates"), F.count_distinct(F.when(kept, F.col("hash"))).alias("distinct_texts"))


def rejection_reasons(s, d):
    return table(s, d, "rejection").select("doc_id", "page_id", "reason").distinct().groupBy("reason").agg(F.count("*").alias("n"))


def url_canonical(s, d):
    return table(s, d, "pages").select("url").distinct().select("url", U.canonical(F.col("url")).alias("canonical"), U.early_stop_key(F.col("url")).alias("stop_key"))


def url_group(s, d):
    return pages.group_by_url(table(s, d, "pages").select("doc_id", "page_id", "url").where("url is not null").distinct())


def url_group_traces(s, d):
    grouped = pages.group_with_traces(table(s, d, "pages").where("url is not null").dropDuplicates(["doc_id", "page_id", "url"]))
    return grouped.select("doc_id", "canonical", "url", "first", F.size("traces").cast("bigint").alias("traces"))


def _hits(s, d):
    hit = table(s, d, "pages").select("doc_id", "url", F.explode("source_queries").alias("q"))
    return hit.select("doc_id", F.col("q.query_id").alias("query_no"), F.col("q.rank").alias("rank"), "url").distinct()


def url_early_stop(s, d):
    return pages.early_stop(_hits(s, d), 3).select("doc_id", "query_no", "rank", "url")


def content_kinds(s, d):
    return table(s, d, "pages").select("url", "content_type").distinct().select("url", "content_type", U.content_kind(F.col("url"), F.col("content_type"), F.lit("")).alias("kind"), U.charset(F.col("content_type")).alias("charset"))


# --- duplicates -----------------------------------------------------------------------------


def exact_dedup(s, d):
    return dedup.exact(_candidates(s, d))


def exact_dedup_scoped(s, d):
    return dedup.exact(_candidates(s, d), ("content_hash", "doc_id"))


def _signed(s, d):
    return _candidates(s, d).where("text is not null").withColumn("sig", T.signature(F.col("text")))


def _pairs(s, d, least, metric):
    return dedup.similar_pairs(_signed(s, d), "global_id", F.col("sig"), 3, least, metric)


def ngram_jaccard_pairs(s, d):
    return _pairs(s, d, 0.85, "jaccard").select("a", "b", F.round("score", 6).alias("score"))


def containment_pairs(s, d):
    return _pairs(s, d, 0.9, "containment").select("a", "b", F.round("score", 6).alias("score"))


def containment_asym_pairs(s, d):
    """Pairs (a, b) by quality: b, the worse, lies in a, or both nearly lie in each other."""
    rows = _signed(s, d)
    pairs = dedup.similar_pairs(rows, "global_id", F.col("sig"), 3, dedup.MUTUAL * 0.95, "containment")
    quality = rows.select("global_id", dedup.quality_value(prefer_longer=True).alias("q"))
    ranked = pairs.join(quality.toDF("a", "qa"), "a").join(quality.toDF("b", "qb"), "b")
    turn = F.col("qb") < F.col("qa")
    first = [F.when(turn, F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in [("b", "a", "a"), ("a", "b", "b"), ("size_b", "size_a", "size_a"), ("size_a", "size_b", "size_b")]]
    both = dedup.asymmetric(ranked.select(*first, "common"), 0.95)
    return both.select("a", "b", F.round("b_in_a", 6).alias("b_in_a"), F.round("a_in_b", 6).alias("a_in_b"))


def similarity_metrics(s, d):
    pairs = _pairs(s, d, 0.9, "containment")
    return pairs.select("a", "b", *[F.round(dedup.metrics(m), 6).alias(m) for m in ("jaccard", "containment", "b_in_a", "a_in_b")])


def doc_scope_pairs(s, d):
    return dedup.similar_pairs(_signed(s, d), "global_id", F.col("sig"), 3, 0.5, "jaccard", "doc_id").select("a", "b", F.round("score", 6).alias("score"))


def _near(s, d, least, metric):
    found = dedup.near(_signed(s, d), "global_id", F.col("sig"), 3, least, dedup.quality_order(prefer_longer=True), metric)
    # Rows that are kept have no keeper; -1 and 0 stand for that here.
    return found.select(F.col("node").alias("global_id"), F.coalesce("keeper", F.lit(-1).cast("bigint")).alias("keeper"), F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"))


def near_dedup(s, d):
    return _near(s, d, 0.85, "jaccard")


def near_dedup_contained(s, d):
    return _near(s, d, 0.95, "asymmetric")


def _unique(s, d):
    rows = _candidates(s, d)
    return rows.join(dedup.exact(rows).where("kept = global_id").select("global_id"), "global_id")


def export_manifest(s, d):
    return pages.manifest(_unique(s, d)).select("doc_id", F.col("local_no").cast("bigint").alias("local_no"), "global_id")


def export_files(s, d):
    return pages.manifest(_unique(s, d)).select("global_id", "file_name")


# --- keywords and queries -------------------------------------------------------------------


def _lines(s, d):
    line = table(s, d, "source_text").select("file_name", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return line.select("file_name", F.floor(F.col("i") / 4).alias("chunk"), "line")


def keyword_candidates(s, d):
    return keywords.candidates(_lines(s, d), "file_name", "chunk", F.col("line"))


def _aggregated(s, d, top=15):
    found = keyword_candidates(s, d).withColumn("score", F.col("tf") + F.length("word") / 100)
    total = _lines(s, d).groupBy("file_name").agg(F.count_distinct("chunk").alias("chunks"))
    return keywords.aggregate(found, "file_name", total, top=top)


def keyword_aggregate(s, d):
    return _aggregated(s, d).select("file_name", "word", "score", F.col("rank").cast("bigint").alias("rank"))


def keyword_mmr(s, d):
    return keywords.mmr(_aggregated(s, d), "file_name", top=8)


def _terms(s, d):
    return _aggregated(s, d, 8).select("file_name", F.col("word").alias("term"), "score")


def _hits_of_terms(s, d, terms=None):
    corpus = keyword_candidates(s, d).select(F.col("file_name").alias("doc_id"), F.col("word").alias("term"))
    return keywords.pair_hits(_terms(s, d) if terms is None else terms, corpus, "file_name")


def cooccurrence_hits(s, d):
    return _hits_of_terms(s, d)


def anchor_score(s, d):
    terms = keep(_terms(s, d))
    return keywords.anchor_scores(terms, _hits_of_terms(s, d, terms), "file_name").drop("score").withColumn("quality", F.round("quality", 6))


def query_variants(s, d):
    return keywords.variants(_aggregated(s, d), "file_name", 3, 4).select("file_name", "variant", F.col("place").cast("bigint").alias("place"), "word")


def translate_lookup(s, d):
    return keywords.translated(_terms(s, d).select("term").distinct(), table(s, d, "translation_cache")).select("term", "trans", "found")


def query_compose(s, d):
    ranked = _aggregated(s, d, 6).select("file_name", (F.col("rank") - 1).alias("place"), F.col("word").alias("term"))
    found = keywords.translated(ranked, table(s, d, "translation_cache")).select("file_name", "place", F.col("trans").alias("han"))
    return keywords.compose(found, "file_name", 3, ("a.example", "b.example"))


def _pool(s, d, terms=None):
    found = keywords.translated(_terms(s, d) if terms is None else terms, table(s, d, "translation_cache"))
    return keywords.rerank_pool(found.select("file_name", "term", "score", F.col("trans").alias("han")), min_han=2)


def rerank_candidates(s, d):
    return _pool(s, d).select("file_name", "term", "han", "eligible")


def _anchors(s, d):
    terms = keep(_terms(s, d))
    return keywords.top_anchors(_pool(s, d, terms), _hits_of_terms(s, d, terms), "file_name", 6)


def anchor_top(s, d):
    return _anchors(s, d).select("file_name", "term", "support", "anchor", F.col("place").cast("bigint").alias("place"))


def anchor_connections(s, d):
    return keywords.connected_terms(_hits_of_terms(s, d), "file_name").select("file_name", "term", "max_hits", F.array_join("connected", "|").alias("connected"))


def query_terms(s, d):
    return keywords.select_terms(_anchors(s, d), "file_name", 4).select("file_name", "term", F.col("place").cast("bigint").alias("place"))


def query_exact_loose(s, d):
    tag = F.when(F.col("term").contains(" "), "Np").otherwise("N")
    chosen = keywords.select_terms(_anchors(s, d), "file_name", 5, fill=True).withColumn("tag", tag)
    return keywords.exact_and_loose(chosen, "file_name", 2).select("file_name", "term", "is_exact", F.col("place").cast("bigint").alias("place"))


def query_local_ranges(s, d):
    chunks = _lines(s, d).groupBy("file_name").agg(F.count_distinct("chunk").alias("chunks"))
    return keywords.local_ranges(chunks, "file_name")


def translation_hit_counts(s, d):
    found = keywords.translated(_terms(s, d), table(s, d, "translation_cache"))
    return keywords.translation_hits(found, "file_name")


def terms_first_seen(s, d):
    return keywords.first_seen(_terms(s, d).select("term", "file_name"), "file_name")


def translation_table(s, d):
    t = table(s, d, "translation_cache")
    return t.select("src_norm", F.coalesce("tgt", F.lit("")).alias("tgt"), (F.length("tgt") > 0).alias("filled"))


# --- alignment ------------------------------------------------------------------------------


def _segments(s, d):
    v = table(s, d, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("chunk"), F.col("embedding").cast("array<double>").alias("vec"))
    return v.where("chunk % 2 = 0"), v.where("chunk % 2 = 1")


def knn_chunks(s, d):
    a, b = _segments(s, d)
    return align.knn(a, b, 5).select("src", "src_chunk", "dst", "dst_chunk", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


def vote_docs(s, d):
    a, b = _segments(s, d)
    return align.vote(align.knn(a, b, 5), 10).select("src", "dst", "votes", F.col("rank").cast("bigint").alias("rank"))


def _bimax(s, d, mode):
    a, b = _segments(s, d)
    return align.bimax(align.vote(align.knn(a, b, 5), 10), a, b, mode)


def bimax_avg(s, d):
    return _bimax(s, d, "avg").select("src", "dst", F.round("score", 6).alias("score"))


def bimax_max(s, d):
    return _bimax(s, d, "max").select("src", "dst", F.round("score", 6).alias("score"))


def bimax_min(s, d):
    return _bimax(s, d, "min").select("src", "dst", F.round("score", 6).alias("score"))


def _margins(s, d, mode):
    a, b = _segments(s, d)
    return align.margins(a, b, mode=mode)


def csls_edges(s, d):
    return _margins(s, d, "max").select("src", "dst", F.round("margin", 6).alias("margin"), F.col("rank").cast("bigint").alias("rank"))


def align_mm(s, d):
    return align.edges_above(_margins(s, d, "max"), THRESHOLD).select("src", "dst", F.round("margin", 6).alias("margin"))


def align_one_to_one(s, d):
    return align.one_to_one(align.edges_above(_margins(s, d, "avg"), -1.0)).select("src", "dst", F.round("margin", 6).alias("margin"))


def align_eval(s, d):
    gold = table(s, d, "embeddings").select(F.col("label").alias("src"), F.col("label").alias("dst")).distinct()
    e = align.evaluate(align.edges_above(_margins(s, d, "max"), THRESHOLD), gold)
    return e.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def corpus_index(s, d):
    return tables.numbered(table(s, d, "source_text").select("file_name").distinct())


def pair_metadata(s, d):
    """Listed pairs with the index of their source; pairs whose source is no file are left out."""
    return tables.with_metadata(gold_pairs(s, d), corpus_index(s, d), "src", "src_idx").select("src_idx", "src", "tgt")


def title_names(s, d):
    shown = F.coalesce(F.when(F.col("html_title") != "", F.col("html_title")), F.when(F.col("title") != "", F.col("title")), "doc_id")
    return _candidates(s, d).select("global_id", T.without_site(shown).alias("title"), T.unit_form(shown).alias("unit"))


def gold_pairs(s, d):
    return table(s, d, "gold_pair").where("src is not null and tgt is not null and src <> '' and tgt <> ''").select("src", "tgt").distinct()


def target_link(s, d):
    return pages.target_links(gold_pairs(s, d), table(s, d, "candidate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        text_stats, clean_text_export, clean_text_aggressive, clean_text_keyword, sentence_split, sentence_windows, token_windows, signatures,
        pages_latest, line_run_stats, page_gate, page_rollup, funnel_summary, rejection_reasons, url_canonical, url_group, url_early_stop, content_kinds,
        exact_dedup, exact_dedup_scoped, ngram_jaccard_pairs, containment_pairs, containment_asym_pairs, similarity_metrics, doc_scope_pairs, near_dedup, near_dedup_contained, export_manifest, export_files,
        keyword_candidates, keyword_aggregate, keyword_mmr, cooccurrence_hits, anchor_score, query_variants, translate_lookup, query_compose, translation_table,
        rerank_candidates, anchor_top, anchor_connections, query_terms, query_exact_loose, query_local_ranges, translation_hit_counts, terms_first_seen, url_group_traces, corpus_index, pair_metadata, title_names,
        knn_chunks, vote_docs, bimax_avg, bimax_max, bimax_min, csls_edges, align_mm, align_one_to_one, align_eval, gold_pairs, target_link,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.oracle_sql()
