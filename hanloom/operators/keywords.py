"""Keyword candidates, document-level aggregation, diversity ranking and query building."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..session import keep, ship


#: Tags of words that may stand at the edge of a candidate, and tags that may not occur in one.
EDGE_TAGS, NO_TAGS = ("N", "Np", "V", "Nc", "A"), ("CH", "X")
#: Words of 64 documents that are compared at once for pairs of terms.
PAIR_CELLS = 1 << 20


def rule_tags(words: Column) -> Column:
    """The offline annotator: capitalised words are names, other words nouns, the rest signs."""
    return F.transform(words, lambda x: F.when(x.rlike(r"^\p{Lu}"), "Np").when(x.rlike(r"^\p{L}"), "N").otherwise("CH"))


def candidates(rows: DataFrame, key: str, chunk: str, text: Column, longest: int = 2, stops: DataFrame | None = None, tag: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, chunk, word, tf): runs of one to ``longest`` words of at least two letters each, without digits.

    ``stops`` (word) may not be a candidate or stand at either edge of one; ``tag`` annotates an array of words,
    and a candidate needs EDGE_TAGS at both edges and none of NO_TAGS.  Without them neither rule applies.
    """
    form = F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}\s])")
    words = F.regexp_extract_all(F.lower(text), form)
    rows = rows.select(key, chunk, words.alias("w"), *([tag(F.regexp_extract_all(text, form)).alias("t")] if tag else []))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("w") - n + 1)
        if tag:
            edge = lambda at: F.get("t", at - 1).isin(*EDGE_TAGS)
            starts = F.filter(starts, lambda i: edge(i) & edge(i + n - 1) & ~F.arrays_overlap(F.slice("t", i, F.lit(n)), F.array(*map(F.lit, NO_TAGS))))
        taken = F.transform(starts, lambda i: F.slice("w", i, F.lit(n)))
        return F.when(F.size("w") >= n, F.transform(F.filter(taken, lambda g: F.forall(g, lambda x: (F.length(x) >= 2) & x.rlike(r"^\p{L}"))), lambda g: F.array_join(g, " "))).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[runs(n) for n in range(1, longest + 1)])
    found = rows.select(key, chunk, F.explode(grams).alias("word"))
    if stops is not None:
        split = F.split("word", " ")
        for part in (F.col("word"), F.get(split, F.lit(0)), F.element_at(split, -1)):
            found = found.join(stops.select(F.col("word").alias("stop")).distinct(), part == F.col("stop"), "left_anti")
    return found.groupBy(key, chunk, "word").agg(F.count("*").alias("tf"))


def aggregate(keywords: DataFrame, key: str, total: DataFrame, rarity: float = 0.2, rank_weight: float = 0.1, top: int = 15) -> DataFrame:
    """(key, word, score, rank) from (key, chunk, word, score) and the number of chunks ``total`` (key, chunks).

    Scores are scaled within their chunk with a bonus for early rank, joined over chunks as
    0.7 · best + 0.3 · mean, and blended with the rarity over chunks.
    """
    chunk = Window.partitionBy(key, "chunk")
    placed = keywords.withColumns({"lo": F.min("score").over(chunk), "hi": F.max("score").over(chunk), "n": F.count("*").over(chunk), "r": F.row_number().over(chunk.orderBy(F.desc("score"), "word")) - 1})
    scaled = (F.col("score") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    bonus = rank_weight * (1 - F.col("r") / F.greatest(F.col("n") - 1, F.lit(1)))
    joined = placed.withColumn("s", scaled + bonus).groupBy(key, T.normal_phrase(F.col("word")).alias("word")).agg(F.max("s").alias("best"), F.avg("s").alias("mean"), F.count("*").alias("seen"))
    raw = joined.join(total, key).withColumns({"quality": 0.7 * F.col("best") + 0.3 * F.col("mean"), "idf": F.log(F.col("chunks") / F.col("seen"))})
    doc = Window.partitionBy(key)

    def unit(name: str) -> Column:
        lo, hi = F.min(name).over(doc), F.max(name).over(doc)
        return F.when(hi - lo < 1e-9, 1.0).otherwise((F.col(name) - lo) / (hi - lo))

    quality = unit("quality")
    final = raw.withColumn("score", F.round((1 - rarity) * quality + rarity * quality * unit("idf"), 6))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "word")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(key, "word", "score", "rank")


def _bag(word: str, size: int = 64) -> np.ndarray:
    """A hashed vector of character pairs: the offline stand-in for a sentence encoder."""
    out = np.zeros(size)
    padded = f"^{word}$"
    for a, b in zip(padded, padded[1:]):
        out[(ord(a) * 31 + ord(b)) % size] += 1
    return out / np.linalg.norm(out)


def mmr(keywords: DataFrame, key: str, top: int = 10, diversity: float = 0.4) -> DataFrame:
    """(key, word, score): words chosen one by one for relevance (``score``) against what is chosen already.

    Selection is sequential by definition, so a document's keywords, which are few, form one group.
    """
    kind = dict(keywords.dtypes)[key]

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "word"], ascending=[False, True]).reset_index(drop=True)
        if len(part) > top:
            vectors = np.stack([_bag(w) for w in part.word])
            relevance, chosen = part.score.to_numpy(float), [0]
            nearest = vectors @ vectors[0]
            while len(chosen) < top:
                gain = (1 - diversity) * relevance - diversity * nearest
                gain[chosen] = -np.inf
                chosen.append(int(gain.argmax()))
                nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
            part = part.iloc[sorted(chosen)]
        return part[[key, "word", "score"]]

    return keywords.select(key, "word", "score").groupBy(key).applyInPandas(choose, f"{key} {kind}, word string, score double")


def _counted_pairs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block of documents, its rows (doc, term) and the pairs (a, b) asked there: in how many of its documents both terms stand."""
    docs, words = (left.column(i).combine_chunks().dictionary_encode() for i in (1, 2))
    docs, words = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (docs, words))
    have = np.zeros((len(words.dictionary) + 1, len(docs.dictionary) // 64 * 8 + 8), np.uint8)  # the last row stands for terms that the block doesn't hold
    d = docs.indices.to_numpy(zero_copy_only=False)
    np.bitwise_or.at(have, (words.indices.to_numpy(zero_copy_only=False), d >> 3), np.left_shift(1, d & 7).astype(np.uint8))
    have = have.view(np.uint64)
    at = [pc.fill_null(pc.index_in(right.column(c), words.dictionary), len(words.dictionary)).to_numpy() for c in ("a", "b")]
    step = max(1, PAIR_CELLS // have.shape[1])
    hits = [np.bitwise_count(have[at[0][i : i + step]] & have[at[1][i : i + step]]).sum(1, dtype=np.int64) for i in range(0, right.num_rows, step)]
    made = pa.table({"a": right.column("a"), "b": right.column("b"), "hits": pa.array(np.concatenate([*hits, np.zeros(0, np.int64)]))})
    return made.filter(pc.greater(made.column("hits"), 0))


def pair_hits(terms: DataFrame, corpus: DataFrame, group: str, doc: str = "doc_id") -> DataFrame:
    """(group, a, b, hits): in how many corpus rows two terms of a group both occur, a before b.

    ``terms`` (group, term) are few for each group; ``corpus`` (doc, term) lists the terms each row holds.

    A pair is counted once, however many groups ask for it.  Documents are hashed into blocks; a pair goes only to the
    blocks that hold its rarer term, where rows of bits over the block's documents are compared.  No pair meets a document by itself.
    """
    spark = terms.sparkSession
    ship(spark)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = keep(terms.select(group, "term").distinct())
    every = mine.toDF(group, "a").join(mine.toDF(group, "b"), group).where("a < b")
    rows = keep(corpus.where(F.col("term").isNotNull() & F.col(doc).isNotNull()).select(F.pmod(F.xxhash64(doc), F.lit(blocks)).alias("block"), F.col(doc).cast("string").alias("doc"), "term"))
    held = rows.select("block", "term").distinct()
    spread = held.groupBy("term").agg(F.count("*").alias("n"))
    asked = every.select("a", "b").distinct().join(spread.toDF("a", "na"), "a").join(spread.toDF("b", "nb"), "b")
    rarer = asked.select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("term"))
    sent = rarer.join(held, "term").select(F.col("block").alias("at"), "a", "b")
    counted = rows.groupBy("block").cogroup(sent.groupBy("at")).applyInArrow(_counted_pairs, "a string, b string, hits bigint")
    seen = counted.groupBy("a", "b").agg(F.sum("hits").alias("hits"))
    return every.join(seen, ["a", "b"], "left").select(group, "a", "b", F.coalesce("hits", F.lit(0)).alias("hits"))


def pair_quality(hits: Column) -> Column:
    # How specific a number of common hits is.
    return F.when(hits <= 0, 0.0).when(hits <= 3, 1.0).when(hits <= 10, 0.8).when(hits <= 30, 0.5).when(hits <= 100, 0.25).otherwise(0.1)


def anchor_scores(terms: DataFrame, pairs: DataFrame, group: str, weights: tuple[float, float, float] = (0.10, 0.60, 0.30), min_hit: int = 1, best_of: DataFrame | None = None) -> DataFrame:
    """(group, term, score, support, hits, quality, anchor) from terms (group, term, score) and their pair hits.

    ``best_of`` (group, term, ranked) says which terms are ranked by their hits; the others have only their own score, and
    pairs with them do not count.
    """
    if best_of is not None:
        ranked = best_of.where("ranked").select(group, F.col("term"))
        pairs = pairs.join(ranked.withColumnRenamed("term", "a"), [group, "a"], "left_semi").join(ranked.withColumnRenamed("term", "b"), [group, "b"], "left_semi")
    both = pairs.select(group, F.col("a").alias("term"), "hits").unionByName(pairs.select(group, F.col("b").alias("term"), "hits"))
    support = both.groupBy(group, "term").agg(F.count_if(F.col("hits") >= min_hit).alias("support"), F.sum("hits").alias("hits"), F.sum(pair_quality(F.col("hits"))).alias("quality"))
    full = terms.join(support, [group, "term"], "left").na.fill({"support": 0, "hits": 0, "quality": 0.0})
    all_ = Window.partitionBy(group)

    def share(name: str) -> Column:
        top = F.max(name).over(all_)
        return F.col(name) / F.when(top > 0, top).otherwise(1.0)

    anchor = weights[0] * share("score") + weights[1] * share("support") + weights[2] * share("quality")
    return full.select(group, "term", "score", "support", "hits", "quality", F.round(anchor, 4).alias("anchor"))


def connected_terms(pairs: DataFrame, group: str, min_hit: int = 1) -> DataFrame:
    """(group, term, max_hits, connected): for each term of pair hits its most common hits and the terms it is found with, best first."""
    both = pairs.select(group, F.col("a").alias("term"), F.col("b").alias("other"), "hits").unionByName(pairs.select(group, F.col("b").alias("term"), F.col("a").alias("other"), "hits"))
    ordered = F.struct((-pair_quality(F.col("hits"))).alias("q"), (-F.col("hits")).alias("h"), "other")
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("hits") >= min_hit, ordered))), lambda x: x["other"])
    return both.groupBy(group, "term").agg(F.max("hits").alias("max_hits"), listed.alias("connected"))


def rerank_pool(terms: DataFrame, min_han: int = 2, tags: tuple[str, ...] | None = None, top: int | None = None, group: str = "file_name") -> DataFrame:
    """Translated terms (group, term, score, han, and tag if ``tags`` are asked for) with ``eligible``; others stay as fallback."""
    fit = F.length(F.trim("han")) >= min_han
    if tags:
        fit = fit & F.arrays_overlap(F.split("tag", " "), F.array(*map(F.lit, tags)))
    pool = terms.where(F.trim("han") != "").withColumn("eligible", fit)
    if top is None:
        return pool
    place = F.row_number().over(Window.partitionBy(group, "eligible").orderBy(F.desc("score"), "term"))
    return pool.withColumn("eligible", F.col("eligible") & (place <= top))


def top_anchors(pool: DataFrame, pairs: DataFrame, group: str, top: int = 3) -> DataFrame:
    """(group, term, support, anchor, place): the best terms of each pool; ineligible ones, and all where fewer than two are
    eligible, are scored by their own score only."""
    several = pool.groupBy(group).agg(F.count_if("eligible").alias("n"))
    known = pool.join(several, group).withColumn("ranked", F.col("eligible") & (F.col("n") >= 2))
    scored = anchor_scores(known.select(group, "term", "score"), pairs, group, best_of=known.select(group, "term", "ranked"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("anchor"), F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select(group, "term", "support", "anchor", "place")


def select_terms(ranked: DataFrame, group: str, top: int, fill: bool = False) -> DataFrame:
    """(group, term, support, place): the first supported terms of a ranking (group, term, support, place); with ``fill`` others
    take the places left, and where none is supported the ranking itself is taken."""
    whole = Window.partitionBy(group)
    supported = F.col("support") > 0
    any_ = F.max(supported.cast("int")).over(whole) == 1
    wanted = ranked.withColumn("_take", ~any_ | supported | F.lit(fill)).where("_take")
    order = whole.orderBy(F.when(any_ & ~supported, 1).otherwise(0), "place")
    return wanted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).select(group, "term", "support", F.col("_n").alias("place"))


def exact_and_loose(terms: DataFrame, group: str, exact: int = 3, preferred: tuple[str, ...] = ("Np",)) -> DataFrame:
    """(group, term, is_exact, place): supported terms with a preferred tag first, then other supported ones, then the rest;
    the first ``exact`` are quoted.  Terms are (group, term, tag, support, place)."""
    tagged = F.arrays_overlap(F.split("tag", " "), F.array(*map(F.lit, preferred)))
    kind = F.when((F.col("support") > 0) & tagged, 0).when(F.col("support") > 0, 1).otherwise(2)
    at = F.row_number().over(Window.partitionBy(group).orderBy(kind, "place"))
    return terms.withColumn("_n", at).select(group, "term", (F.col("_n") <= exact).alias("is_exact"), F.col("_n").alias("place"))


def local_ranges(counts: DataFrame, key: str) -> DataFrame:
    """(key, part, first_chunk, last_chunk): the chunks of a document (key, chunks) in about as many even parts as the root of their number."""
    k = F.greatest(F.lit(1), F.ceil(F.sqrt("chunks"))).cast("bigint")
    parts = counts.select(key, "chunks", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("part"))
    lo, hi = F.floor(F.col("part") * F.col("chunks") / F.col("k")), F.floor((F.col("part") + 1) * F.col("chunks") / F.col("k")) - 1
    return parts.select(key, "part", lo.alias("first_chunk"), hi.alias("last_chunk")).where("first_chunk <= last_chunk")


def first_seen(terms: DataFrame, order: str) -> DataFrame:
    """(term, first): each different term by its normal form with where it is seen first."""
    return terms.groupBy(T.normal_phrase(F.col("term")).alias("term")).agg(F.min(order).alias("first")).where("term <> ''")


def translation_hits(terms: DataFrame, group: str) -> DataFrame:
    """(group, terms, hits): how many terms of a group (group, term, trans) have a translation."""
    return terms.groupBy(group).agg(F.count("*").alias("terms"), F.count_if(F.coalesce("trans", F.lit("")) != "").alias("hits"))


def rank_by_vector(candidates: DataFrame, documents: DataFrame, key: str, top: int) -> DataFrame:
    """(key, word, score, rank): candidates (key, word, vec) by their cosine to the document's vector (key, vec)."""
    met = candidates.join(documents.withColumnRenamed("vec", "_doc"), key)
    scored = met.select(key, "word", V.cosine(F.col("vec"), F.col("_doc")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def wanted_results(queries: DataFrame, usual: int, weak: int | None = None, source: str = "wikisource") -> DataFrame:
    """Queries with ``num_results``: another number for those without support from a co-occurrence source."""
    supported = F.coalesce(F.col("rerank_source").startswith(source), F.lit(False))
    return queries.withColumn("num_results", F.when(supported | F.lit(weak is None), usual).otherwise(F.lit(weak if weak is not None else usual)))


def variants(pool: DataFrame, key: str, windows: int, size: int) -> DataFrame:
    """(key, variant, place, word): circular windows over the ranked pool (key, rank, word)."""
    n = F.count("*").over(Window.partitionBy(key))
    numbered = pool.withColumn("n", n).withColumn("i", F.col("rank") - 1)
    spread = numbered.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(windows))))
    place = F.pmod(F.col("i") - F.pmod(F.col("variant") * size, F.col("n")), F.col("n"))
    return spread.withColumn("place", place).where(F.col("place") < size).select(key, "variant", "place", "word")


def translated(terms: DataFrame, table: DataFrame) -> DataFrame:
    """Terms with their translation and whether the table holds them; an empty translation is a hit."""
    known = table.groupBy("src_norm").agg(F.min("tgt").alias("tgt"))
    return terms.join(known, T.normal_phrase(F.col("term")) == F.col("src_norm"), "left").select(*terms.columns, F.coalesce("tgt", F.lit("")).alias("trans"), F.col("src_norm").isNotNull().alias("found"))


def compose(terms: DataFrame, key: str, exact: int = 3, sites: tuple[str, ...] = ()) -> DataFrame:
    """(key, query): the first terms quoted, the others loose, and the sites; terms are (key, place, han)."""
    shown = F.when(F.col("place") < exact, F.concat(F.lit('"'), "han", F.lit('"'))).otherwise(F.col("han"))
    parts = terms.where("han <> ''").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", shown.alias("t")))), lambda x: x["t"]), " ").alias("query"))
    if not sites:
        return parts
    tail = f"site:{sites[0]}" if len(sites) == 1 else "(" + " OR ".join(f"site:{s}" for s in sites) + ")"
    return parts.select(key, F.concat_ws(" ", "query", F.lit(tail)).alias("query"))
