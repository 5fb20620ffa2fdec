"""Exact and near duplicate removal of candidate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.iterate import first_independent
from ..session import cut_lineage, keep
from . import gram_sets

# Hosts whose copies are preferred; a parameter of every caller.
TRUSTED: tuple[str, ...] = ()


def quality_order(prefer_longer: bool = False, trusted: tuple[str, ...] = TRUSTED, tie: str = "global_id") -> list[Column]:
    """Best first: trusted host, traditional script, then share or length of Han text."""
    trust = F.lower("domain").isin(*trusted) if trusted else F.lit(False)
    rest = ["text_len", "han_chars", "han_ratio"] if prefer_longer else ["han_ratio", "han_chars", "text_len"]
    return [trust.desc(), F.desc("traditional_score"), *[F.desc(c) for c in rest], F.asc(tie)]


def quality_value(prefer_longer: bool = False, trusted: tuple[str, ...] = TRUSTED, tie: str = "global_id") -> Column:
    """The same order as a value whose least is best, so that a partial aggregate finds it; nulls are last."""
    trust = F.lower("domain").isin(*trusted) if trusted else F.lit(False)
    rest = ["text_len", "han_chars", "han_ratio"] if prefer_longer else ["han_ratio", "han_chars", "text_len"]
    falling = [F.coalesce(-F.col(c).cast("double"), F.lit(float("inf"))).alias(c) for c in ("traditional_score", *rest)]
    return F.struct((~F.coalesce(trust, F.lit(False))).alias("trust"), *falling, F.col(tie).alias("tie"))


def exact(rows: DataFrame, scope: tuple[str, ...] = ("content_hash",), key: str = "global_id", **order) -> DataFrame:
    """(key, kept): for each row the key of the best row with the same values of ``scope``; a row without a hash keeps itself.

    The best of a group is an aggregate, combined before the shuffle, and joined back; a popular page is never sorted in one task.
    """
    ranked = rows.select(key, *scope, quality_value(tie=key, **order).alias("quality")).dropDuplicates([key])
    best = ranked.groupBy(*scope).agg(F.min("quality").alias("best")).select(*scope, F.col("best.tie").alias("kept"))
    # Null scopes never join, and so stay apart.
    return ranked.join(best, list(scope), "left").select(key, F.coalesce("kept", key).alias("kept"))


def gram_table(rows: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """(key, gram, size): the set of n-grams of each text and its size."""
    grams = T.ngrams(text, n)
    return rows.select(key, grams.alias("grams")).select(key, F.size("grams").alias("size"), F.explode("grams").alias("gram"))


def gram_classes(rows: DataFrame, key: str, text: Column, n: int, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (key, cls) and classes (cls, scope, text, size): texts with equal sets of n-grams, within a scope if one is named, are one class.

    A class has one of its texts, which is smaller than its set; classes lie in partitions by ``cls``.
    """
    at = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    sets = keep(gram_sets.with_class(rows.select(key, at.alias("scope"), text.alias("text")), key, n))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.select(key, "cls"), sets.select("cls", "scope", "text", "size").repartition(parts, "cls").dropDuplicates(["cls"])


def similar_classes(classes: DataFrame, n: int, least: float, metric: str = "jaccard") -> DataFrame:
    """(a, b, common, size_a, size_b, score) of the pairs of different classes of one scope that reach ``least``.

    A prefix-filtered join with sketches gives few candidates besides the pairs themselves; only their texts meet, and are compared in full.
    """
    found = gram_sets.candidates(classes, n, least, metric)
    # Spread by class once for both joins.
    texts = classes.select("cls", "scope", "text", "size").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cls")
    both = found.join(texts.toDF("a", "sa", "text_a", "size_a"), "a").join(texts.toDF("b", "sb", "text_b", "size_b"), "b").withColumn("same", F.col("sa").eqNullSafe(F.col("sb")))
    counted = gram_sets.common_runs(both, n)
    return counted.withColumn("score", metrics(metric)).where(F.col("score") >= least - 1e-9)


def metrics(metric: str) -> Column:
    """One of the similarities of two sets from ``common``, ``size_a`` and ``size_b``."""
    common, a, b = F.col("common"), F.col("size_a"), F.col("size_b")
    return {"jaccard": common / (a + b - common), "containment": common / F.least(a, b), "b_in_a": common / b, "a_in_b": common / a}[metric]


def similar_pairs(rows: DataFrame, key: str, text: Column, n: int, least: float, metric: str = "jaccard", scope: str | None = None) -> DataFrame:
    """(a, b, common, size_a, size_b, score) of the pairs of keys that reach ``least``, from classes and membership."""
    members, classes = gram_classes(rows, key, text, n, scope)
    classes = keep(classes)
    own = classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.col("size").alias("common"), F.lit(1.0).alias("score"))
    every = similar_classes(classes, n, least, metric).select("a", "b", "size_a", "size_b", "common", "score").unionByName(own)
    pairs = every.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    swap = F.col("x") > F.col("y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"), "score")


#: Both directions of asymmetric containment may fall this far below the threshold together.
MUTUAL = 0.9


def asymmetric(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs where b, the worse of the two, lies in a to ``least``, or both lie in each other to MUTUAL of it."""
    shares = pairs.withColumns({"b_in_a": metrics("b_in_a"), "a_in_b": metrics("a_in_b")})
    return shares.where((F.col("b_in_a") >= least - 1e-9) | (F.least("b_in_a", "a_in_b") >= MUTUAL * least - 1e-9))


def near(rows: DataFrame, key: str, text: Column, n: int, least: float, order: list[Column], metric: str = "jaccard", scope: str | None = None) -> DataFrame:
    """(node, keeper, score) of greedy near-duplicate removal: keeper and score are null for what is kept.

    The choice is made among classes of equal n-gram sets, each ranked by its best text: the best text of a
    class is kept or dropped with it, all others are dropped for it or for what it is dropped for.  A page
    that is copied any number of times is one node.  ``metric`` is jaccard, containment or asymmetric;
    within a ``scope`` column only rows of equal value are compared.  Texts without n-grams are kept.
    """
    rows = rows.dropDuplicates([key])
    members, classes = gram_classes(rows, key, text, n, scope)
    classes = keep(classes)
    asym = metric == "asymmetric"
    pairs = cut_lineage(similar_classes(classes, n, MUTUAL * least if asym else least, "containment" if asym else metric))
    # Ranks of the texts that are in question; the order of the others does not matter.
    copied = members.groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1").select("cls")
    linked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(copied).distinct()
    involved = rows.join(members.join(linked, "cls"), key)
    placed = involved.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(key), "cls", F.monotonically_increasing_id().alias("rank"))
    rank = cut_lineage(placed)
    best = cut_lineage(rank.groupBy("cls").agg(F.min(F.struct("rank", F.col(key).alias("best"))).alias("m")).select(F.col("cls").alias("node"), F.col("m.rank").alias("rank"), F.col("m.best").alias("best")))
    ranked = pairs.join(best.select(F.col("node").alias("a"), F.col("rank").alias("ra")), "a").join(best.select(F.col("node").alias("b"), F.col("rank").alias("rb")), "b")
    first = F.col("ra") < F.col("rb")
    turned = ranked.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"), "common",
        F.when(first, F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(first, F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"), "score",
    )
    if asym:
        turned = asymmetric(turned, least).withColumn("score", F.when(F.col("b_in_a") >= least - 1e-9, F.col("b_in_a")).otherwise(F.least("b_in_a", "a_in_b")))
    links = cut_lineage(turned.select("better", "worse", "score"))
    chosen = first_independent(best.select("node", "rank"), links.select("better", "worse"))
    scored = chosen.join(links.toDF("keeper", "node", "score"), ["keeper", "node"], "left").select(F.col("node").alias("cls"), F.col("keeper").alias("by"), "score")
    names = best.select(F.col("node").alias("by"), F.col("best").alias("keeper"))
    done = rank.join(scored, "cls").join(names, "by", "left").join(best.select(F.col("node").alias("cls"), "best"), "cls")
    own = F.col(key) == F.col("best")
    decided = done.select(F.col(key).alias("node"), F.when(own | F.col("keeper").isNotNull(), F.col("keeper")).otherwise(F.col("best")).alias("keeper"), F.when(own | F.col("keeper").isNotNull(), F.col("score")).otherwise(1.0).alias("score"))
    nothing = F.lit(None).cast(dict(rows.dtypes)[key])
    alone = rows.select(F.col(key).alias("node")).join(decided.select("node"), "node", "left_anti").select("node", nothing.alias("keeper"), F.lit(None).cast("double").alias("score"))
    return decided.unionByName(alone)
