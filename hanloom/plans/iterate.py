"""Greedy algorithms that are sequential by definition, as rounds of joins with cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def locally_dominant(edges: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The greedy matching of a weighted bipartite graph under (score desc, left, right).

    An edge that is best at both of its ends is what the greedy rule takes, so each round takes all
    of these and drops the edges at their ends, until none is left.
    """
    rest = cut_lineage(edges)
    taken: DataFrame | None = None
    while not rest.isEmpty():
        by_left = Window.partitionBy(left).orderBy(F.desc(score), left, right)
        by_right = Window.partitionBy(right).orderBy(F.desc(score), left, right)
        ranked = rest.withColumns({"_l": F.row_number().over(by_left), "_r": F.row_number().over(by_right)})
        best = cut_lineage(ranked.where("_l = 1 and _r = 1").drop("_l", "_r"))
        taken = best if taken is None else taken.unionByName(best)
        rest = cut_lineage(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"))
    return rest if taken is None else taken


def first_independent(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The greedy choice of nodes, best rank first, each dropping what it is linked to.

    nodes (node, rank); links (better, worse).  Returns (node, keeper): keeper is null for kept
    nodes and the best-ranked kept neighbour for the others.
    """
    rank = nodes.select("node", "rank")
    links = cut_lineage(links.distinct())
    state = cut_lineage(rank.withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        seen = links.join(state.select(F.col("node").alias("better"), F.col("kept").alias("above")), "better").groupBy(F.col("worse").alias("node")).agg(F.max("above").alias("any_kept"), F.count_if(F.col("above").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = cut_lineage(state.join(seen, "node", "left").select("node", "rank", new.alias("kept")))
        if state.where("kept is null").isEmpty():
            break
    keepers = state.where("kept").select(F.col("node").alias("better"), F.col("rank").alias("r"))
    keeper = links.join(keepers, "better").groupBy(F.col("worse").alias("node")).agg(F.min(F.struct("r", "better")).alias("k")).select("node", F.col("k.better").alias("keeper"))
    return state.join(keeper, "node", "left").select("node", F.when(F.col("kept"), F.lit(None)).otherwise(F.col("keeper")).alias("keeper"))
