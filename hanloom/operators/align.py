"""Retrieval, reranking, hubness correction and matching of documents by their segments' vectors.

Segments are rows (doc, chunk, vec array<double>).  Exact neighbour search compares groups of segments
by matrix products on the executors; everything after it is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import locally_dominant
from ..session import keep, ship

#: Vectors of a group; with 768 dimensions it takes about 25 MB.  Rows of one product.
BLOCK, STRIP = 4_096, 1_024
#: Segments of one document compared at once.
SEGMENT_BLOCK = 1_024


def _blocks(segments: DataFrame, side: str, blocks: int) -> DataFrame:
    """Segments in ``blocks`` groups by hash: their documents, chunks and vectors as arrays."""
    at = F.pmod(F.xxhash64("doc", "chunk"), F.lit(blocks)).cast("int").alias(f"{side}_block")
    return segments.select(at, "doc", "chunk", "vec").groupBy(f"{side}_block").agg(*[F.collect_list(c).alias(f"{side}_{c}") for c in ("doc", "chunk", "vec")])


def knn(queries: DataFrame, targets: DataFrame, k: int = 5, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(src, src_chunk, dst, dst_chunk, sim, rank): the k best targets of every query by inner product.

    Exact search in blocks: both sides are hashed into groups of about BLOCK vectors on the executors, every
    pair of groups is one matrix product, and each gives at most its k best (with ties) before the shuffle.
    A group of queries is sent to the groups of targets, never a vector to the driver.  ``sizes`` are the numbers
    of both sides' vectors, counted if they are not given.
    """
    ship(queries.sparkSession)
    n, m = sizes or (queries.count(), targets.count())
    a, b = _blocks(queries, "q", max(1, -(-n // BLOCK))), _blocks(targets, "t", max(1, -(-m // BLOCK)))
    every = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-m // BLOCK)) - 1))).alias("t_block")
    met = a.select("*", every).join(b, "t_block").select("q_doc", "q_chunk", "q_vec", "t_doc", "t_chunk", "t_vec")
    kinds, own = dict(targets.dtypes), dict(queries.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(cell) -> np.ndarray:
            rows = cell.values
            return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                qd, qc, qv, td, tc, tv = (column[i] for column in batch.columns)
                left, right = matrix(qv), matrix(tv)
                width = min(k, len(right))
                # In strips of queries, so that no product is larger than STRIP rows.
                for lo in range(0, len(left), STRIP):
                    sims = left[lo : lo + STRIP] @ right.T
                    edge = -np.partition(-sims, width - 1, axis=1)[:, width - 1 : width]
                    q, t = np.nonzero(sims >= edge)
                    at, other = pa.array(q + lo), pa.array(t)
                    yield pa.RecordBatch.from_arrays([qd.values.take(at), qc.values.take(at), td.values.take(other), tc.values.take(other), pa.array(sims[q, t])], ["src", "src_chunk", "dst", "dst_chunk", "sim"])

    found = met.mapInArrow(compare, f"src {own['doc']}, src_chunk {own['chunk']}, dst {kinds['doc']}, dst_chunk {kinds['chunk']}, sim double")
    order = Window.partitionBy("src", "src_chunk").orderBy(F.desc("sim"), "dst", "dst_chunk")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, k_docs: int = 10) -> DataFrame:
    """(src, dst, votes, rank): targets by the number of neighbours they hold, the first seen first."""
    first = F.min(F.struct("src_chunk", "rank"))
    counted = neighbours.groupBy("src", "dst").agg(F.count("*").alias("votes"), first.alias("first"))
    order = Window.partitionBy("src").orderBy(F.desc("votes"), "first", "dst")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_docs).select("src", "dst", "votes", "rank")


def _packed(segments: DataFrame, name: str) -> DataFrame:
    """Segments gathered in blocks of about ``SEGMENT_BLOCK`` rows; a long document has several blocks."""
    sizes = segments.groupBy("doc").agg(F.count("*").alias("n"))
    blocks = F.pmod(F.xxhash64("chunk"), F.ceil(F.col("n") / SEGMENT_BLOCK))
    placed = segments.join(sizes, "doc").withColumn("block", blocks)
    return placed.groupBy(F.col("doc").alias(name), "block").agg(F.collect_list("chunk").alias(f"{name}_chunks"), F.collect_list("vec").alias(f"{name}_vecs")).drop("block")


def _coverage(best: DataFrame, side: int, name: str, trim: float) -> DataFrame:
    """The mean of the best shares of one side's maximal similarities."""
    whole = best.where(F.col("side") == side).groupBy("src", "dst", "chunk").agg(F.max("best").alias("best"))
    pair = Window.partitionBy("src", "dst")
    ranked = whole.withColumns({"rn": F.row_number().over(pair.orderBy(F.desc("best"), "chunk")), "n": F.count("*").over(pair)})
    return ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * trim + 1e-9))).groupBy("src", "dst").agg(F.avg("best").alias(name))


def bimax(pairs: DataFrame, sources: DataFrame, targets: DataFrame, mode: str = "avg", trim: float = 0.7) -> DataFrame:
    """(src, dst, score): both directions' trimmed coverage, combined by avg, max or min.

    Blocks of segments are compared by matrix products, which leave one maximum for each segment;
    the rest is aggregation.
    """
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes) | {"chunk": dict(sources.dtypes)["chunk"]}
    both = pairs.select("src", "dst").distinct().join(_packed(sources, "src"), "src").join(_packed(targets, "dst"), "dst")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(cell) -> np.ndarray:
            rows = cell.values
            return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        for batch in batches:
            src, dst, ca, va, cb, vb = batch.columns
            for i in range(batch.num_rows):
                sims = matrix(va[i]) @ matrix(vb[i]).T
                for side, chunks, best in ((0, ca[i].values, sims.max(axis=1)), (1, cb[i].values, sims.max(axis=0))):
                    n = len(best)
                    yield pa.RecordBatch.from_arrays([pa.array([src[i].as_py()] * n, src.type), pa.array([dst[i].as_py()] * n, dst.type), pa.array([side] * n, pa.int32()), chunks, pa.array(best, pa.float64())], ["src", "dst", "side", "chunk", "best"])

    wide = both.select("src", "dst", "src_chunks", "src_vecs", "dst_chunks", "dst_vecs")
    best = wide.mapInArrow(compare, f"src {kinds['src']}, dst {kinds['dst']}, side int, chunk {kinds['chunk']}, best double")
    best = keep(best)
    joined = _coverage(best, 0, "f", trim).join(_coverage(best, 1, "g", trim), ["src", "dst"])
    f, g = F.col("f"), F.col("g")
    return joined.select("src", "dst", {"avg": (f + g) / 2, "max": F.greatest(f, g), "min": F.least(f, g)}[mode].alias("score"))


def margins(sources: DataFrame, targets: DataFrame, k_chunks: int = 5, k_docs: int = 10, mode: str = "avg", trim: float = 0.7, k: int = 10, k_out: int = 10) -> DataFrame:
    """csls over both directions; each candidate pair is compared once, whichever direction proposed it."""
    n, m = sources.count(), targets.count()
    forth = keep(vote(knn(sources, targets, k_chunks, (n, m)), k_docs).select("src", "dst"))
    back = keep(vote(knn(targets, sources, k_chunks, (m, n)), k_docs).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    scored = keep(bimax(forth.unionByName(back), sources, targets, mode, trim))
    return csls(scored.join(forth, ["src", "dst"], "left_semi"), scored.join(back, ["src", "dst"], "left_semi"), k, k_out)


def csls(forward: DataFrame, backward: DataFrame, k: int = 10, k_out: int = 10) -> DataFrame:
    """(src, dst, margin, rank): 2·s − r(src) − r(dst); the forward score wins where both directions have one."""

    def hubness(edges: DataFrame, node: str, other: str) -> DataFrame:
        order = Window.partitionBy(node).orderBy(F.desc("score"), other)
        return edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).groupBy(node).agg(F.avg("score").alias(f"r_{node}"))

    both = forward.select("src", "dst", "score", F.lit(0).alias("way")).unionByName(backward.select("src", "dst", "score", F.lit(1).alias("way")))
    one = both.withColumn("rn", F.row_number().over(Window.partitionBy("src", "dst").orderBy("way"))).where("rn = 1")
    joined = one.join(hubness(forward, "src", "dst"), "src", "left").join(hubness(backward, "dst", "src"), "dst", "left")
    margin = 2 * F.col("score") - F.coalesce("r_src", F.lit(0.0)) - F.coalesce("r_dst", F.lit(0.0))
    scored = joined.select("src", "dst", margin.alias("margin"))
    order = Window.partitionBy("src").orderBy(F.desc("margin"), "dst")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_out)


def edges_above(ranked: DataFrame, threshold: float = 0.08) -> DataFrame:
    return ranked.where(F.col("margin") >= threshold)


def one_to_one(edges: DataFrame) -> DataFrame:
    """Greedy matching, best margin first, each document once."""
    return locally_dominant(edges, "src", "dst", "margin")


def evaluate(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over distinct pairs (src, dst)."""
    p, g = found.select("src", "dst").distinct().withColumn("p", F.lit(1)), gold.select("src", "dst").distinct().withColumn("g", F.lit(1))
    counts = p.join(g, ["src", "dst"], "full").agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g is null")).alias("fp"), F.count_if(F.expr("p is null and g = 1")).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    rated = counts.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rated.withColumn("f1", f1)
