"""Exact top-k by integer inner product with a three-phase uniform threshold.

The score of a vector is the sum over PARTS groups of its components, and each group is one list of local scores.
1. Every list gives its k highest entries for each query, and its least score. A row's known parts, with least scores for
   the unknown ones, bound its score from below; the k-th highest bound is a safe cutoff. Rows are told apart by block and
   place, not by vec_id, so that rows with one id do not lend each other their parts.
2. With scores counted from the least ones, a vector at or above the cutoff has at least an equal share of it in some list:
   the cutoff is sent to all, and these entries are collected.
3. The parts of the collected entries that are not known yet are looked up, and the exact sums compete for the top k.
Rows are packed in blocks and stay where they are. The stated queries go to them in chunks of at most CHUNK bytes, one pass over
the blocks each; a task keeps k rows a query, so what is shuffled is k rows for each query and task.

Components become floor(256 * x), and beyond the range of long its limits, as do scores. Null vectors, and such that hold null, NaN or infinite components, take no part, nor do
rows without vec_id. Missing components of shorter vectors count as 0. A repeated query row counts once (the least vector);
rows with the query's own vec_id are no candidates; other repeated rows each count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import handed_on, scratch, written
from scriptorium.llm.vectors import BLOCK, Best, chunks, highest, packed, products, read, table_of, usable, within_long

PARTS = 2


def _group(m: np.ndarray, g: int, dim: int) -> np.ndarray:
    """The components of group g of vectors with dim components; those that are missing count as 0."""
    a, b = dim * g // PARTS, dim * (g + 1) // PARTS
    own = m[:, a:b]
    return np.pad(own, ((0, 0), (0, b - a - own.shape[1])))


def _local_lists(batches: Iterator[pa.RecordBatch], queries: list, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: the k highest entries of each list for each query, and its least score."""
    best, lows = [Best(k) for _ in range(PARTS)], [{} for _ in range(PARTS)]
    for block, x_ids, x in read(batches):
        for q_ids, q, _ in queries:
            for g in range(PARTS):
                scores = products(_group(q, g, dim), _group(x, g, dim))
                for i, query in enumerate(q_ids.tolist()):
                    lows[g][query] = min(lows[g].get(query, np.inf), float(scores[i].min()))
                    near = highest(scores[i], k + np.count_nonzero(x_ids == query), x_ids)
                    near = near[x_ids[near] != query][:k]
                    best[g].add(query, scores[i, near], x_ids[near], block * BLOCK + near)
    for g in range(PARTS):
        for query, (scores, _, rows) in best[g].held.items():
            low = lows[g][query]
            yield table_of([(query, g, int(r), float(s), low) for s, r in zip(scores, rows, strict=True)] or [(query, g, None, None, low)], [("query_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("score", pa.float64()), ("low", pa.float64())])


def _resolved(batches: Iterator[pa.RecordBatch], queries: list, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: from each list the entries with their share of the cutoff; then their scores in the other lists."""
    best = Best(k)
    for block, x_ids, x in read(batches):
        for q_ids, q, cuts in queries:
            local = [products(_group(q, g, dim), _group(x, g, dim)) for g in range(PARTS)]
            collected = np.logical_or.reduce([s.astype(float, copy=False) - cuts[:, 1 + g, None] >= cuts[:, :1] / PARTS for g, s in enumerate(local)])
            exact = all(s.dtype != object for s in local)  # sums of two exact doubles below 2 ** 52 are exact
            for i in np.flatnonzero(collected.any(axis=1)):
                query = int(q_ids[i])
                at = np.flatnonzero(collected[i] & (x_ids != query))
                if not len(at):
                    continue
                total = sum(s[i, at] for s in local) if exact else np.array([sum(int(s[i, j]) for s in local) for j in at], object)
                best.add(query, total, x_ids[at], block * BLOCK + at)
    for query, (scores, ids, _) in best.held.items():
        yield table_of([(query, int(v), s) for s, v in zip(within_long(scores), ids, strict=True)], [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pass(blocks: DataFrame, queries: DataFrame, work, schema: str, k: int, dim: int, *cuts: str) -> DataFrame | None:
    """work over all blocks for each chunk of queries, as a table."""
    out = None
    for chunk in chunks(queries, *cuts):
        sent = blocks.sparkSession.sparkContext.broadcast(chunk)
        made = written(blocks.mapInArrow(lambda b, sent=sent: work(b, sent.value, k, dim), schema), "found")
        sent.unpersist()
        out = made if out is None else out.union(made)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest rows, ties to the smaller vec_id."""
    rows = usable(vectors)
    spread = max(2, vectors.sparkSession.sparkContext.defaultParallelism)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = "query_id long, vec_id long, score long"
    with scratch():
        blocks = written(packed(rows.repartition(spread), BLOCK), "blocks")
        dim = blocks.agg(F.max("dim")).first()[0] or 1
        queries = written(usable(vectors.where(is_query)).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
        lists = _pass(blocks, queries, _local_lists, "query_id long, part int, row long, score double, low double", k, dim)
        if lists is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        lows = lists.groupBy("query_id", "part").agg(F.min("low").alias("least"))
        over = lists.where("row IS NOT NULL").join(lows, ["query_id", "part"]).groupBy("query_id", "row").agg(F.sum(F.col("score") - F.col("least")).alias("bound"))
        nth = over.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "row"))).where(F.col("n") == k).select("query_id", F.col("bound").alias("cut"))
        each = lows.groupBy("query_id").agg(*(F.min(F.when(F.col("part") == g, F.col("least"))).alias(f"low{g}") for g in range(PARTS)))
        cuts = each.join(nth, "query_id", "left").withColumn("cut", F.coalesce(F.col("cut") - F.abs("cut") * 1e-9, F.lit(float("-inf"))))
        armed = written(queries.join(cuts.withColumnRenamed("query_id", "vec_id"), "vec_id"), "armed")
        best = _pass(blocks, armed, _resolved, found, k, dim, "cut", *(f"low{g}" for g in range(PARTS)))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return handed_on(best.select("query_id", "rank", "vec_id", "score"), "top")
