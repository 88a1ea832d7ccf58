"""Hard negatives for stated anchors: rows of another label whose score lies in a window below a positive's.

An anchor's positives are its best other rows of its own label; each positive sets a window, low to high percent of its score, and
the best rows of other labels in that window are its negatives. Scores are integer inner products.
Candidates are sorted by norm, longest first, in ranges, and packed in blocks that know their greatest norm. Anchors go to the
blocks in chunks of at most CHUNK bytes. By Cauchy-Schwarz no row of a block scores above the product of the anchor's norm and
the block's: a block is left out for an anchor where that bound is below the lower limits of all its windows, or below the k-th
score that a task holds so far. A task keeps k rows for each window, so what is shuffled is that much.

Components become floor(256 * x), and beyond the range of long its limits, as do scores. Rows with a null id or label, a null
vector, or a null, NaN or infinite component take no part. Missing components of shorter vectors count as 0. A repeated anchor
counts once (the least label, then vector); rows with its own id are neither positives nor negatives; other repeated rows each
count. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import handed_on, scratch, written
from scriptorium.llm.vectors import BLOCK, Best, chunks, highest, packed, products, table_of, unpack, usable, within_long

#: Cauchy-Schwarz is taken with rounded norms: a bound counts as this much larger.
_SLACK = 1 + 1e-9
_FOUND = "anchor_id long, nth int, vec_id long, score long"
_FIELDS = [("anchor_id", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]


def _blocks_of(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """ids, vectors, labels and greatest norm of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, x = unpack(row["ids"], row["data"], row["dim"])
            yield ids, _padded(x, dim), np.frombuffer(row["cuts"]).reshape(len(ids), -1)[:, 0], float(np.sqrt((x * x).sum(axis=1)).max())


def _padded(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m


def _kth(best: Best, key, k: int) -> float:
    """The score that a row must reach to count for a key whose k places are taken."""
    held = best.held.get(key)
    return float(held[0][-1]) if held is not None and len(held[0]) >= k else -np.inf


def _positives(batches: Iterator[pa.RecordBatch], anchors: list, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    best, lengths = Best(k), [np.sqrt((a * a).sum(axis=1)) for _, a, _ in anchors]
    for ids, x, labels, norm in _blocks_of(batches, dim):
        for (a_ids, a, extra), length in zip(anchors, lengths, strict=True):
            bound = length * norm * _SLACK
            open_ = np.flatnonzero([b >= _kth(best, i, k) for i, b in zip(a_ids.tolist(), bound, strict=True)])
            scores = products(_padded(a[open_], dim), x)
            for row, i in zip(scores, open_, strict=True):
                anchor = int(a_ids[i])
                at = np.flatnonzero((labels == extra[i, 0]) & (ids != anchor))
                at = at[highest(row[at], k, ids[at])]
                best.add(anchor, row[at], ids[at], at)
    for anchor, (scores, ids, _) in best.held.items():
        yield table_of([(anchor, 0, int(i), s) for i, s in zip(ids, within_long(scores), strict=True)], _FIELDS)


def _negatives(batches: Iterator[pa.RecordBatch], anchors: list, dim: int, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    best, lengths = Best(k), [np.sqrt((a * a).sum(axis=1)) for _, a, _ in anchors]
    each = [[_windows(a_id, row, low, high) for a_id, row in zip(a_ids.tolist(), extra, strict=True)] for a_ids, _, extra in anchors]
    for ids, x, labels, norm in _blocks_of(batches, dim):
        for (a_ids, a, extra), length, windows in zip(anchors, lengths, each, strict=True):
            bound = length * norm * _SLACK
            open_ = [[w for w in mine if b >= max(w[1], _kth(best, w[0], k))] for mine, b in zip(windows, bound, strict=True)]
            at = [i for i, w in enumerate(open_) if w]
            for row, i in zip(products(_padded(a[at], dim), x), at, strict=True):
                other = (labels != extra[i, 0]) & (ids != a_ids[i])
                for key, least, most in open_[i]:
                    in_ = np.flatnonzero(other & (row >= least) & (row <= most))
                    in_ = in_[highest(row[in_], k, ids[in_])]
                    best.add(key, row[in_], ids[in_], in_)
    for (anchor, nth), (scores, ids, _) in best.held.items():
        yield table_of([(anchor, nth, int(i), s) for i, s in zip(ids, within_long(scores), strict=True)], _FIELDS)


def _windows(anchor: int, extra: np.ndarray, low: int, high: int) -> list[tuple[tuple[int, int], int, int]]:
    """((anchor, nth), least, most) of the windows that hold any number. Positive scores come as two halves, exact as doubles."""
    found = []
    for nth, (above, below) in enumerate(extra[1:].reshape(-1, 2), 1):
        if not np.isnan(above):
            score = int(above) * (1 << 32) + int(below)
            least, most = -(-low * score // 100), high * score // 100
            if least <= most:
                found.append(((anchor, nth), least, most))
    return found


def _pass(blocks: DataFrame, anchors: DataFrame, work, *args, cuts: tuple[str, ...]) -> DataFrame | None:
    """work over all blocks for each chunk of anchors, as a table."""
    out = None
    for chunk in chunks(anchors, *cuts):
        sent = blocks.sparkSession.sparkContext.broadcast(chunk)
        made = written(blocks.mapInArrow(lambda b, sent=sent: work(b, sent.value, *args), _FOUND), "found")
        sent.unpersist()
        out = made if out is None else out.union(made)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "nth").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, low: int = 30, high: int = 90, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, embedding, label; is_anchor may
    read vec_id and label."""
    spark = vectors.sparkSession
    rows = usable(vectors.where(F.col("label").isNotNull()), F.col("label").cast("double").alias("label"))
    with scratch():
        rows = written(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "rows")
        spread = max(2, spark.sparkContext.defaultParallelism, rows.count() // (4 * BLOCK))
        sorted_ = rows.repartitionByRange(spread, F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
        blocks = written(packed(sorted_, BLOCK, "label"), "blocks")
        dim = blocks.agg(F.max("dim")).first()[0] or 1
        anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least")).select("vec_id", "least.v", "least.label")
        anchors = written(anchors, "anchors")
        found = _pass(blocks, anchors, _positives, dim, positives, cuts=("label",))
        if found is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        best = written(_best(found, positives).select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        score = F.col("positive_score")
        halves = [
            F.max(F.when(F.col("nth") == n, half)).cast("double").alias(f"{name}{n}")
            for n in range(1, positives + 1)
            for name, half in (("above", F.shiftright(score, 32)), ("below", score.bitwiseAND(0xFFFFFFFF)))
        ]
        limits = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(*halves)
        armed = written(anchors.join(limits, "vec_id"), "armed")
        found = _pass(blocks, armed, _negatives, dim, negatives, low, high, cuts=("label", *limits.columns[1:]))
        if found is None:
            found = spark.createDataFrame([], _FOUND)
        mined = best.join(_best(found, negatives), ["anchor_id", "nth"])
        return handed_on(mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
