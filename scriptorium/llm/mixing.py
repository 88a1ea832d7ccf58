"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule: its density over training time t from 0 to 1, linear between knots. The integral of the schedule,
scaled to the source's target, is the cumulative demand for its words. Documents of a source stand in a fixed pseudo-random
order, once for each pass; the words before a copy are its place in the demand, and the inverse of the demand at that place is
the time at which the copy is trained on. The mix is the copies whose time is at most 1, range-sorted by it.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words, no source more than
`passes` times its own words; what is over goes to the others by weight until none is above. With a level x the target is
min(passes * size, x * weight); sources full at the lowest level come first, so the level is found in one sorted pass.

The last document that a target reaches is taken in part: its `taken` is what is left of the target. Documents without words
take no part: taken 0, no position. Null texts count as empty. Rows alike in doc_id, source and size stand in the order of a hash of their
texts. Extra columns are ignored. Words before a document: sums over 4,096 hash buckets of each source, then inside a bucket, so
that no source is in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD, text_or_empty, written

WEIGHTS = (3, 1, 2)
#: Densities at equally spaced times, for sources by their rank modulo the number of schedules: early, steady and late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
PASSES = 2


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size in words and the place in the source's order: the md5 of doc_id, by its first 3 digits in buckets.

    A bucket is named by these digits and its source, never null: the window and the join over buckets share one shuffle."""
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), mark.alias("mark"), F.xxhash64("text").alias("tie"), *more)
    return sized.withColumn("bucket", F.concat(F.substring("mark", 1, 3), F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))))


def targets(sums: DataFrame, percent: int = 150, weights: tuple = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source, rank, source_size and target of each source, from words by source. One row a source: windows over all of them
    are small."""
    by = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", _of(weights, F.col("rank") % len(weights)).cast("long"))
    fills = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    by = by.withColumn("goal", percent * F.sum("source_size").over(W.partitionBy()))  # in hundredths of a word
    # with the k sources that fill first at their limits: what is left for the others, and their weights
    done = fills.rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("left", F.col("goal") - 100 * passes * F.coalesce(F.sum("source_size").over(done), F.lit(0)))
    by = by.withColumn("heavy", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(done), F.lit(0)))
    # the first source that the level does not fill sets the level of all after it
    level = F.col("left") * F.col("weight") < 100 * passes * F.col("source_size") * F.col("heavy")
    at = F.min(F.when(level, F.struct((F.col("source_size") / F.col("weight")).alias("fill"), F.col("rank").alias("by"), F.col("left").alias("rest"), F.col("heavy").alias("of"))))
    by = by.withColumn("cut", at.over(W.partitionBy()))
    share = (F.col("weight") * F.col("cut.rest")).cast("double") / (100 * F.col("cut.of")).cast("double")
    limit = (passes * F.col("source_size")).cast("double")
    before = F.struct((F.col("source_size") / F.col("weight")).alias("fill"), F.col("rank").alias("by")) < F.struct(F.col("cut.fill").alias("fill"), F.col("cut.by").alias("by"))
    return by.select("source", "rank", "source_size", F.when(F.col("cut").isNull() | before, limit).otherwise(share).alias("target"))


def _of(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def training_time(share: Column, schedule: Column, knots: int) -> Column:
    """The time at which a source's cumulative demand reaches a share (0 to 1) of its whole.

    schedule: densities at `knots` equally spaced times. Between two of them the demand is a parabola, which is inverted."""
    step = 1.0 / (knots - 1)
    parts = F.transform(F.sequence(F.lit(1), F.lit(knots - 1)), lambda i: (F.element_at(schedule, i) + F.element_at(schedule, i + 1)) * step / 2)
    sums = F.transform(F.sequence(F.lit(0), F.lit(knots - 1)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    want = share * F.element_at(sums, -1)
    j = F.least(F.greatest(F.size(F.filter(sums, lambda x: x <= want)), F.lit(1)), F.lit(knots - 1))
    a, b, rest = F.element_at(schedule, j), F.element_at(schedule, j + 1), want - F.element_at(sums, j)
    # a u + (b - a) u^2 / (2 step) = rest, in the form that stays exact where a = b
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) / step * rest, F.lit(0.0)))
    u = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (a + root))
    return (j - 1) * step + F.least(u, F.lit(step))


def _placed(rows: DataFrame, sums: DataFrame, percent: int, weights: tuple, passes: int, schedules: tuple) -> DataFrame:
    """rows (of sizes()) with source_size, target, taken and positions; sums: the words of each source and bucket."""
    goal = targets(sums, percent, weights, passes)
    before = sums.select("source", "bucket", (F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("before"))
    place = before.join(goal, before.source.eqNullSafe(goal.source)).select(F.col("bucket").alias("k"), "before", "rank", "source_size", "target")
    inside = W.partitionBy("bucket").orderBy("mark", F.col("doc_id").asc_nulls_first(), "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(place, rows.bucket == F.col("k")).withColumn("start", F.col("before") + F.col("prior"))
    whole = F.floor("target").cast("long")
    copies = [F.col("start") + p * F.col("source_size") for p in range(passes)]
    taken = sum((F.least(F.greatest(whole - at, F.lit(0)), F.col("size")) for at in copies), F.lit(0)).cast("long")
    schedule = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in schedules)), (F.col("rank") % len(schedules) + 1).cast("int"))
    times = [F.when((F.col("size") > 0) & (at < whole), training_time(at / F.col("target"), schedule, len(schedules[0]))) for at in copies]
    return rows.withColumns({"taken": taken, "positions": F.array_compact(F.array(*times))})


def _sums(sized: DataFrame) -> DataFrame:
    return written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")


def mixed(docs: DataFrame, percent: int = 150, weights: tuple = WEIGHTS, passes: int = PASSES, schedules: tuple = SCHEDULES) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, and positions, the time of each copy that is in."""
    sized = written(sizes(docs), "sizes")
    out = _placed(sized, _sums(sized), percent, weights, passes, schedules)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "positions")


def mix_report(docs: DataFrame) -> DataFrame:
    """mixed(), range-sorted by the first position; documents outside the mix last."""
    out = mixed(docs).withColumn("position", F.get("positions", F.lit(0)))
    # documents outside the mix all lack a position: the hash deals them out
    return out.orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id")).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("n_copies"))


def mix(docs: DataFrame, percent: int = 150, weights: tuple = WEIGHTS, passes: int = PASSES, schedules: tuple = SCHEDULES) -> DataFrame:
    """The mix itself: a row of docs for each copy that is in, range-sorted by training time. A document in which a target ends
    is in whole."""
    sums = _sums(sizes(docs))
    rows = sizes(docs, F.struct(*docs.columns).alias("row"))
    copies = _placed(rows, sums, percent, weights, passes, schedules).select("row", "tie", F.explode("positions").alias("position"))
    return copies.orderBy("position", F.xxhash64("row.doc_id"), "tie").select("row.*")
