"""Exact medians of groups of any size: no group, nor its distinct values, comes to one task.

Rows are counted by (group, value) where they lie. The counts are dealt out in ranges of (group, value), whose sums tell in which one
or two ranges a group's middle ranks are; in these alone the values are ranked. A window never sees more than one range of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators.scorers import kept


def medians(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """by, with the median of each value under its name: the mean of the two middle ones of an even number. Nulls and NaN do not count;
    what has no value is null. Null groups are groups."""
    spark = rows.sparkSession
    group = [f"_g{i}" for i in range(len(by))]
    own = F.array(*(F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")) for name, value in values.items()))
    each = rows.select(*(F.col(c).alias(g) for c, g in zip(by, group, strict=True)), F.explode(own).alias("x")).select(*group, "x.*")
    names = each.groupBy(*group).agg(F.lit(1).alias("_one"))
    keys = [*group, "name"]
    counts = each.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    dealt = kept(counts.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys, "value").withColumn("part", F.spark_partition_id()))
    # how many values of a group come before each of its ranges: a row for each range and group
    sums = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("held"))
    whole = W.partitionBy(*keys)  # a row for each range that a group lies in
    sums = sums.withColumn("before", F.sum("held").over(whole.orderBy("part")) - F.col("held")).withColumn("all", F.sum("held").over(whole))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    near = sums.where((F.col("before") <= high) & (F.col("before") + F.col("held") > low)).select(*(F.col(c).alias(f"near_{c}") for c in (*keys, "part")), "before", low.alias("low"), high.alias("high"))
    ranked = dealt.join(near, [F.col(c).eqNullSafe(F.col(f"near_{c}")) for c in (*keys, "part")])
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*keys, "part").orderBy("value")))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("value")))
    found = ranked.groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"))
    wide = found.groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.col("median"))).alias(name) for name in values))
    wide = wide.select(*(F.col(g).alias(f"near{g}") for g in group), *values)
    out = names.join(wide, [F.col(g).eqNullSafe(F.col(f"near{g}")) for g in group], "left") if group else names.crossJoin(wide)
    return out.select(*(F.col(g).alias(c) for c, g in zip(by, group, strict=True)), *values)
