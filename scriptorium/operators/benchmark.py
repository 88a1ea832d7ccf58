"""Comparisons with human marks, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.medians import medians


def zero_filled(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Every label of either side, the missing side 0, and the absolute difference."""
    out = left.join(right, list(key), "full_outer")
    a, b = F.coalesce("human", F.lit(0.0)), F.coalesce("model", F.lit(0.0))
    return out.select(*key, a.alias("human"), b.alias("model"), F.abs(a - b).alias("abs_delta"))


def by_and_overall(runs: DataFrame, by: Column, *aggregates: Column) -> DataFrame:
    """A10: the aggregates over all rows (by is null) and by a column, in one pass."""
    return runs.groupingSets([[], [by]], by).agg(*aggregates)


def amortised(runs: DataFrame, batches: tuple = (1, 5, 10, 25, 50)) -> DataFrame:
    """Means of a variant, and seconds a script with preparation shared by a batch."""
    by = runs.groupBy("variant").agg(F.count("*").alias("n"), F.avg("extraction").alias("extraction"), F.avg("latency").alias("latency"), F.avg("preparation").alias("preparation"))
    by = by.withColumn("batch", F.explode(F.array(*map(F.lit, batches))))
    return by.select("variant", "n", "batch", F.round(F.col("extraction") + F.col("latency") + F.col("preparation") / F.col("batch"), 4).alias("amortised"))


def top_values(rows: DataFrame, value: str, most: int, *by: str) -> DataFrame:
    """The most frequent values (of each group), ties by the value."""
    from pyspark.sql import Window as W

    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.col("n").desc(), value).limit(most)
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), value))
    return counts.withColumn("nth", nth).where(F.col("nth") <= most)


#: A6. Stages whose latencies a report names; columns latency_<stage> of results, where they are there.
STAGES = ("assessment_prepare", "structure_detect", "part_refine", "part_analysis", "moderation", "finalize")


def consistency(results: DataFrame, by: str, most: float) -> DataFrame:
    """One row a model of results (status, mark, n_parts, n_words, extraction_issue, calibration_delta, latency, ai_math_delta, and
    latency_<stage> of any of STAGES).

    Medians are exact, and no model's values come to one task for them. The distinct marks are as many as the scale has."""
    delta = F.abs("ai_math_delta")
    stages = [x for x in STAGES if f"latency_{x}" in results.columns]
    sums = results.groupBy(by).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if("extraction_issue").alias("n_extraction_issues"), F.count_if(F.coalesce("calibration_delta", F.lit(0.0)) != 0).alias("n_calibrated"),
        F.max("latency").alias("max_latency"), F.max(delta).alias("max_delta"), F.count_if(delta > 3).alias("n_large_delta"), F.count("mark").alias("n_marks"), F.round(F.avg("mark"), 2).alias("mean_mark"), F.min("mark").alias("min_mark"), F.max("mark").alias("max_mark"),
        F.array_join(F.transform(F.array_sort(F.collect_set("mark")), _reported), ", ").alias("distinct_marks"), F.count_if(F.col("mark") == most).alias("n_top_marks"), F.round(F.count_if(F.col("mark") == most) / F.nullif(F.count("mark"), F.lit(0)), 3).alias("top_mark_rate"),
        *(F.max(f"latency_{x}").alias(f"max_{x}") for x in stages),
    )
    middle = medians(results, [by], median_parts=F.col("n_parts"), median_words=F.col("n_words"), median_latency=F.col("latency"), median_delta=delta, median_mark=F.col("mark"), **{f"median_{x}": F.col(f"latency_{x}") for x in stages})
    return sums.join(middle.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def verifier_lists(verdicts: DataFrame, order: str, *by: str, most: int = 5) -> DataFrame:
    """The recommendations, issues and errors that come most often in a verifier's verdicts (recommendation, issues, error_code): by,
    kind, value, n, nth; ties by where they are first seen."""
    issue = F.transform("issues", lambda x: F.regexp_replace(x, r"\|", "/"))
    each = verdicts.select(*by, order, F.explode(F.concat(
        F.array(F.struct(F.lit("recommendation").alias("kind"), F.col("recommendation").alias("value")), F.struct(F.lit("error").alias("kind"), F.col("error_code").alias("value"))),
        F.transform(F.coalesce(issue, F.array().cast("array<string>")), lambda x: F.struct(F.lit("issue").alias("kind"), x.alias("value"))),
    )).alias("x")).select(*by, order, "x.*")
    return repeated(each, "value", order, most, *by, "kind")


def _reported(x: Column) -> Column:
    """Whole numbers without a point, others to two places."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).when(x.isNotNull(), F.format_string("%.2f", x))


def repeated(rows: DataFrame, value: str, order: str, most: int, *by: str, separator: str | None = None) -> DataFrame:
    """The values that come most often (split at a separator, if there is one), ties by where they are first seen."""
    from pyspark.sql import Window as W

    each = rows.select(*by, order, F.explode(F.split(value, separator)).alias("value")) if separator else rows.select(*by, order, F.col(value).alias("value"))
    counts = each.withColumn("value", F.trim("value")).where("value <> ''").groupBy(*by, "value").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), "first", "value"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= most).select(*by, "value", "n", "nth")


def disagreements(results: DataFrame, order: str, most: int = 10, least: float = 0.0) -> DataFrame:
    """The first rows whose AI total is not the sum of the parts."""
    return results.where(F.abs("ai_math_delta") > least).orderBy(order).limit(most)


def moderation_groups(parts: DataFrame, *group: str) -> DataFrame:
    """Sums of a group before and after moderation, their difference, and the labels that changed, in order."""
    by = parts.groupBy(*group).agg(F.sum("score").alias("before"), F.sum("new_score").alias("after"), F.array_sort(F.collect_list(F.when(F.col("score") != F.col("new_score"), F.struct("part_idx", "label")))).alias("changed"))
    return by.select(*group, "before", "after", F.round(F.col("after") - F.col("before"), 2).alias("delta"), F.array_join(F.transform("changed", lambda x: x["label"]), "|").alias("changed_labels"))


def detection(found: Column, wanted: Column) -> tuple[Column, Column]:
    """How many wanted labels were found, and whether all were, in order."""
    return F.size(F.array_intersect(found, wanted)), found == wanted
