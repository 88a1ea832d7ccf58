"""Deterministic marks: totals, caps, moderation, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total_marks(parts: DataFrame, key: str = "submission_id", most: float = 100.0) -> DataFrame:
    """A1: rounded sum of parts, held between 0 and the maximum; null as soon as one part has no mark.

    parts: key, score, and maybe percent and max_mark. A part without a score has its percentage of its own maximum, which a
    single part takes from the whole. Maxima that do not sum to the whole are not rescaled."""
    own = F.col("max_mark") if "max_mark" in parts.columns else F.lit(None).cast("double")
    percent = F.col("percent") if "percent" in parts.columns else F.lit(None).cast("double")
    by = parts.groupBy(key).agg(
        F.count("*").alias("n_parts"), F.sum("score").alias("scored"), F.sum(F.when(F.col("score").isNull(), percent * own / 100)).alias("from_percent"),
        F.count_if(F.col("score").isNull() & (percent * own).isNull()).alias("open"), F.max(F.when(F.col("score").isNull() & own.isNull(), percent)).alias("alone"),
    )
    single = (F.col("n_parts") == 1) & F.col("alone").isNotNull()
    total = F.when(single, F.col("alone") * most / 100).when(F.col("open") == 0, F.coalesce("scored", F.lit(0.0)) + F.coalesce("from_percent", F.lit(0.0)))
    return by.select(key, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.round(total, 2))).alias("held"), total.isNotNull().alias("known"), "n_parts").select(key, F.when(F.col("known"), F.col("held")).alias("total_mark"), "n_parts")


def with_missing(submissions: DataFrame, parts: DataFrame, key: str = "submission_id") -> DataFrame:
    """A submission without parts has one missing part: score 0, band Missing, confidence 95."""
    out = submissions.join(parts, key, "left")
    gone = F.col("part_idx").isNull()
    return out.select(key, F.coalesce("part_idx", F.lit(1)).alias("part_idx"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(gone, "Missing").otherwise("Scored").alias("state"), F.when(gone, F.lit(95)).otherwise(F.lit(75)).alias("confidence"))


def capped(score: Column, verdict: Column, advice: Column, ceiling: Column) -> Column:
    """A verifier lowers a score only where it says too generous, advises to lower it, and names less."""
    return F.when((verdict == "too_generous") & (advice == "lower_score") & (ceiling < score), F.least(score, ceiling)).otherwise(score)


def moderation_gate(parts: DataFrame, *group: str) -> DataFrame:
    """Whether a dependency group may be moderated, and why not."""
    out = parts.groupBy(*group).agg(F.count("*").alias("size"), F.max(F.col("score").isNull().cast("int")).alias("unscored"), (F.max("percent") - F.min("percent")).alias("spread"), (F.max("ordinal") - F.min("ordinal")).alias("gap"))
    reason = F.when(F.col("size") < 2, "single_part").when(F.col("unscored") == 1, "missing_score").when(F.col("spread") > 15, "spread").when(F.col("gap") > 1, "band_gap").otherwise("eligible")
    return out.withColumn("reason", reason).withColumn("should_moderate", F.col("reason") == "eligible").drop("unscored")


def moderated(parts: DataFrame, adjusted: DataFrame, *key: str) -> DataFrame:
    """Adjusted scores over the old ones; an adjustment outside 0 to the maximum is an error and changes nothing."""
    bad = (F.col("adjusted") < 0) | (F.col("adjusted") > F.col("most"))
    out = parts.join(adjusted, list(key), "left")
    new = F.when(F.col("adjusted").isNull() | bad, F.col("score")).otherwise(F.col("adjusted"))
    return out.select(*key, "score", new.alias("new_score"), F.round(new - F.col("score"), 2).alias("delta"), F.when(bad, "out_of_range").when(F.col("adjusted").isNull(), "no_change").otherwise("ok").alias("status"))


def calibrated(results: DataFrame, marks: DataFrame, key: str, group: str, most: float = 100.0) -> DataFrame:
    """A group takes its calibration only if every member has a valid one; unknown keys are ignored."""
    out = results.join(marks, key, "left")
    valid = F.col("calibrated").isNotNull() & F.col("calibrated").between(0, most)
    whole = F.min(valid.cast("int")).over(W.partitionBy(group)) == 1
    new = F.when(whole, F.col("calibrated")).otherwise(F.col("mark"))
    return out.select(key, group, "mark", new.alias("final_mark"), F.round(new - F.col("mark"), 2).alias("calibration_delta"), F.when(whole, "ok").otherwise("calibration_failed").alias("status"))
