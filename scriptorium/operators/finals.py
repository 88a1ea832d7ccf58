"""What ends a script's marking: the checked final result, its latencies, and the regrade loop, feedback that follows from the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import any_of, clean_number, word_count

# Words of a major weakness, and the stages whose seconds are kept.
MAJOR = ("incorrect", "missing", "does not address", "fails to", "not properly specified", "superficial", "underdeveloped", "limited discussion")
STAGES = ("assessment_prepare", "structure_detect", "part_refine", "part_analysis", "moderation", "finalize")


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def final_result(ai_total: Column, ai_max: Column, expected: Column, feedback: Column, strengths: Column, weaknesses: Column, math_total: Column, has_parts: Column, spread: Column, moved: Column, low_text: Column, issue: Column) -> Column:
    """Struct (error_code, total_mark, ai_total_mark, math_total_mark, ai_math_mark_delta, validation_notes).

    A total out of 100 is rescaled to the expected maximum. With scored parts their total wins over the scorer's. Lists may be
    null, but if given hold two points or more. Spread and moved (largest change by moderation) are null without parts. On an
    error all marks are null and no notes are given."""
    scaled = F.round(ai_total * expected / 100, 2)
    told = F.when(F.abs(ai_max - expected) < 1e-9, ai_total).when((F.abs(ai_max - 100) < 1e-9) & ai_total.between(0, 100), scaled)
    untold = F.when((ai_total > expected) & (ai_total <= 100) & (expected != 100), scaled).otherwise(ai_total)
    total = F.when(ai_max.isNotNull(), told).otherwise(untold)
    few = lambda points: points.isNotNull() & (F.size(points) < 2)
    faults = any_of(F.lower(F.concat_ws(" ", weaknesses, feedback)), MAJOR)
    error = (
        F.when(F.trim(F.coalesce(feedback, F.lit(""))) == "", "no_feedback")
        .when(ai_max.isNotNull() & ai_total.isNull(), "max_without_total")
        .when(ai_max <= 0, "non_positive_max")
        .when(ai_max.isNotNull() & total.isNull(), "conflicting_max")
        .when((total < 0) | (total > expected), "out_of_range")
        .when(few(strengths) | few(weaknesses), "too_few_points")
        .when(word_count(feedback) < 120, "short_feedback")
        .when((total == expected) & faults, "full_marks_with_weaknesses")
        .when(has_parts & math_total.isNull(), "no_math_total")
        .when(~has_parts & total.isNull(), "no_total")
    )
    delta = F.when(has_parts, F.round(total - math_total, 2))
    notes = F.array_compact(F.array(
        F.when(issue, "possible_extraction_issue"), F.when(low_text, "low_text"),
        F.when(has_parts, F.concat(F.lit("part_score_spread="), _two(spread))),
        F.when(has_parts & moved.isNotNull(), F.concat(F.lit("part_moderation_max_delta="), _two(moved))),
        F.when(has_parts, F.lit("math_total_used")),
        F.when(has_parts & (F.abs(total - math_total) > 1e-9), F.concat(F.lit("ai_total_disagreement="), _two(F.abs(total - math_total)))),
    ))
    fine = error.isNull()
    return F.struct(
        error.alias("error_code"),
        F.when(fine, F.when(has_parts, math_total).otherwise(total)).alias("total_mark"),
        F.when(fine, total).alias("ai_total_mark"),
        F.when(fine & has_parts, math_total).alias("math_total_mark"),
        F.when(fine, delta).alias("ai_math_mark_delta"),
        F.when(fine, notes).otherwise(F.array().cast("array<string>")).alias("validation_notes"),
    )


def latencies(timings: Column, total: Column, n_parts: Column) -> Column:
    """Struct of the eight latencies in seconds with two decimals (halves away from zero), the mean of a part, and notes.

    timings: map of stage to seconds; a stage that is absent took 0. Fewer than one part counts as one."""
    seconds = {stage: F.round(F.coalesce(F.try_element_at(timings, F.lit(stage)), F.lit(0.0)), 2) for stage in STAGES}
    whole = F.round(F.coalesce(total, F.lit(0.0)), 2)
    notes = (("script", whole), ("assessment_prepare", seconds["assessment_prepare"]), ("part_analysis", seconds["part_analysis"]))
    return F.struct(
        whole.alias("total"),
        seconds["assessment_prepare"].alias("rubric_verify"),
        *(x.alias(stage) for stage, x in seconds.items()),
        F.round(seconds["part_analysis"] / F.greatest(F.coalesce(n_parts, F.lit(1)), F.lit(1)), 2).alias("part_analysis_per_part_avg"),
        F.array(*(F.concat(F.lit(f"latency_{name}_seconds="), _two(x)) for name, x in notes)).alias("notes"),
    )


def _noted(notes: Column, what: Column) -> Column:
    return F.trim(F.concat(F.trim(F.coalesce(notes, F.lit(""))), F.lit(" | "), what), F.lit(" |"))


def regraded(results: DataFrame, verifications: DataFrame, regrades: DataFrame, key: str) -> DataFrame:
    """Verify; after a major concern regrade and verify again; a second major concern asks for review.

    results: key, status, mark, notes, one row a key. verifications: key, attempt (1 or 2), agreement, error_code. regrades: key,
    mark, error_code. A row that is not there is the error no_answer; of repeated rows the greatest counts. Only results with the
    status ok are verified."""
    answer = lambda n: F.max(F.when(F.col("attempt") == n, F.struct("agreement", "error_code")))
    said = verifications.groupBy(key).agg(answer(1).alias("_first"), answer(2).alias("_second"))
    again = regrades.groupBy(key).agg(F.max(F.struct("mark", "error_code")).alias("_again"))
    out = results.select(key, "status", "mark", "notes").join(said, key, "left").join(again, key, "left")

    def failed(x: str) -> Column:
        return F.when(F.col(x).isNull(), "no_answer").otherwise(F.col(x)["error_code"])

    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    concern = ok & failed("_first").isNull() & F.coalesce(F.col("_first")["agreement"] == "major_concern", F.lit(False))
    new = concern & failed("_again").isNull()
    review = new & failed("_second").isNull() & F.coalesce(F.col("_second")["agreement"] == "major_concern", F.lit(False))
    second = _noted(F.col("notes"), F.lit("regraded_after_verifier"))
    return out.select(
        key,
        F.when(new, F.col("_again")["mark"]).otherwise(F.col("mark")).alias("mark"),
        F.when(review, _noted(second, F.lit("review_required"))).when(new, second)
        .when(concern, _noted(F.col("notes"), F.concat(F.lit("regrade_failed: "), failed("_again")))).otherwise(F.col("notes")).alias("notes"),
        F.when(new, F.when(failed("_second").isNull(), F.col("_second")["agreement"])).when(ok & failed("_first").isNull(), F.col("_first")["agreement"]).alias("agreement"),
        F.when(new, failed("_second")).when(ok, failed("_first")).alias("verifier_error"),
    )


# N22. The sentences of a feedback that follows from the parts; {} is filled in order.
FEEDBACK_INTRO = "This script is classified from part-level evidence rather than a separate final-language pass. The deterministic overall mark is {} out of {}, computed as the sum of the part scores."
FEEDBACK_PART = "{} scored {}/{} and was placed in the {} band at the {} end of that bracket. {} Stronger features here include {}, while the mark is held back by {}."
FEEDBACK_OUTRO = (
    "The feedback therefore follows the classified rubric language for each part, rather than trying to invent a fresh overall judgement. "
    "Where a section sits inside its bracket depends on the evidence quality, completeness, precision, and support actually visible in that section."
)
NO_SCORE, NO_BAND, NO_POSITION, NO_STRENGTH, NO_WEAKNESS = "unscored", "classified", "mid", "clear relevant material", "remaining weaknesses in precision and support"


def _filled(text: str, *values: Column) -> Column:
    pieces = text.split("{}")
    return F.concat(F.lit(pieces[0]), *(x for value, after in zip(values, pieces[1:], strict=True) for x in (value, F.lit(after))))


def part_feedback(parts: DataFrame) -> Column:
    """What is said of a part (label, max_mark, provisional_score, provisional_score_0_to_100, grade_band, within_band_position,
    coverage_comment, strengths, weaknesses): its score, band and place, and up to two strengths and weaknesses."""
    score = F.coalesce("provisional_score", F.round(F.col("provisional_score_0_to_100") * F.col("max_mark") / 100, 2))
    said = lambda c, other: F.coalesce(F.trim(F.col(c)), F.lit(other))
    two = lambda c, other: F.coalesce(F.nullif(F.array_join(F.filter(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 2), lambda x: F.trim(x)), lambda x: x != ""), ", "), F.lit("")), F.lit(other))
    return _filled(
        FEEDBACK_PART, F.col("label"), F.coalesce(clean_number(score), F.lit(NO_SCORE)), F.coalesce(clean_number(F.col("max_mark")), F.lit("100")), said("grade_band", NO_BAND), said("within_band_position", NO_POSITION), said("coverage_comment", ""),
        two("strengths", NO_STRENGTH), two("weaknesses", NO_WEAKNESS),
    )


def rendered_feedback(parts: DataFrame, totals: DataFrame, most: float, key: str = "submission_id") -> DataFrame:
    """Key and feedback: the total (totals: key, total_mark; the maximum where it is null), each part in order (part_idx), and what that
    rests on."""
    said = parts.select(key, "part_idx", part_feedback(parts).alias("said")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part_idx", "said"))).alias("x"))
    top = clean_number(F.lit(float(most)))
    intro = _filled(FEEDBACK_INTRO, F.coalesce(clean_number(F.col("total_mark")), top), top)
    return said.join(totals.select(key, "total_mark"), key, "left").select(key, F.concat_ws(" ", intro, F.array_join(F.transform("x", lambda x: x["said"]), " "), F.lit(FEEDBACK_OUTRO)).alias("feedback"))
