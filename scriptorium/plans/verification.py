"""Queries on zero credit, part verifiers and moderators' answers (N12, N13, N15). Their SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import verification as v
from scriptorium.plans.marks import _t
from scriptorium.plans.structure import _N, _numbered


def zero_credit(spark, sf):
    """Turns that hold nothing get a whole analysis of zero, by their scale and mode."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.length("text") % 4 == 0, " \n").otherwise(F.col("text")).alias("section_text"))
    parts = c.where(v.is_missing(F.col("section_text"))).withColumns({
        "label": F.concat(F.lit("Part "), F.col("turn").cast("string")), "max_mark": F.when(F.col("turn") % 3 > 0, F.col("turn") / 2), "marking_guidance": F.when(F.col("turn") % 2 == 0, "First to Fail").otherwise(""),
        "criterion_mode": F.when(F.col("role") == "user", "abstract").otherwise("deterministic"), "criteria": F.array(F.lit("criterion_1"), F.col("role")),
    })
    notes = F.array_join(F.transform("criterion_notes", lambda x: F.concat_ws(":", x["criterion_name"], x["status"], x["normalized_status"], x["note"])), "|")
    return v.missing_analysis(parts).select("conv_id", "turn", "provisional_score", "grade_band", "within_band_position", "band_confidence_0_to_100", notes.alias("notes"), F.array_join(F.concat("strengths", "weaknesses", "evidence"), "|").alias("said"), "coverage_comment")


def part_verdicts(spark, sf):
    """Verdicts on each line's score, some of them invalid, and the caps that follow."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("score"), "l_partkey")
    k = F.col("l_partkey") % 9
    content = F.when(k == 0, "no").otherwise(F.to_json(F.struct(
        F.when(k == 1, "yes").otherwise(" major_concern ").alias("agreement"), F.when(k == 2, 101).otherwise(F.col("l_linenumber") * 10).alias("confidence_0_to_100"), F.when(k == 3, F.lit(None).cast("boolean")).otherwise(k != 8).alias("score_too_generous"),
        F.when(k == 4, 60).otherwise(F.col("l_linenumber") * 6).alias("max_reasonable_score"), F.when(k == 5, "lower").when(k == 6, "accept").otherwise("lower_score").alias("recommendation"), F.array(F.lit("vague"), F.lit(" ")).alias("overgenerous_criteria"),
        F.when(k == 7, F.array(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))).alias("criteria_adjustments"),
    )))
    judged = li.withColumn("verdict", v.part_verdict(content, F.lit(50.0)))
    done = v.with_verdict(F.col("score"), F.lit(" fine "), F.col("verdict"))
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "score", F.col("verdict.error_code").alias("error_code"), done.alias("d")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("score").alias("before"), "error_code", "d.*")


def moderation_answers(spark, sf):
    """A moderator's answer on each order, which lowers odd parts; some break a rule, and then nothing changes."""
    rows = _numbered(spark, sf).select(F.col("l_orderkey").alias("submission"), F.col("n").alias("part_idx"), F.concat(F.lit("Part "), F.col("n").cast("string")).alias("label"), F.when(F.col("n") % 4 != 3, 50.0).alias("max_mark"), F.col("q").cast("double").alias("score"))
    k = F.col("submission") % 8
    none = F.lit(None).cast("double")
    lower = F.col("score") / 2
    whole = F.col("max_mark").isNotNull()
    first = F.col("part_idx") == 1
    item = F.struct(
        F.when(first & (k == 1), "Part 99").otherwise(F.upper("label")).alias("section_label"), F.when(first & (k == 2), " ").otherwise(" too high ").alias("rationale"),
        F.when(first & (k == 3), 51.0).when(whole, lower).otherwise(none).alias("adjusted_provisional_score"), F.when(first & (k == 4), 10.0).when(~whole, lower).otherwise(none).alias("adjusted_provisional_score_0_to_100"),
    )
    answers = rows.where("part_idx % 2 = 1").groupBy("submission").agg(F.array_sort(F.collect_list(F.struct("part_idx", item.alias("i")))).alias("x"))
    content = F.when(k == 0, "{}").when(k == 5, "no").otherwise(F.to_json(F.struct(F.transform("x", lambda x: x["i"]).alias("adjusted_sections"))))
    return v.moderated_parts(rows, answers.where("submission % 8 != 6").select("submission", content.alias("content")), "submission")


SQL = {
    "zero_credit": f"""
SELECT conv_id, turn, 0.0::DOUBLE AS provisional_score, CASE WHEN turn % 2 = 0 THEN 'Missing/unfinished' ELSE 'Missing' END AS grade_band, 'low' AS within_band_position, 95.0::DOUBLE AS band_confidence_0_to_100,
  'criterion_1:' || status || ':missed:no usable response|' || role || ':' || status || ':missed:no usable response' AS notes,
  '{"|".join(v.ZERO_STRENGTHS)}|{v.ZERO_WEAKNESSES[0]}|No valid method, evidence, or answer was available to earn marks out of ' || CASE WHEN turn % 3 = 0 THEN '100' WHEN turn % 2 = 0 THEN (turn // 2)::VARCHAR ELSE (turn / 2.0::DOUBLE)::VARCHAR END || '.|{v.ZERO_EVIDENCE[0]}' AS said, '{v.ZERO_COMMENT}' AS coverage_comment
FROM (SELECT *, CASE WHEN role = 'user' THEN 'weak' ELSE 'missing_or_wrong' END AS status FROM conversations WHERE length(text) % 4 = 0)
""",
    "part_verdicts": """
WITH judged AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS before, l_partkey % 9 AS k, l_linenumber * 6.0::DOUBLE AS ceiling,
    CASE l_partkey % 9 WHEN 0 THEN 'not_json' WHEN 1 THEN 'invalid_agreement' WHEN 2 THEN 'confidence_out_of_range' WHEN 3 THEN 'invalid_score_too_generous' WHEN 4 THEN 'max_reasonable_score_out_of_range' WHEN 5 THEN 'invalid_recommendation' END AS error_code FROM lineitem
), capped AS (SELECT *, k = 7 AND ceiling < before AS capped FROM judged)
SELECT l_orderkey, l_linenumber, l_partkey, before, error_code, CASE WHEN capped THEN ceiling ELSE before END AS score,
  CASE WHEN capped THEN 'fine Verifier cap applied because the earlier score was too generous: vague; line ' || l_linenumber || '.' ELSE ' fine ' END AS comment, capped FROM capped
""",
    "moderation_answers": f"""
WITH parts AS (SELECT l_orderkey AS submission, n AS part_idx, q::DOUBLE AS score, l_orderkey % 8 AS k FROM ({_N})),
judged AS (SELECT *, CASE k WHEN 0 THEN 'invalid_adjusted_sections' WHEN 1 THEN 'unknown_label' WHEN 2 THEN 'no_rationale' WHEN 3 THEN 'score_out_of_range' WHEN 4 THEN 'both_scales' WHEN 5 THEN 'not_json' END AS error_code, part_idx % 2 = 1 AND k > 6 AS changed FROM parts)
SELECT submission, part_idx, 'Part ' || part_idx AS label, score, CASE WHEN changed THEN score / 2 ELSE score END AS new_score, CASE WHEN changed THEN round(score / 2 - score, 2) ELSE 0.0::DOUBLE END AS delta,
  CASE WHEN error_code IS NULL THEN CASE WHEN changed THEN 'too high' ELSE 'No moderation change returned.' END END AS rationale, error_code FROM judged
""",
}
QUERIES = {name: globals()[name] for name in SQL}
