"""Queries on final results, latencies, the regrade loop, inference profiles, retries and structure measures. Their SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import guidance
from scriptorium.operators import attempts, finals, rubrics
from scriptorium.plans.marks import _t


def final_result_checks(spark, sf):
    k = F.col("o_orderkey")
    strings = lambda *x: F.array(*map(F.lit, x))
    parts = k % 4 < 2
    result = finals.final_result(
        F.when(k % 7 != 0, (k % 61).cast("double")),
        F.when(k % 5 == 0, 50.0).when(k % 5 == 1, 100.0).when(k % 5 == 2, F.when(k % 10 == 2, 40.0).otherwise(-1.0)),
        F.lit(50.0), F.repeat(F.lit("word "), (110 + k % 90).cast("int")), F.when(k % 11 == 0, strings("one")),
        F.when(k % 3 == 0, strings("a step is Missing", "thin")).when(k % 3 == 1, strings("small", "thin")),
        F.when(k % 8 != 0, (k % 51).cast("double")), parts, (k % 9) * 0.5, F.when(k % 2 == 0, (k % 3) * 0.25), k % 13 == 0, k % 17 == 0,
    )
    rows = _t(spark, sf, "orders").select(k, result.alias("r")).select("o_orderkey", "r.*")
    return rows.withColumn("validation_notes", F.array_join("validation_notes", "|"))


def latency_attach(spark, sf):
    k = F.col("o_orderkey")
    timings = F.create_map(F.lit("assessment_prepare"), (k % 97) * 0.25, F.lit("part_analysis"), (k % 89) * 0.5, F.lit("moderation"), (k % 7) * 0.25)
    rows = _t(spark, sf, "orders").select(k, finals.latencies(timings, (k % 101) * 0.75, (k % 6).cast("int")).alias("r")).select("o_orderkey", "r.*")
    return rows.withColumn("notes", F.array_join("notes", "|"))


def regrade_loop(spark, sf):
    orders, k = _t(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey")
    results = orders.select(k, F.when(k % 10 == 0, "error").otherwise("ok").alias("status"), (k % 100).cast("double").alias("mark"), F.when(k % 2 == 0, "checked").alias("notes"))
    concern = lambda every: F.when(k % every != 0, "major_concern").otherwise("agree")
    first = orders.filter(k % 9 != 0).select(k, F.lit(1).alias("attempt"), concern(4).alias("agreement"), F.when(k % 11 == 0, "timeout").alias("error_code"))
    second = orders.filter(k % 13 != 0).select(k, F.lit(2).alias("attempt"), concern(3).alias("agreement"), F.lit(None).cast("string").alias("error_code"))
    regrades = orders.filter(k % 7 != 0).select(k, (k % 50).cast("double").alias("mark"), F.when(k % 5 == 0, "not_json").alias("error_code"))
    return finals.regraded(results, first.unionByName(second), regrades, "o_orderkey")


def inference_profiles(spark, sf):
    names = F.array(*map(F.lit, ("verification", "detector_small", "moderation", "other")))
    rows = _t(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("profile"))
    return rows.select("p_partkey", "profile", *(guidance.profile(F.col("profile"), x).alias(x) for x in guidance.PROFILE))


def retry_policy(spark, sf):
    orders, k = _t(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey")
    error = F.when(k % 3 == 0, "Too long: too few items for evidence").when(k % 3 == 1, F.when(k % 2 == 0, "not JSON"))
    first = orders.filter(k % 11 != 0).select(k, F.lit(1).alias("attempt"), (k % 100).alias("value"), F.when(k % 6 != 3, error).otherwise("bad criterion_notes").alias("error"))
    second = orders.filter(k % 5 != 0).select(k, F.lit(2).alias("attempt"), (k % 50).alias("value"), F.when(k % 7 == 0, "criterion_notes again").alias("error"))
    return attempts.retried(first.unionByName(second), "o_orderkey", attempts.RETRY_PART)


def detector_fallback(spark, sf):
    orders, k = _t(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey")
    asked = lambda rank, name, every: orders.select(k, F.lit(rank).alias("rank"), F.lit(name).alias("scorer"), (k % (10 * rank)).alias("value"), F.when(k % every == 0, f"{name} timed out").alias("error"))
    return attempts.fallen_back(asked(1, "small", 2).unionByName(asked(2, "primary", 3)), "o_orderkey")


def structure_metrics(spark, sf):
    k = F.col("o_orderkey")
    node = lambda label, mark, weight: (label.alias("label"), mark.cast("double").alias("max_mark"), weight.cast("string").alias("weight_text"))
    nothing = F.lit(None)
    parts = F.array(F.struct(*node(F.lit(" Q1 "), F.when(k % 2 == 0, 5), nothing)), F.struct(*node(F.when(k % 3 == 0, "Q2").otherwise(" "), nothing, F.when(k % 5 == 0, "10%").otherwise(""))))
    sections = F.array(
        F.struct(*node(F.lit("Part 1"), nothing, F.when(k % 7 == 0, "20%")), parts.alias("subparts")),
        F.struct(*node(F.when(k % 4 != 0, "Part 2"), F.lit(20), nothing), F.slice(parts, 1, 0).alias("subparts")),
    )
    rows = _t(spark, sf, "orders").select(k, rubrics.structure_metrics(F.when(k % 13 != 0, sections)).alias("r")).select("o_orderkey", "r.*")
    return rows.withColumn("labels", F.array_join("labels", " | "))


def part_feedback_text(spark, sf):
    """The feedback of each order's lines as parts, some of them scored by percentage or not at all."""
    li = _t(spark, sf, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = li.withColumn("n", F.row_number().over(w)).select(F.col("l_orderkey").alias("submission_id"), F.col("n").alias("part_idx"), F.col("l_quantity").cast("double").alias("q"), "l_partkey")
    k = F.col("l_partkey") % 5
    strings = lambda *x: F.array(*x)
    parts = rows.withColumns({
        "label": F.concat(F.lit("Part "), F.col("part_idx").cast("string")), "max_mark": F.when(k != 4, 50.0), "provisional_score": F.when(k < 2, F.col("q") / 4), "provisional_score_0_to_100": F.when(k >= 2, F.col("q")), "grade_band": F.when(k != 1, " Secure "),
        "within_band_position": F.when(k != 2, "high"), "coverage_comment": F.when(k != 3, F.concat(F.lit(" item "), F.col("l_partkey").cast("string"))), "strengths": F.when(k == 0, strings(F.lit("a"), F.lit(" b "), F.lit("c"))).when(k == 1, strings(F.lit(" "), F.lit("d"))),
        "weaknesses": F.when(k == 2, strings(F.lit(" "))).otherwise(strings(F.lit("w"))),
    })
    totals = rows.groupBy("submission_id").agg(F.sum("q").alias("s")).select("submission_id", F.when(F.col("submission_id") % 3 > 0, F.col("s") / 8).alias("total_mark"))
    return finals.rendered_feedback(parts, totals, 100.0)


QUERIES = {f.__name__: f for f in (final_result_checks, latency_attach, regrade_loop, inference_profiles, retry_policy, detector_fallback, structure_metrics, part_feedback_text)}

SQL = {
    "part_feedback_text": """
WITH rows AS (
  SELECT l_orderkey AS submission_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS n, l_quantity::DOUBLE AS q, l_partkey, l_partkey % 5 AS k FROM lineitem
), said AS (
  SELECT *, CASE WHEN k < 2 THEN q / 4 WHEN k < 4 THEN round(q * 50.0::DOUBLE / 100, 2) END AS score FROM rows
), parts AS (
  SELECT submission_id, n, 'Part ' || n || ' scored ' || coalesce(CASE WHEN score = floor(score) THEN (score)::BIGINT::VARCHAR ELSE (round(score, 2))::VARCHAR END, 'unscored') || '/' || CASE WHEN k <> 4 THEN '50' ELSE '100' END || ' and was placed in the ' || CASE WHEN k <> 1 THEN 'Secure' ELSE 'classified' END || ' band at the ' || CASE WHEN k <> 2 THEN 'high' ELSE 'mid' END
    || ' end of that bracket. ' || CASE WHEN k <> 3 THEN 'item ' || l_partkey ELSE '' END || ' Stronger features here include ' || CASE k WHEN 0 THEN 'a, b' WHEN 1 THEN 'd' ELSE 'clear relevant material' END || ', while the mark is held back by ' || CASE WHEN k = 2 THEN 'remaining weaknesses in precision and support' ELSE 'w' END || '.' AS line FROM said
), totals AS (
  SELECT submission_id, sum(q) / 8 AS total FROM rows GROUP BY 1
)
SELECT submission_id, 'This script is classified from part-level evidence rather than a separate final-language pass. The deterministic overall mark is ' || CASE WHEN submission_id % 3 > 0 THEN CASE WHEN any_value(total) = floor(any_value(total)) THEN (any_value(total))::BIGINT::VARCHAR ELSE (round(any_value(total), 2))::VARCHAR END ELSE '100' END || ' out of 100, computed as the sum of the part scores. ' || string_agg(line, ' ' ORDER BY n) || ' The feedback therefore follows the classified rubric language for each part, rather than trying to invent a fresh overall judgement. Where a section sits inside its bracket depends on the evidence quality, completeness, precision, and support actually visible in that section.' AS feedback
FROM parts JOIN totals USING (submission_id) GROUP BY submission_id
""",
    "final_result_checks": """
WITH a AS (
  SELECT o_orderkey AS k, CASE WHEN k % 7 <> 0 THEN CAST(k % 61 AS DOUBLE) END AS ai,
    CASE WHEN k % 5 = 0 THEN 50.0 WHEN k % 5 = 1 THEN 100.0 WHEN k % 10 = 2 THEN 40.0 WHEN k % 10 = 7 THEN -1.0 END AS mx,
    k % 4 < 2 AS parts, CASE WHEN k % 8 <> 0 THEN CAST(k % 51 AS DOUBLE) END AS math FROM orders),
b AS (SELECT *, CASE WHEN mx = 50 THEN ai WHEN mx = 100 THEN ai / 2 WHEN mx IS NULL AND ai > 50 THEN ai / 2 WHEN mx IS NULL THEN ai END AS total FROM a),
c AS (SELECT *, CASE
    WHEN mx IS NOT NULL AND ai IS NULL THEN 'max_without_total' WHEN mx <= 0 THEN 'non_positive_max' WHEN mx = 40 THEN 'conflicting_max'
    WHEN total > 50 THEN 'out_of_range' WHEN k % 11 = 0 THEN 'too_few_points' WHEN 110 + k % 90 < 120 THEN 'short_feedback'
    WHEN total = 50 AND k % 3 = 0 THEN 'full_marks_with_weaknesses' WHEN parts AND math IS NULL THEN 'no_math_total'
    WHEN NOT parts AND total IS NULL THEN 'no_total' END AS error_code FROM b)
SELECT k AS o_orderkey, error_code, CASE WHEN error_code IS NULL THEN CASE WHEN parts THEN math ELSE total END END AS total_mark,
  CASE WHEN error_code IS NULL THEN total END AS ai_total_mark, CASE WHEN error_code IS NULL AND parts THEN math END AS math_total_mark,
  CASE WHEN error_code IS NULL AND parts THEN round(total - math, 2) END AS ai_math_mark_delta,
  CASE WHEN error_code IS NOT NULL THEN '' ELSE concat_ws('|', CASE WHEN k % 17 = 0 THEN 'possible_extraction_issue' END, CASE WHEN k % 13 = 0 THEN 'low_text' END,
    CASE WHEN parts THEN printf('part_score_spread=%.2f', CAST((k % 9) * 0.5 AS DOUBLE)) END,
    CASE WHEN parts AND k % 2 = 0 THEN printf('part_moderation_max_delta=%.2f', CAST((k % 3) * 0.25 AS DOUBLE)) END,
    CASE WHEN parts THEN 'math_total_used' END,
    CASE WHEN parts AND total <> math THEN printf('ai_total_disagreement=%.2f', abs(total - math)) END) END AS validation_notes
FROM c""",
    "latency_attach": """
WITH a AS (SELECT o_orderkey, CAST((o_orderkey % 101) * 0.75 AS DOUBLE) AS total, CAST((o_orderkey % 97) * 0.25 AS DOUBLE) AS prepare,
  CAST((o_orderkey % 89) * 0.5 AS DOUBLE) AS analysis, CAST((o_orderkey % 7) * 0.25 AS DOUBLE) AS moderation FROM orders)
SELECT o_orderkey, total, prepare AS rubric_verify, prepare AS assessment_prepare, 0.0::DOUBLE AS structure_detect, 0.0::DOUBLE AS part_refine,
  analysis AS part_analysis, moderation, 0.0::DOUBLE AS finalize, round(analysis / greatest(o_orderkey % 6, 1), 2) AS part_analysis_per_part_avg,
  printf('latency_script_seconds=%.2f|latency_assessment_prepare_seconds=%.2f|latency_part_analysis_seconds=%.2f', total, prepare, analysis) AS notes
FROM a""",
    "regrade_loop": """
WITH a AS (SELECT o_orderkey AS k, k % 10 <> 0 AS ok, k % 9 <> 0 AND k % 11 <> 0 AS answered,
  CASE WHEN k % 7 = 0 THEN 'no_answer' WHEN k % 5 = 0 THEN 'not_json' END AS failed FROM orders),
b AS (SELECT *, ok AND answered AND k % 4 <> 0 AS concern, ok AND answered AND k % 4 <> 0 AND failed IS NULL AS renewed FROM a)
SELECT k AS o_orderkey, CAST(CASE WHEN renewed THEN k % 50 ELSE k % 100 END AS DOUBLE) AS mark,
  CASE WHEN NOT concern THEN CASE WHEN k % 2 = 0 THEN 'checked' END ELSE concat_ws(' | ', CASE WHEN k % 2 = 0 THEN 'checked' END,
    CASE WHEN renewed THEN 'regraded_after_verifier' ELSE 'regrade_failed: ' || failed END,
    CASE WHEN renewed AND k % 13 <> 0 AND k % 3 <> 0 THEN 'review_required' END) END AS notes,
  CASE WHEN renewed THEN CASE WHEN k % 13 = 0 THEN NULL WHEN k % 3 <> 0 THEN 'major_concern' ELSE 'agree' END
    WHEN ok AND answered THEN CASE WHEN k % 4 <> 0 THEN 'major_concern' ELSE 'agree' END END AS agreement,
  CASE WHEN renewed THEN CASE WHEN k % 13 = 0 THEN 'no_answer' END WHEN NOT ok THEN NULL
    WHEN k % 9 = 0 THEN 'no_answer' WHEN k % 11 = 0 THEN 'timeout' END AS verifier_error
FROM b""",
    "inference_profiles": """
SELECT p_partkey, profile, temperature, top_p, num_ctx, 7.0::DOUBLE AS seed, num_predict
FROM part JOIN (VALUES (0, 'verification', 0.0::DOUBLE, 0.8::DOUBLE, 8192.0::DOUBLE, 700.0::DOUBLE), (1, 'detector_small', 0.0, 0.75, 4096.0, 320.0),
  (2, 'moderation', 0.05, 0.85, 8192.0, 1100.0), (3, 'other', 0.0, 0.85, 8192.0, 900.0)) v(n, profile, temperature, top_p, num_ctx, num_predict)
ON p_partkey % 4 = n""",
    "retry_policy": """
WITH a AS (SELECT o_orderkey AS k, k % 11 <> 0 AS asked, k % 5 <> 0 AS again,
  CASE WHEN k % 6 = 3 THEN 'bad criterion_notes' WHEN k % 3 = 0 THEN 'Too long: too few items for evidence' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'not JSON' END AS e FROM orders),
b AS (SELECT *, asked AND again AND k % 3 = 0 AS second FROM a WHERE asked OR again)
SELECT k AS o_orderkey, CASE WHEN second THEN CASE WHEN k % 7 <> 0 THEN k % 50 END WHEN asked AND e IS NULL THEN k % 100 END AS value,
  CASE WHEN NOT asked THEN 'no_answer' WHEN second THEN CASE WHEN k % 7 = 0 THEN 'criterion_notes again' END ELSE e END AS error,
  CASE WHEN NOT asked THEN 0 WHEN second THEN 2 ELSE 1 END AS attempts FROM b""",
    "detector_fallback": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'small' ELSE 'primary' END AS scorer,
  CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey % 10 WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 20 END AS value,
  CASE WHEN o_orderkey % 6 = 0 THEN 'primary timed out' END AS error FROM orders""",
    "structure_metrics": """
WITH a AS (SELECT o_orderkey AS k, CASE WHEN k % 13 = 0 THEN 0 ELSE 1 END AS there FROM orders)
SELECT k AS o_orderkey, 2 * there AS top_level_count,
  there * (2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END) AS total_unit_count,
  there * (1 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS marks_found_count,
  CASE WHEN there = 0 THEN '' ELSE concat_ws(' | ', 'Part 1', 'Q1', CASE WHEN k % 3 = 0 THEN 'Q2' END, CASE WHEN k % 4 <> 0 THEN 'Part 2' END) END AS labels FROM a""",
}
