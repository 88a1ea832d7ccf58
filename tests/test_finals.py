"""Edges of final results, retries, the regrade loop and rubric parsing: nulls, empty tables, repeated rows."""

from pyspark.sql import functions as F

from scriptorium.functions import guidance
from scriptorium.operators import attempts, finals, rubrics


def _final(spark, **given):
    base = {"ai_total": 30.0, "ai_max": None, "expected": 50.0, "feedback": "word " * 130, "strengths": None, "weaknesses": None, "math_total": None, "has_parts": False, "spread": None, "moved": None, "low_text": False, "issue": False}
    kinds = dict.fromkeys(base, "double") | {"feedback": "string", "strengths": "array<string>", "weaknesses": "array<string>", "has_parts": "boolean", "low_text": "boolean", "issue": "boolean"}
    columns = {k: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kinds[k]) for k, v in (base | given).items()}
    return spark.range(1).select(finals.final_result(**columns).alias("r")).head().r


def test_final_results(spark):
    assert _final(spark).total_mark == 30
    assert _final(spark, feedback=None).error_code == _final(spark, feedback=" ").error_code == "no_feedback"
    assert _final(spark, ai_total=None).error_code == "no_total"
    assert _final(spark, ai_total=80.0).total_mark == 40
    assert _final(spark, ai_total=-1.0).error_code == "out_of_range"
    assert _final(spark, ai_total=50.0, feedback="word " * 130 + "Superficial").error_code == "full_marks_with_weaknesses"
    own = _final(spark, has_parts=True, math_total=28.0, spread=4.0)
    assert (own.total_mark, own.ai_math_mark_delta) == (28, 2)
    assert own.validation_notes == ["part_score_spread=4.00", "math_total_used", "ai_total_disagreement=2.00"]


def test_regrade_loop_of_repeated_and_empty_tables(spark):
    results = spark.createDataFrame([(1, "ok", 5.0, None), (2, "error", 6.0, "| old |"), (3, None, 7.0, None)], "k int, status string, mark double, notes string")
    said = spark.createDataFrame([(1, 1, "major_concern", None)] * 2, "k int, attempt int, agreement string, error_code string")
    again = spark.createDataFrame([(1, 9.0, None)] * 2, "k int, mark double, error_code string")
    rows = {r.k: r[1:] for r in finals.regraded(results, said, again, "k").collect()}
    assert rows == {1: (9.0, "regraded_after_verifier", None, "no_answer"), 2: (6.0, "| old |", None, None), 3: (7.0, None, None, None)}
    assert finals.regraded(results, said.limit(0), again.limit(0), "k").filter("verifier_error = 'no_answer'").count() == 1
    assert finals.regraded(results.limit(0), said, again, "k").count() == 0


def test_attempts(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None), (2, 1, None, "criterion_notes"), (3, 2, "c", None)], "k int, attempt int, value string, error string")
    assert {r.k: r[1:] for r in attempts.retried(rows, "k", attempts.RETRY_PART).collect()} == {1: ("a", None, 1), 2: (None, "criterion_notes", 1), 3: (None, "no_answer", 0)}
    assert attempts.retried(rows.limit(0), "k", attempts.RETRY_PART).count() == 0


def test_texts_that_are_null(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(rubrics.matrix_rows(null).alias("m"), guidance.anchors(null)["weak"].alias("a"), guidance.guidance_summary(null).alias("s"), guidance.profile(null, "seed").alias("p"), F.size(guidance.scoring_rules(null)).alias("n")).head()
    assert tuple(row) == ([], guidance.ANY_ANCHOR[0], guidance.NO_GUIDANCE, 7.0, 1)
