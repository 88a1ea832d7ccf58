"""Zero credit, part verdicts and moderators' answers on cases written by hand."""

import json

from pyspark.sql import functions as F

from scriptorium.operators import verification as v


def test_blank_parts_are_missing(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", " \n\t", "a")], "x string")
    assert [r.m for r in rows.select(v.is_missing(F.col("x")).alias("m")).collect()] == [True, True, True, False]


def test_zero_credit_is_a_whole_analysis(spark):
    parts = spark.createDataFrame([("Part 1", 7.5, "First, 2:1", "abstract", ["c1", "c2"], "x"), ("Part 2", None, None, None, [], "y")], "label string, max_mark double, marking_guidance string, criterion_mode string, criteria array<string>, kept string")
    one, two = v.missing_analysis(parts).orderBy("label").collect()
    assert (one.kept, one.provisional_score, one.grade_band, one.within_band_position, one.band_confidence_0_to_100) == ("x", 0.0, "Missing/unfinished", "low", 95.0)
    assert [tuple(n) for n in one.criterion_notes] == [("c1", "weak", "missed", "no usable response"), ("c2", "weak", "missed", "no usable response")] and one.weaknesses[1].endswith("out of 7.5.")
    assert two.grade_band == "Missing" and two.criterion_notes == [] and two.weaknesses[1].endswith("out of 100.")


FINE = {"agreement": "agree", "confidence_0_to_100": 80, "score_too_generous": True, "max_reasonable_score": 4, "recommendation": "lower_score", "overgenerous_criteria": ["a", " "], "criteria_adjustments": ["b"]}


def test_part_verdicts(spark):
    cases = {
        None: FINE, "invalid_agreement": {**FINE, "agreement": "no"}, "invalid_confidence": {**FINE, "confidence_0_to_100": True}, "invalid_score_too_generous": {**FINE, "score_too_generous": "true"}, "invalid_max_reasonable_score": {**FINE, "max_reasonable_score": "4"},
        "max_reasonable_score_out_of_range": {**FINE, "max_reasonable_score": 11}, "invalid_recommendation": {**FINE, "recommendation": "keep"}, "invalid_criteria_adjustments": {**FINE, "criteria_adjustments": "b"}, "not_json": None,
    }
    rows = spark.createDataFrame([(k, json.dumps(x) if x else "{") for k, x in cases.items()], "k string, c string")
    got = {r.k: r for r in rows.select("k", v.part_verdict(F.col("c"), F.lit(10.0)).alias("v"), v.with_verdict(F.lit(8.0), F.lit("said"), v.part_verdict(F.col("c"), F.lit(10.0))).alias("d")).collect()}
    assert {k: r.v.error_code for k, r in got.items()} == {k: k for k in cases}
    assert tuple(got[None].d) == (4.0, "said Verifier cap applied because the earlier score was too generous: a; b.", True)
    assert all(tuple(r.d) == (8.0, "said", False) for k, r in got.items() if k)
    same = spark.range(1).select(v.with_verdict(F.lit(3.0), F.lit("said"), v.part_verdict(F.lit(json.dumps(FINE)), F.lit(None).cast("double"))).alias("d")).head().d
    assert tuple(same) == (3.0, "said", False)


def moderated(spark, content):
    parts = spark.createDataFrame([("s", 1, "Part 1", 10.0, 8.0), ("s", 2, "Part 2", None, 60.0)], "sub string, part_idx int, label string, max_mark double, score double")
    answers = spark.createDataFrame([("s", content if isinstance(content, str) else json.dumps({"adjusted_sections": content}))], "sub string, content string")
    rows = v.moderated_parts(parts, answers, "sub").orderBy("part_idx").collect()
    return [(r.new_score, r.delta, r.rationale) for r in rows], rows[0].error_code


def test_moderators_answers(spark):
    item = lambda label="part  1", why=" why ", **scores: {"section_label": label, "rationale": why, **scores}
    keep = [(8.0, 0.0, None), (60.0, 0.0, None)]
    assert moderated(spark, [item(adjusted_provisional_score=6.5), item("Part 2", adjusted_provisional_score_0_to_100=70)]) == ([(6.5, -1.5, "why"), (70.0, 10.0, "why")], None)
    assert moderated(spark, [item(), item(adjusted_provisional_score=0)]) == ([(0.0, -8.0, "why"), (60.0, 0.0, v.NO_CHANGE)], None)  # the last of a label counts
    assert moderated(spark, [item()]) == ([(8.0, 0.0, "why"), (60.0, 0.0, v.NO_CHANGE)], None)
    for bad, code in ((item("Part 3"), "unknown_label"), (item(why=" "), "no_rationale"), (item(why=3), "no_rationale"), (item(adjusted_provisional_score=1, adjusted_provisional_score_0_to_100=1), "both_scales"), (item(adjusted_provisional_score="1"), "score_not_numeric"), (item(adjusted_provisional_score=11), "score_out_of_range"), (item("Part 2", adjusted_provisional_score_0_to_100=-1), "score_out_of_range")):
        assert moderated(spark, [item(adjusted_provisional_score=5), bad]) == (keep, code)
    assert moderated(spark, "no")[1] == "not_json" and moderated(spark, "{}") == (keep, "invalid_adjusted_sections")
    assert moderated(spark, []) == ([(8.0, 0.0, v.NO_CHANGE), (60.0, 0.0, v.NO_CHANGE)], None)
