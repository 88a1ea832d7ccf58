"""Scorer responses: JSON text to typed rows with error codes instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import bands
from scriptorium.functions.text import bound, collapse
from scriptorium.operators.jsons import is_string, missing, number

#: N3. What fills lists that a response leaves short, and how many items they have at least.
FILLERS = {
    "strengths": ("Additional concrete strength was not provided in the model response.", 2),
    "weaknesses": ("Additional concrete weakness was not provided in the model response.", 2),
    "evidence": ("Concrete supporting evidence was not provided in the model response.", 1),
}


def part_analysis(rows: DataFrame) -> DataFrame:
    """Rows with provisional_score, provisional_score_0_to_100, coverage_comment, strengths, weaknesses, evidence, grade_band,
    within_band_position, band_confidence_0_to_100 and error_code from content, JSON text that is parsed once. All but error_code are
    null where there is an error.

    A score out of the part's own maximum comes before one of 100. The columns max_mark and marking_guidance of rows, if they are there,
    give the scale; bands, positions and confidences that a response leaves out, or that the scale has not, follow from the score."""
    has = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    most, guidance = has("max_mark", "double"), has("marking_guidance", "string")
    said = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    parsed = rows.withColumn("_v", F.try_parse_json("content"))
    parsed = parsed.withColumns({
        "_own": ~missing(F.col("_v"), "$.provisional_score"),
        "_score": F.when(missing(F.col("_v"), "$.provisional_score"), number(F.col("_v"), "$.provisional_score_0_to_100")).otherwise(number(F.col("_v"), "$.provisional_score")),
        "_given": F.col("_v").isNotNull() & ~(missing(F.col("_v"), "$.provisional_score") & missing(F.col("_v"), "$.provisional_score_0_to_100")),
        "_comment": F.when(is_string(F.col("_v"), "$.coverage_comment"), trimmed(said("coverage_comment"))),
        "_confidence": F.round(number(F.col("_v"), "$.band_confidence_0_to_100"), 2),
        "_band": said("grade_band"), "_position": said("within_band_position"),
        **{f"_{n}": F.filter(F.transform(F.try_variant_get("_v", f"$.{n}", "array<string>"), lambda x: trimmed(F.coalesce(x, F.lit("None")))), lambda x: x != "") for n in FILLERS},
    })
    error = (
        F.when(F.col("_v").isNull(), "not_json").when(F.col("_score").isNull(), F.when(F.col("_given"), "score_not_numeric").otherwise("score_missing"))
        .when(F.col("_score") < 0, "score_negative").when(~F.col("_own") & (F.col("_score") > 100), "percent_too_high")
    )
    for name in FILLERS:
        error = error.when(F.col(f"_{name}").isNull(), f"{name}_not_a_list")
    parsed = parsed.withColumn("error_code", error.when(F.coalesce("_comment", F.lit("")) == "", "comment_missing"))
    percent = F.when(F.col("_own") & (most > 0), F.col("_score") / most * 100).otherwise(F.col("_score"))
    parsed = parsed.withColumn("_percent", percent).withColumn("_as", bands.band(F.col("_band"), F.col("_percent"), guidance))
    ok = lambda x: F.when(F.col("error_code").isNull(), x)
    filled = {n: F.concat(F.col(f"_{n}"), F.array_repeat(F.lit(text), F.greatest(F.lit(0), F.lit(least) - F.size(f"_{n}")))) for n, (text, least) in FILLERS.items()}
    out = {
        "provisional_score": F.when(F.col("_own"), F.round("_score", 2)),
        "provisional_score_0_to_100": F.when(~F.col("_own"), F.round("_score", 2)),
        "coverage_comment": F.col("_comment"),
        **filled,
        "grade_band": F.col("_as"),
        "within_band_position": bands.position(F.col("_percent"), F.col("_as"), guidance, F.col("_position")),
        "band_confidence_0_to_100": F.when(F.col("_confidence").between(0, 100), F.col("_confidence")).otherwise(bands.default_confidence(F.col("_as"), guidance)),
    }
    return parsed.select(*rows.columns, *(ok(x).alias(name) for name, x in out.items()), "error_code")


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n\x0b\x0c"))


#: N5. By scale, what a status may be called and its own name there; and what each own name amounts to.
STATUSES = {
    "likert_judgement": {"weak": "weak", "developing": "developing", "clear": "clear", "strong": "strong", "missed": "weak", "met": "clear", "meets": "clear", "partial": "developing", "partly": "developing", "mixed": "developing", "secure": "strong", "strong_anchor": "strong", "weak_anchor": "weak", "absent": "weak"},
    "": {"missing_or_wrong": "missing_or_wrong", "partial": "partial", "partly": "partial", "mixed": "partial", "secure": "secure", "missed": "missing_or_wrong", "met": "secure", "meets": "secure", "clear": "secure", "strong": "secure", "strong_anchor": "secure", "weak": "missing_or_wrong", "weak_anchor": "missing_or_wrong", "absent": "missing_or_wrong"},
}
AMOUNTS_TO = {"likert_judgement": {"weak": "missed", "developing": "partial", "clear": "met", "strong": "met"}, "": {"missing_or_wrong": "missed", "partial": "partial", "secure": "met"}}


def status(raw: Column, scale: Column) -> Column:
    """Struct (native, normalized) of a status on a scale: likert_judgement, or any other. Unknown ones stay as they are."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit("None"))))
    look = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key), key)
    likert = F.coalesce(scale == "likert_judgement", F.lit(False))
    native = F.when(likert, look(STATUSES["likert_judgement"], low)).otherwise(look(STATUSES[""], low))
    normal = F.when(likert, look(AMOUNTS_TO["likert_judgement"], native)).otherwise(look(AMOUNTS_TO[""], native))
    return F.struct(native.alias("native"), normal.alias("normalized"))


def note(text: Column) -> Column:
    """Five words, at most 48 characters, no closing punctuation."""
    flat = F.regexp_replace(collapse(text), r"[.;:,]+$", "")
    return F.substring(F.array_join(F.slice(F.split(flat, " ", 6), 1, 5), " "), 1, 48)


_NOTE = "struct<criterion_name:string,status:string,note:string>"


def criterion_notes(content: Column, names: Column, scale: Column, labels: Column) -> Column:
    """Struct (notes, error_code) of a response's criterion notes: JSON text, an object by name or a list of objects.

    names: the expected criteria in order; labels: statuses that the scale allows (empty: any). Unknown or repeated names, other
    statuses and blank notes are errors; what was left out is 'omitted by model' at the lowest status."""
    return bound(content, lambda said: _read_notes(said, names, scale, labels))


def _read_notes(content: Column, names: Column, scale: Column, labels: Column) -> Column:
    listed = F.from_json(content, f"array<{_NOTE}>")
    keyed = F.from_json(content, "map<string,struct<status:string,note:string>>")
    from_map = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("criterion_name"), e["value"]["status"].alias("status"), e["value"]["note"].alias("note")))
    is_list = F.ltrim(content).startswith("[")
    given = F.transform(F.when(is_list, listed).otherwise(from_map), lambda x: F.struct(F.trim(x["criterion_name"]).alias("name"), status(x["status"], scale).alias("s"), note(F.coalesce(x["note"], F.lit(""))).alias("note")))

    def error_of(given: Column) -> Column:
        wrong = lambda found: F.exists(found, lambda x: F.coalesce(~F.array_contains(names, x), F.lit(True))) | (F.size(F.array_distinct(found)) < F.size(found))
        return (
            F.when(F.try_parse_json(content).isNull(), "not_json").when(given.isNull(), "not_a_list").when(bound(F.transform(given, lambda x: x["name"]), wrong), "wrong_name")
            .when((F.size(labels) > 0) & F.exists(given, lambda x: ~F.array_contains(labels, x["s"]["native"])), "wrong_status").when(F.exists(given, lambda x: x["note"] == ""), "blank_note")
        )

    least = status(F.when(scale == "likert_judgement", "weak").otherwise("missing_or_wrong"), scale)

    def one(name: Column, mine: Column) -> Column:
        return F.struct(name.alias("criterion_name"), F.coalesce(mine["s"]["native"], least["native"]).alias("status"), F.coalesce(mine["s"]["normalized"], least["normalized"]).alias("normalized_status"), F.coalesce(mine["note"], F.lit("omitted by model")).alias("note"))

    def made(given: Column, error: Column) -> Column:
        named = lambda name: bound(F.get(F.filter(given, lambda x: x["name"] == name), F.lit(0)), lambda mine: one(name, mine))
        return F.struct(F.when(error.isNull(), F.transform(names, named)).alias("notes"), error.alias("error_code"))

    # the response is read once, and its error worked out once
    return bound(given, lambda rows: bound(error_of(rows), lambda error: made(rows, error)))


#: N18. Fixed values.
AGREEMENTS = ("agree", "minor_concern", "major_concern")


def verification(content: Column) -> Column:
    """Struct (agreement, confidence, issues, recommendation, error_code) of a verifier's response (JSON text)."""
    v = F.try_parse_json(content)
    agreement, advice = (F.trim(F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))) for n in ("agreement", "recommendation"))
    confidence, issues = number(v, "$.confidence_0_to_100"), F.try_variant_get(v, "$.issues", "array<string>")
    error = (
        F.when(v.isNull(), "not_json").when(~agreement.isin(*AGREEMENTS), "invalid_agreement").when(confidence.isNull(), "invalid_confidence")
        .when(~confidence.between(0, 100), "confidence_out_of_range").when(issues.isNull(), "invalid_issues").when(advice == "", "empty_recommendation")
    )
    said = F.filter(F.transform(issues, lambda x: F.trim(x)), lambda x: x != "")
    ok = lambda x: F.when(error.isNull(), x)
    return F.struct(ok(agreement).alias("agreement"), ok(F.round(confidence, 2)).alias("confidence"), ok(said).alias("issues"), ok(advice).alias("recommendation"), error.alias("error_code"))


#: N19, N20. How a soft failure is marked, what it costs, and what a map must reach.
VERIFIER_FAILED, FAILURE_COSTS, ACCEPTABLE = "rubric_verifier_failed:", 25.0, 75.0


def verified_rubric(content: Column, text: Column, issues: Column) -> Column:
    """Struct (rubric_text, confidence, issues) after a rubric's verification. A response that is no valid one leaves the text,
    takes the confidence to 0 and adds an issue."""

    def read(v: Column) -> Column:
        new, confidence = F.trim(F.try_variant_get(v, "$.rubric_text", "string")), F.round(number(v, "$.confidence_0_to_100"), 2)
        bare = F.variant_get(v, "$.issues", "variant")
        said = F.when(bare.isNull() | F.is_variant_null(bare), F.array().cast("array<string>")).otherwise(F.try_variant_get(v, "$.issues", "array<string>"))
        return F.struct(v.isNotNull().alias("there"), new.alias("text"), confidence.alias("confidence"), said.alias("issues"))

    def why_of(r: Column) -> Column:
        return (
            F.when(~r["there"], "not_json").when(F.coalesce(r["text"], F.lit("")) == "", "no_rubric_text").when(r["issues"].isNull() | F.exists(r["issues"], lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""), "invalid_issues")
            .when(r["confidence"].isNull(), "invalid_confidence").when(~r["confidence"].between(0, 100), "confidence_out_of_range")
        )

    def made(r: Column, why: Column) -> Column:
        failed = F.concat(issues, F.array(F.concat(F.lit(VERIFIER_FAILED + " "), why)))
        return F.struct(F.when(why.isNull(), r["text"]).otherwise(text).alias("rubric_text"), F.when(why.isNull(), r["confidence"]).otherwise(0.0).alias("confidence"), F.when(why.isNull(), F.transform(r["issues"], lambda x: F.trim(x))).otherwise(failed).alias("issues"))

    return bound(bound(F.try_parse_json(content), read), lambda r: bound(why_of(r), lambda why: made(r, why)))


def refinement_score(confidence: Column, issues: Column) -> Column:
    """Confidence less one for each issue, and less for a failed verifier."""
    failed = F.exists(issues, lambda x: F.ltrim(x).startswith(VERIFIER_FAILED))
    return F.round(F.coalesce(confidence, F.lit(0.0)) - F.size(issues) - F.when(failed, FAILURE_COSTS).otherwise(0.0), 2)


def refined(old: Column, new: Column, attempt: Column) -> Column:
    """Struct (accepted, audit) of two units (rubric_text, confidence, issues): the new one only if its score is higher."""
    better = refinement_score(new["confidence"], new["issues"]) > refinement_score(old["confidence"], old["issues"])
    two = lambda x: F.format_string("%.2f", F.coalesce(x, F.lit(0.0)))
    changed = F.when(F.trim(old["rubric_text"]) != F.trim(new["rubric_text"]), "text_changed").otherwise("text_unchanged")
    audit = F.concat(F.lit("attempt_"), attempt.cast("string"), F.lit(": confidence "), two(old["confidence"]), F.lit("->"), two(new["confidence"]), F.lit(", issues "), F.size(old["issues"]).cast("string"), F.lit("->"), F.size(new["issues"]).cast("string"), F.lit(", "), changed)
    return F.struct(better.alias("accepted"), audit.alias("audit"))


def preparation(units: DataFrame, *key: str) -> DataFrame:
    """A4: mean confidence of the units that have one (null without), and whether the map is acceptable: no failed verifier, and
    no unit below ACCEPTABLE."""
    failed = F.exists("issues", lambda x: F.ltrim(x).startswith(VERIFIER_FAILED))
    by = units.groupBy(*key).agg(F.round(F.avg("confidence"), 2).alias("confidence"), F.min("confidence").alias("least"), F.bool_or(failed).alias("failed"))
    return by.select(*key, "confidence", (F.col("least").isNull() | (~F.col("failed") & (F.col("least") >= ACCEPTABLE))).alias("acceptable"))


def feedback_text(content: Column) -> Column:
    """A feedback as text; an object whose content lists sections becomes 'label - analysis feedback' of each, in one line."""
    listed = F.from_json(content, "content array<struct<section_label:string,analysis:string,feedback:string>>")["content"]

    def said(x: Column) -> Column:
        parts = F.filter(F.transform(F.array(x["section_label"], x["analysis"], x["feedback"]), lambda y: F.trim(F.coalesce(y, F.lit("")))), lambda y: y != "")
        return F.concat_ws(" - ", F.get(parts, F.lit(0)), F.nullif(F.array_join(F.slice(parts, 2, 3), " "), F.lit("")))

    lines = F.filter(F.transform(listed, said), lambda x: x != "")
    return F.when(F.ltrim(content).startswith("{"), F.coalesce(F.array_join(lines, " "), F.lit(""))).otherwise(F.trim(content))
