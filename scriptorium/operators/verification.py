"""What is done to a part's analysis after it was scored: zero credit for what is missing, a verifier's cap, a moderator's adjustments
(N12, N13, N15). Responses that break a rule give a code and change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import bands
from scriptorium.functions import text as t
from scriptorium.functions.text import bound
from scriptorium.operators.jsons import is_string, missing, number
from scriptorium.operators.responses import AGREEMENTS, trimmed
from scriptorium.operators.scorers import CHECK, JUDGEMENT

# Fixed values.
ADVICE = ("accept", "lower_score", "refine_criteria")
ZERO_CONFIDENCE = 95.0
ZERO_STRENGTHS = ("No creditable response was identified for this section.", "The section remains available for explicit zero-credit accounting in the final arithmetic.")
ZERO_WEAKNESSES = ("The expected section content was not found in the extracted submission text.", "No valid method, evidence, or answer was available to earn marks out of {}.")
ZERO_EVIDENCE = ("No section text was matched to this expected assessment unit.",)
ZERO_COMMENT = "This expected assessment unit was not detected in the submission text. It is therefore treated as missing for deterministic arithmetic and awarded zero."
ZERO_NOTE = "no usable response"
CAPPED = "Verifier cap applied because the earlier score was too generous: {}."
NO_CHANGE = "No moderation change returned."
# End of the fixed values.


def missing_analysis(parts: DataFrame) -> DataFrame:
    """Parts (label, max_mark, marking_guidance, criterion_mode, criteria: an array of names, and others) with the analysis of a part that
    is not there: score 0, the lowest band and position, confidence 95, each criterion missed."""
    guidance = F.col("marking_guidance")
    abstract = F.col("criterion_mode") == "abstract"
    band = bands.band(F.lit("missing/unfinished"), F.lit(0.0), guidance)
    most = F.coalesce(F.when(F.col("max_mark") == F.floor("max_mark"), F.floor("max_mark").cast("string")), F.round("max_mark", 2).cast("string"), F.lit("100"))
    before, after = ZERO_WEAKNESSES[1].split("{}")
    note = lambda name: F.struct(name.alias("criterion_name"), F.when(abstract, JUDGEMENT[1][0]).otherwise(CHECK[1][0]).alias("status"), F.lit("missed").alias("normalized_status"), F.lit(ZERO_NOTE).alias("note"))
    return parts.withColumns({
        "provisional_score": F.lit(0.0), "provisional_score_0_to_100": F.lit(None).cast("double"), "grade_band": band, "within_band_position": bands.position(F.lit(0.0), band, guidance, F.lit("low")), "band_confidence_0_to_100": F.lit(ZERO_CONFIDENCE),
        "criterion_notes": F.transform("criteria", note), "strengths": F.array(*map(F.lit, ZERO_STRENGTHS)), "weaknesses": F.array(F.lit(ZERO_WEAKNESSES[0]), F.concat(F.lit(before), most, F.lit(after))), "evidence": F.array(*map(F.lit, ZERO_EVIDENCE)),
        "coverage_comment": F.lit(ZERO_COMMENT),
    })


def is_missing(text: Column) -> Column:
    """Whether a part of a submission has nothing to score."""
    return trimmed(F.coalesce(text, F.lit(""))) == ""


def part_verdict(content: Column, most: Column) -> Column:
    """Struct (agreement, confidence, criteria_adjustments, overgenerous_criteria, too_generous, ceiling, advice, error_code) of a part
    verifier's response (JSON text); most: the part's maximum, 100 where it is null."""

    def read(v: Column) -> Column:
        said = lambda name: F.coalesce(trimmed(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))
        confidence, ceiling = number(v, "$.confidence_0_to_100"), number(v, "$.max_reasonable_score")
        flag = F.when(F.schema_of_variant(F.variant_get(v, "$.score_too_generous", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.score_too_generous", "boolean"))
        none = F.array().cast("array<string>")
        bare = lambda name: F.variant_get(v, f"$.{name}", "variant")
        listed = lambda name: F.when(bare(name).isNull(), none).otherwise(F.try_variant_get(v, f"$.{name}", "array<string>"))
        clean = lambda name: F.filter(F.transform(listed(name), lambda x: trimmed(F.coalesce(x, F.lit("None")))), lambda x: x != "")
        lists = ("criteria_adjustments", "overgenerous_criteria")
        # each field is read once, and the error worked out once
        fields = F.struct(v.isNotNull().alias("there"), said("agreement").alias("agreement"), confidence.alias("confidence"), flag.alias("flag"), ceiling.alias("ceiling"), said("recommendation").alias("advice"), *(clean(n).alias(n) for n in lists))

        def error_of(r: Column) -> Column:
            error = (
                F.when(~r["there"], "not_json").when(~r["agreement"].isin(*AGREEMENTS), "invalid_agreement").when(r["confidence"].isNull(), "invalid_confidence").when(~r["confidence"].between(0, 100), "confidence_out_of_range")
                .when(r["flag"].isNull(), "invalid_score_too_generous").when(r["ceiling"].isNull(), "invalid_max_reasonable_score").when(~r["ceiling"].between(0, F.coalesce(most, F.lit(100.0))), "max_reasonable_score_out_of_range")
                .when(~r["advice"].isin(*ADVICE), "invalid_recommendation")
            )
            for name in lists:
                error = error.when(r[name].isNull(), f"invalid_{name}")
            return error

        def made(r: Column, error: Column) -> Column:
            ok = lambda x: F.when(error.isNull(), x)
            return F.struct(
                ok(r["agreement"]).alias("agreement"), ok(F.round(r["confidence"], 2)).alias("confidence"), *(ok(r[n]).alias(n) for n in lists), ok(r["flag"]).alias("too_generous"), ok(F.round(r["ceiling"], 2)).alias("ceiling"), ok(r["advice"]).alias("advice"), error.alias("error_code"),
            )

        return bound(fields, lambda r: bound(error_of(r), lambda error: made(r, error)))

    return bound(F.try_parse_json(content), read)


def with_verdict(score: Column, comment: Column, verdict: Column) -> Column:
    """Struct (score, comment, capped): a score is lowered only where a valid verdict says too generous, advises to lower it and names
    less; the comment then says why, if the verdict does."""
    held = F.coalesce(score, F.lit(0.0))
    cap = F.coalesce(verdict["error_code"].isNull() & verdict["too_generous"] & (verdict["advice"] == "lower_score") & (verdict["ceiling"] < held), F.lit(False))
    why = F.array_join(F.concat(F.coalesce(verdict["overgenerous_criteria"], F.array().cast("array<string>")), F.coalesce(verdict["criteria_adjustments"], F.array().cast("array<string>"))), "; ")
    before, after = CAPPED.split("{}")
    told = trimmed(F.concat(trimmed(F.coalesce(comment, F.lit(""))), F.lit(" " + before), why, F.lit(after)))
    return F.struct(F.when(cap, F.round(verdict["ceiling"], 2)).otherwise(score).alias("score"), F.when(cap & (why != ""), told).otherwise(comment).alias("comment"), cap.alias("capped"))


_ITEM = "struct<section_label:string,rationale:string,absolute:double,percent:double,both:boolean,numeric:boolean>"


def adjustments(content: Column) -> Column:
    """Struct (items, error_code) of a moderator's response (JSON text): its adjusted sections, in order."""

    def item(v: Column) -> Column:
        path = lambda n: f"$.{n}"
        a, p = path("adjusted_provisional_score"), path("adjusted_provisional_score_0_to_100")
        said = lambda n: F.when(is_string(v, path(n)), trimmed(F.try_variant_get(v, path(n), "string")))
        numeric = (missing(v, a) | number(v, a).isNotNull()) & (missing(v, p) | number(v, p).isNotNull())
        return F.struct(F.coalesce(said("section_label"), F.lit("")).alias("section_label"), said("rationale").alias("rationale"), F.round(number(v, a), 2).alias("absolute"), F.round(number(v, p), 2).alias("percent"), (~missing(v, a) & ~missing(v, p)).alias("both"), numeric.alias("numeric")).cast(_ITEM)

    def read(v: Column) -> Column:
        listed = F.try_variant_get(v, "$.adjusted_sections", "array<variant>")
        error = F.when(v.isNull(), "not_json").when(listed.isNull(), "invalid_adjusted_sections")
        return F.struct(F.transform(listed, item).alias("items"), error.alias("error_code"))

    return bound(F.try_parse_json(content), read)


def moderated_parts(parts: DataFrame, answers: DataFrame, *key: str) -> DataFrame:
    """Parts (key, part_idx, label, max_mark, score) with what a moderator's answer (key, content) makes of them: new_score, delta,
    rationale and error_code.

    A label that the submission has not, a missing rationale, scores on both scales, one that is no number or out of range is an error, and an
    error in any item leaves the whole submission as it was. A part with a maximum is adjusted by an absolute score, another by a
    percentage; one that is not named keeps its score. Of items of one label the last counts."""
    listed = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part_idx", t.label_key(F.col("label")).alias("k"), "label", F.col("max_mark").cast("double").alias("max_mark"), F.col("score").cast("double").alias("score")))).alias("_parts"))
    rows = listed.join(answers.select(*key, adjustments(F.col("content")).alias("_a")), list(key), "left")
    rows = rows.withColumn("_items", F.transform(F.coalesce("_a.items", F.array().cast(f"array<{_ITEM}>")), lambda x: F.struct(t.label_key(x["section_label"]).alias("k"), x.alias("x"))))
    named = lambda x: F.get(F.filter("_parts", lambda p: p["k"] == x["k"]), F.lit(0))

    def wrong(x: Column) -> Column:
        def code(p: Column) -> Column:
            y = x["x"]
            value, top = F.when(p["max_mark"].isNotNull(), y["absolute"]).otherwise(y["percent"]), F.coalesce(p["max_mark"], F.lit(100.0))
            return (
                F.when(p.isNull(), "unknown_label").when(F.coalesce(y["rationale"], F.lit("")) == "", "no_rationale").when(y["both"], "both_scales").when(~y["numeric"], "score_not_numeric").when(~F.coalesce(value.between(0, top), F.lit(True)), "score_out_of_range")
            )

        return bound(named(x), code)

    errors = F.filter(F.transform("_items", wrong), lambda e: e.isNotNull())
    rows = rows.withColumn("_error", F.coalesce("_a.error_code", F.get(errors, F.lit(0))))

    def judged(p: Column) -> Column:
        mine = F.get(F.reverse(F.filter("_items", lambda x: x["k"] == p["k"])), F.lit(0))["x"]

        def made(x: Column) -> Column:
            new = F.coalesce(F.when(F.col("_error").isNull(), F.when(p["max_mark"].isNotNull(), x["absolute"]).otherwise(x["percent"])), p["score"])
            said = F.when(F.col("_error").isNull(), F.coalesce(x["rationale"], F.lit(NO_CHANGE)))
            return F.struct(p["part_idx"].alias("part_idx"), p["label"].alias("label"), p["score"].alias("score"), new.alias("new_score"), F.round(new - p["score"], 2).alias("delta"), said.alias("rationale"))

        return bound(mine, made)

    return rows.select(*key, F.explode(F.transform("_parts", judged)).alias("_p"), F.col("_error").alias("error_code")).select(*key, "_p.*", "error_code")
