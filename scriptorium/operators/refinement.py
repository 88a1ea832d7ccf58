"""Rounds of verification of an assessment's rubrics (N19, N20, A4): units that a verifier improves, until all are acceptable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import responses, scorers
from scriptorium.operators.responses import VERIFIER_FAILED

#: N20. Fixed value: rounds at most.
ROUNDS = 3
#: A verifier that gave no usable object is asked once more.
RETRY_RUBRIC = ("no_object", "invalid_object", "not_an_object", "no_rubric_text", "invalid_issues", "invalid_confidence", "confidence_out_of_range")
SYSTEM = "You check one unit of a rubric. Answer with one JSON object: rubric_text, issues, confidence_0_to_100."

_UNIT = ("rubric_text", "confidence", "issues")


def verification_requests(units: DataFrame, model: str, profile: str = "rubric_verification") -> DataFrame:
    """Units (label, rubric_text, issues, and others) with profile and body."""
    payload = F.to_json(F.struct(F.col("label").alias("unit"), F.coalesce("rubric_text", F.lit("")).alias("rubric_text"), F.coalesce("issues", F.array().cast("array<string>")).alias("known_issues")))
    return units.withColumns({"profile": F.lit(profile), "body": scorers.body(model, F.lit(profile), ("system", F.lit(SYSTEM)), ("user", F.concat(F.lit("unit_payload:\n"), payload)))})


def _checked(read: DataFrame) -> DataFrame:
    """What a verifier's object makes of a unit, and why it is none."""
    none = F.array().cast("array<string>")
    found = read.withColumn("_new", responses.verified_rubric(F.col("content"), F.col("rubric_text"), none))
    why = F.get(F.filter("_new.issues", lambda x: x.startswith(VERIFIER_FAILED)), F.lit(0))
    return found.withColumn("error_code", F.trim(F.substring(why, len(VERIFIER_FAILED) + 1, 1 << 20)))


def verified(units: DataFrame, scorer: scorers.Scorer, model: str) -> DataFrame:
    """Units with candidate, struct (rubric_text, confidence, issues). A verifier that fails leaves the text, takes the confidence
    to 0 and adds an issue, and no unit is lost."""
    out = scorers.answers(verification_requests(units, model), scorer, _checked, RETRY_RUBRIC)
    failed = F.struct(F.col("rubric_text"), F.lit(0.0).alias("confidence"), F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.array(F.concat(F.lit(VERIFIER_FAILED + " "), F.col("error_code")))).alias("issues"))
    return out.select(*units.columns, F.when(F.col("error_code").isNull(), F.col("_new")).otherwise(failed).alias("candidate"))


def acceptable(units: DataFrame, key: str) -> DataFrame:
    """key of the assessments whose units are all well enough."""
    return responses.preparation(units, key).where("acceptable").select(key)


def refined_in_rounds(units: DataFrame, scorer: scorers.Scorer, model: str, key: str = "assessment", rounds: int = ROUNDS) -> DataFrame:
    """Units (key, label, rubric_text, confidence, issues) after up to `rounds` rounds, with attempts (rounds that their assessment
    took part in), accepted and rejected (audits).

    The first round's candidates stand as they are; later ones replace a unit only if they score higher. After each round the
    assessments whose units are all acceptable are settled and drop out; no round is made where none is left."""
    audits = F.array().cast("array<string>")
    pending = units.withColumns({"accepted": audits, "rejected": audits})
    settled = []
    for nth in range(1, rounds + 1):
        seen = verified(pending, scorer, model)
        old, new = F.struct(*(F.col(c) for c in _UNIT)), F.col("candidate")
        if nth == 1:
            seen = seen.withColumns({c: new[c] for c in _UNIT}).drop("candidate")
        else:
            seen = seen.withColumn("_r", responses.refined(old, new, F.lit(nth))).withColumn("_changed", _differs(old, new))
            take = F.col("_r.accepted")
            noted = lambda name, when: F.when(when & F.col("_changed"), F.concat(F.col(name), F.array(F.col("_r.audit")))).otherwise(F.col(name))
            seen = seen.withColumns({"accepted": noted("accepted", take), "rejected": noted("rejected", ~take)})
            seen = seen.withColumns({c: F.when(take, new[c]).otherwise(F.col(c)) for c in _UNIT}).drop("candidate", "_r", "_changed")
        seen = scorers.kept(seen.withColumn("attempts", F.lit(nth)))
        if nth == rounds:
            settled.append(seen)
            break
        done = scorers.kept(acceptable(seen, key))
        settled.append(seen.join(done, key, "left_semi"))
        pending = seen.join(done, key, "left_anti").drop("attempts")
        if pending.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _differs(old: Column, new: Column) -> Column:
    return (F.trim(old["rubric_text"]) != F.trim(new["rubric_text"])) | ~old["confidence"].eqNullSafe(new["confidence"]) | ~old["issues"].eqNullSafe(new["issues"])
