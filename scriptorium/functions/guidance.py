"""What marking guidance says to scorers: anchors, scoring rules, summaries, inference profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import any_of, collapse

# Results depend on them word for word.
ANCHORS = (
    (("evidence", "reference", "page", "source", "support", "quote", "cited"), "Support is missing, vague, or not tied to the point.", "Support is specific and linked to the point being made."),
    (("judgement", "tradeoff", "qualification", "counterargument", "appraisal", "proportionate"), "Discussion stays descriptive or one-sided.", "Judgement is clear, balanced, and appropriately qualified."),
    (("working", "algebra", "derivation", "equation", "specification", "variable", "method"), "Method is incomplete or materially wrong.", "Method is complete, consistent, and materially correct."),
    (("interpret", "explain", "reasoning", "mechanism", "why", "comparison"), "Explanation is vague or does not follow from the setup.", "Explanation is clear and follows from the setup."),
    (("covers", "complete", "components", "steps", "gap"), "Required parts are missing or only partly attempted.", "Required parts are covered without material gaps."),
    (("addresses", "states", "defines", "identifies", "response"), "Misses the task or treats it only loosely.", "Directly addresses the task in the way asked."),
)
ANY_ANCHOR = ("Performance on this criterion is weak or incomplete.", "Performance on this criterion is secure and well supported.")
RULES = (
    (("first", "2:1", "2:2", "third/pass", "missing/unfinished", "fail"), "Choose the quality band first, then place the score within it."),
    (("partial credit", "algebra", "equation", "deriv", "method", "interpretation"), "Give partial credit for correct setup, method, or interpretation."),
    (("reference", "references", "page number", "page numbers", "quote", "quotes"), "Reward specific references when the task asks for them."),
    (("rewrite", "own tone", "own words", "correct any mistakes", "edit the output"), "Reward justified correction and rewriting when asked."),
)
NO_ATTEMPT = "If a response contains no relevant attempt, no attempt at the required method, or only unrelated content, award zero or minimal credit."
NO_GUIDANCE = "Assess the unit against the stated task."
PROFILE = {"temperature": 0.0, "top_p": 0.85, "num_ctx": 8192, "seed": 7, "num_predict": 900}
PROFILES = {
    "structure_extraction": {"top_p": 0.8, "num_predict": 700},
    "rubric_verification": {"top_p": 0.8, "num_predict": 700},
    "verification": {"top_p": 0.8, "num_predict": 700},
    "detector_small": {"num_ctx": 4096, "top_p": 0.75, "num_predict": 320},
    "part_scoring": {"temperature": 0.05, "num_predict": 1100},
    "moderation": {"temperature": 0.05, "num_predict": 1100},
    "final_result": {"temperature": 0.05, "num_predict": 1100},
}
# End of the fixed values.


def anchors(criterion: Column) -> Column:
    """Struct (weak, strong) by the first family of words that the criterion names; null counts as empty."""
    low = F.lower(F.coalesce(criterion, F.lit("")))
    pair = lambda weak, strong: F.struct(F.lit(weak).alias("weak"), F.lit(strong).alias("strong"))
    return F.coalesce(*(F.when(any_of(low, words), pair(weak, strong)) for words, weak, strong in ANCHORS), pair(*ANY_ANCHOR))


def scoring_rules(guidance: Column) -> Column:
    """The rules whose words the guidance names, and always the one on responses without an attempt."""
    low = F.lower(F.coalesce(guidance, F.lit("")))
    return F.array_compact(F.array(*(F.when(any_of(low, words), F.lit(rule)) for words, rule in RULES), F.lit(NO_ATTEMPT)))


def guidance_summary(guidance: Column, most: int = 220) -> Column:
    """The first sentence of the collapsed guidance, cut to `most` code points; a stock phrase where there is none."""
    flat = collapse(F.coalesce(guidance, F.lit("")))
    return F.when(flat == "", NO_GUIDANCE).otherwise(F.rtrim(F.substring(F.split(flat, r"(?<=[.!?])\s+", 2)[0], 1, most)))


def profile(name: Column, option: str) -> Column:
    """An option of an inference profile; names that are not known, and null, have the common one."""
    own = [x for pair in PROFILES.items() if option in pair[1] for x in (F.lit(pair[0]), F.lit(float(pair[1][option])))]
    common = F.lit(float(PROFILE[option]))
    return F.coalesce(F.try_element_at(F.create_map(*own), name), common) if own else common
