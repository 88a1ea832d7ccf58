"""Scalar text functions (T*): pure Column to Column, no Python on executors."""

from __future__ import annotations

import functools
import operator
import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that only some engines count.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The same, but for single spaces, which collapse() would put back as they are.
RUNS = r"(?U)[\s\x1c-\x1f](?:(?<! )[\s\x1c-\x1f]*+|[\s\x1c-\x1f]++)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is a part of the text. Places where none can begin are passed over before the words are tried."""
    return text.rlike(f"(?=[{re.escape(''.join(sorted({w[0] for w in words})))}])(?:{'|'.join(map(re.escape, words))})")


#: What surrounds trimmed lines that are not blank: each run of blanks and line ends that begins or ends the text or has a line end.
#: Nothing in it is tried twice.
_AROUND_LINES = r"(?=[ \t\x0b\x0c\u00a0\r\n])(?<![ \t\x0b\x0c\u00a0\r\n])(?:\A[ \t\x0b\x0c\u00a0\r\n]++|[ \t\x0b\x0c\u00a0]*+(?:[\r\n][ \t\x0b\x0c\u00a0\r\n]*+|\z))"


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not blank. One pass over the text and no lambda: split() compiles any pattern but a single character anew
    for each row."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _AROUND_LINES, "\n"), "\n"), "")


def trimmed_lines(lines: Column) -> Column:
    """Lines trimmed, without those that are then blank."""
    return F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(" \t\x0b\x0c\u00a0"))), lambda x: x != "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, RUNS, " "))


def label_key(label: Column) -> Column:
    """The join key of sections, units and parts."""
    return F.lower(collapse(label))


def word_count(text: Column) -> Column:
    """T2."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != ""))


def low_text(text: Column) -> Column:
    """Under 120 words."""
    return word_count(text) < 120


def extraction_issue(text: Column) -> Column:
    """Under 80 words, or a character nine times in a row on one line."""
    return (word_count(text) < 80) | F.coalesce(text, F.lit("")).rlike(r"(.)\1{8,}")


def damaged(text: Column) -> Column:
    """An ellipsis of dots, two glued words, or a run of 16 small letters. The patterns are fixed values."""
    glued = F.size(F.regexp_extract_all(text, F.lit(r"[a-z]{6,}[A-Z][a-z]+"), F.lit(0))) >= 2
    return F.contains(text, F.lit("...")) | glued | text.rlike(r"[a-z]{16,}")


def truncated(text: Column, most: int) -> Column:
    """Collapsed, and cut with dots where longer than `most`."""
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most - 3), r"[ ,;:]+$", ""), F.lit("..."))).otherwise(flat)


#: T7. Fixed value: a weight, before or after its words. What follows a per cent sign keeps most of them out.
WEIGHT = r"(?i)(\d+(?:\.\d+)?)\s*(marks?|points?|%)\b|\b(?:worth|allocated|allocation|available)\s+(\d+(?:\.\d+)?)\s*(marks?|points?|%)\b"
#: The same, passing over places where no weight can begin.
_WEIGHT = rf"(?i)(?=[\dwa])(?:{WEIGHT})"


def _number(found: Column) -> Column:
    return F.regexp_extract(found, r"[0-9]+(?:\.[0-9]+)?", 0)


def weight_found(text: Column) -> Column:
    """The first weight with its words, else empty."""
    return F.regexp_extract(text, _WEIGHT, 0)


def mark_in(found: Column) -> Column:
    """The number of what weight_found() gave; a per cent is no mark."""
    return F.when((found != "") & ~F.endswith(found, F.lit("%")), _number(found).cast("double"))


def weight_in(found: Column) -> Column:
    """Number and unit of what weight_found() gave, else empty."""
    return F.when(found != "", F.concat_ws(" ", _number(found), F.regexp_extract(found, "(?:[A-Za-z]+|%)$", 0))).otherwise("")


def mark_of(text: Column) -> Column:
    """The number of the first weight; a per cent is no mark. The text is searched once."""
    return bound(weight_found(text), mark_in)


def weight_of(text: Column) -> Column:
    """Number and unit of the first weight, else empty."""
    return bound(weight_found(text), weight_in)


def goal_fragment(text: Column, most: int) -> Column:
    """A leading 'N. [x marks]' and the closing stop are left out, then cut like truncated()."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^\d+\.\s*(?:\[\d+(?:\.\d+)?\s*marks?\])?\s*", ""), r"\.+$", "")
    return F.when(F.length(bare) > most, F.concat(F.regexp_replace(F.substring(bare, 1, most - 3), r"[ ,;:]+$", ""), F.lit("..."))).otherwise(bare)


#: T4. The shapes in which a document states its maximum mark.
MAX_MARK = (
    r"(?i)maximum\s+mark\s*(?:is|=|:)?\s*(\d+(?:\.\d+)?)",
    r"(?i)max(?:imum)?\s+mark\s*(?:is|=|:)?\s*(\d+(?:\.\d+)?)",
    r"(?i)single\s+overall\s+mark\s+out\s+of\s*(\d+(?:\.\d+)?)",
    r"(?i)mark\s+out\s+of\s*(\d+(?:\.\d+)?)",
    r"(?i)out\s+of\s*(\d+(?:\.\d+)?)",
    r"(?i)total\s+(?:mark|marks)\s*(?:is|=|:)?\s*(\d+(?:\.\d+)?)",
)


def max_marks(*texts: Column) -> Column:
    """T4: all maximum marks that texts state, distinct and sorted. None: nothing is stated; several: they are in conflict."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(p), F.lit(1)) for x in texts for p in MAX_MARK)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def context_check(rubric: Column, brief: Column, scheme: Column, manual: Column) -> Column:
    """T5: struct (max_mark, error_code). A rubric or a scheme must be there; a maximum given by hand needs no other."""
    found = max_marks(rubric, scheme, brief)
    bare = F.trim(F.concat_ws("", rubric, scheme)) == ""
    error = F.when(bare, "no_rubric_or_scheme").when(manual.isNotNull(), None).when(F.size(found) == 0, "no_max_mark").when(F.size(found) > 1, "conflicting_max_marks")
    most = F.when(~bare & manual.isNotNull(), manual.cast("double")).when(~bare & (F.size(found) == 1), F.get(found, F.lit(0)))
    return F.struct(most.alias("max_mark"), error.alias("error_code"))


def scale_label(*texts: Column) -> Column:
    """What the documents suggest as a scale. Labels are fixed values."""
    found = max_marks(*texts)
    mark = F.get(found, F.lit(0))
    named = F.when(F.abs(mark - 100) < 1e-9, "Deterministic / numeric (0-100)").when(F.abs(mark - 85) < 1e-9, "Analytical / evaluative (0-85, typical 20-80)")
    return F.when(F.size(found) > 1, "Conflicting document scales").when(F.size(found) == 0, "No document suggestion").otherwise(F.coalesce(named, F.concat(F.lit("Inferred "), clean_number(mark), F.lit("-point scale"))))


def signature(text: Column, words: int = 12) -> Column:
    """The first words of a feedback."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != ""), 1, words), " ")


def error_signature(message: Column, label: Column) -> Column:
    """The label becomes a place-holder; collapsed, at most 240 characters."""
    return F.substring(collapse(F.replace(message, label, F.lit("Part <section>"))), 1, 240)


def slug(text: Column) -> Column:
    """T36."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def clean_number(x: Column) -> Column:
    """Whole numbers without a point, others to two places without closing zeros."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).when(x.isNotNull(), F.regexp_replace(F.format_string("%.2f", x), r"0$", ""))


def canonical_label(label: Column) -> Column:
    """T34: 'question iv' becomes 'Question IV'; a label of one word stays, as does a second word that is not of letters alone (3a)."""
    second = lambda words: F.get(words, F.lit(1))
    # letters alone need no search for the words in a word
    capital = lambda word: F.when(word.rlike("^[A-Za-z]+$"), F.concat(F.translate(F.substring(word, 1, 1), string.ascii_lowercase, string.ascii_uppercase), F.lower(F.substring(word, F.lit(2), F.length(word))))).otherwise(F.initcap(word))
    made = lambda words: F.when(F.size(words) < 2, F.trim(label)).otherwise(F.concat(capital(words[0]), F.lit(" "), F.when(second(words).rlike(r"^\p{L}+$"), F.upper(second(words))).otherwise(second(words))))
    return bound(F.split(collapse(label), " "), made)


#: T34. Labels that point at another section and name none.
PLACEHOLDERS = ("section above", "section below", "answer above", "answer below", "above", "below")


def placeholder(label: Column) -> Column:
    return label_key(label).isin(*PLACEHOLDERS)


def clean_question(text: Column) -> Column:
    """Hyphenation undone, suggested word counts, a leading label with its marks and the closing stop removed. The patterns are
    fixed values."""
    joined = collapse(F.regexp_replace(F.trim(text), r"(\w)-\s+(\w)", "$1$2"))
    without = F.trim(F.regexp_replace(joined, r"(?i)\[\s*suggested\s+word\s+count\s*:[^\]]*\]", ""))
    label = r"(?i)^(?:part|question|section)\s+[a-z0-9ivx]+(?:\s+q[a-z0-9ivx]+)?\s*(?:\(\d+(?:\.\d+)?\s*marks?\))?\s*"
    return F.regexp_replace(F.trim(F.regexp_replace(without, label, "")), r"\.+$", "")


def keywords(text: Column) -> Column:
    """T41."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def markdown_cleaned(text: Column) -> Column:
    """Marks of markup out, lines of digits out, at most one blank line in a row."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), r"\*\*|__|`|#+", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit("|"), F.lit(" ")), r"[ \t]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\d+$")), "\n"), r"\n{3,}", "\n\n"), F.lit("\n"))


#: T12. Ordered rules; the first of which every group has a word in the text names the task.
TASKS = (
    ("critique_and_revision", (("generate", "draft", "produce"), ("summary", "answer", "response"), ("comment on whether", "review", "critique", "evaluate accuracy", "rewrite", "revise", "edit", "correct"))),
    ("model_specification", (("write out", "write down", "state", "specify", "formulate"), ("payoff function", "utility function", "objective function", "formal model", "formal specification"))),
    ("comparative_statics", (("parameter", "parameters"), ("more likely", "less likely", "increases", "decreases", "higher", "lower"), ("scenario", "outcome", "equilibrium"))),
    ("regression_specification", (("regression equation", "empirical specification", "estimating equation", "econometric specification"), ("write down", "state", "specify", "formulate"))),
    ("deterministic_derivation", (("derive", "show that", "solve for", "prove that"), ("condition", "equilibrium", "solution"))),
    ("welfare_reasoning", (("welfare", "well-being", "wellbeing", "efficiency"), ("condition", "implication", "effect", "impact"))),
    ("prediction_generation", (("list", "state", "give", "identify"), ("prediction", "predictions", "implication", "implications", "testable hypothesis"))),
    ("measurement_and_data_design", (("measure", "measured", "measurement", "operationalise", "operationalize", "indicator", "observable", "observed"), ("data source", "data sources", "dataset", "datasets", "real world", "practice", "in practice"))),
    ("causal_identification", (("endogeneity", "omitted variable", "reverse causality", "selection bias", "simultaneity", "confounding"),)),
    ("synthesis_across_sources", (("source", "sources", "material", "materials", "article", "articles", "video", "videos", "case", "cases"), ("claim", "claims", "argument", "arguments", "compare", "contrast", "synthes", "shed light on"))),
    ("synthesis_across_sources", (("model", "framework", "theory"), ("missing from", "omission", "omissions", "limitations", "extend", "extension"))),
    ("evaluative_discussion", (("discuss", "evaluate", "comment on whether", "whether you think", "critically assess", "good idea"),)),
    ("explanation_interpretation", (("explain how changing", "explain carefully why", "discuss the intuition", "explain how each term", "explain how each variable", "interpret the coefficient", "interpret the result", "explain the mechanism"),)),
    ("evaluative_discussion", (("summary", "overview", "comment", "assess"),)),
)
#: T13, T14. Tasks that are judged as a whole; words of guidance that tell how to grade where no task does.
ABSTRACT = ("critique_and_revision", "evaluative_discussion", "synthesis_across_sources", "whole_submission_holistic")
STEPWISE = ("comparative_statics", "model_specification", "deterministic_derivation", "explanation_interpretation", "welfare_reasoning", "prediction_generation", "measurement_and_data_design", "regression_specification", "causal_identification")
STEPWISE_WORDS = ("derive", "equation", "regression", "condition", "hypothesis", "measure", "data source", "calculate", "show carefully", "parameter", "endogeneity")
WHOLE_WORDS = ("summary", "discuss", "evaluate", "commentary", "in your own words", "good idea", "critically assess", "justify your conclusion", "comment on whether", "compare and contrast")


def task_type(label: Column, question: Column) -> Column:
    """A derivation where no rule holds. Words are looked for as parts: "state" is in "estate" too."""

    def ruled(low: Column) -> Column:
        held = lambda words: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(low, x))
        out = F.lit("deterministic_derivation")
        for name, groups in reversed(TASKS):
            out = F.when(functools.reduce(operator.and_, map(held, groups)), name).otherwise(out)
        return out

    return bound(F.lower(collapse(F.concat_ws("\n", label, question))), ruled)


def criterion_mode(task: Column) -> Column:
    """T13."""
    return F.when(task.isin(*ABSTRACT), "abstract").otherwise("deterministic")


def grading_mode(task: Column, label: Column, guidance: Column) -> Column:
    """By the task, else deterministic words before analytical ones."""
    low = F.lower(F.concat_ws("\n", label, guidance))
    by_word = F.when(any_of(low, STEPWISE_WORDS), "deterministic").when(any_of(low, WHOLE_WORDS), "analytical").otherwise("deterministic")
    return F.when(task.isin(*ABSTRACT), "analytical").when(task.isin(*STEPWISE), "deterministic").otherwise(by_word)


#: T15. How guidance refers back to earlier work.
BACK = (
    r"\busing\s+(?:your|the|previous|earlier)\s+(?:answer|result|results|work|analysis|model|derivation|prediction|predictions|evidence)\b",
    r"\busing\s+the\s+\w+\s+(?:model|results|answer|analysis)\s+from\s+(?:question|part|section)\s+\w+\b",
    r"\bfrom\s+(?:your|the|previous|earlier)\s+(?:answer|result|results|work|analysis|model|derivation|prediction|predictions|evidence)\b",
    r"\bbased on\s+(?:your|the|previous|earlier)\s+(?:answer|result|results|work|analysis|model|derivation|prediction|predictions|evidence)\b",
    r"\bgiven\s+(?:your|the)\s+(?:answer|result|results|work|analysis|model|derivation)\b",
    r"\bas\s+(?:shown|derived|established)\s+in\s+(?:your|the)\s+(?:answer|work|analysis)\b",
    r"\b(question|part|section)\s+\w+\s+(?:above|earlier|previously)\b",
    r"\byour\s+(?:answer|result|results|work|analysis)\s+to\s+(?:question|part|section)\s+\w+\b",
    r"\bprediction[s]?\s+from\s+your\s+answer\b",
    r"\bfrom\s+the\s+model\s+above\b",
)


def dependency_group(text: Column, label: Column, parent: Column) -> Column:
    """The key of the parent, else of the unit itself, where its text refers back; else empty."""
    return F.when(F.lower(collapse(text)).rlike("|".join(BACK)), label_key(F.coalesce(F.nullif(parent, F.lit("")), label))).otherwise("")


#: T16. Fixed value: a part by its number, roman numbers too, and maybe its child.
NAMED = r"(?i)\b((?:part|question|section)\s+(?:\d+|[ivx]+)(?:\s*q\d+)?)\b"


def dependency_labels(text: Column, own: Column, key: Column | None = None) -> Column:
    """Keys of the labels that a text names, in order, each once, without its own (label, or its key where that is known)."""
    named = lambda x: label_key(F.regexp_replace(x, r"(?i)(\s+(?:\d+|[ivx]+))\s*q(\d+)$", "$1 q$2"))
    others = lambda found, key: F.filter(F.array_distinct(F.transform(found, named)), lambda x: x != key)
    kept = lambda found: F.when(F.size(found) > 0, others(found, key) if key is not None else bound(label_key(own), lambda k: others(found, k))).otherwise(found)
    return bound(F.regexp_extract_all(text, F.lit(f"(?i)(?=[pqs]){NAMED}"), F.lit(1)), kept)


#: T17. What shows that a line directs the answer, or asks for evidence.
ANCHOR_CUES = ("use ", "using ", "comment on whether", "discuss", "explain", "identify", "support", "qualify", "contradict", "rewrite", "in your own", "use the results")
EVIDENCE_CUES = ("quote", "quotes", "page", "slide", "reference", "references", "data source", "link", "evidence", "report", "course material", "lecture")


def cued_lines(text: Column, cues: tuple[str, ...], most: int = 4) -> Column:
    """The first lines with a cue."""
    return cued(lines_of(text), cues, most)


def cued(lines: Column, cues: tuple[str, ...], most: int = 4) -> Column:
    """Of lines that lines_of() gave."""
    return F.slice(F.filter(lines, lambda x: any_of(F.lower(x), cues)), 1, most)


#: T18. Fixed values.
GUIDANCE = (r"\b(question|part|section|subsection|subpart|task|item)\s+[a-z0-9ivx]+\b", r"\b\d+(?:\.\d+)?\s*(marks?|points?|%)\b", r"\b(weight|weights|weighting|worth|allocated|allocation|available)\b", r"\bout of\s+\d+\b")


def structure_guidance(*texts: Column) -> Column:
    """The first 12 lines of the marking documents that say something of structure or marks."""
    return F.array_join(F.slice(F.filter(lines_of(F.concat_ws("\n\n", *texts)), lambda x: x.rlike("(?i)" + "|".join(GUIDANCE))), 1, 12), "\n")


#: T39, D3. A section's header, the number or letter of a subpart's first line, and such a line.
TOP_HEADER = r"(?i)^((?:question|part|section|task|item)\s+(?:\d+|[ivx]+|[a-z]))\b(.*)$"
SUBPART_TOKEN = r"(?i)^\(?(\d+|[a-z])"
SUBPART = r"(?i)^((?:\d+|[a-z])(?:[.)]|\])|\((?:\d+|[a-z])\))\s*(.*)$"


def is_header(line: Column) -> Column:
    """A label, and a weight, nothing else or at most 32 characters in all."""
    tail = F.regexp_replace(collapse(F.regexp_extract(line, TOP_HEADER, 2)), r"^[ :.\-]+|[ :.\-]+$", "")
    return line.rlike(TOP_HEADER) & ((F.length(line) <= 32) | line.rlike(_WEIGHT) | (tail == ""))


#: T39. How lines of marking instructions begin, and what is in them.
MARKING_STARTS = ("students should", "student should", "marks should", "mark should", "for full mark", "for a high grade", "points that should", "key elements", "references should", "references to", "note:", "high grade")
MARKING_PHRASES = ("marks should be allocated", "should be allocated", "are expected to", "should mention", "should provide", "for full mark", "high grade would", "key elements for a high grade")


def is_marking_line(line: Column) -> Column:
    return bound(F.lower(F.trim(line)), lambda low: low.rlike("^(?:" + "|".join(map(re.escape, MARKING_STARTS)) + ")") | any_of(low, MARKING_PHRASES))


def header_only(text: Column) -> Column:
    """No line, or one that is short or a header."""
    lines = lines_of(text)
    return (F.size(lines) == 0) | ((F.size(lines) == 1) & ((F.length(F.get(lines, F.lit(0))) <= 40) | F.get(lines, F.lit(0)).rlike(TOP_HEADER)))


def numbered_items(text: Column) -> Column:
    """Items after '1. ', '2. ', if there are two or more."""
    cut = F.split(F.concat(F.lit(" "), text), r"\s\d+\.\s+")
    items = F.filter(F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^[ ;.]+|[ ;.]+$", "")), lambda x: x != "")
    return F.when(F.size(cut) > 2, items).otherwise(F.array().cast("array<string>"))


def bracketed_items(text: Column) -> Column:
    """Items after (1), (2)."""
    found = F.regexp_extract_all(text, F.lit(r"\(\d+\)\s*([^()]+?)(?=\s*\(\d+\)|$)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(collapse(x), r"^[ ;,.]+|[ ;,.]+$", "")), lambda x: x != "")


#: T10. Fixed values.
RICH_PHRASES = ("for each", "give an example", "explain why", "define each", "state the hypothesis", "more likely than")


def needs_context(question: Column) -> Column:
    """Two numbered items or more, or a phrase that asks for more than one thing."""
    cleaned = clean_question(question)
    return F.coalesce((cleaned != "") & ((F.size(numbered_items(cleaned)) >= 2) | any_of(F.lower(cleaned), RICH_PHRASES)), F.lit(False))


def incomplete(section: Column, question: Column) -> Column:
    """T11."""
    flat = collapse(section)
    return (flat == "") | damaged(flat) | (F.length(flat) < 120) | (needs_context(question) & (F.length(flat) < 260))


def part_breakdown(comments: Column) -> Column:
    """T35: 'Part 1 Q2: 7/10' in a marker's comments to a map of labels and scores; of one label the last counts."""
    p = r"(?i)(Part\s+\d+(?:\s+Q\d+)?):\s*([0-9]+(?:\.[0-9]+)?)/[0-9]+(?:\.[0-9]+)?"
    labels = F.transform(F.regexp_extract_all(comments, F.lit(p), F.lit(1)), lambda x: F.initcap(collapse(x)))
    scores = F.regexp_extract_all(comments, F.lit(p), F.lit(2))
    every = F.arrays_zip(labels.alias("label"), F.transform(scores, lambda x: x.cast("double")).alias("score"))
    last = F.filter(every, lambda x, i: ~F.exists(F.slice(labels, i + 2, F.size(labels)), lambda y: y == x["label"]))
    return F.map_from_entries(last)


def marking_text(scheme: Column, brief: Column, sample: Column, other: Column) -> Column:
    """The documents that marking rests on, under headings, blank ones left out."""
    named = (("Marking scheme", scheme), ("Assignment brief", brief), ("Graded sample", sample), ("Other context", other))
    return F.concat_ws("\n\n", *(F.when(F.trim(x) != "", F.concat(F.lit(f"{n}:\n"), F.trim(x))) for n, x in named))
