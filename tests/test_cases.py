"""Text functions on literal cases, with what they give written by hand."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import guidance
from scriptorium.functions import text as t
from scriptorium.operators import responses, rubrics
from scriptorium.sources import documents


def _mode(x):
    task = t.task_type(F.lit("Part 1"), x)
    return F.concat_ws("|", task, t.criterion_mode(task), t.grading_mode(task, F.lit("Part 1"), x))


def _check(x):
    found = t.context_check(F.split(x, "@")[0], F.lit("brief"), F.split(x, "@")[1], F.nullif(F.split(x, "@")[2], F.lit("")))
    return F.concat_ws("|", F.coalesce(t.clean_number(found["max_mark"]), F.lit("-")), F.coalesce(found["error_code"], F.lit("ok")))


def _verified(x):
    v = responses.verification(x)
    return F.coalesce(v["error_code"], F.concat_ws("|", v["agreement"], v["confidence"].cast("int").cast("string"), F.array_join(v["issues"], "+"), v["recommendation"]))


def _rubric(x):
    v = responses.verified_rubric(x, F.lit("old text"), F.array(F.lit("old issue")))
    return F.concat_ws("|", v["rubric_text"], v["confidence"].cast("int").cast("string"), F.array_join(v["issues"], "+"))


def _notes(x):
    n = responses.criterion_notes(x, F.array(F.lit("Accuracy"), F.lit("Depth")), F.lit("likert_judgement"), F.array(*map(F.lit, ("weak", "developing", "clear", "strong"))))
    said = F.transform(n["notes"], lambda y: F.concat_ws(":", y["criterion_name"], y["status"], y["normalized_status"], y["note"]))
    return F.coalesce(n["error_code"], F.array_join(said, "|"))


def _matrix(x):
    said = F.transform(rubrics.matrix_rows(x), lambda r: F.concat_ws("/", *(F.replace(r[c], F.lit("\n"), F.lit("+")) for c in _MATRIX)))
    return F.array_join(said, ";")


_MATRIX = ("section", "unit", "max_mark", "mode", "classification_question", "ranking_rule", "criteria_sentences", "band", "descriptor", "within_band_placement")
_LONG = "word " * 60

#: name: (column of the text, ((text, what it gives), ...))
CASES = {
    "task_type_ladder": (_mode, (
        ("Draft an answer, then critique it", "critique_and_revision|abstract|analytical"),
        ("State the utility function of the firm", "model_specification|deterministic|deterministic"),
        ("Which parameter makes this outcome more likely", "comparative_statics|deterministic|deterministic"),
        ("Write down the regression equation", "regression_specification|deterministic|deterministic"),
        ("Derive the condition", "deterministic_derivation|deterministic|deterministic"),
        ("What is the effect on welfare", "welfare_reasoning|deterministic|deterministic"),
        ("List two predictions", "prediction_generation|deterministic|deterministic"),
        ("How would you measure it in practice", "measurement_and_data_design|deterministic|deterministic"),
        ("Is there omitted variable bias", "causal_identification|deterministic|deterministic"),
        ("Compare the articles", "synthesis_across_sources|abstract|analytical"),
        ("What is missing from the theory", "synthesis_across_sources|abstract|analytical"),
        ("Do you find it a good idea", "evaluative_discussion|abstract|analytical"),
        ("Explain carefully why", "explanation_interpretation|deterministic|deterministic"),
        ("Give an overview", "evaluative_discussion|abstract|analytical"),
        ("Tell it", "deterministic_derivation|deterministic|deterministic"),
    )),
    "dependency_group": (lambda x: t.dependency_group(x, F.lit("Part 2 Q1"), F.lit("Part 2")), (
        ("Using your results, go on", "part 2"), ("based on  the evidence", "part 2"), ("As derived in the work", "part 2"), ("see question 3 above", "part 2"),
        ("your answer to part b", "part 2"), ("predictions from your answer", "part 2"), ("from the model above", "part 2"), ("given the answer", "part 2"), ("using a model", ""), ("answer part 3", ""),
    )),
    "dependency_labels": (lambda x: F.array_join(t.dependency_labels(x, F.lit("Part 3")), "|"), (
        ("Part 2, part 3 and PART 2", "part 2"), ("see Question iv q2 or section 1Q3", "question iv q2|section 1 q3"), ("partly 4", ""), ("question 12", "question 12"),
    )),
    "context_check": (_check, (
        (" @ @", "-|no_rubric_or_scheme"), ("out of 20@@", "20|ok"), ("a@b@", "-|no_max_mark"), ("out of 20@Maximum mark: 30@", "-|conflicting_max_marks"), ("out of 20@Maximum mark: 30@45", "45|ok"), ("@total marks = 12.5@", "12.5|ok"),
    )),
    "scale_suggestion": (lambda x: t.scale_label(x), (
        ("out of 100", "Deterministic / numeric (0-100)"), ("max mark 85", "Analytical / evaluative (0-85, typical 20-80)"), ("out of 12.5", "Inferred 12.5-point scale"), ("out of 30", "Inferred 30-point scale"), ("none", "No document suggestion"), ("out of 3 and out of 4", "Conflicting document scales"),
    )),
    "header_only_text": (lambda x: t.header_only(x).cast("string"), (
        ("", "true"), ("short line", "true"), ("a line that is longer than forty characters are", "false"), ("Question 3 which is longer than forty characters, too", "true"), ("two\nlines", "false"),
    )),
    "richer_context": (lambda x: F.concat_ws("|", t.needs_context(x).cast("string"), F.array_join(t.numbered_items(x), "+"), F.array_join(t.bracketed_items(x), "+")), (
        ("1. one thing; 2. another.", "true|one thing+another|"), ("1. alone", "false||"), ("Explain why it is so", "true||"), ("Question 2 Say (1) this, (2) that.", "false||this+that"), ("", "false||"),
    )),
    "incomplete_section": (lambda x: t.incomplete(F.split(x, "@")[0], F.split(x, "@")[1]).cast("string"), (
        ("@why", "true"), ("short@why", "true"), (f"{_LONG}@why", "false"), (f"{_LONG[:200]}@Give an example", "true"), (f"{_LONG[:200]}@why", "false"), (f"{_LONG} ...@why", "true"),
    )),
    "cued_lines": (lambda x: F.concat_ws("|", F.array_join(t.cued_lines(x, t.ANCHOR_CUES), "+"), F.array_join(t.cued_lines(x, t.EVIDENCE_CUES), "+")), (
        ("Discuss it\nplain\nQuote a page", "Discuss it|Quote a page"), ("explain a\nexplain b\nexplain c\nexplain d\nexplain e", "explain a+explain b+explain c+explain d|"), ("nothing", "|"),
    )),
    "structure_guidance": (lambda x: t.structure_guidance(x, F.lit("out of 5")), (
        ("Question 1\nplain words\nworth much", "Question 1\nworth much\nout of 5"), ("plain", "out of 5"), ("20 points go here", "20 points go here\nout of 5"),
    )),
    "part_breakdown": (lambda x: F.array_join(F.array_sort(F.transform(F.map_entries(t.part_breakdown(x)), lambda e: F.concat_ws("=", e["key"], t.clean_number(e["value"])))), "|"), (
        ("Part 1: 3/5 part 2 q1: 7.5/10", "Part 1=3|Part 2 Q1=7.5"), ("Part 1: 3/5, PART 1: 4/5", "Part 1=4"), ("nothing", ""),
    )),
    "label_helpers": (lambda x: F.concat_ws("|", t.canonical_label(x), t.placeholder(x).cast("string"), t.is_header(x).cast("string"), t.is_marking_line(x).cast("string")), (
        ("question iv", "Question IV|false|true|false"), ("Section  Above", "Section ABOVE|true|false|false"), ("Students should say", "Students SHOULD|false|false|true"), ("Part 2 is about many things in one (20 marks)", "Part 2|false|true|false"), ("Part 2 is about many things that are told", "Part 2|false|false|false"),
    )),
    "goal_fragment": (lambda x: t.goal_fragment(x, 20), (
        ("1. [5 marks] Say it.", "Say it"), ("2. A sentence that is, of course, longer", "A sentence that i..."), ("Fourteen words , ; : long", "Fourteen words..."),
    )),
    "verification_validate": (_verified, (
        ('{"agreement": " agree ", "confidence_0_to_100": 80, "issues": [" a ", "", "b"], "recommendation": "keep"}', "agree|80|a+b|keep"), ("{", "not_json"), ('{"agreement": "yes"}', "invalid_agreement"), ('{"agreement": "agree", "confidence_0_to_100": true}', "invalid_confidence"),
        ('{"agreement": "agree", "confidence_0_to_100": 101}', "confidence_out_of_range"), ('{"agreement": "agree", "confidence_0_to_100": 1, "issues": "x"}', "invalid_issues"), ('{"agreement": "agree", "confidence_0_to_100": 1, "issues": [], "recommendation": " "}', "empty_recommendation"),
    )),
    "rubric_verification": (_rubric, (
        ('{"rubric_text": " new ", "issues": null, "confidence_0_to_100": 90}', "new|90|"), ('{"rubric_text": "new", "issues": ["a"], "confidence_0_to_100": 90}', "new|90|a"), ('{"rubric_text": "", "confidence_0_to_100": 90}', "old text|0|old issue+rubric_verifier_failed: no_rubric_text"),
        ('{"rubric_text": "new", "issues": [" "], "confidence_0_to_100": 9}', "old text|0|old issue+rubric_verifier_failed: invalid_issues"), ('{"rubric_text": "new", "confidence_0_to_100": "9"}', "old text|0|old issue+rubric_verifier_failed: invalid_confidence"), ("no", "old text|0|old issue+rubric_verifier_failed: not_json"),
    )),
    "criterion_notes_validate": (_notes, (
        ('{"Depth": {"status": "met", "note": "One two three four five six."}}', "Accuracy:weak:missed:omitted by model|Depth:clear:met:One two three four five"), ('[{"criterion_name": "Accuracy", "status": "Strong", "note": "fine"}, {"criterion_name": "Depth", "status": "partly", "note": "thin,"}]', "Accuracy:strong:met:fine|Depth:developing:partial:thin"),
        ('{"Other": {"status": "met", "note": "x"}}', "wrong_name"), ('[{"criterion_name": "Depth", "status": "met", "note": "x"}, {"criterion_name": "Depth", "status": "met", "note": "x"}]', "wrong_name"), ('{"Depth": {"status": "superb", "note": "x"}}', "wrong_status"), ('{"Depth": {"status": "met", "note": " . "}}', "blank_note"), ("no", "not_json"),
    )),
    "feedback_render": (lambda x: responses.feedback_text(x), (
        (" plain ", "plain"), ('{"content": [{"section_label": "Part 1", "analysis": "good", "feedback": "more"}, {"feedback": "only"}]}', "Part 1 - good more only"), ('{"content": "x"}', ""),
    )),
    "docx_text_choice": (lambda x: documents.docx_variant(F.split(x, "@")[0], F.split(x, "@")[1]), (
        ("@b", "b"), ("a@b", "a"), ("a <latex> ----media/1@b", "a <latex> ----media/1"), ("a ----media/1@b", "b"), ("a ----media/1@", "a ----media/1"),
    )),
    "docx_headings": (lambda x: documents.heading(F.split(x, "@")[0], F.split(x, "@")[1] == "b", F.nullif(F.split(x, "@")[2], F.lit("")).cast("double"), F.split(x, "@")[3]).cast("string"), (
        ("Part two of it@@@", "true"), ("plain words of a text.@@@", "false"), ("plain words of a text.@b@@", "true"), ("plain words of a text.@@14@", "true"), ("Title Words@@13@", "true"), ("Title Words@@12@", "false"), ("LOUD WORDS!@@@", "true"), ("words@@@Heading 2", "true"), ("Q1a then@@@", "true"), ("@b@@", "false"),
    )),
    "snapshot_names": (lambda x: documents.safe_name(F.lit(7), x), (("a b (1).txt", "007_a_b_1_.txt"), ("ok-1_2.docx", "007_ok-1_2.docx"), ("é", "007__"))),
    "criterion_anchors": (lambda x: F.concat_ws("|", guidance.anchors(x)["weak"], guidance.anchors(x)["strong"]), (
        ("Uses a page as Evidence", "Support is missing, vague, or not tied to the point.|Support is specific and linked to the point being made."),
        ("The method and why it is used", "Method is incomplete or materially wrong.|Method is complete, consistent, and materially correct."),
        ("All steps are told", "Required parts are missing or only partly attempted.|Required parts are covered without material gaps."),
        ("", "Performance on this criterion is weak or incomplete.|Performance on this criterion is secure and well supported."),
    )),
    "scoring_rules": (lambda x: F.array_join(guidance.scoring_rules(x), "|"), (
        ("", "If a response contains no relevant attempt, no attempt at the required method, or only unrelated content, award zero or minimal credit."),
        ("A First cites a page number", "Choose the quality band first, then place the score within it.|Reward specific references when the task asks for them.|If a response contains no relevant attempt, no attempt at the required method, or only unrelated content, award zero or minimal credit."),
        ("Derive it in your own words", "Give partial credit for correct setup, method, or interpretation.|Reward justified correction and rewriting when asked.|If a response contains no relevant attempt, no attempt at the required method, or only unrelated content, award zero or minimal credit."),
    )),
    "guidance_summary": (guidance.guidance_summary, (
        ("  ", "Assess the unit against the stated task."), ("One is  told.\nTwo is not.", "One is told."), ("v1.5 counts! More", "v1.5 counts!"), ("ab " * 100, ("ab " * 74)[:220].rstrip()),
    )),
    "rubric_matrix_parse": (_matrix, (
        ("# T\n## Part 1\n### Q1\n- Max mark: 20\n- Mode: analytical\n- Core criterion: none\n- Ranking rule: best: first\n#### Criteria Sentences\n- Says it.\n- Shows it.\n| Band | Descriptor | Within-band placement |\n| --- | --- | --- |\n| First | all of it | high |\n| Fail | little\n|| Pass | some | low |",
         "Part 1/Q1/20/analytical//best: first/Says it.+Shows it./First/all of it/high;Part 1/Q1/20/analytical//best: first/Says it.+Shows it./Pass/some/low"),
        ("### Q1\n- Max mark: 5\n- One.\n### Q2\n| Band | Descriptor | Within-band placement |\n| Third | a | b |\n## Part 2\n| Lost | a | b |\n- no unit", "/Q2//////Third/a/b"),
        ("| First | a | b |", ""), ("", ""),
    )),
}




@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    column, cases = CASES[name]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, said string").select("i", column(F.col("said")).alias("result")).collect()
    assert {r.i: r.result for r in rows} == {i: result for i, (_, result) in enumerate(cases)}
