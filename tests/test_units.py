"""Criteria, guidance, merges of sections, detected parts, chunks, and rounds of rubric verification."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import criteria as c
from scriptorium.operators import merging, refinement, structure, units


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).head().x


def made(spark, task, question="", guidance="", mode="analytical"):
    return one(spark, c.unit_criteria(F.col("t"), F.col("m"), F.col("q"), F.col("g")), t=task, m=mode, q=question, g=guidance)


def test_criteria_follow_the_task_not_its_topic(spark):
    found = made(spark, "evaluative_discussion", "Say whether you think VAT is a good idea.")
    assert found[0] == "Evaluate whether the response reaches a clear and justified overall judgement."
    assert found[1] == "Evaluate whether the response directly addresses the required evaluative discussion." and len(found) == 5
    assert made(spark, "model_specification", "State the payoff")[0] == "Evaluate whether the response states the required payoff function and explanation of its terms correctly."
    assert len(made(spark, "prediction_generation")) == 4
    plain = made(spark, "other", "", "Quote a page, in your own words")
    assert plain[0].endswith("addresses the required corrected and rewritten response.") and "page numbers" in plain[2] and len(plain) == 5
    assert made(spark, "other", "", "Solve the equation", "deterministic")[-1].startswith("Evaluate whether variables")
    assert made(spark, None, None, None, None)[0] == "Evaluate whether the attempt sets up and answers the required analytical step correctly."


def test_constructs(spark):
    found = lambda task, q, g="": one(spark, c.constructs(F.col("t"), F.col("q"), F.col("g")), t=task, q=q, g=g)
    assert found("other", "Your answer should contain (1) a claim; (2)  its  source, (3) a link") == ["includes a claim", "includes its source", "includes a link"]
    assert found("other", "(1) a (2) b") == []
    assert found("measurement_and_data_design", "plain") == ["maps each theoretical concept to an observable variable or indicator"]
    assert found("measurement_and_data_design", "a link to the source")[-1] == "provides a usable source link for the proposed data"
    assert found("critique_and_revision", "the prompt and output, comment and rewrite, with quotes", "Parent marking instructions:\nquote it") == [
        "includes the original prompt", "includes the model output being audited", "identifies and explains substantive inaccuracies or weaknesses in the output", "provides a corrected rewrite in the student's own tone",
        "supports the critique and corrections with specific source evidence or page references",
    ]
    assert found("other", "", "parent marking instructions: quote") == ["uses the source evidence required by the parent marking instructions"]


def test_wording_of_criteria(spark):
    said = lambda x, abstract: one(spark, c.normal_criterion(F.col("x"), F.lit(abstract)), x=x)
    assert said(" evaluate  whether it holds.. ", True) == "Judge how well it holds." and said("Assess how it ends", True) == "Judge how well it ends."
    assert said("evaluate whether it holds", False) == "Check that it holds." and said("CONFIRM THAT it is", False) == "Confirm that it is." and said("other", False) == "Other."
    assert said("  ", True) is None and said(None, False) is None


def test_stated_criteria(spark):
    found = lambda g: one(spark, c.stated_criteria(F.col("g")), g=g)
    assert found("Compact scoring criteria:\n- a\n\n- b") == ["a"]
    assert found("Compact scoring criteria:\n- a\n- b\nDetailed rubric:\n- Evaluate whether c") == ["a", "b"]
    assert found("Detailed rubric:\n- Evaluate whether c\n- other\n- Rank attempts\n- Check whether d") == ["Evaluate whether c"]
    assert found("one line..") == ["one line."] and found("word " * 41) == [] and found("two\nlines") == [] and found("") == found(None) == []
    assert len(found("Compact scoring criteria:\n" + "\n".join(f"- {i}" for i in range(9)))) == 5


def test_goals(spark):
    goal = lambda task, q: one(spark, c.task_goal(F.col("t"), F.col("q")), t=task, q=q)
    assert goal("critique_and_revision", "Part 1 (5 marks) 1. Write a draft. 2. Audit it. 3. Revise it. 4. More.") == "Write a draft; Audit it; Revise it"
    assert goal("other", "1. First do this. 2. Then that.") == "First do this" and goal("other", "Do this. Then that.") == "Do this"
    assert goal("welfare_reasoning", "") == c.GOALS["welfare_reasoning"] and goal("other", "") == ""
    told = lambda g, q: one(spark, c.stated_goal(F.col("g"), F.col("q")), g=g, q=q)
    assert told("cut ...", "q") == told("Do This.", "do this") == told("short (", "q") == "" and told("a goal of its own", "the question") == "a goal of its own"
    long = "explain the whole mechanism of the thing"
    assert told(long, f"please {long} now") == "" and told(long, long + " and more" * 30) == long


def section(label, marking, kids="", mark="(10 marks)"):
    return f"{label} {mark}\nDiscuss it with evidence.\n{kids}Answer: {marking}"


def test_guidance_of_units(spark):
    text = section("Part 1", "Students should say why.", "1. explain a [4 marks]\n2. state b after Part 2\n") + "\n" + section("Part 2", "no instruction", mark="(5 marks)") + "\nPart 3 (1 mark)"
    parsed = structure.sections(spark.createDataFrame([("a", text)], "assessment string, text string"))
    found = {r.label: r for r in units.assessment_units(parsed).collect()}
    assert found["Part 1 Q1"].marking_guidance == "Parent marking instructions:\nStudents should say why.\nAnchor phrases:\n- 1. explain a [4 marks]"
    assert found["Part 1 Q2"].marking_guidance == "Parent marking instructions:\nStudents should say why.\nDependency links: part 2"
    assert found["Part 2"].marking_guidance == "Anchor phrases:\n- Discuss it with evidence.\nEvidence expectations:\n- Discuss it with evidence."
    assert found["Part 3"].marking_guidance == "Part 3 (1 mark)" and found["Part 1 Q1"].parent_label == "Part 1" and found["Part 1 Q2"].max_mark == 6.0
    assert found["Part 1 Q1"].rubric_text.startswith("Unit: Part 1 Q1\nTask focus: ") and "0 to 4." in found["Part 1 Q1"].rubric_text
    bare = structure.sections(spark.createDataFrame([("a", "Part 1\n1. derive a\n2. derive b")], "assessment string, text string"))
    rows = units.assessment_units(bare, require_marks=False).collect()
    assert [r.label for r in rows] == ["Part 1 Q1", "Part 1 Q2"] and all("Child-specific scoring guidance:\nUnit: Part 1" in r.marking_guidance for r in rows)


def test_parts_take_what_units_know(spark):
    kind = "a string, label string, max_mark double, marking_guidance string, question string, task_type string, criterion_mode string"
    parts = spark.createDataFrame([("x", " part  1", 1.0, "own", "q", "", "abstract"), ("x", "Part 2", 2.0, None, "q", "t", ""), ("y", "Part 1", 3.0, "own", "q", "t", "m")], kind)
    known = spark.createDataFrame([("x", "Part 1", None, " ", "new", "task", "", "rubric"), ("x", "part 2", 9.0, "guide", "", "", "mode", " ")], kind + ", rubric_text string")
    got = {(r.a, r.label): tuple(r)[2:] for r in units.attached(parts, known, "a").collect()}
    assert got == {("x", " part  1"): (1.0, "rubric", "new", "task", "abstract"), ("x", "Part 2"): (9.0, "guide", "q", "t", "mode"), ("y", "Part 1"): (3.0, "own", "q", "t", "m")}
    prepared = spark.createDataFrame([("x", "PART 1", ["a", "b"]), ("x", "Part 2", ["c"]), ("y", "Part 1", [])], "a string, label string, compact_criteria array<string>")
    got = {(r.a, r.label): r.marking_guidance for r in units.with_prepared_criteria(parts, prepared, "a").collect()}
    assert got == {("x", " part  1"): "Compact scoring criteria:\n- a\n- b\n\nDetailed rubric:\nown", ("x", "Part 2"): "Compact scoring criteria:\n- c", ("y", "Part 1"): "own"}


def test_richer_and_canonical_texts(spark):
    pick = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert [pick(merging.richer, *x) for x in ((" a ", ""), (None, "b"), ("a\nb", "longer by far"), ("a", "b\nc"), ("a", "bb"), ("aa", "b"))] == ["a", "b", "a\nb", "b\nc", "bb", "aa"]
    full = "What a full question of some length asks for"
    assert [pick(merging.canonical, *x) for x in (("", full), (full, ""), ("Part 1", full), ("it is cut ... and then goes on for long", full), ("another " + full, full))] == [full, full, full, full, "another " + full]
    assert one(spark, merging.unique(F.col("a"), F.col("b"), F.col("l")), a=["One ", "", "two"], b=["ONE", "Part  1", "three"], l="part 1") == ["One", "two", "three"]
    assert one(spark, merging.unique(F.lit(None).cast("array<string>"), F.col("b")), b=["x"]) == ["x"]


def test_children_are_merged_by_label(spark):
    doc = "Part 1 (9 marks)\n1. a [2 marks]\n2. b\nPART 1\n2. b and more\n3. c [1 mark]"
    parsed = structure.sections(spark.createDataFrame([("a", doc)], "assessment string, text string"))
    got = merging.merged_sections(parsed).head()
    assert got.ord == 1 and got.section.max_mark == 9.0 and [(x.label, x.max_mark, x.text) for x in got.section.children] == [("Part 1 Q1", 2.0, "1. a [2 marks]"), ("Part 1 Q2", None, "2. b and more"), ("Part 1 Q3", 1.0, "3. c [1 mark]")]


def test_detected_parts(spark):
    found = lambda x: [tuple(p) for p in one(spark, merging.detected_parts(F.col("x")), x=x)]
    whole = [("Whole Submission", merging.WHOLE_HINT, "")]
    listed = {"sections": [{"label": " Part 1 ", "focus_hint": " h "}, {"label": "Part 1", "anchor_text": "no"}, {"label": "part 1"}, {"label": "Answer  Below"}, {"label": ""}, "x", {"focus_hint": "y"}]}
    assert found(json.dumps(listed)) == [("Part 1", "h", ""), ("part 1", "", "")]
    assert found('{"sections": []}') == found('{"sections": [{"label": "above"}]}') == found("no json") == found(None) == whole


def test_chunks_around_cues(spark):
    chunks = lambda text: [tuple(x) for x in one(spark, merging.detection_chunks(F.col("x")), x=text)]
    assert chunks("") == chunks(" \n") == chunks(None) == [] and chunks("short") == [(0, 5, "short")]
    text = "a" * 1000 + "\nPart 1: x\n" + "b" * 1000 + "\r\nQuestion iv q2\n" + "c" * 100
    plain = text.replace("\r\n", "\n")
    first, second = plain.index("\nPart"), plain.index("\nQuestion")
    assert [x[:2] for x in chunks(text)] == [(0, 700), (first - 99, first + 421), (second - 99, len(plain))]
    many = "".join(f"\nPart {i}\n" + "x" * 600 for i in range(1, 30))
    assert len(chunks("h" * 800 + many)) == 8
    assert one(spark, merging.chunk_text(merging.detection_chunks(F.col("x"))), x="y" * 900 + "\nTask 2 z") == "[Chunk 1 @ 0:700]\n" + "y" * 700 + "\n\n---\n\n[Chunk 2 @ 801:909]\n" + "y" * 99 + "\nTask 2 z"


def verifier(by_round, asked):
    """A scorer that says for each unit what by_round holds for it, ask by ask, and notes what it was asked."""

    def scorer(requests):
        rows = [(r.request_key, json.loads(json.loads(r.payload)["messages"][1]["content"].split("\n", 1)[1])["unit"]) for r in requests.select("request_key", "payload").collect()]
        asked.append(sorted(u for _, u in rows))
        said = lambda u: by_round[u][min(sum(u in x for x in asked), len(by_round[u])) - 1]
        return requests.sparkSession.createDataFrame([(k, json.dumps({"message": {"content": json.dumps(said(u)) if isinstance(said(u), dict) else said(u)}}), None) for k, u in rows], "request_key string, response string, error string")

    return scorer


def told(confidence, text="better", issues=()):
    return {"rubric_text": text, "confidence_0_to_100": confidence, "issues": list(issues)}


def rounds(spark, by_round):
    asked: list = []
    rows = [(u[0], u, "old", None, []) for u in by_round]
    out = refinement.refined_in_rounds(spark.createDataFrame(rows, "assessment string, label string, rubric_text string, confidence double, issues array<string>"), verifier(by_round, asked), "m")
    return {r.label: r for r in out.collect()}, asked


def test_rounds_stop_where_all_units_are_acceptable(spark):
    got, asked = rounds(spark, {"a1": [told(80)], "a2": [told(90, issues=["small"])], "b1": [told(50), told(85)]})
    assert asked == [["a1", "a2", "b1"], ["b1"]]  # the settled assessment drops out
    assert {k: (r.attempts, r.confidence) for k, r in got.items()} == {"a1": (1, 80.0), "a2": (1, 90.0), "b1": (2, 85.0)}
    assert got["b1"].accepted == ["attempt_2: confidence 50.00->85.00, issues 0->0, text_unchanged"] and got["b1"].rejected == []


def test_rounds_are_bounded_and_keep_the_better_unit(spark):
    got, asked = rounds(spark, {"a1": [told(60, "first"), told(55, "second"), told(60, "third", ["x"])], "a2": [told(99)]})
    assert asked == [["a1", "a2"]] * 3
    assert (got["a1"].rubric_text, got["a1"].confidence, got["a1"].attempts, got["a1"].accepted, len(got["a1"].rejected)) == ("first", 60.0, 3, [], 2)
    assert (got["a2"].rubric_text, got["a2"].rejected) == ("better", [])  # the same again is no audit


@pytest.mark.parametrize("bad", ["no json", told(140), told("high"), told(50, " ")])
def test_a_verifier_that_fails_is_asked_once_more_and_loses_no_unit(spark, bad):
    got, asked = rounds(spark, {"a1": [bad, told(90)]})
    assert asked == [["a1"], ["a1"]] and (got["a1"].confidence, got["a1"].attempts) == (90.0, 1)
    got, asked = rounds(spark, {"a1": [bad]})
    assert len(asked) == 6 and (got["a1"].rubric_text, got["a1"].confidence, got["a1"].attempts) == ("old", 0.0, 3)
    assert got["a1"].issues[0].startswith("rubric_verifier_failed: ")
