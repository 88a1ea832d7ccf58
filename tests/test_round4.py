"""Work on marking documents that is done once: what a plan holds, and what lines, answers and units it must still give."""

from scriptorium.functions import text as t
from scriptorium.operators import parsers, structure, units
from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_lines_are_cut_without_a_lambda(spark):
    ends = ("\n", "\r", "\r\n", "\n\r", "\n \n\r\n\t", " ")
    texts = ["", None, " ", "\n", "a", "  a b\t", *(f"{x}a{y}  b {y}{x}c{x}" for x in ends for y in ends), "a b\n c", "a" + " " * 20_000 + "b"]
    made = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.lines_of(F.col("x")).alias("y"), t.trimmed_lines(F.split(F.coalesce("x", F.lit("")), r"\r?\n|\r")).alias("z"))
    assert all(r.y == r.z for r in made.collect()) and "lambda" not in plan(made.select("y"))


def test_a_line_of_an_answer_is_judged_once(spark):
    assert plan(registry.queries()["unit_guidance"](spark, SF)).count(r"marks\ should\ be\ allocated") == 1
    doc = "Part 1\nask\nANSWER: note: a\n- b\nother\n- c\nanswer:\n- d\nAnswer: plain\nStudents should e : f\n• g\nPart 2\nanswer: high grade: h"
    got = structure.sections(spark.createDataFrame([("a", doc)], "assessment string, text string")).orderBy("ord").collect()
    assert [(r.label, r.label_key, r.marking) for r in got] == [("Part 1", "part 1", "note: a\n- b\nStudents should e : f\n• g"), ("Part 2", "part 2", "high grade: h")]


def test_parts_need_not_hold_what_they_do_not_ask_for(spark):
    parts = spark.createDataFrame([("x", " part  1", 1.0, "own")], "a string, label string, max_mark double, marking_guidance string")
    known = spark.createDataFrame([("x", "Part 1", 2.0, "guide", "rubric")], "a string, label string, max_mark double, marking_guidance string, rubric_text string")
    assert [tuple(r) for r in units.attached(parts, known, "a").collect()] == [("x", " part  1", 2.0, "rubric")]


def test_documents_are_made_once_for_two_parsers(spark):
    assert plan(registry.queries()["hybrid_structure"](spark, SF)).count("Window [row_number()") == 3
    texts = [("a", "Part 1 (4 marks)\n1. x [1 mark]\n2. y"), ("b", " no header "), ("c", None), (None, "Part 1")]
    docs = spark.createDataFrame(texts, "assessment string, text string")
    got = {r.assessment: r.sections for r in parsers.hybrid(docs, spark.createDataFrame([], "assessment string, content string")).collect()}
    assert set(got) == {"a", "b", "c"} and [(s.label, s.instruction_text) for k in "bc" for s in got[k]] == [("Whole Submission", "no header"), ("Whole Submission", None)]
    assert [(x.label, x.max_mark) for x in got["a"][0].subparts] == [("Part 1 Q1", 1.0), ("Part 1 Q2", 3.0)]
