"""Literal cases of text functions, scoring and sources."""

import io
import zipfile

from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.operators import responses, scoring, structure
from scriptorium.sources import documents


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head().x


def test_white_space_is_unicode(spark):
    said = "a b c\x0bd\x1ce\u0085f g"
    assert one(spark, t.word_count(F.col("s")), s=said) == len(said.split())
    assert one(spark, t.collapse(F.col("s")), s=said) == " ".join(said.split())


def test_repeated_character_is_an_issue(spark):
    assert one(spark, t.extraction_issue(F.col("s")), s="word " * 100 + "x" * 9)
    assert not one(spark, t.extraction_issue(F.col("s")), s="word " * 100 + "x" * 8)


def test_maximum_marks(spark):
    assert one(spark, t.max_marks(F.col("s")), s="out of 20. Maximum mark: 85. Total: 7") == [20.0, 85.0]
    assert one(spark, t.max_marks(F.col("s")), s="nothing") == []


def test_per_cent_is_no_mark(spark):
    assert one(spark, t.mark_of(F.col("s")), s="worth 30%x") is None
    assert one(spark, t.weight_of(F.col("s")), s="worth 30%x") == "30 %"
    assert one(spark, t.weight_of(F.col("s")), s="(30%)") == ""
    assert one(spark, t.mark_of(F.col("s")), s="worth 7.5 points") == 7.5


def test_context(spark):
    check = t.context_check(F.col("r"), F.col("b"), F.col("s"), F.col("m"))
    say = lambda r, b, s, m: tuple(one(spark, check, r=r, b=b, s=s, m=m))
    assert say(" ", "out of 5", "", "") == (None, "no_rubric_or_scheme")
    assert say("out of 5", "", "max mark 5", "5") == (5.0, None)
    check = t.context_check(F.col("r"), F.col("b"), F.col("s"), F.lit(None))
    assert say("out of 5", "out of 6", "", "") == (None, "conflicting_max_marks")
    assert say("a rubric", "", "", "") == (None, "no_max_mark")


def test_totals(spark):
    parts = spark.createDataFrame([(1, 16.0), (1, 24.0), (2, 90.0), (2, 30.0), (3, None), (3, 5.0)], "submission_id int, score double")
    assert {r.submission_id: r.total_mark for r in scoring.total_marks(parts).collect()} == {1: 40.0, 2: 100.0, 3: None}


def test_cap(spark):
    cap = scoring.capped(F.col("s"), F.col("v"), F.col("a"), F.col("c"))
    assert one(spark, cap, s=8.5, v="too_generous", a="lower_score", c=7.0) == 7.0
    assert one(spark, cap, s=8.5, v="agree", a="lower_score", c=7.0) == 8.5


def test_distributed_marks(spark):
    kids = "array<struct<label:string,label_key:string,max_mark:double,text:string>>"
    shared = lambda *marks: [x.max_mark for x in spark.createDataFrame([([("l", "l", m, "t") for m in marks],)], f"x {kids}").select(structure.with_shared_marks(F.col("x"), F.lit(10.0)).alias("x")).head().x]
    assert shared(4.0, None, None) == [4.0, 3.0, 3.0]
    assert shared(None) == [None] and shared(9.0, 2.0, None) == [9.0, 2.0, None]


def children_of(spark, text, specs, detected=None):
    parts = spark.createDataFrame([("s", "Part 1", text, 7)], "sub string, label string, section_text string, kept int")
    wanted = spark.createDataFrame([("s", i, *x) for i, x in enumerate(specs)], "sub string, part_idx int, label string, question string, task_type string")
    seen = spark.createDataFrame([("s", x) for x in detected], "sub string, label string") if detected else None
    rows = structure.subpart_segments(parts, wanted, "sub", detected=seen).orderBy("part_idx").collect()
    assert all(r.kept == 7 for r in rows)
    return {r.label: (r.resolved, r.section_text) for r in rows}


LONG = "a claim with its reason and some detail of it " * 4


def test_subparts_inherit_repair_and_accumulate(spark):
    spec = lambda n, task="comparison", q="why": (f"Part 1 Q{n}", q, task)
    text = f"intro\n\nQ1 {LONG}\nQuestion 2 {LONG}\n3) {LONG}"
    q1, q2, q3 = (x.strip() for x in (f"Q1 {LONG}", f"Question 2 {LONG}", f"3) {LONG}"))
    found = children_of(spark, text, [spec(1), spec(2), spec(3, structure.CUMULATIVE_TASK), spec(4)])
    assert found == {"Part 1 Q1": ("anchored", q1), "Part 1 Q2": ("anchored", q2), "Part 1 Q3": ("cumulative", text.strip()), "Part 1 Q4": ("inherited", text)}
    # a cumulative subpart in the middle stops at the next one
    assert children_of(spark, text, [spec(1), spec(2, structure.CUMULATIVE_TASK), spec(3)])["Part 1 Q2"] == ("cumulative", f"intro\n\n{q1} \n{q2}")
    # one anchor of two: both inherit, unless it is the cumulative task's
    one = f"intro\nQ1 {LONG}"
    assert children_of(spark, one, [spec(1), spec(2)]) == {"Part 1 Q1": ("inherited", one), "Part 1 Q2": ("inherited", one)}
    assert children_of(spark, one, [spec(1, structure.CUMULATIVE_TASK), spec(2)])["Part 1 Q1"] == ("cumulative", one.strip())
    # a short slice is widened to the lines around it
    short = f"{'x ' * 200}\nQ1 yes\n{'y ' * 200}\nQ2 {LONG}"
    got = children_of(spark, short, [spec(1), spec(2)])["Part 1 Q1"]
    assert got == ("anchored", f"Q1 yes\n{'y ' * 200}".strip())
    # damaged: the repair reaches beyond the slice
    bad = f"{LONG}\nQ1 so...\nQ2 {LONG}"
    assert children_of(spark, bad, [spec(1), spec(2)])["Part 1 Q1"] == ("anchored", bad.strip())


def test_subparts_by_a_detector_and_without_any(spark):
    spec = lambda n: (f"Part 1 Q{n}", "why", "comparison")
    text = f"Q1 {LONG}\nQ2 {LONG}\nnothing else has a number"
    specs = [spec(i) for i in range(1, 6)]
    assert {r for r, _ in children_of(spark, text, specs).values()} == {"inherited"}
    found = children_of(spark, text, specs, ["part 1  Q1", "PART 1 q2", "other"])
    assert [found[f"Part 1 Q{i}"][0] for i in range(1, 6)] == ["anchored", "anchored", "inherited", "inherited", "inherited"]
    assert {r for r, _ in children_of(spark, text, specs, ["Part 1 Q1"]).values()} == {"inherited"}
    few = "Q1 few\nQ2 words"
    assert {r for r, _ in children_of(spark, few, specs, ["Part 1 Q1", "Part 1 Q2"]).values()} == {"inherited"}
    assert children_of(spark, " \n", [spec(1), spec(2)]) == {"Part 1 Q1": ("inherited", " \n"), "Part 1 Q2": ("inherited", " \n")}
    assert children_of(spark, text, [spec(1)]) == {"Part 1": ("whole", text)}
    # two subparts at one place: the first has it
    twice = children_of(spark, f"Q1 {LONG}\n2. {LONG}", [spec(1), ("Part 2 Q1", "why", ""), spec(2)])
    assert [twice[x][0] for x in ("Part 1 Q1", "Part 2 Q1", "Part 1 Q2")] == ["anchored", "inherited", "anchored"]


def test_anchors_on_both_sides_of_the_contents(spark):
    toc = "".join(f"Part {i} ..... {i}\n" for i in range(1, 4))
    place = lambda text, labels: {r.label: r.section_text for r in structure.segmented(spark.createDataFrame([("s", text)], "submission_id string, text string"), spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "submission_id string, part_idx int, label string")).collect()}
    labels = ["Part 1", "Part 2", "Part 3"]
    body = " end" * 100
    assert place(f"{toc}Part 1\none\nPart 2\ntwo\nPart 3\nthree{body}", labels)["Part 2"] == "Part 2\ntwo\n"
    # named in the contents only: that is where it begins
    assert place(f"{toc}Part 1\none\nPart 3\nthree{body}", labels)["Part 2"].startswith("Part 2 ..... 2")
    # before the contents
    assert place(f"Part 2\nfirst\n{toc}Part 1\none\nPart 3\nthree{body}", labels)["Part 2"].startswith("Part 2\nfirst")
    many = "\n".join(f"line {i} of Part 1" for i in range(20_000))
    assert place("Part 1\n" + many, ["Part 1"])["Part 1"].startswith("Part 1\nline 0")


def test_files(spark):
    held = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:delText>three</w:delText></w:r></w:p></w:body></w:document>')
    files = spark.createDataFrame([("a.docx", held.getvalue()), ("b.txt", "né!".encode("cp1252")), ("c.docx", b"no zip"), ("d.odt", b"")], "path string, content binary")
    found = {r.path: (r.text, r.error_code) for r in documents.texts(files).collect()}
    assert found == {"a.docx": ("one\ttwo\nthree", None), "b.txt": ("né!", None), "c.docx": (None, "BadZipFile"), "d.odt": (None, "unsupported_type")}


def test_few_anchors_give_the_whole_text(spark):
    subs = spark.createDataFrame([(1, "no headers here")], "submission_id int, text string")
    wanted = spark.createDataFrame([(1, 1, "Part 1"), (1, 2, "Part 2")], "submission_id int, part_idx int, label string")
    assert [r.section_text for r in structure.segmented(subs, wanted).collect()] == ["no headers here"] * 2


def test_marking_lines(spark):
    lines = ["What is it?", "Answer: Students should say so", "- and this", "other", "- not this", "They are expected to show it", "\u2022 and that"]
    found = spark.createDataFrame([(lines,)], "x array<string>").select(structure.split_marking(F.col("x")).alias("x")).head().x
    assert (found.question, found.marking) == (["What is it?"], ["Students should say so", "- and this", "They are expected to show it", "\u2022 and that"])


def test_sections_with_all_forms(spark):
    text = "intro\nQuestion iv (20 marks)\nDiscuss:\na) one thing [5 marks]\n(b) another\nAnswer: marks should be given for part 2 q3\nsection B\nUse slide 3 and Question IV"
    rows = structure.sections(spark.createDataFrame([("a", text)], "assessment string, text string")).orderBy("ord").collect()
    assert [(r.label, r.max_mark, r.weight_text) for r in rows] == [("Question IV", 20.0, "20 marks"), ("Section B", None, "")]
    assert [(c.label, c.max_mark) for c in rows[0].children] == [("Question IV A", 5.0), ("Question IV B", None)]
    assert rows[0].marking == "marks should be given for part 2 q3" and rows[0].dependencies == ["part 2 q3"]
    assert rows[1].dependencies == ["question iv"] and rows[1].evidence == ["Use slide 3 and Question IV"]
    units = structure.assessment_map(spark.createDataFrame([("a", text), ("b", "no headers")], "assessment string, text string")).collect()
    assert sorted((u.assessment, u.label_key, u.max_mark) for u in units) == sorted([("a", "question iv a", 5.0), ("a", "question iv b", 15.0), ("a", "section b", None), ("b", "whole submission", None)], key=str)


def test_anchors_keep_out_of_contents(spark):
    body = "Part 1\nfirst answer. " + "words " * 120 + "\nthe reply to Part 2 is here " + "words " * 120 + "\nPart 3: third\n" + "words " * 40
    toc = "Part 1 .... 1\nPart 2 .... 2\nPart 3 .... 3\n"
    subs = spark.createDataFrame([(1, toc + body)], "submission_id int, text string")
    wanted = spark.createDataFrame([(1, i, f"Part {i}") for i in (1, 2, 3)], "submission_id int, part_idx int, label string")
    found = {r.label: r.section_text for r in structure.segmented(subs, wanted).collect()}
    assert found["Part 1"].startswith("Part 1\nfirst") and found["Part 2"].startswith("Part 2 is here") and found["Part 3"].strip().startswith("Part 3: third")


def test_short_slices_are_widened(spark):
    text = "x" * 300 + "\n" + "start of a line " + "TARGET" + " end of it\n" + "y" * 300
    at = text.index("TARGET")
    assert one(spark, structure.repaired(F.col("s"), F.lit(at), F.lit(at + 6), F.lit("why")), s=text) == "start of a line TARGET end of it"


def test_part_breakdown(spark):
    assert one(spark, t.part_breakdown(F.col("s")), s="part 1: 3/5 Part 2  q1: 7.5/10, PART 1: 4/5") == {"Part 1": 4.0, "Part 2 Q1": 7.5}


def test_parts_without_an_anchor_spoil_no_others(spark):
    text = "Part 1\nlong answer\nPart 3\nanother\nPart 4\nlast"
    subs = spark.createDataFrame([(1, text)], "submission_id int, text string")
    wanted = spark.createDataFrame([(1, i, f"Part {i}") for i in (1, 2, 3, 4)], "submission_id int, part_idx int, label string")
    found = {r.label: r.section_text.strip() for r in structure.segmented(subs, wanted).collect()}
    assert found == {"Part 1": "Part 1\nlong answer", "Part 3": "Part 3\nanother", "Part 4": "Part 4\nlast"}


def test_docx_structure(spark):
    held = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>a styled line.</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold words.</w:t></w:r></w:p><w:p><w:r><w:rPr><w:sz w:val="28"/></w:rPr><w:t>large words.</w:t></w:r></w:p><w:p><w:r><w:t>plain words.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    files = spark.createDataFrame([("a.docx", held.getvalue()), ("b.docx", b"")], "path string, content binary")
    found = {r.path: (r.text, r.error_code) for r in documents.structure_texts(files).collect()}
    assert found == {"a.docx": ("[HEADING] a styled line.\n[HEADING] bold words.\n[HEADING] large words.\nplain words.\nx | y", None), "b.docx": (None, "BadZipFile")}


def test_pdf_without_a_library_is_an_error_row(spark):
    files = spark.createDataFrame([("a.pdf", b"%PDF-1.4 broken")], "path string, content binary")
    assert documents.texts(files).head().error_code is not None


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("id,said\n1,né\n".encode())
    (tmp_path / "w.csv").write_bytes("id,said\n1,né€\n".encode("cp1252"))
    assert [documents.read_csv(spark, str(tmp_path / f)).head().said for f in ("u.csv", "w.csv")] == ["né", "né€"]


def test_samples_repeat(spark):
    files = spark.range(50).select(F.format_string("f%d.txt", "id").alias("path"))
    one_, two = (sorted(r.path for r in documents.sampled(files.repartition(n), "path", 5, 7).collect()) for n in (1, 6))
    assert one_ == two and len(one_) == 5
