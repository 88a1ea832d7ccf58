"""Folders to assessments, sample lists and manifests, from files on disk and from relations of paths."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import documents, folders

PATHS = ["/r/a/Rubric.txt", "/r/a/deep/er/essay.pdf", "/r/a/essay.docx", "/r/b/brief_rubric.txt", "/r/b/guidance/plain.TXT", "/r/b/x.md", "/r/own brief.txt", "/r/essay 2.txt", "/other/z.txt", "/r/c/example essay.txt"]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, f"text of {p}", "d") for p in PATHS], "path string, text string, digest string")


def test_a_folder_for_each_assessment(spark, files):
    got = {r.path: (r.assessment, r.role, r.ord) for r in folders.assessments(files, "/r/").collect()}
    assert got == {
        "/r/a/Rubric.txt": ("a", "rubric", 1), "/r/a/deep/er/essay.pdf": ("a", "submission", 1), "/r/a/essay.docx": ("a", "submission", 2), "/r/b/brief_rubric.txt": ("b", "rubric", 1),
        "/r/b/guidance/plain.TXT": ("b", "other", 1), "/r/c/example essay.txt": ("c", "graded_sample", 1),
    }


def test_one_assessment(spark, files):
    got = {r.path: (r.role, r.ord) for r in folders.single_assessment(files, "/r", "all").where("assessment = 'all'").collect()}
    assert got["/r/own brief.txt"] == ("brief", 1) and got["/r/essay 2.txt"] == ("submission", 7) and got["/r/a/Rubric.txt"] == ("submission", 1)
    assert "/r/b/x.md" not in got and "/other/z.txt" not in got and len(got) == 8


def test_contexts(spark, files):
    got = {r.assessment: r for r in folders.contexts(folders.assessments(files, "/r")).collect()}
    assert got["a"].rubric == "text of /r/a/Rubric.txt" and got["a"].brief == "" and got["a"].n_submissions == 2
    assert got["c"].graded_sample == "text of /r/c/example essay.txt" and got["c"].n_submissions == 0


def test_files_on_disk(spark, tmp_path):
    for name, text in (("one/rubric.txt", "marks"), ("one/essay.txt", "words"), ("one/notes.md", "no"), ("two/deep/essay.txt", "more")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = documents.read(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    got = {(r.assessment, r.role): r.text for r in folders.assessments(read, str(tmp_path)).collect()}
    assert got == {("one", "rubric"): "marks", ("one", "submission"): "words", ("two", "submission"): "more"}


def test_the_first_list_that_names_a_file_counts(spark):
    lists = spark.createDataFrame([("x", "root", "/r/b.txt"), ("x", "default", "/d.txt"), ("x", "argument", " "), ("y", "default", " /d.txt "), ("y", "other", "/o.txt"), ("z", "list_file", "/l.txt"), ("z", "argument", "/a.txt")], "k string, source string, path string")
    got = sorted(map(tuple, folders.chosen_samples(lists, "k").collect()))
    assert got == [("x", "root", "/r/b.txt"), ("y", "default", "/d.txt"), ("z", "argument", "/a.txt")]
    assert [tuple(r) for r in folders.chosen_samples(lists.where("k = 'z'").drop("k")).collect()] == [("argument", "/a.txt")]


def test_manifests(spark, files):
    held = folders.manifest(folders.assessments(files, "/r"))
    got = {r.assessment: json.loads(r.manifest) for r in folders.manifest_json(held).collect()}
    assert got["a"] == {"rubric": ["rubric/001_Rubric.txt"], "submission": ["submission/001_essay.pdf", "submission/002_essay.docx"]}
    assert got["c"] == {"graded_sample": ["graded_sample/001_example_essay.txt"]}
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    then = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, digest string")
    assert {r.path: r.change for r in folders.changes(now, then).collect()} == {"a": "new", "b": "same", "c": "changed", "d": "gone"}
    assert spark.range(1).select(documents.safe_name(F.lit(1234), F.lit(" é "))).head()[0] == "1234__"
