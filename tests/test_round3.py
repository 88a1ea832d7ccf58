"""Findings of the third round: results that depended on what two rows share, and work that a query left out."""

import duckdb
from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.operators import merging, parsers, responses, structure, units, verification
from scriptorium.plans import registry


def equals_sql(spark, folder, table, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    told = con.sql(registry.oracle_sql()[name])
    made = registry.queries()[name](spark, str(folder)).select(*told.columns)
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == sorted(told.fetchall(), key=repr)
    return got


def test_replay_with_equal_texts_in_two_conversations(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT c AS conv_id, t AS turn, 'user' AS role, 'text of turn ' || t AS text FROM range(12) a(c), range(6) b(t)) TO '{tmp_path}/conversations.parquet'")
    assert len(equals_sql(spark, tmp_path, "conversations", "replay_pipeline")) == 12


def test_rubric_matrix_reads_whole_texts(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1, 'one |' || chr(10) || chr(10) || '  two: a', 's', 'en'), (2, 'one |' || chr(10) || chr(10) || '  two: b', 's', 'en'), (3, NULL, NULL, NULL)) x(doc_id, text, source, lang)) TO '{tmp_path}/documents.parquet'")
    got = dict(equals_sql(spark, tmp_path, "documents", "rubric_matrix_parse"))
    assert got[1] != got[2] and "In en: one |+In en: two: a" in got[1] and "one    two: a" in got[1]


def test_sections_are_made_once(spark):
    """A filter on what explode or posexplode reads has Spark make it twice."""
    docs = spark.createDataFrame([("a", "Part 1 (5 marks)\n1. one [2 marks]\n2. two\nPart 2 why"), ("b", "none"), ("c", None)], "assessment string, text string")
    parsed = structure.sections(docs)
    for made in (parsed, structure.children(parsed), structure.expected_subparts(parsed)):
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not any("Filter" in line and "lambda" in line for line in plan)
    assert [(r.ord, r.label) for r in parsed.orderBy("ord").collect()] == [(1, "Part 1"), (2, "Part 2")]
    assert sorted((r.label, r.max_mark) for r in structure.expected_subparts(parsed).collect()) == [("Part 1 Q1", 2.0), ("Part 1 Q2", 3.0)]


def test_weights_of_one_search(spark):
    rows = spark.createDataFrame([("worth 5.5 points",), ("(10 Marks) or 3 marks",), ("20 %x",), ("none",), ("",), (None,)], "x string")
    got = rows.select(t.mark_of(F.col("x")).alias("m"), t.weight_of(F.col("x")).alias("w")).collect()
    assert [tuple(r) for r in got] == [(5.5, "5.5 points"), (10.0, "10 Marks"), (None, "20 %"), (None, ""), (None, ""), (None, "")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_units_and_criteria_are_made_once(spark):
    """explode has Spark filter by what it reads, which it then makes twice; the outer form does not."""
    docs = spark.createDataFrame([("a", "Part 1 (5 marks)\n1. one [2 marks]\n2. two\nPart 2 why"), ("b", "none"), ("c", None)], "assessment string, text string")
    folder = "/root/testdata/sf0.001"
    made = [structure.assessment_map(docs), units.assessment_units(structure.sections(docs)), *(registry.queries()[n](spark, folder) for n in ("generated_criteria", "detected_and_expected"))]
    for df in made:
        assert not any("Filter" in line and "lambda" in line for line in _plan(df).splitlines())
    rows = {(r.assessment, r.label): (r.label_key, r.max_mark) for r in made[0].collect()}
    assert rows == {("a", "Part 1 Q1"): ("part 1 q1", 2.0), ("a", "Part 1 Q2"): ("part 1 q2", 3.0), ("a", "Part 2"): ("part 2", None), ("b", "Whole Submission"): ("whole submission", None), ("c", "Whole Submission"): ("whole submission", None)}


def test_responses_are_read_once(spark):
    """A field that an error and the result need was read again for each of them."""
    rows = spark.createDataFrame([('{"a": 1}',), (None,)], "x string")
    x, none = F.col("x"), F.array().cast("array<string>")
    assert _plan(rows.select(verification.part_verdict(x, F.lit(50.0)))).count("$.recommendation") <= 2
    assert _plan(rows.select(responses.verified_rubric(x, F.lit("t"), none))).count("parse_json") == 1
    assert _plan(rows.select(responses.criterion_notes(x, F.array(F.lit("a")), F.lit("s"), none))).count("from_json") <= 3


def test_layout_labels_are_made_once(spark):
    rows = spark.createDataFrame([("a", "Part i (5 marks)\na) one [2 marks]\n(2) two\n3] three")], "assessment string, text string")
    made = parsers.by_layout(rows)
    assert _plan(made).count("initcap") == 1
    (section,) = made.collect()[0].sections
    assert (section.label, [s.label for s in section.subparts]) == ("Part I", ["Part I A", "Part I Q2", "Part I Q3"])


def test_texts_are_trimmed_once(spark):
    rows = spark.createDataFrame([("a\nb", "c"), (" ", "d\te"), (None, None)], "a string, b string")
    made = rows.select(merging.richer(F.col("a"), F.col("b")).alias("x"))
    assert _plan(made).count("trim(") == 2
    assert [r.x for r in made.collect()] == ["a\nb", "d\te", ""]


def test_collapse_of_all_kinds_of_space(spark):
    texts = ["", " ", "  ", "a b", "a  b", " a\tb ", " a   b\x1c", "a\n", "\t", "a \x1f", "\x85 b", "　x  y z"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    old = F.trim(F.regexp_replace("x", t.SPACE, " "))
    assert all(a == b for a, b in rows.select(t.collapse(F.col("x")), old).collect())
