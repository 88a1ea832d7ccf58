"""Queries on texts: diagnostics, marks in prose, classification, response validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.operators import responses
from scriptorium.operators.structure import distinct_capped
from scriptorium.plans.marks import _t
from scriptorium.sources import documents


def submission_diagnostics(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", t.word_count(F.col("text")).alias("word_count"), t.low_text(F.col("text")).alias("low_text"), (t.word_count(F.col("text")) < 80).alias("short"), F.length(t.collapse(F.col("text"))).alias("collapsed_chars"))


def damaged_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", t.damaged(F.col("text")).alias("damaged"))


def truncate_excerpt(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", t.truncated(F.col("text"), 220).alias("excerpt"))


def repeated_feedback_starts(spark, sf):
    starts = _t(spark, sf, "documents").select(t.signature(F.col("text")).alias("start"))
    return starts.groupBy("start").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "start").limit(5)


def error_signature(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", t.error_signature(F.concat(F.lit("failed at  "), F.col("url")), F.regexp_extract("url", r"://([^/]*)", 1)).alias("signature"), t.slug(F.col("url")).alias("slug"))


def markdown_cleanup(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", t.markdown_cleaned(F.regexp_replace("html", r"</?p>", "\n")).alias("cleaned"))


def heading_and_line_metrics(spark, sf):
    lines = F.split("text", "\n")
    d = _t(spark, sf, "documents")
    return d.select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: x.rlike(r"^[A-Z][^.!?]{0,60}$"))).alias("n_headings"), (F.length("text") - F.length(F.replace("text", F.lit("Ã"), F.lit("")))).alias("suspicious"))


def weight_extraction(spark, sf):
    li = _t(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("worth "), q, F.lit(" marks"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Part ("), q, F.lit(" points)"))).otherwise(F.concat(q, F.lit("%of the total")))
    return li.select(said.alias("said")).groupBy("said").agg(F.count("*").alias("n")).select("said", "n", t.mark_of(F.col("said")).alias("max_mark"), t.weight_of(F.col("said")).alias("weight"))


def max_mark_inference(spark, sf):
    p = _t(spark, sf, "part")
    said = F.concat(F.lit("This paper is marked out of "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, F.lit(". Maximum mark: 20")).otherwise(". Total: 7"))
    said = F.when(F.col("p_partkey") % 7 == 0, F.lit("No mark is stated")).otherwise(said)
    found = p.select("p_partkey", t.max_marks(said).alias("found"))
    state = F.when(F.size("found") == 0, "none").when(F.size("found") == 1, "ok").otherwise("conflict")
    return found.select("p_partkey", state.alias("state"), F.when(F.size("found") == 1, F.col("found")[0]).alias("max_mark"))


def role_classification(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("stem"), F.element_at(F.array(F.lit("rubric_a"), F.lit("Assignment 1"), F.lit("mark_scheme"), F.lit("samples"), F.lit("instructions"), F.lit("work")), (F.col("page_id") % 6 + 1).cast("int")).alias("parent"))
    return p.select("page_id", documents.role(F.col("stem"), F.col("parent")).alias("role"))


def bundle_summary(spark, sf):
    return role_classification(spark, sf).groupBy((F.col("page_id") % 10).alias("assessment")).pivot("role", ["rubric", "brief", "scheme", "graded_sample", "other", "submission"]).count().na.fill(0)


def csv_row_text(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", documents.row_text("c_name", "c_mktsegment").alias("script_text"))


def keyword_lists(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.array_join(t.keywords(F.concat_ws(" , ", "p_name", "p_brand", F.lit(""), "p_type")), "|").alias("keywords"))


def criteria_cap5_dedup(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", F.concat(F.lit("Checks step "), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 3).cast("string"), F.when(F.col("l_returnflag") == "R", ".").otherwise("")).alias("criterion"), (F.col("l_orderkey") * 100 + F.col("l_partkey") % 100).alias("ord"))
    return distinct_capped(rows.groupBy("l_suppkey", "criterion").agg(F.min("ord").alias("ord")), "l_suppkey", "criterion", "ord", 5).select("l_suppkey", "nth", F.lower(F.regexp_replace("criterion", r"\.$", "")).alias("criterion"))


def json_part_analysis_validate(spark, sf):
    """Responses with a score of 50, three in six of them wrong; a band that the scale has not, a confidence out of range."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    kind = F.col("l_partkey") % 6
    score = F.col("l_quantity").cast("int").cast("string")
    body = lambda s, c: F.concat(F.lit('{"section_label":"Part 1","provisional_score":'), s, F.lit(f',"coverage_comment":"{c}","strengths":["a"," "],"weaknesses":[1,2,3],"evidence":[],"grade_band":"2:1","band_confidence_0_to_100":'), (F.col("l_linenumber") * 20).cast("string"), F.lit("}"))
    content = F.when(kind == 0, body(F.lit("true"), "x")).when(kind == 1, body(F.concat(F.lit("-"), score), "x")).when(kind == 2, body(score, " ")).when(kind == 3, F.lit("{not json")).otherwise(body(score, "fine"))
    checked = responses.part_analysis(li.withColumn("content", content).withColumn("max_mark", F.lit(50.0)))
    listed = [F.sum(F.size(n)).alias(f"n_{n}") for n in responses.FILLERS]
    return checked.groupBy("error_code", "grade_band", "within_band_position").agg(F.count("*").alias("n"), F.sum("provisional_score").alias("score"), *listed, F.sum("band_confidence_0_to_100").alias("confidence"))


_STATUS = ("Met", "partially met", "missed", "strong", "weak", "secure", "mixed")


def criterion_status_map(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("l_partkey") % len(_STATUS) + 1).cast("int"))
    scale = F.when(F.col("l_linenumber") % 2 == 0, "likert_judgement").otherwise("step_status")
    found = _t(spark, sf, "lineitem").select(raw.alias("raw"), scale.alias("scale")).groupBy("raw", "scale").agg(F.count("*").alias("n"))
    return found.select("raw", "scale", "n", responses.status(F.col("raw"), F.col("scale")).alias("s")).select("raw", "scale", "n", "s.*")


def note_trim(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", responses.note(F.col("text")).alias("note"))


def feedback_points(spark, sf):
    """A5: the first six distinct lines of a conversation's turns."""
    rows = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("text").alias("point"))
    return distinct_capped(rows, "conv_id", "point", "ord", 6)


_W = r"[\s]+"
_ROLE = "SELECT page_id, CASE WHEN contains(s, 'rubric') THEN 'rubric' WHEN contains(s, 'brief') OR contains(s, 'assignment') THEN 'brief' WHEN contains(s, 'scheme') THEN 'scheme' WHEN contains(s, 'sample') OR contains(s, 'example') THEN 'graded_sample' WHEN contains(s, 'support') OR contains(s, 'context') OR contains(s, 'guidance') OR contains(s, 'instruction') THEN 'other' ELSE 'submission' END AS role FROM (SELECT page_id, lower(replace(string_split(url, '/')[-1] || ' ' || (['rubric_a','Assignment 1','mark_scheme','samples','instructions','work'])[page_id % 6 + 1], '_', ' ')) AS s FROM pages)"
_ANALYSES = """
WITH judged AS (
  SELECT l_quantity::INT AS q, 2.0 * l_quantity::INT AS p, l_linenumber * 20 AS confidence,
    CASE l_partkey % 6 WHEN 0 THEN 'score_not_numeric' WHEN 1 THEN 'score_negative' WHEN 2 THEN 'comment_missing' WHEN 3 THEN 'not_json' END AS error_code FROM lineitem
), bands(name, least, most) AS (
  VALUES ('Excellent', 85.0, 100.0), ('Strong', 70.0, 84.99), ('Secure', 55.0, 69.99), ('Adequate', 40.0, 54.99), ('Developing', 25.0, 39.99), ('Weak', 0.01, 24.99)
), placed AS (
  SELECT j.*, b.name, CASE WHEN p < least + (most - least) / 3 THEN 'low' WHEN p > most - (most - least) / 3 THEN 'high' ELSE 'mid' END AS position FROM judged j JOIN bands b ON p >= least AND p <= most
)
SELECT error_code, CASE WHEN error_code IS NULL THEN name END AS grade_band, CASE WHEN error_code IS NULL THEN position END AS within_band_position, count(*) AS n,
  sum(CASE WHEN error_code IS NULL THEN q END)::DOUBLE AS score, sum(CASE WHEN error_code IS NULL THEN 2 END)::BIGINT AS n_strengths, sum(CASE WHEN error_code IS NULL THEN 3 END)::BIGINT AS n_weaknesses,
  sum(CASE WHEN error_code IS NULL THEN 1 END)::BIGINT AS n_evidence, sum(CASE WHEN error_code IS NULL THEN CASE WHEN confidence <= 100 THEN confidence ELSE 75 END END)::DOUBLE AS confidence
FROM placed GROUP BY 1, 2, 3
"""
SQL = {
    "submission_diagnostics": rf"SELECT doc_id, n AS word_count, n < 120 AS low_text, n < 80 AS short, length(c)::INT AS collapsed_chars FROM (SELECT doc_id, trim(regexp_replace(text, '{_W}', ' ', 'g')) AS c, len(list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> ''))::INT AS n FROM documents)",
    "damaged_text": "SELECT doc_id, contains(text, '...') OR len(regexp_extract_all(text, '[a-z]{6,}[A-Z][a-z]+')) >= 2 OR regexp_matches(text, '[a-z]{16,}') AS damaged FROM documents",
    "truncate_excerpt": rf"SELECT doc_id, CASE WHEN length(c) > 220 THEN regexp_replace(substring(c, 1, 217), '[ ,;:]+$', '') || '...' ELSE c END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '{_W}', ' ', 'g')) AS c FROM documents)",
    "repeated_feedback_starts": rf"SELECT array_to_string((list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> ''))[1:12], ' ') AS start, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "error_signature": rf"SELECT page_id, substring(trim(regexp_replace(replace('failed at  ' || url, regexp_extract(url, '://([^/]*)', 1), 'Part <section>'), '{_W}', ' ', 'g')), 1, 240) AS signature, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages",
    "heading_and_line_metrics": "SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-Z][^.!?]{0,60}$')))::INT AS n_headings, (length(text) - length(replace(text, 'Ã', '')))::INT AS suspicious FROM documents",
    "weight_extraction": "SELECT said, n, CASE WHEN k = 2 THEN NULL ELSE q::DOUBLE END AS max_mark, CASE k WHEN 0 THEN q || ' marks' WHEN 1 THEN q || ' points' ELSE q || ' %' END AS weight FROM (SELECT l_linenumber % 3 AS k, l_quantity::INT AS q, CASE l_linenumber % 3 WHEN 0 THEN 'worth ' || l_quantity::INT || ' marks' WHEN 1 THEN 'Part (' || l_quantity::INT || ' points)' ELSE l_quantity::INT || '%of the total' END AS said, count(*) AS n FROM lineitem GROUP BY ALL)",
    "max_mark_inference": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'none' WHEN p_partkey % 4 = 0 AND p_size <> 20 THEN 'conflict' ELSE 'ok' END AS state, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 4 = 0 AND p_size <> 20 THEN NULL ELSE p_size::DOUBLE END AS max_mark FROM part",
    "role_classification": _ROLE,
    "bundle_summary": f"SELECT page_id % 10 AS assessment, {', '.join(f'''count(*) FILTER (role = '{r}') AS {r}''' for r in ('rubric', 'brief', 'scheme', 'graded_sample', 'other', 'submission'))} FROM ({_ROLE}) GROUP BY 1",
    "csv_row_text": "SELECT c_custkey, 'c_name:' || chr(10) || trim(c_name) || chr(10) || chr(10) || 'c_mktsegment:' || chr(10) || trim(c_mktsegment) AS script_text FROM customer",
    "keyword_lists": "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ' || p_brand || ' ,  , ' || p_type, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS keywords FROM part",
    "criteria_cap5_dedup": "SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY ord, criterion)::INT AS nth, criterion FROM (SELECT l_suppkey, 'checks step ' || (l_linenumber * 10 + l_quantity::INT % 3) AS criterion, min(l_orderkey * 100 + l_partkey % 100) AS ord FROM lineitem GROUP BY 1, 2) QUALIFY nth <= 5",
    "json_part_analysis_validate": _ANALYSES,
    "criterion_status_map": "SELECT raw, scale, n, native, CASE native WHEN 'clear' THEN 'met' WHEN 'strong' THEN 'met' WHEN 'secure' THEN 'met' WHEN 'developing' THEN 'partial' WHEN 'partial' THEN 'partial' WHEN 'weak' THEN 'missed' WHEN 'missing_or_wrong' THEN 'missed' ELSE native END AS normalized FROM (SELECT *, CASE WHEN scale = 'likert_judgement' THEN CASE raw WHEN 'Met' THEN 'clear' WHEN 'missed' THEN 'weak' WHEN 'secure' THEN 'strong' WHEN 'mixed' THEN 'developing' ELSE lower(raw) END ELSE CASE raw WHEN 'Met' THEN 'secure' WHEN 'missed' THEN 'missing_or_wrong' WHEN 'strong' THEN 'secure' WHEN 'weak' THEN 'missing_or_wrong' WHEN 'mixed' THEN 'partial' ELSE lower(raw) END END AS native FROM (SELECT (['Met','partially met','missed','strong','weak','secure','mixed'])[l_partkey % 7 + 1] AS raw, CASE WHEN l_linenumber % 2 = 0 THEN 'likert_judgement' ELSE 'step_status' END AS scale, count(*) AS n FROM lineitem GROUP BY ALL))",
    "note_trim": rf"SELECT doc_id, substring(array_to_string((string_split(regexp_replace(trim(regexp_replace(text, '{_W}', ' ', 'g')), '[.;:,]+$', ''), ' '))[1:5], ' '), 1, 48) AS note FROM documents",
    "feedback_points": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord, point)::INT AS nth, point FROM (SELECT conv_id, min(turn) AS ord, arg_min(p, turn) AS point FROM (SELECT conv_id, turn, text AS p FROM conversations) GROUP BY conv_id, regexp_replace(lower(p), '[.]+$', '')) QUALIFY nth <= 6",
}
ROWS_ONLY = ("markdown_cleanup",)
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
