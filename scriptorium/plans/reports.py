"""Queries on reports, run summaries, moderation, preparation and sources of marks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.operators import benchmark, refinement, responses, scoring
from scriptorium.operators.medians import medians
from scriptorium.plans.marks import _orders, _parts, _t
from scriptorium.sources import documents


def _results(spark, sf):
    """A result for each line: a third of the models' calls fail, some totals of parts differ from the AI's."""
    q = F.col("score")
    return _parts(spark, sf).select(
        "submission_id", "part_idx", F.col("l_returnflag").alias("model"), F.when(F.col("l_suppkey") % 5 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("l_suppkey") % 5 != 0, q).alias("mark"), F.col("part_idx").cast("double").alias("n_parts"), (q * 10).alias("n_words"),
        (q < 8).alias("extraction_issue"), F.when(F.col("part_idx") == 3, 1.5).alias("calibration_delta"), (q / 4 + F.col("part_idx")).alias("latency"), F.when(F.col("l_suppkey") % 5 != 0, q - F.col("part_idx") * 4).alias("ai_math_delta"),
    )


def consistency_report(spark, sf):
    """A6, with the latencies of all stages."""
    stages = {f"latency_{x}": F.col("latency") * i + F.col("part_idx") for i, x in enumerate(benchmark.STAGES)}
    return benchmark.consistency(_results(spark, sf).withColumns(stages), "model", 50.0)


def repeated_errors(spark, sf):
    """Notes that are joined by bars, by model."""
    notes = F.concat_ws(" | ", F.concat(F.lit("note "), (F.col("part_idx") % 3).cast("string")), F.when(F.col("score") > 40, "high"), F.when(F.col("score") < 10, " "))
    rows = _parts(spark, sf).select(F.col("l_returnflag").alias("model"), (F.col("submission_id") * 10 + F.col("part_idx")).alias("ord"), notes.alias("notes"))
    return benchmark.repeated(rows, "notes", "ord", 5, "model", separator=r" \| ")


def disagreements(spark, sf):
    """A8."""
    sized = _parts(spark, sf).groupBy("submission_id").agg(F.sum("score").alias("s"), F.count("*").alias("n")).select("submission_id", (F.col("s") - F.col("n") * 20).alias("ai_math_delta"))
    return benchmark.disagreements(sized, "submission_id")


def _verdicts(spark, sf):
    """Verdicts of a verifier, read from its responses."""
    d = _t(spark, sf, "labels").where("doc_id IS NOT NULL")
    agreement = F.when(F.col("toxic") == 1, "major_concern").when(F.col("quality") == 0, "minor_concern").when(F.col("doc_id") % 10 == 0, "unsure").otherwise("agree")
    issues = F.when(F.col("doc_id") % 2 == 0, F.lit('["too short"]')).otherwise('["no source", "too short"]')
    content = F.concat(F.lit('{"agreement": "'), agreement, F.lit('", "confidence_0_to_100": '), (F.col("doc_id") % 101).cast("string"), F.lit(', "issues": '), issues, F.lit(', "recommendation": "'), F.when(F.col("doc_id") % 3 == 0, "keep").otherwise("look again"), F.lit('"}'))
    return d.select("doc_id", "quality", responses.verification(content).alias("v")).select("doc_id", "quality", "v.*")


def verifier_report(spark, sf):
    """Verdicts by kind of document."""
    v = _verdicts(spark, sf)
    verdicts = [F.count_if(F.col("agreement") == a).alias(f"n_{a}") for a in responses.AGREEMENTS]
    issues = F.sum(F.size(F.coalesce("issues", F.array().cast("array<string>")))).alias("n_issues")
    sums = v.groupBy("quality").agg(F.count_if(F.col("error_code").isNull()).alias("n_ok"), F.count_if(F.col("error_code").isNotNull()).alias("n_failed"), *verdicts, issues)
    middle = medians(v, ["quality"], median_confidence=F.col("confidence")).withColumnRenamed("quality", "_q")
    return sums.join(middle, F.col("quality").eqNullSafe(F.col("_q"))).drop("_q")


def verifier_lists(spark, sf):
    """The recommendations, issues and errors that come most often, by kind of document."""
    return benchmark.verifier_lists(_verdicts(spark, sf), "doc_id", "quality")


def run_means(spark, sf):
    """Means over all runs and by file type, rounded to two places, with the number of distinct runs."""
    o = _orders(spark, sf).select("o_orderstatus", F.floor("o_totalprice").alias("delta"), "o_custkey")
    return benchmark.by_and_overall(o, F.col("o_orderstatus"), F.count("*").alias("n"), F.round(F.sum("delta") / F.count("*"), 2).alias("mean_delta"), F.countDistinct("o_custkey").alias("repeat_count"))


def error_signatures(spark, sf):
    """The twenty most frequent signatures of errors, ties by their text."""
    p = _t(spark, sf, "pages")
    said = t.error_signature(F.concat(F.lit("Part 1 failed:  "), F.regexp_extract("url", r"://([^/]*)", 1)), F.lit("Part 1"))
    return p.select(said.alias("signature")).groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "signature").limit(20)


def moderation_rollup(spark, sf):
    """Groups in all, eligible, changed, and with moderation that changed nothing; mean seconds."""
    e = _t(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("size"), F.sum(F.floor("value")).alias("seconds"))
    eligible = F.col("size") >= 2
    changed = eligible & (F.col("seconds") % 3 == 0)
    return e.groupBy("event_type").agg(F.count("*").alias("n_groups"), F.count_if(eligible).alias("n_eligible"), F.count_if(changed).alias("n_changed"), F.count_if(eligible & ~changed).alias("n_zero_delta"), F.round(F.sum("seconds") / F.count("*"), 2).alias("mean_seconds"))


def moderation_groups(spark, sf):
    """A16."""
    label = F.concat(F.lit("Part "), F.col("part_idx").cast("string"))
    moderated = F.when((F.col("part_idx") % 2 == 0) & (F.col("score") < 30), F.col("score") + 2).otherwise(F.col("score"))
    return benchmark.moderation_groups(_parts(spark, sf).select("submission_id", "part_idx", label.alias("label"), "score", moderated.alias("new_score")), "submission_id")


def score_spread(spark, sf):
    """A2, A3: spread of raw scores, and the largest change by moderation."""
    delta = F.when(F.col("part_idx") % 2 == 0, F.col("score") - 25)
    return _parts(spark, sf).groupBy("submission_id").agg((F.max("score") - F.min("score")).alias("spread"), F.max(F.abs(delta)).alias("max_delta"))


def preparation_confidence(spark, sf):
    """A4: of units some of which have no confidence or a failed verifier."""
    issues = F.when(F.col("part_idx") == 7, F.array(F.lit("rubric_verifier_failed: timeout"))).otherwise(F.array(F.lit("thin")))
    units = _parts(spark, sf).select("submission_id", F.when(F.col("part_idx") % 4 != 0, F.col("score") + 50).alias("confidence"), issues.alias("issues"))
    return responses.preparation(units, "submission_id")


def rubric_refinement(spark, sf):
    """A second attempt on each unit, taken only if it scores higher; with its audit."""
    none = F.array().cast("array<string>")
    old = F.struct(F.lit("text").alias("rubric_text"), F.col("score").alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("issues"))
    failed = F.array(F.lit("rubric_verifier_failed: x"))
    new = F.struct(F.when(F.col("part_idx") == 1, " text ").otherwise("better").alias("rubric_text"), (F.col("part_idx") * 7.0).alias("confidence"), F.when(F.col("part_idx") == 7, failed).otherwise(none).alias("issues"))
    out = _parts(spark, sf).select("part_idx", "score", responses.refined(old, new, F.lit(1)).alias("r"))
    return out.groupBy("part_idx", "score", "r.accepted", "r.audit").agg(F.count("*").alias("n"))


def _verifier(requests):
    """A verifier that is sure by 30 more for each '+' that it has added to a text, and vague at every other one; of size 7 it says
    nothing of use."""
    unit = F.from_json(F.regexp_extract(F.get(F.from_json("payload", "messages array<struct<content:string>>")["messages"], F.lit(1))["content"], r"(?s)\{.*", 0), "unit string, rubric_text string")
    rows = requests.select("request_key", unit.alias("u")).select("request_key", F.col("u.unit").cast("int").alias("size"), F.concat("u.rubric_text", F.lit("+")).alias("text"))
    nth = F.length("text") - F.length(F.replace("text", F.lit("+"), F.lit("")))
    vague = (F.col("size") % 3 == 0) & (nth % 2 == 1)
    said = F.to_json(F.struct(F.col("text").alias("rubric_text"), F.when(vague, F.array(F.lit("vague"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.least(F.lit(100), F.col("size") + 30 * nth).alias("confidence_0_to_100")))
    content = F.when(F.col("size") == 7, "no idea").otherwise(said)
    return rows.select("request_key", F.to_json(F.struct(F.struct(content.alias("content")).alias("message"))).alias("response"), F.lit(None).cast("string").alias("error"))


def rubric_rounds(spark, sf):
    """Four parts are an assessment, whose units a verifier improves in up to three rounds; settled assessments drop out."""
    p = _t(spark, sf, "part").select(F.floor(F.col("p_partkey") / 4).alias("assessment"), "p_partkey", F.col("p_size").cast("string").alias("label"), F.col("p_name").alias("rubric_text"))
    units = p.withColumns({"confidence": F.lit(None).cast("double"), "issues": F.array().cast("array<string>")})
    out = refinement.refined_in_rounds(units, _verifier, "verifier-1")
    return out.select("p_partkey", "rubric_text", "confidence", F.array_join("issues", "|").alias("issues"), "attempts", F.size("accepted").alias("n_accepted"), F.size("rejected").alias("n_rejected"))


def wide_marksheet(spark, sf):
    """A row for each submission, the marks and statuses of every model side by side."""
    r = _results(spark, sf).groupBy("submission_id", "model").agg(F.max("mark").alias("mark"), F.max("status").alias("status"))
    return r.groupBy("submission_id").pivot("model", ["A", "N", "R"]).agg(F.max("mark").alias("mark"), F.max("status").alias("status"))


def marks_onto_csv(spark, sf):
    """Marks join the rows of the input by their id as text; rows without a mark stay, repeated ids fan out."""
    given = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name")
    marks = _orders(spark, sf).select(F.col("o_custkey").cast("string").alias("id"), F.floor("o_totalprice").alias("mark"))
    return given.join(marks, "id", "left")


def human_records(spark, sf):
    """A marks sheet; rows without an id of seven digits or a grade go, and the last row of an id counts."""
    o = _orders(spark, sf)
    ident = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Participant "), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))).otherwise("none")
    rows = o.select(F.col("o_orderkey").alias("ord"), ident.alias("identifier"), F.lit(" a name ").alias("full_name"), F.when(F.col("o_orderkey") % 7 != 0, F.floor("o_totalprice")).alias("grade"), F.lit(None).cast("string").alias("comments"))
    return documents.human_records(rows)


def supported_files(spark, sf):
    """Files that readers know, in the order of their paths."""
    p = _t(spark, sf, "pages")
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".PDF", ".docx", ".odt", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = p.select("page_id", F.concat(F.regexp_extract("url", r"://([^/]*)", 1), F.lit("/file"), suffix).alias("path")).where(documents.supported(F.col("path")))
    nth = F.row_number().over(W.partitionBy(F.substring_index("path", "/", 1)).orderBy("path", "page_id"))
    return rows.select("page_id", "path", nth.alias("nth"))


def combined_documents(spark, sf):
    """The turns of a conversation as the files of one document; blank ones are left out."""
    c = _t(spark, sf, "conversations").select("conv_id", F.format_string("%05d", F.col("turn").cast("int")).alias("path"), F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("role")).alias("text"))
    return documents.combined(c, "conv_id")


def marking_documents(spark, sf):
    """The texts that marking rests on."""
    p = _t(spark, sf, "part")
    return p.select("p_partkey", t.marking_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit(" "), F.col("p_type")).alias("marking_text"))


def label_detection(spark, sf):
    """Detected labels against those that are expected."""
    rows = _parts(spark, sf).where("score > 10").groupBy("submission_id").agg(F.array_sort(F.collect_set("part_idx")).alias("found"))
    matched, exact = benchmark.detection(F.col("found"), F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))))
    found = rows.withColumn("found", F.col("found").cast("array<long>"))
    return found.select("submission_id", matched.alias("n_matched"), exact.alias("exact"))


def part_rollup(spark, sf):
    """Subparts count towards their part, rounded; labels in natural order."""
    label = F.concat(F.lit("Part "), F.ceil(F.col("part_idx") / 3).cast("string"), F.when(F.col("part_idx") <= 3, F.concat(F.lit(" Q"), F.col("part_idx").cast("string"))).otherwise(""))
    rows = _parts(spark, sf).select("submission_id", F.regexp_extract(label, r"^(Part \d+)", 1).alias("label"), "score")
    return rows.groupBy("submission_id", "label").agg(F.round(F.sum("score"), 2).alias("score"))


def calibration_maximum(spark, sf):
    """Calibrated marks that are no number, or over the maximum of the assessment, spoil their group."""
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cohort"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("mark"))
    said = F.when(F.col("id") % 13 == 0, "n/a").otherwise((F.col("mark") + 2).cast("string"))
    marks = o.select("id", said.try_cast("double").alias("calibrated"))
    return scoring.calibrated(o, marks, "id", "cohort", 60.0)


_R = "SELECT l_orderkey, l_linenumber AS k, l_returnflag AS model, l_suppkey % 5 = 0 AS bad, l_quantity AS q FROM lineitem"
_LISTS = """
WITH judged AS (
  SELECT doc_id, quality, NOT coalesce(toxic = 1, false) AND NOT coalesce(quality = 0, false) AND doc_id % 10 = 0 AS unsure FROM labels WHERE doc_id IS NOT NULL
), every AS (
  SELECT quality, doc_id, 'recommendation' AS kind, CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'look again' END AS value FROM judged WHERE NOT unsure
  UNION ALL SELECT quality, doc_id, 'issue', 'too short' FROM judged WHERE NOT unsure
  UNION ALL SELECT quality, doc_id, 'issue', 'no source' FROM judged WHERE NOT unsure AND doc_id % 2 <> 0
  UNION ALL SELECT quality, doc_id, 'error', 'invalid_agreement' FROM judged WHERE unsure
)
SELECT quality, kind, value, n, row_number() OVER (PARTITION BY quality, kind ORDER BY n DESC, first, value)::INT AS nth FROM (SELECT quality, kind, value, count(*) AS n, min(doc_id) AS first FROM every GROUP BY 1, 2, 3) QUALIFY nth <= 5
"""
_ROUNDS = """
WITH units AS (
  SELECT p_partkey, p_name, p_size AS s, min(CASE WHEN p_size = 7 THEN 0 ELSE p_size END) OVER (PARTITION BY p_partkey // 4) AS least FROM part
), taken AS (
  SELECT *, CASE WHEN least >= 45 THEN 1 WHEN least >= 15 THEN 2 ELSE 3 END AS attempts,
    least(100, s + 90) - CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END > least(100, s + 60) AS third FROM units
), plus AS (
  SELECT *, CASE WHEN s = 7 THEN 0 WHEN attempts = 3 AND third THEN 3 ELSE least(attempts, 2) END AS n FROM taken
)
SELECT p_partkey, p_name || repeat('+', n) AS rubric_text, CASE WHEN s = 7 THEN 0 ELSE least(100, s + 30 * n) END::DOUBLE AS confidence,
  CASE WHEN s = 7 THEN 'rubric_verifier_failed: no_object' WHEN s % 3 = 0 AND n % 2 = 1 THEN 'vague' ELSE '' END AS issues, attempts,
  (CASE WHEN s = 7 THEN 0 ELSE n - 1 END)::INT AS n_accepted, (CASE WHEN s = 7 THEN 2 WHEN attempts = 3 AND NOT third THEN 1 ELSE 0 END)::INT AS n_rejected
FROM plus
"""
SQL = {
    "consistency_report": f"SELECT model, count(*) FILTER (NOT bad) AS n_ok, count(*) FILTER (bad) AS n_error, median(k::DOUBLE) AS median_parts, median(q * 10) AS median_words, count(*) FILTER (q < 8) AS n_extraction_issues, count(*) FILTER (k = 3) AS n_calibrated, median(q / 4 + k) AS median_latency, max(q / 4 + k) AS max_latency, median(abs(q - k * 4)) FILTER (NOT bad) AS median_delta, max(abs(q - k * 4)) FILTER (NOT bad) AS max_delta, count(*) FILTER (NOT bad AND abs(q - k * 4) > 3) AS n_large_delta, count(*) FILTER (NOT bad) AS n_marks, round(avg(q) FILTER (NOT bad), 2) AS mean_mark, median(q) FILTER (NOT bad) AS median_mark, min(q) FILTER (NOT bad) AS min_mark, max(q) FILTER (NOT bad) AS max_mark, array_to_string(list_transform(list_sort(list(DISTINCT q) FILTER (NOT bad)), lambda x: x::INT::VARCHAR), ', ') AS distinct_marks, count(*) FILTER (NOT bad AND q = 50) AS n_top_marks, round((count(*) FILTER (NOT bad AND q = 50))::DOUBLE / (count(*) FILTER (NOT bad)), 3) AS top_mark_rate, median((q / 4 + k) * 0 + k) AS median_assessment_prepare, max((q / 4 + k) * 0 + k) AS max_assessment_prepare, median((q / 4 + k) * 1 + k) AS median_structure_detect, max((q / 4 + k) * 1 + k) AS max_structure_detect, median((q / 4 + k) * 2 + k) AS median_part_refine, max((q / 4 + k) * 2 + k) AS max_part_refine, median((q / 4 + k) * 3 + k) AS median_part_analysis, max((q / 4 + k) * 3 + k) AS max_part_analysis, median((q / 4 + k) * 4 + k) AS median_moderation, max((q / 4 + k) * 4 + k) AS max_moderation, median((q / 4 + k) * 5 + k) AS median_finalize, max((q / 4 + k) * 5 + k) AS max_finalize FROM ({_R}) GROUP BY 1",
    "repeated_errors": f"SELECT model, value, n, row_number() OVER (PARTITION BY model ORDER BY n DESC, first, value)::INT AS nth FROM (SELECT model, value, count(*) AS n, min(ord) AS first FROM (SELECT model, l_orderkey * 10 + k AS ord, unnest(list_filter(['note ' || (k % 3), CASE WHEN q > 40 THEN 'high' END], lambda x: x IS NOT NULL)) AS value FROM ({_R})) GROUP BY 1, 2) QUALIFY nth <= 5",
    "disagreements": "SELECT l_orderkey AS submission_id, sum(l_quantity) - count(*) * 20 AS ai_math_delta FROM lineitem GROUP BY 1 HAVING abs(ai_math_delta) > 0 ORDER BY 1 LIMIT 10",
    "verifier_lists": _LISTS,
    "verifier_report": "SELECT quality, count(*) FILTER (v <> 'unsure') AS n_ok, count(*) FILTER (v = 'unsure') AS n_failed, count(*) FILTER (v = 'agree') AS n_agree, count(*) FILTER (v = 'minor_concern') AS n_minor_concern, count(*) FILTER (v = 'major_concern') AS n_major_concern, median((doc_id % 101)::DOUBLE) FILTER (v <> 'unsure') AS median_confidence, sum(CASE WHEN v = 'unsure' THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS n_issues FROM (SELECT *, CASE WHEN toxic = 1 THEN 'major_concern' WHEN quality = 0 THEN 'minor_concern' WHEN doc_id % 10 = 0 THEN 'unsure' ELSE 'agree' END AS v FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1",
    "run_means": "SELECT o_orderstatus, count(*) AS n, round(sum(floor(o_totalprice)::BIGINT)::DOUBLE / count(*), 2) AS mean_delta, count(DISTINCT o_custkey) AS repeat_count FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus))",
    "error_signatures": "SELECT 'Part <section> failed: ' || regexp_extract(url, '://([^/]*)', 1) AS signature, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "moderation_rollup": "SELECT event_type, count(*) AS n_groups, count(*) FILTER (size >= 2) AS n_eligible, count(*) FILTER (size >= 2 AND s % 3 = 0) AS n_changed, count(*) FILTER (size >= 2 AND s % 3 <> 0) AS n_zero_delta, round(sum(s)::DOUBLE / count(*), 2) AS mean_seconds FROM (SELECT event_type, user_id, count(*) AS size, sum(floor(value)::BIGINT)::BIGINT AS s FROM events GROUP BY 1, 2) GROUP BY 1",
    "moderation_groups": "SELECT submission_id, sum(q) AS before, sum(m) AS after, sum(m) - sum(q) AS delta, coalesce(string_agg('Part ' || k, '|' ORDER BY k) FILTER (m <> q), '') AS changed_labels FROM (SELECT l_orderkey AS submission_id, l_linenumber AS k, l_quantity AS q, CASE WHEN l_linenumber % 2 = 0 AND l_quantity < 30 THEN l_quantity + 2 ELSE l_quantity END AS m FROM lineitem) GROUP BY 1",
    "score_spread": "SELECT l_orderkey AS submission_id, max(l_quantity) - min(l_quantity) AS spread, max(abs(l_quantity - 25)) FILTER (l_linenumber % 2 = 0) AS max_delta FROM lineitem GROUP BY 1",
    "preparation_confidence": "SELECT l_orderkey AS submission_id, round(avg(l_quantity + 50) FILTER (l_linenumber % 4 <> 0), 2) AS confidence, count(*) FILTER (l_linenumber % 4 <> 0) = 0 OR (count(*) FILTER (l_linenumber = 7) = 0 AND min(l_quantity + 50) FILTER (l_linenumber % 4 <> 0) >= 75) AS acceptable FROM lineitem GROUP BY 1",
    "rubric_rounds": _ROUNDS,
    "rubric_refinement": "SELECT k AS part_idx, q AS score, k * 7 - CASE WHEN k = 7 THEN 26 ELSE 0 END > q - 2 AS accepted, 'attempt_1: confidence ' || q::INT || '.00->' || (k * 7) || '.00, issues 2->' || CASE WHEN k = 7 THEN 1 ELSE 0 END || ', ' || CASE WHEN k = 1 THEN 'text_unchanged' ELSE 'text_changed' END AS audit, count(*) AS n FROM (SELECT l_linenumber AS k, l_quantity AS q FROM lineitem) GROUP BY ALL",
    "wide_marksheet": "SELECT l_orderkey AS submission_id, " + ", ".join(f"max(q) FILTER (model = '{m}' AND NOT bad) AS \"{m}_mark\", max(CASE WHEN bad THEN 'error' ELSE 'ok' END) FILTER (model = '{m}') AS \"{m}_status\"" for m in "ANR") + f" FROM ({_R}) GROUP BY 1",
    "marks_onto_csv": "SELECT c_custkey::VARCHAR AS id, c_name, floor(o_totalprice)::BIGINT AS mark FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "human_records": "SELECT lpad(o_custkey::VARCHAR, 7, '0') AS participant_id, 'a name' AS full_name, arg_max(floor(o_totalprice)::DOUBLE, o_orderkey) AS total_mark, '' AS comments FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 1",
    "supported_files": "SELECT page_id, path, row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY path, page_id)::INT AS nth FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) || '/file' || (['.txt','.PDF','.docx'])[page_id % 5 + 1] AS path FROM pages WHERE page_id % 5 < 3)",
    "combined_documents": "SELECT conv_id, string_agg(role, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 3 <> 2 AND trim(role) <> '' GROUP BY 1",
    "marking_documents": "SELECT p_partkey, 'Marking scheme:' || chr(10) || p_name || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || 'Assignment brief:' || chr(10) || p_brand ELSE '' END || chr(10) || chr(10) || 'Other context:' || chr(10) || p_type AS marking_text FROM part",
    "label_detection": "SELECT submission_id, len(list_filter(found, lambda x: x <= 3))::INT AS n_matched, found = [1, 2, 3] AS exact FROM (SELECT l_orderkey AS submission_id, list_sort(list(DISTINCT l_linenumber::INT)) AS found FROM lineitem WHERE l_quantity > 10 GROUP BY 1)",
    "part_rollup": "SELECT l_orderkey AS submission_id, 'Part ' || ((l_linenumber + 2) // 3) AS label, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2",
    "calibration_maximum": "SELECT id, cohort, mark, CASE WHEN ok THEN mark + 2 ELSE mark END AS final_mark, CASE WHEN ok THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS calibration_delta, CASE WHEN ok THEN 'ok' ELSE 'calibration_failed' END AS status FROM (SELECT *, min((id % 13 <> 0 AND mark + 2 BETWEEN 0 AND 60)::INT) OVER (PARTITION BY cohort) = 1 AS ok FROM (SELECT o_orderkey AS id, o_custkey AS cohort, floor(o_totalprice / 5000)::DOUBLE AS mark FROM orders))",
}
QUERIES = {name: globals()[name] for name in SQL}
