"""Queries on structure and segmentation, most of them round trips: texts are built from rows and parsed back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import bands
from scriptorium.functions import text as t
from scriptorium.operators import jsons, merging, parsers, responses, scorers, structure
from scriptorium.plans.marks import _t


def _numbered(spark, sf):
    li = _t(spark, sf, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return li.withColumn("n", F.row_number().over(w)).select("l_orderkey", "n", F.col("l_quantity").cast("int").alias("q"), "l_partkey", "l_suppkey")


def _documents(spark, sf):
    """A marking document for each order: a preamble, and a header with a body of two numbered lines for each of its lines."""
    line = F.concat(F.lit("Part "), F.col("n").cast("string"), F.lit(" ("), F.col("q").cast("string"), F.lit(" marks)\n1. state item "), F.col("l_partkey").cast("string"), F.lit(" [2 marks]\n2. explain item "), F.col("l_suppkey").cast("string"))
    rows = _numbered(spark, sf).select(F.col("l_orderkey").alias("assessment"), "n", line.alias("line"))
    joined = rows.groupBy("assessment").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"))
    return joined.select("assessment", F.concat(F.lit("Answer all parts.\n\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n\n")).alias("text"))


def section_parse(spark, sf):
    out = structure.sections(_documents(spark, sf))
    return out.select("assessment", "ord", "label_key", "max_mark", "weight_text", F.length("body").alias("body_chars"))


def child_parse_and_marks(spark, sf):
    units = structure.children(structure.sections(_documents(spark, sf)))
    return units.groupBy("assessment").agg(F.count("*").alias("n_units"), F.sum("max_mark").alias("marks"), F.count("max_mark").alias("n_marked"))


def assessment_units(spark, sf):
    """A section with two marked children or more gives its children, another itself."""
    return structure.assessment_map(_documents(spark, sf)).select("assessment", "label_key", "max_mark")


def scale_confidence(spark, sf):
    """Of documents half of which state no marks, or have no sections at all."""
    d = _documents(spark, sf)
    plain = F.when(F.col("assessment") % 4 == 0, "no headers").when(F.col("assessment") % 4 == 1, F.regexp_replace("text", r"\d+ marks", "all")).otherwise(F.col("text"))
    return structure.scale_confidence(structure.assessment_map(d.withColumn("text", plain)))


def expected_units(spark, sf):
    """What a submission should hold, by the marking document."""
    return structure.expected_subparts(structure.sections(_documents(spark, sf)))


def _half(spark, sf, keep, shift):
    p = _t(spark, sf, "part").where(keep)
    return p.select(F.col("p_brand").alias("assessment"), F.concat(F.lit("part "), (F.col("p_size") % 10).cast("string")).alias("label_key"), F.col("p_partkey").alias("ord"), F.concat(F.col("p_name"), F.lit(shift)).alias("body"), F.col("p_size").cast("double").alias("max_mark"))


def structure_merge(spark, sf):
    return structure.merged(_half(spark, sf, F.lit(True), ""))


def structure_reconcile(spark, sf):
    prompt = structure.merged(_half(spark, sf, "p_size < 30", ""))
    scheme = structure.merged(_half(spark, sf, "p_size >= 25", "..."))
    return structure.reconciled(prompt, scheme)


def whole_reconcile(spark, sf):
    """A prompt with a part for each line of an order, and a scheme that knows each odd one twice, last ones first; texts, lists
    and children merged."""
    n, q, pk, sk = (F.col(c).cast("string") for c in ("n", "q", "l_partkey", "l_suppkey"))
    rows = _numbered(spark, sf)
    asked = F.concat(F.lit("Part "), n, F.lit(" ("), q, F.lit(" marks)\nDiscuss item "), pk, F.lit(".\n1. state item "), pk, F.lit(" [2 marks]\n2. explain item "), sk)
    told = F.concat(F.lit("PART  "), n, F.lit("\nUse report "), sk, F.lit(".\n{}Answer: Students should mention item "), pk, F.lit("."))
    more = F.concat(F.lit("Quote lecture "), pk, F.lit(" after Part 2.\nuse  report "), sk, F.lit(".\n"))
    scheme = F.concat(F.replace(told, F.lit("{}"), F.lit("")), F.lit("\n"), F.replace(told, F.lit("{}"), more))
    text = lambda rows, line, order: rows.groupBy(F.col("l_orderkey").alias("assessment")).agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), line.alias("line")))).alias("x")).select("assessment", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
    prompt = merging.merged_sections(structure.sections(text(rows, asked, F.col("n"))))
    known = merging.merged_sections(structure.sections(text(rows.where("n % 2 = 1"), scheme, -F.col("n"))))
    out = merging.reconciled_sections(prompt, known)
    s = F.col("section")
    nth = F.row_number().over(W.partitionBy("assessment").orderBy("place"))
    return out.select("assessment", nth.alias("nth"), "side", s["label"].alias("label"), s["max_mark"].alias("max_mark"), s["question"].alias("question"), s["marking"].alias("marking"), *(F.array_join(s[x], "|").alias(x) for x in ("anchors", "evidence", "dependencies")), F.array_join(F.transform(s["children"], lambda x: F.concat_ws(":", x["label"], x["text"])), "|").alias("children"))


def detected_and_expected(spark, sf):
    """A detector's answer on each order, which knows odd parts, repeats itself, points elsewhere and names a part that is not
    there; every third order expects nothing."""
    n = F.col("n").cast("string")
    said = F.struct(F.concat(F.lit("PART "), n).alias("label"), F.when(F.col("q") > 25, F.concat(F.lit(" on "), F.col("q").cast("string"))).otherwise("").alias("focus_hint"))
    extra = F.array(*(F.struct(F.lit(x).alias("label"), F.lit("").alias("focus_hint")) for x in ("", " Section  above", "Part 9", "Part 9")))
    answers = _numbered(spark, sf).where("n % 2 = 1").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))).alias("x"))
    content = F.to_json(F.struct(F.concat(F.transform("x", lambda x: x["s"]), extra).alias("sections")))
    seen = answers.select(F.col("l_orderkey").alias("submission"), F.explode_outer(merging.detected_parts(content)).alias("p")).select("submission", "p.*", F.lit("").alias("section_text"))
    wanted = _numbered(spark, sf).where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("submission"), F.concat(F.lit("Part "), n).alias("label"), F.lit("hint").alias("focus_hint"), F.concat(F.lit("Q"), n).alias("anchor_text"), F.col("q").cast("double").alias("max_mark"))
    return merging.reconciled_parts(wanted, seen, "submission").drop("section_text")


def detection_chunks(spark, sf):
    """What a detector is shown of a conversation's transcript: the head and what surrounds its first cues."""
    subs, _ = _transcripts(spark, sf)
    return subs.select("submission_id", merging.chunk_text(merging.detection_chunks(F.col("text"))).alias("chunks"))


def _transcripts(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("submission_id"), (F.col("turn") + 1).cast("int").alias("part_idx"), "text")
    c = c.withColumn("label", F.concat(F.lit("Part "), F.col("part_idx").cast("string")))
    toc = F.concat(F.lit("Part "), F.lit("1 ....... 1\nPart 2 ....... 2\nPart 3 ....... 3\n"))
    joined = c.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("part_idx", "label", "text"))).alias("rows"))
    toc = F.when(F.size("rows") >= 3, toc).otherwise("")  # fewer labels make no table of contents
    text = F.concat(toc, F.array_join(F.transform("rows", lambda x: F.concat(x["label"], F.lit("\n"), x["text"])), "\n"), F.repeat(F.lit(" end"), 200))
    return joined.select("submission_id", text.alias("text")), c.select("submission_id", "part_idx", "label")


def segment_by_anchor(spark, sf):
    subs, expected = _transcripts(spark, sf)
    out = structure.segmented(subs, expected)
    body = F.expr("substring(section_text, length(label) + 2, length(section_text))")
    return out.select("submission_id", "part_idx", "label", F.regexp_replace(F.regexp_replace(body, r"( end){200}$", ""), r"\n$", "").alias("said"))


def expected_left_detected(spark, sf):
    """Detected labels that are expected stay, expected ones that were not detected come back."""
    found = _numbered(spark, sf).where("n % 2 = 1").select("l_orderkey", F.concat(F.lit("part "), F.col("n").cast("string")).alias("label_key"), F.lit(True).alias("detected"))
    wanted = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).withColumn("label_key", F.concat(F.lit("part "), F.col("i").cast("string")))
    return wanted.join(found, ["l_orderkey", "label_key"], "left").groupBy("l_orderkey").agg(F.count("detected").alias("n_detected"), F.count_if(F.col("detected").isNull()).alias("n_added"))


def unexpected_anti(spark, sf):
    found = _numbered(spark, sf).select("l_orderkey", "n")
    wanted = _t(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return found.join(wanted, "l_orderkey", "left_anti").groupBy("n").agg(F.count("*").alias("unexpected"))


def chunk_interval_merge(spark, sf):
    """Spans around each event of a user, by its place among all events, joined where they overlap."""
    e = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("start"))
    spans = e.select("user_id", (F.col("start") - 100).alias("start"), (F.col("start") + 420).alias("end"))
    return structure.merged_spans(spans, "user_id", most=8).select("user_id", F.col("island").cast("int").alias("island"), "start", "end", "n")


def subpart_segment(spark, sf):
    """What one role says in a conversation is a part, its turns are the subparts. Turns are numbered in three ways, but not
    those under 200 bytes; a detector names the numbered turns of assistants. Some questions ask for more than one thing, and every
    fourth turn revises what precedes it."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    c = _t(spark, sf, "conversations").select("conv_id", "role", "text", F.row_number().over(w).alias("part_idx"), F.octet_length("text").alias("size"))
    n = F.col("part_idx").cast("string")
    head = F.when(F.col("size") < 200, F.lit("")).when(F.col("part_idx") % 3 == 0, F.concat(n, F.lit(") "))).when(F.col("part_idx") % 3 == 1, F.concat(F.lit("Q"), n, F.lit(" "))).otherwise(F.concat(F.lit("Question "), n, F.lit(": ")))
    rows = c.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("part_idx", F.concat(head, "text").alias("line")))).alias("rows"))
    parts = rows.select("conv_id", "role", F.lit("Part 1").alias("label"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("section_text"))
    question = F.when(F.col("part_idx") % 2 == 0, "1. State the claim. 2. Define each term.").otherwise("State the claim.")
    task = F.when(F.col("part_idx") % 4 == 0, structure.CUMULATIVE_TASK).otherwise("comparison")
    wanted = c.select("conv_id", "role", "part_idx", F.concat(F.lit("Part 1 Q"), n).alias("label"), question.alias("question"), task.alias("task_type"))
    detected = c.where("role = 'assistant' AND size >= 200").select("conv_id", "role", F.concat(F.lit("PART 1  q"), n).alias("label"))
    return structure.subpart_segments(parts, wanted, "conv_id", "role", detected=detected)


def fast_path_detection(spark, sf):
    """Whether a submission's anchors suffice, or a model must be asked."""
    rows = _numbered(spark, sf).groupBy("l_orderkey").agg(F.count("*").alias("expected"), F.count_if(F.col("q") > 25).alias("anchored"))
    path = F.when(F.col("expected") == 1, "accept").when(F.col("anchored") >= F.greatest(F.lit(2), F.floor(F.col("expected") / 2)), "accept").otherwise("ask")
    return rows.withColumn("path", path)


def hybrid_structure(spark, sf):
    """Marking documents parsed by their units, by their layout, and as models answered, for one in three in two answers of
    which one knows a section more; merged."""
    docs = _documents(spark, sf)
    rows = _numbered(spark, sf).where("n <= 2").select(F.col("l_orderkey").alias("assessment"), "n", "q")
    unit = lambda label, text, mark: F.struct(label.alias("label"), text.alias("instruction_text"), mark.alias("max_mark"), F.lit("").alias("weight_text"))
    label = F.concat(F.lit("PART "), F.col("n").cast("string"))
    kid = unit(F.concat(label, F.lit(" q3")), F.lit("said by a model"), F.lit(1.5))
    part = F.struct(label.alias("label"), F.repeat(F.lit("long "), F.col("q")).alias("instruction_text"), F.col("q").cast("double").alias("max_mark"), F.lit("").alias("weight_text"), F.array(kid).alias("subparts"))
    extra = F.struct(F.lit("Task 9").alias("label"), F.lit("more").alias("instruction_text"), F.lit(None).cast("double").alias("max_mark"), F.lit("").alias("weight_text"), F.array(*(unit(F.lit(f"Task 9 Q{i}"), F.lit("x"), F.lit(1.0)) for i in range(1, 20))).alias("subparts"))
    lists = rows.groupBy("assessment").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]).alias("parts"))
    few = lists.select("assessment", F.to_json(F.struct(F.col("parts").alias("sections"))).alias("content"))
    many = lists.where(F.size("parts") == 2).select("assessment", F.to_json(F.struct(F.concat("parts", F.array(extra)).alias("sections"))).alias("content"))
    out = parsers.hybrid(docs, few.union(many))
    texts = F.aggregate("sections", F.lit(0), lambda a, x: a + F.length(x["instruction_text"]))
    return out.select("assessment", "top_level_count", "total_unit_count", "marks_found_count", F.array_join("labels", "|").alias("labels"), texts.alias("text_chars"))


def rubric_matrix_rows(spark, sf):
    """K4: a row for each band of each unit."""
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("unit"), F.col("p_size").alias("max_mark"))
    each = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(lo).alias("least")) for b, lo, _ in bands.ANALYTICAL))
    return p.withColumn("b", F.explode(each)).select("section", "unit", "b.band", (F.col("max_mark") * F.col("b.least") / 100).alias("least_mark"))


def _answers(spark, sf, label=None):
    """What each turn of a conversation asks of a scorer, with the turn as a whole text; parts are labelled by their turn, or by `label`."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("section_text"))
    parts = c.withColumns({
        "label": F.concat(F.lit("Part "), F.col("turn").cast("string")) if label is None else label, "max_mark": F.when(F.col("turn") % 3 > 0, F.col("turn") + 9.5), "question": F.lit("Say why, with evidence."),
        "task_type": F.when(F.col("turn") % 2 == 0, "evaluative_discussion").otherwise("comparison"), "marking_guidance": F.lit("Quote the page numbers."),
    })
    return scorers.part_requests(parts, "scorer-1")


def request_keys(spark, sf):
    """The digests of all requests, and the size of their payloads."""
    return scorers.keyed(_answers(spark, sf)).select("conv_id", "turn", "request_key", F.length("payload").alias("payload_chars"))


def replay_pipeline(spark, sf):
    """Requests for parts that are not blank, answers looked up by the requests' digests, those without a comment
    asked for again with a note, validated scores, totals. Some answers come in no envelope, some in prose. Answers depend on the
    conversation, so its number is in the requests: those of equal texts in two conversations would be one request else."""
    requests = _answers(spark, sf, F.concat_ws(" of ", F.concat(F.lit("Part "), F.col("turn").cast("string")), F.col("conv_id").cast("string")))
    n = F.col("conv_id") + F.col("turn")
    content = lambda comment: F.concat(F.lit('Here: {"provisional_score":'), (F.col("turn") % 5 + F.col("conv_id") % 3).cast("string"), F.lit(f',"coverage_comment":"{comment}","strengths":[],"weaknesses":[],"evidence":[]}} {{'))
    message = lambda said: F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), said.alias("content")).alias("message")))
    again = requests.where(n % 4 == 0).withColumn("body", scorers.with_note(F.col("body"), scorers.retry_note(F.lit("comment_missing"))))
    first = scorers.keyed(requests).select("request_key", F.when(n % 11 == 1, F.lit('{"done": true}')).otherwise(message(F.when(n % 4 == 0, content(" ")).otherwise(content("ok")))).alias("response"))
    second = scorers.keyed(again).select("request_key", message(content("ok")).alias("response"))
    scored = scorers.answers(requests, scorers.replayed(first.union(second)), responses.part_analysis)
    score = F.coalesce("provisional_score", F.col("provisional_score_0_to_100"))
    return scored.groupBy("conv_id").agg(F.least(F.lit(100.0), F.sum(score)).alias("total_mark"), F.count_if(F.col("error_code") == "no_message").alias("n_errors"), F.sum("attempts").alias("n_calls"))


def json_brace_scan(spark, sf):
    """An object with a whole document inside, as a response may hold it: alone, in prose, behind braces that nothing closes, behind
    a string with a brace (which a quote in the text makes an object of its own, and no JSON), after what only looks like one, or cut off."""
    held = F.to_json(F.struct(F.coalesce("source", F.lit("")).alias("a"), F.coalesce("text", F.lit("")).alias("b")))
    d = _t(spark, sf, "documents").select("doc_id", (F.length("text") % 6).alias("kind"), held.alias("held"))
    around = F.element_at(F.array(F.concat(F.lit("noise "), "held", F.lit(" } tail")), F.col("held"), F.concat(F.lit("a set { of { "), "held"), F.concat(F.lit('so { "{" and '), "held"), F.concat(F.lit("{a: {}} "), "held"), F.expr("substring(held, 1, length(held) - 1)")), (F.coalesce("kind", F.lit(0)) + 1).cast("int"))
    found = d.select("doc_id", "held", "kind", jsons.json_object(around).alias("found"))
    return found.select("doc_id", F.col("found.object").alias("object"), F.col("found.error_code").alias("error_code"))


def question_cleanup(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("Part "), F.col("p_size").cast("string"), F.lit(" (5 marks) Ex- plain  "), F.col("p_name"), F.lit(" [Suggested word count: 200] at length.")).alias("q"))
    return p.select("p_partkey", t.clean_question(F.col("q")).alias("question"))


_N = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::INT AS n, l_quantity::INT AS q, l_partkey, l_suppkey FROM lineitem"
_SECOND = "CASE WHEN q - 2 > 0 THEN (q - 2)::DOUBLE END"
_MERGED = "SELECT p_brand AS assessment, 'part ' || (p_size % 10) AS label_key, min(p_partkey) AS ord, arg_max(p_name || '{s}', length(p_name) * 1000000 - p_partkey) AS body, arg_min(p_size::DOUBLE, p_partkey) AS max_mark FROM part WHERE {w} GROUP BY 1, 2"
_REPAIRED = """{n}_own AS (
  SELECT *, trim(substr(text, {a} + 1, {b} - {a}), ' ' || chr(10)) AS own, greatest(0, {a} - wide) AS low, least(length(text), {b} + wide) AS high FROM {f}
), {n}_flat AS (
  SELECT *, trim(regexp_replace(own, '\\s+', ' ', 'g')) AS flat, strpos(reverse(substr(text, low + 1, {a} - low)), chr(10)) AS last, strpos(substr(text, {b} + 1, high - {b}), chr(10)) AS after FROM {n}_own
), {n} AS (
  SELECT * EXCLUDE (own, low, high, flat, last, after, left_, right_), CASE WHEN NOT (flat = '' OR contains(flat, '...') OR len(regexp_extract_all(flat, '[a-z]{{6,}}[A-Z][a-z]+')) >= 2 OR regexp_matches(flat, '[a-z]{{16,}}')
    OR length(flat) < 120 OR (many AND length(flat) < 260)) THEN own ELSE coalesce(nullif(trim(substr(text, left_ + 1, right_ - left_), ' ' || chr(10)), ''), own) END AS {n}_text
  FROM (SELECT *, CASE WHEN low > 0 AND last > 0 THEN {a} - last + 1 ELSE low END AS left_, CASE WHEN high < length(text) AND after > 0 THEN {b} + after - 1 ELSE high END AS right_ FROM {n}_flat)
)"""
_HYBRID = f"""
WITH parts AS (
  SELECT l_orderkey AS assessment, n, q, q > 2 AS by_kids, count(*) OVER (PARTITION BY l_orderkey) BETWEEN 2 AND 8 AS modelled,
    length('Part ' || n || ' (' || q || ' marks)' || chr(10) || '1. state item ' || l_partkey || ' [2 marks]' || chr(10) || '2. explain item ' || l_suppkey) AS whole FROM ({_N})
)
SELECT assessment, (count(*) + any_value(modelled)::INT)::INT AS top_level_count,
  (sum(CASE WHEN NOT modelled THEN 3 ELSE 1 + 2 * by_kids::INT + (n <= 2)::INT END) + 20 * any_value(modelled)::INT)::INT AS total_unit_count,
  (sum(CASE WHEN modelled AND n <= 2 THEN 2 + 2 * by_kids::INT WHEN modelled THEN 1 + by_kids::INT ELSE 2 + by_kids::INT END) + 19 * any_value(modelled)::INT)::INT AS marks_found_count,
  string_agg('Part ' || n || CASE WHEN by_kids OR NOT modelled THEN '|Part ' || n || ' Q1|Part ' || n || ' Q2' ELSE '' END || CASE WHEN modelled AND n <= 2 THEN '|PART ' || n || ' q3' ELSE '' END, '|' ORDER BY n)
    || CASE WHEN any_value(modelled) THEN '|Task 9|' || array_to_string(list_transform(range(1, 20), lambda i: 'Task 9 Q' || i), '|') ELSE '' END AS labels,
  (sum(CASE WHEN NOT modelled OR NOT by_kids THEN whole WHEN n <= 2 THEN 5 * q - 1 ELSE 0 END) + 4 * any_value(modelled)::INT)::INT AS text_chars
FROM parts GROUP BY assessment
"""
_KEYS = """
WITH payloads AS (
  SELECT conv_id, turn, '{"section_id":"Part ' || turn || '","max_mark":' || CASE WHEN turn % 3 > 0 THEN (turn + 9.5)::DOUBLE ELSE 100.0::DOUBLE END
    || ',"question":{"text":"Say why, with evidence.","task_type":"' || CASE WHEN turn % 2 = 0 THEN 'evaluative_discussion' ELSE 'comparison' END
    || '"},"scoring":{"method":"' || CASE WHEN turn % 2 = 0 THEN 'classification_then_score","scale":{"type":"likert_judgement","labels":["weak","developing","clear","strong"]}' ELSE 'criterion_evaluation","scale":{"type":"verification_check","labels":["missing_or_wrong","partial","secure"]}' END
    || ',"rules":["' || CASE WHEN turn % 3 > 0 THEN 'provisional_score lies between 0 and ' || (turn + 9.5)::DOUBLE ELSE 'provisional_score_0_to_100 lies between 0 and 100' END
    || '.","Nothing outside this section counts.","Reward specific references when the task asks for them.","If a response contains no relevant attempt, no attempt at the required method, or only unrelated content, award zero or minimal credit."]},"student_response":{"text":' || to_json(text)
    || '},"output_contract":["Keys: section_label, ' || CASE WHEN turn % 3 > 0 THEN 'provisional_score' ELSE 'provisional_score_0_to_100' END || ', criterion_notes, strengths, weaknesses, evidence, coverage_comment.","criterion_notes lists {criterion_name, status, note}; a status is one of: '
    || CASE WHEN turn % 2 = 0 THEN 'weak, developing, clear, strong' ELSE 'missing_or_wrong, partial, secure' END || '; a note has two to five words.","Two strengths, two weaknesses and one piece of evidence at least; coverage_comment is not empty."]}' AS payload
  FROM conversations WHERE trim(text) <> ''
), bodies AS (
  SELECT conv_id, turn, '{"model":"scorer-1","format":"json","messages":[{"role":"system","content":"You mark one section of a submission. The payload holds all that counts. Answer with one JSON object."},{"role":"user","content":'
    || to_json('scoring_payload:' || chr(10) || payload) || '}],"stream":false,"options":{"temperature":0.05,"top_p":0.85,"num_ctx":8192,"seed":7,"num_predict":1100}}' AS body
  FROM payloads
)
SELECT conv_id, turn, sha256('part_scoring' || chr(10) || body) AS request_key, length(body)::INT AS payload_chars FROM bodies
"""
_CHILDREN = f"""
WITH turns AS (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i, strlen(text) AS size, text FROM conversations
), lines AS (
  SELECT *, CASE WHEN size < 200 THEN '' WHEN i % 3 = 0 THEN i || ') ' WHEN i % 3 = 1 THEN 'Q' || i || ' ' ELSE 'Question ' || i || ': ' END || text AS line FROM turns
), placed AS (
  SELECT conv_id, role, i, size >= 200 AS marked, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id, role ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
    count(*) OVER p AS n, count(*) FILTER (size >= 200) OVER p AS found FROM lines WINDOW p AS (PARTITION BY conv_id, role)
), joined AS (
  SELECT conv_id, role, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY ALL
), decided AS (
  SELECT p.*, j.text, CASE WHEN i % 2 = 0 THEN 420 ELSE 260 END AS wide, i % 2 = 0 AS many,
    found >= greatest(2, n // 2 + 1) OR (role = 'assistant' AND found >= 2 AND len(regexp_extract_all(j.text, '[^ \n]+')) >= 10 * n) AS cut,
    coalesce(min(pos) FILTER (marked) OVER (PARTITION BY conv_id, role ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), length(j.text))::BIGINT AS stop, 0::BIGINT AS zero
  FROM placed p JOIN joined j USING (conv_id, role)
), {_REPAIRED.format(n="slice", a="pos", b="stop", f="decided")}, {_REPAIRED.format(n="before", a="zero", b="stop", f="slice")}
SELECT conv_id, role, CASE WHEN n > 1 THEN i::INT END AS part_idx, CASE WHEN n > 1 THEN 'Part 1 Q' || i ELSE 'Part 1' END AS label,
  CASE WHEN n > 1 AND marked AND i % 4 = 0 THEN before_text WHEN n > 1 AND marked AND cut THEN slice_text ELSE text END AS section_text,
  CASE WHEN n < 2 THEN 'whole' WHEN marked AND i % 4 = 0 THEN 'cumulative' WHEN marked AND cut THEN 'anchored' ELSE 'inherited' END AS resolved
FROM before
"""
_RECONCILED = f"""
WITH rows AS (
  SELECT l_orderkey AS assessment, n, q, l_partkey::VARCHAR AS pk, l_suppkey::VARCHAR AS sk, n % 2 = 1 AS known FROM ({_N})
)
SELECT assessment, row_number() OVER (PARTITION BY assessment ORDER BY NOT known, CASE WHEN known THEN -n ELSE n END)::INT AS nth, CASE WHEN known THEN 'both' ELSE 'prompt' END AS side, 'Part ' || n AS label, q::DOUBLE AS max_mark,
  CASE WHEN known THEN 'PART  ' || n || chr(10) || 'Use report ' || sk || '.' || chr(10) || 'Quote lecture ' || pk || ' after Part 2.' || chr(10) || 'use  report ' || sk || '.'
    ELSE 'Part ' || n || ' (' || q || ' marks)' || chr(10) || 'Discuss item ' || pk || '.' || chr(10) || '1. state item ' || pk || ' [2 marks]' || chr(10) || '2. explain item ' || sk END AS question,
  CASE WHEN known THEN 'Students should mention item ' || pk || '.' ELSE '' END AS marking,
  'Discuss item ' || pk || '.|2. explain item ' || sk || CASE WHEN known THEN '|Use report ' || sk || '.' ELSE '' END AS anchors,
  CASE WHEN known THEN 'Use report ' || sk || '.|Quote lecture ' || pk || ' after Part 2.' ELSE '' END AS evidence,
  CASE WHEN known THEN 'part 2' ELSE '' END AS dependencies,
  'Part ' || n || ' Q1:1. state item ' || pk || ' [2 marks]|Part ' || n || ' Q2:2. explain item ' || sk AS children
FROM rows
"""
_DETECTED = f"""
WITH rows AS (SELECT l_orderkey AS submission, n, q FROM ({_N}))
SELECT submission, 'Part ' || n AS label, CASE WHEN n % 2 = 1 AND n <> 9 AND q > 25 THEN 'on ' || q ELSE 'hint' END AS focus_hint, 'Q' || n AS anchor_text, q::DOUBLE AS max_mark, n % 2 = 1 OR n = 9 AS detected FROM rows WHERE submission % 3 > 0
UNION ALL SELECT submission, 'PART ' || n, CASE WHEN q > 25 THEN 'on ' || q ELSE '' END, '', NULL, true FROM rows WHERE submission % 3 = 0 AND n % 2 = 1
UNION ALL SELECT DISTINCT submission, 'Part 9', '', '', NULL::DOUBLE, true FROM rows WHERE submission % 3 = 0
"""
_CHUNKS = """
WITH lines AS (
  SELECT conv_id, turn + 1 AS i, 'Part ' || (turn + 1) || chr(10) || text AS line, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), heads AS (
  SELECT DISTINCT conv_id, CASE WHEN n >= 3 THEN 'Part 1 ....... 1' || chr(10) || 'Part 2 ....... 2' || chr(10) || 'Part 3 ....... 3' || chr(10) ELSE '' END AS toc, CASE WHEN n >= 3 THEN 3 ELSE 0 END AS listed FROM lines
), texts AS (
  SELECT conv_id, toc || string_agg(line, chr(10) ORDER BY i) || repeat(' end', 200) AS text FROM lines JOIN heads USING (conv_id) GROUP BY conv_id, toc
), cues AS (
  SELECT l.conv_id, listed + i AS nth, (length(toc) + coalesce(sum(length(line) + 1) OVER (PARTITION BY l.conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM lines l JOIN heads USING (conv_id)
  UNION ALL SELECT conv_id, k, (k - 1) * 17 FROM heads, (VALUES (1), (2), (3)) v(k) WHERE listed = 3
), spans AS (
  SELECT conv_id, 0 AS a, least(length(text), 700) AS b FROM texts
  UNION ALL SELECT conv_id, greatest(0, pos - 100), least(length(text), pos + 420) FROM cues JOIN texts USING (conv_id) WHERE nth <= 7
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY a, b) AS island FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM spans)
), joined AS (
  SELECT conv_id, island, min(a) AS a, max(b) AS b FROM islands GROUP BY 1, 2
)
SELECT conv_id AS submission_id, string_agg('[Chunk ' || (island + 1) || ' @ ' || a || ':' || b || ']' || chr(10) || trim(substr(text, a + 1, b - a), ' ' || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY island) AS chunks
FROM joined JOIN texts USING (conv_id) GROUP BY 1
"""
SQL = {
    "whole_reconcile": _RECONCILED,
    "detected_and_expected": _DETECTED,
    "detection_chunks": _CHUNKS,
    "section_parse": f"SELECT l_orderkey AS assessment, n::BIGINT AS ord, 'part ' || n AS label_key, q::DOUBLE AS max_mark, q || ' marks' AS weight_text, (length('1. state item ' || l_partkey || ' [2 marks]') + 1 + length('2. explain item ' || l_suppkey))::INT AS body_chars FROM ({_N})",
    "child_parse_and_marks": f"SELECT l_orderkey AS assessment, (2 * count(*))::BIGINT AS n_units, sum(2.0::DOUBLE + coalesce({_SECOND}, 0)) AS marks, (count(*) + count({_SECOND}))::BIGINT AS n_marked FROM ({_N}) GROUP BY 1",
    "assessment_units": f"SELECT l_orderkey AS assessment, unnest(CASE WHEN q > 2 THEN ['part ' || n || ' q1', 'part ' || n || ' q2'] ELSE ['part ' || n] END) AS label_key, unnest(CASE WHEN q > 2 THEN [2.0::DOUBLE, (q - 2)::DOUBLE] ELSE [q::DOUBLE] END) AS max_mark FROM ({_N})",
    "scale_confidence": f"SELECT DISTINCT l_orderkey AS assessment, CASE WHEN l_orderkey % 4 < 2 THEN 60 ELSE 95 END AS scale_confidence FROM ({_N})",
    "structure_merge": _MERGED.format(s="", w="true"),
    "structure_reconcile": f"SELECT assessment, label_key, coalesce(s.max_mark, p.max_mark) AS max_mark, coalesce(p.body, s.body) AS body, CASE WHEN s.body IS NULL THEN 'prompt' WHEN p.body IS NULL THEN 'scheme' ELSE 'both' END AS side FROM ({_MERGED.format(s='', w='p_size < 30')}) p FULL JOIN ({_MERGED.format(s='...', w='p_size >= 25')}) s USING (assessment, label_key)",
    "segment_by_anchor": "SELECT conv_id AS submission_id, (turn + 1)::INT AS part_idx, 'Part ' || (turn + 1) AS label, text AS said FROM conversations",
    "expected_left_detected": f"SELECT o_orderkey AS l_orderkey, count(n) AS n_detected, 3 - count(n) AS n_added FROM orders LEFT JOIN (SELECT * FROM ({_N}) WHERE n IN (1, 3)) ON o_orderkey = l_orderkey GROUP BY 1",
    "unexpected_anti": f"SELECT n, count(*) AS unexpected FROM ({_N}) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1",
    "expected_units": f"SELECT l_orderkey AS assessment, 'Part ' || n AS parent, k - 1 AS idx, 'Part ' || n || ' Q' || k AS label, 'Q' || k AS anchor_text, CASE k WHEN 1 THEN '1. state item ' || l_partkey || ' [2 marks]' ELSE '2. explain item ' || l_suppkey END AS focus_hint, CASE k WHEN 1 THEN 2.0::DOUBLE ELSE (q - 2)::DOUBLE END AS max_mark, 'deterministic_derivation' AS task_type FROM ({_N}) CROSS JOIN (VALUES (1), (2)) AS x(k) WHERE q > 2",
    "chunk_interval_merge": "SELECT user_id, island::INT AS island, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a) AS island FROM (SELECT *, CASE WHEN a > lag(b) OVER (PARTITION BY user_id ORDER BY a) OR lag(b) OVER (PARTITION BY user_id ORDER BY a) IS NULL THEN 1 ELSE 0 END AS fresh FROM (SELECT user_id, event_id - 100 AS a, event_id + 420 AS b FROM events))) WHERE island <= 8 GROUP BY 1, 2",
    "subpart_segment": _CHILDREN,
    "fast_path_detection": f"SELECT *, CASE WHEN expected = 1 OR anchored >= greatest(2, expected // 2) THEN 'accept' ELSE 'ask' END AS path FROM (SELECT l_orderkey, count(*) AS expected, count(*) FILTER (q > 25) AS anchored FROM ({_N}) GROUP BY 1)",
    "rubric_matrix_rows": f"SELECT p_brand AS section, p_partkey AS unit, band, p_size * least / 100.0::DOUBLE AS least_mark FROM part CROSS JOIN (VALUES {', '.join(f"('{b}', {lo}::DOUBLE)" for b, lo, _ in bands.ANALYTICAL)}) AS x(band, least)",
    "hybrid_structure": _HYBRID,
    "request_keys": _KEYS,
    "replay_pipeline": "SELECT conv_id, least(100.0::DOUBLE, sum(CASE WHEN n % 11 <> 1 OR n % 11 IS NULL THEN turn % 5 + conv_id % 3 END)::DOUBLE) AS total_mark, count(*) FILTER (n % 11 = 1) AS n_errors, sum(CASE WHEN n % 4 = 0 AND n % 11 <> 1 THEN 2 ELSE 1 END)::BIGINT AS n_calls FROM (SELECT *, conv_id + turn AS n FROM conversations WHERE trim(text) <> '') GROUP BY 1",
    "json_brace_scan": "SELECT doc_id, CASE WHEN kind < 4 AND NOT bare THEN held END AS object, CASE WHEN kind = 4 OR bare THEN 'invalid_object' WHEN kind = 5 THEN 'no_object' END AS error_code FROM (SELECT doc_id, coalesce(length(text) % 6, 0) AS kind, coalesce(length(text) % 6 = 3 AND contains(text, '\"'), false) AS bare, '{\"a\":' || to_json(coalesce(source, '')) || ',\"b\":' || to_json(coalesce(text, '')) || '}' AS held FROM documents)",
    "question_cleanup": "SELECT p_partkey, 'Explain ' || trim(regexp_replace(p_name, '[ ]+', ' ', 'g')) || '  at length' AS question FROM part",
}
QUERIES = {name: globals()[name] for name in SQL}
