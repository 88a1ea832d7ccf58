"""Text functions on whole documents, with phrases that a text's length picks. The SQL works the results out from the same texts and
the functions' fixed values; tests hold the functions to literal cases besides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import guidance
from scriptorium.functions import text as t
from scriptorium.operators import responses, rubrics
from scriptorium.plans.marks import _t
from scriptorium.sources import documents

_ASKS = (
    "Draft an answer, then critique it", "State the utility function", "Which parameter makes this outcome more likely", "Write down the regression equation", "Derive the condition", "What is the effect on welfare", "List two predictions",
    "Is there omitted variable bias", "Compare the articles and their claims", "Discuss it", "Explain carefully why", "Give an overview", "Tell it",
)
_BACKS = ("Using your results, go on", "based on  the evidence", "as derived in the work", "see question 3 above", "your answer to part b", "from the model above", "using a model", "answer part 3")
_CRITERIA = ("uses a page as Evidence", "the method and why it is used", "all steps are told", "says it", "weighs a counterargument")
_GUIDES = ("", "A First cites a page number", "Derive it in your own words", "2:1 for a method")

_MATRIX = ("section", "unit", "max_mark", "mode", "classification_question", "ranking_rule", "criteria_sentences", "band", "descriptor", "within_band_placement")


def _columns() -> dict[str, Column]:
    """The results by name, of rows text, source, lang and n, the length of the text."""
    x, n, source, lang = F.col("text"), F.col("n"), F.col("source"), F.col("lang")
    _said = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    _num = lambda m, plus=0: (n % m + plus).cast("string")
    _pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (n % len(texts) + 1).cast("int"))
    _line = F.substring_index(x, "\n", 1)

    def _mode():
        asked = _said(_pick(_ASKS), "\n", x)
        task = t.task_type(F.lit("Part 1"), asked)
        return F.concat_ws("|", task, t.criterion_mode(task), t.grading_mode(task, F.lit("Part 1"), asked))

    def _check():
        most = _said(x, " out of ", _num(90, 1))
        rubric = F.when(n % 4 == 1, " ").when(n % 4 == 3, x).otherwise(most)
        scheme = F.when(n % 4 == 2, _said("Maximum mark: ", _num(90, 2))).otherwise(" ")
        found = t.context_check(rubric, F.lit("brief"), F.when(n % 4 == 3, "scheme").otherwise(scheme), F.when(n % 4 == 3, _num(70, 1)))
        return F.concat_ws("|", F.coalesce(t.clean_number(found["max_mark"]), F.lit("-")), F.coalesce(found["error_code"], F.lit("ok")))

    def _verified():
        v = responses.verification(F.to_json(F.struct(F.lit(" agree ").alias("agreement"), (n % 120).alias("confidence_0_to_100"), F.array(x, F.lit(" ")).alias("issues"), source.alias("recommendation"))))
        return F.coalesce(v["error_code"], F.concat_ws("|", v["agreement"], v["confidence"].cast("int").cast("string"), F.array_join(v["issues"], "+"), v["recommendation"]))

    def _rubric():
        v = responses.verified_rubric(F.to_json(F.struct(x.alias("rubric_text"), F.array(source).alias("issues"), (n % 120).alias("confidence_0_to_100"))), F.lit("old text"), F.array(F.lit("old issue")))
        return F.concat_ws("|", v["rubric_text"], v["confidence"].cast("int").cast("string"), F.array_join(v["issues"], "+"))

    def _notes():
        content = F.to_json(F.create_map(F.lit("Depth"), F.struct(F.when(n % 2 == 0, "met").otherwise("weak").alias("status"), x.alias("note"))))
        found = responses.criterion_notes(content, F.array(F.lit("Accuracy"), F.lit("Depth")), F.lit("likert_judgement"), F.array(*map(F.lit, ("weak", "developing", "clear", "strong"))))
        said = lambda notes: F.transform(notes, lambda y: F.concat_ws(":", y["criterion_name"], y["status"], y["normalized_status"], y["note"]))
        return t.bound(found, lambda r: F.coalesce(r["error_code"], F.array_join(said(r["notes"]), "|")))

    def _matrix():
        flat = F.regexp_replace(x, r"[\r\n|]+", " ")
        band = lambda name: _said("| ", name, " | ", source, " of ", lang, ": ", flat, " | high |\n")
        table = "| Band | Descriptor | Within-band placement |\n"
        criteria = F.array_join(F.transform(t.lines_of(x), lambda line: F.concat(F.lit("- In "), lang, F.lit(": "), line, F.lit("\n"))), "")
        first = _said("### Unit ", source, "\n- Max mark: ", _num(50), "\n- Mode: analytical\n- Core criterion: none\n- Classification question: is it: ", lang, "?\n- Ranking rule: best first\n#### Criteria Sentences\n- In ", lang, ".\n", criteria, table, "| --- | --- | --- |\n", band("First"), band("Other"), "| Fail | little\n", band("Pass"))
        md = _said("# T\n## Part ", _num(9), "\n", first, "### Rest\n- Max mark: 5\n", table, band("Third"), "## Part 10\n", band("Lost"))
        return F.array_join(F.transform(rubrics.matrix_rows(md), lambda r: F.concat_ws("/", *(F.replace(r[c], F.lit("\n"), F.lit("+")) for c in _MATRIX))), ";")

    return {
        "task_type_ladder": _mode(),
        "dependency_group": t.dependency_group(_said(x, " ", _pick(_BACKS)), _said("Part ", _num(9), " Q1"), _said("PART  ", _num(9))),
        "dependency_labels": F.array_join(t.dependency_labels(_said("Part ", _num(9), "q1, part 3 and PART ", _num(7), " ", x, " see Question iv Q2"), F.lit("Part 3")), "|"),
        "context_check": _check(),
        "scale_suggestion": t.scale_label(F.when(n % 7 == 0, x).otherwise(_said(x, " out of ", _num(101, 1)))),
        "header_only_text": t.header_only(F.when(n % 3 == 0, x).when(n % 3 == 1, _line).otherwise(_said("Question ", _num(50), " ", _line))).cast("string"),
        "richer_context": F.concat_ws("|", t.needs_context(_said("1. state ", source, "; 2. say ", lang, ".")).cast("string"), F.array_join(t.numbered_items(_said("1. state ", source, "; 2. say ", lang, ".")), "+"), F.array_join(t.bracketed_items(_said("Say (1) ", source, ", (2)  ", lang, ".")), "+")),
        "incomplete_section": t.incomplete(x, F.when(n % 2 == 0, "Give an example").otherwise("why")).cast("string"),
        "cued_lines": F.concat_ws("|", F.array_join(t.cued_lines(_said("Discuss ", source, "\n", x, "\nQuote a page"), t.ANCHOR_CUES), "+"), F.array_join(t.cued_lines(_said("Discuss ", source, "\n", x, "\nQuote a page"), t.EVIDENCE_CUES), "+")),
        "structure_guidance": t.structure_guidance(_said(x, "\nQuestion ", _num(9), "\nworth ", n.cast("string")), F.lit("out of 5")),
        "part_breakdown": F.array_join(F.array_sort(F.transform(F.map_entries(t.part_breakdown(_said("Part 1: ", _num(7), "/10 ", lang, " part 2 q1: ", _num(5), ".5/10 PART  1: ", _num(9), "/10"))), lambda e: F.concat_ws("=", e["key"], t.clean_number(e["value"])))), "|"),
        "label_helpers": F.concat_ws("|", t.canonical_label(_said("part ", _num(30), " ", _line)), t.placeholder(_said("part ", _num(30), " ", _line)).cast("string"), t.is_header(_said("part ", _num(30), " ", _line)).cast("string"), t.is_marking_line(_said(F.when(n % 2 == 0, "Note: ").otherwise(""), _line)).cast("string")),
        "goal_fragment": t.goal_fragment(_said(_num(9), ". [5 marks] ", _line), 60),
        "verification_validate": _verified(),
        "rubric_verification": _rubric(),
        "criterion_notes_validate": _notes(),
        "feedback_render": responses.feedback_text(F.to_json(F.struct(F.array(F.struct(source.alias("section_label"), x.alias("analysis"), _said(" ", lang).alias("feedback"))).alias("content")))),
        "docx_text_choice": documents.docx_variant(F.when(n % 4 == 0, " ").when(n % 4 == 1, _said(x, " <latex> ----media/1")).when(n % 4 == 2, _said(x, " ----media/1")).otherwise(_said(x, ".")), source),
        "docx_headings": documents.heading(_line, n % 2 == 1, F.when(n % 3 > 0, (n % 20).cast("double")), F.when(n % 11 == 0, "Heading 2").otherwise("Body")).cast("string"),
        "snapshot_names": documents.safe_name(n % 1000, _line),
        "criterion_anchors": F.concat_ws("|", guidance.anchors(_said(_pick(_CRITERIA), " ", x))["weak"], guidance.anchors(_said(_pick(_CRITERIA), " ", x))["strong"]),
        "scoring_rules": F.array_join(guidance.scoring_rules(_said(_pick(_GUIDES), " ", x)), "|"),
        "guidance_summary": guidance.guidance_summary(x),
        "rubric_matrix_parse": _matrix(),
    }


_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda texts: "([" + ", ".join(map(_q, texts)) + "])"
_of = lambda texts: f"{_list(texts)}[n % {len(texts)} + 1]"
_any = lambda low, words: "(" + " OR ".join(f"contains({low}, {_q(w)})" for w in words) + ")"
_flat = lambda s: f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
_lines = lambda s: f"list_filter(list_transform(regexp_split_to_array({s}, '\\r?\\n|\\r'), lambda l: trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(160))), lambda l: l <> '')"
_once = lambda s: f"list_filter({s}, lambda e, i: list_position({s}, e) = i)"
_L = "split_part(text, chr(10), 1)"
_X = f"({_of(_ASKS)} || chr(10) || text)"
_TASK = "CASE " + " ".join(f"WHEN {' AND '.join(_any('low', words) for words in groups)} THEN {_q(name)}" for name, groups in t.TASKS) + " ELSE 'deterministic_derivation' END"
_RULED = "array_to_string([" + ", ".join(f"CASE WHEN {_any('low', words)} THEN {_q(rule)} END" for words, rule in guidance.RULES) + f", {_q(guidance.NO_ATTEMPT)}], '|')"
_WHEN = lambda table, low: " ".join(f"WHEN {_any(low, words)} THEN {_q(a + '|' + b)}" for words, a, b in table)
_CUED = lambda cues: f"array_to_string(list_filter({_lines('said')}, lambda l: {_any('lower(l)', cues)})[1:4], '+')"
_BARE = "regexp_replace(regexp_replace(trim(said), '^\\d+\\.\\s*(?:\\[\\d+(?:\\.\\d+)?\\s*marks?\\])?\\s*', '', 'i'), '\\.+$', '')"
_NOTE = f"regexp_replace({_flat('text')}, '[.;:,]+$', '')"
_HEAD = f"regexp_replace(trim({_L}), '\\s+', ' ', 'g')"

#: name: (what SQL reads as `said` and as `low` of each text, the result by SQL)
TEXTS = {
    "task_type_ladder": (_X, f"lower({_flat("'Part 1' || chr(10) || " + _X)})", f"""(SELECT task || '|' || CASE WHEN list_contains({_list(t.ABSTRACT)}, task) THEN 'abstract' ELSE 'deterministic' END || '|' || CASE WHEN list_contains({_list(t.ABSTRACT)}, task) THEN 'analytical' WHEN list_contains({_list(t.STEPWISE)}, task) THEN 'deterministic'
        WHEN {_any("lower('Part 1' || chr(10) || said)", t.STEPWISE_WORDS)} THEN 'deterministic' WHEN {_any("lower('Part 1' || chr(10) || said)", t.WHOLE_WORDS)} THEN 'analytical' ELSE 'deterministic' END FROM (SELECT {_TASK} AS task))"""),
    "dependency_group": (f"text || ' ' || {_of(_BACKS)}", None, f"CASE WHEN regexp_matches(lower({_flat('said')}), {_q('|'.join(t.BACK))}) THEN 'part ' || n % 9 ELSE '' END"),
    "dependency_labels": ("'Part ' || n % 9 || 'q1, part 3 and PART ' || n % 7 || ' ' || text || ' see Question iv Q2'", None,
        f"""(SELECT array_to_string(list_filter({_once('found')}, lambda e: e <> 'part 3'), '|') FROM (SELECT list_transform(regexp_extract_all(said, {_q(t.NAMED)}, 1), lambda e: lower({_flat("regexp_replace(e, '(?i)(\\s+(?:\\d+|[ivx]+))\\s*q(\\d+)$', '\\1 q\\2')")})) AS found))"""),
    "context_check": ("text", None, "CASE n % 4 WHEN 0 THEN (n % 90 + 1) || '|ok' WHEN 1 THEN '-|no_rubric_or_scheme' WHEN 2 THEN '-|conflicting_max_marks' ELSE (n % 70 + 1) || '|ok' END"),
    "scale_suggestion": ("text", None, "CASE WHEN n % 7 = 0 THEN 'No document suggestion' WHEN n % 101 = 99 THEN 'Deterministic / numeric (0-100)' WHEN n % 101 = 84 THEN 'Analytical / evaluative (0-85, typical 20-80)' ELSE 'Inferred ' || (n % 101 + 1) || '-point scale' END"),
    "header_only_text": (f"CASE n % 3 WHEN 0 THEN text WHEN 1 THEN {_L} ELSE 'Question ' || n % 50 || ' ' || {_L} END", None,
        f"(SELECT (len(l) = 0 OR (len(l) = 1 AND (length(l[1]) <= 40 OR regexp_matches(l[1], {_q(t.TOP_HEADER)}))))::VARCHAR FROM (SELECT {_lines('said')} AS l))"),
    "richer_context": ("text", None, "'true|state ' || source || '+say ' || lang || '|' || source || '+' || lang"),
    "incomplete_section": ("text", None, f"(SELECT (f = '' OR contains(f, '...') OR len(regexp_extract_all(f, '[a-z]{{6,}}[A-Z][a-z]+')) >= 2 OR regexp_matches(f, '[a-z]{{16,}}') OR length(f) < 120 OR (n % 2 = 0 AND length(f) < 260))::VARCHAR FROM (SELECT {_flat('text')} AS f))"),
    "cued_lines": ("'Discuss ' || source || chr(10) || text || chr(10) || 'Quote a page'", None, f"{_CUED(t.ANCHOR_CUES)} || '|' || {_CUED(t.EVIDENCE_CUES)}"),
    "structure_guidance": ("text || chr(10) || 'Question ' || n % 9 || chr(10) || 'worth ' || n || chr(10) || chr(10) || 'out of 5'", None, f"array_to_string(list_filter({_lines('said')}, lambda l: regexp_matches(l, {_q('(?i)' + '|'.join(t.GUIDANCE))}))[1:12], chr(10))"),
    "part_breakdown": ("text", None, "'Part 1=' || n % 9 || '|Part 2 Q1=' || n % 5 || '.5'"),
    "label_helpers": (f"'part ' || n % 30 || ' ' || {_L}", None,
        f"'Part ' || n % 30 || '|false|' || (length(said) <= 32 OR regexp_matches(said, {_q(t.WEIGHT)}) OR trim({_flat(_L)}, ' :.-') = '')::VARCHAR || '|' || (n % 2 = 0 OR " + " OR ".join(f"starts_with(lower(trim({_L})), {_q(w)})" for w in t.MARKING_STARTS) + f" OR {_any(f'lower({_L})', t.MARKING_PHRASES)})::VARCHAR"),
    "goal_fragment": (f"n % 9 || '. [5 marks] ' || {_L}", None, f"(SELECT CASE WHEN length(b) > 60 THEN regexp_replace(b[1:57], '[ ,;:]+$', '') || '...' ELSE b END FROM (SELECT {_BARE} AS b))"),
    "verification_validate": ("text", None, "CASE WHEN n % 120 > 100 THEN 'confidence_out_of_range' ELSE 'agree|' || n % 120 || '|' || trim(text) || '|' || source END"),
    "rubric_verification": ("text", None, "CASE WHEN trim(text) = '' THEN 'old text|0|old issue+rubric_verifier_failed: no_rubric_text' WHEN n % 120 > 100 THEN 'old text|0|old issue+rubric_verifier_failed: confidence_out_of_range' ELSE trim(text) || '|' || n % 120 || '|' || source END"),
    "criterion_notes_validate": ("text", None, f"(SELECT CASE WHEN f = '' THEN 'blank_note' ELSE 'Accuracy:weak:missed:omitted by model|Depth:' || CASE WHEN n % 2 = 0 THEN 'clear:met:' ELSE 'weak:missed:' END || array_to_string(string_split(f, ' ')[1:5], ' ')[1:48] END FROM (SELECT {_NOTE} AS f))"),
    "feedback_render": ("text", None, "source || ' - ' || CASE WHEN trim(text) = '' THEN '' ELSE trim(text) || ' ' END || lang"),
    "docx_text_choice": ("text", None, "CASE n % 4 WHEN 0 THEN source WHEN 1 THEN ltrim(text || ' <latex> ----media/1') WHEN 2 THEN source ELSE trim(text || '.') END"),
    "docx_headings": ("text", None,
        f"""(SELECT (f <> '' AND length(f) <= 140 AND (regexp_matches(f, {_q(documents.HEADING)}) OR n % 11 = 0 OR (regexp_matches(f, {_q(documents.NUMBERED)}) AND w <= 12) OR (regexp_matches(f, {_q(documents.TITLE)}) AND (n % 2 = 1 OR (n % 3 > 0 AND n % 20 >= 13)))
        OR (upper(f) = f AND lower(f) <> f AND w <= 12) OR (n % 2 = 1 AND w <= 16) OR (n % 3 > 0 AND n % 20 >= 14 AND w <= 20)))::VARCHAR FROM (SELECT {_HEAD} AS f, len(string_split({_HEAD}, ' ')) AS w))"""),
    "snapshot_names": ("text", None, f"lpad((n % 1000)::VARCHAR, 3, '0') || '_' || CASE WHEN trim({_L}) = '' THEN 'file' ELSE regexp_replace(trim({_L}), '[^A-Za-z0-9._-]+', '_', 'g') END"),
    "criterion_anchors": (f"{_of(_CRITERIA)} || ' ' || text", "lower({said})", f"CASE {_WHEN(guidance.ANCHORS, 'low')} ELSE {_q('|'.join(guidance.ANY_ANCHOR))} END"),
    "scoring_rules": (f"{_of(_GUIDES)} || ' ' || text", "lower({said})", _RULED),
    "guidance_summary": ("text", None, f"(SELECT CASE WHEN f = '' THEN {_q(guidance.NO_GUIDANCE)} ELSE rtrim(coalesce(nullif(regexp_extract(f || ' ', '^(.*?[.!?])\\s', 1), ''), f)[1:220]) END FROM (SELECT {_flat('text')} AS f))"),
    "rubric_matrix_parse": ("text", None,
        f"""(SELECT array_to_string(list_transform(['First', 'Other', 'Pass'], lambda b: 'Part ' || n % 9 || '/' || trim('Unit ' || source) || '/' || n % 50 || '/analytical/is it: ' || lang || '?/best first/In ' || lang || '.' || said || '/' || b || '/' || descriptor || '/high'), ';') || ';Part ' || n % 9 || '/Rest/5/////Third/' || descriptor || '/high'
        FROM (SELECT trim(source || ' of ' || lang || ': ' || regexp_replace(text, '[\\r\\n|]+', ' ', 'g')) AS descriptor, array_to_string(list_transform({_lines('text')}, lambda l: '+In ' || lang || ': ' || l), '') AS said))"""),
}


def _query(name: str):
    def query(spark, sf):
        rows = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
        return rows.withColumn("n", F.length("text")).select("doc_id", _columns()[name].alias("result"))

    return query


def _sql(name: str) -> str:
    said, low, result = TEXTS[name]
    low = (low or "''").replace("{said}", said)
    return f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n FROM documents),
read AS (SELECT *, {said} AS said, {low} AS low FROM rows)
SELECT doc_id, {result} AS result FROM read
"""


SQL = {name: _sql(name) for name in TEXTS}
QUERIES = {name: _query(name) for name in TEXTS}
