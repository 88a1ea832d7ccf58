"""Structure and segmentation (D*): lines to sections, sections to units, anchors to slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.functions.text import bound

_CHILD = "array<struct<label:string,label_key:string,max_mark:double,text:string>>"


def with_groups(rows: DataFrame, lines: str, opens, name: str) -> DataFrame:
    """rows with a column of lines grouped by the ones that open a group; those before the first are dropped. In steps, so that
    each line is judged once; no line is copied twice."""
    rows = rows.withColumn("_starts", F.filter(F.transform(lines, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("_ends", F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), F.array(F.size(lines))))
    groups = F.zip_with("_starts", "_ends", lambda a, b: F.slice(F.col(lines), a + 1, b - a))
    return rows.withColumn(name, F.when(F.size("_starts") > 0, groups).otherwise(F.array().cast("array<array<string>>"))).drop("_starts", "_ends")


def _rest(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))


#: What begins an answer.
_ANSWER = "answer:"


def _answers(line: Column) -> Column:
    return F.lower(F.substring(line, 1, len(_ANSWER))) == _ANSWER


def split_marking(lines: Column) -> Column:
    """Struct (question, marking), arrays of lines. All before the first 'answer:' line is the question; of what follows,
    marking instructions stay, and bullets right after one. In the fold, whether a line begins an answer, what it says and whether that
    stays are worked out once."""
    none = F.array().cast("array<string>")
    first = F.array_position(F.transform(lines, _answers), F.lit(True)).cast("int")
    state = "struct<on:boolean,kept:array<string>>"

    def step(a: Column, x: Column) -> Column:
        # an answer line without an instruction changes nothing
        after = lambda said, line, keep: F.struct((keep | (said & a["on"])).alias("on"), F.when(keep, F.concat(a["kept"], F.array(line))).otherwise(a["kept"]).alias("kept"))
        kept = lambda said, line: bound(t.is_marking_line(line) | (~said & a["on"] & x.rlike("^[-\u2022]")), lambda keep: after(said, line, keep))
        said_of = lambda said: F.when(said, F.trim(F.substring(x, F.lit(len(_ANSWER) + 1), F.length(x)))).otherwise(x)
        return bound(_answers(x), lambda said: bound(said_of(said), lambda line: kept(said, line))).cast(state)

    kept = F.aggregate(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), F.struct(F.lit(False), none).cast(state), step, lambda a: a["kept"])
    return F.struct(F.when(first > 0, F.slice(lines, 1, first - 1)).otherwise(lines).alias("question"), F.when(first > 0, kept).otherwise(none).alias("marking"))


def _with_subparts(rows: DataFrame, label: str, question: str, name: str, key: Column | None = None) -> DataFrame:
    """D3: lines that begin with '1.', 'a)', '(2)' or '3]' open a subpart; fewer than two are none. Numbers become 'Q1'."""

    def child(lines: Column, key: Column) -> Column:
        tail = lambda token: F.when((token >= "0") & (token < ":"), F.concat(F.lit(" Q"), token)).otherwise(F.concat(F.lit(" "), F.upper(token)))
        made = lambda own: F.struct(F.concat(F.col(label), own).alias("label"), F.trim(F.concat(key, F.lower(own))).alias("label_key"), t.mark_of(lines[0]).alias("max_mark"), F.array_join(lines, "\n").alias("text"))
        return bound(bound(F.regexp_extract(lines[0], t.SUBPART_TOKEN, 1), tail), made)

    rows = with_groups(rows, question, lambda x: x.rlike(t.SUBPART), "_groups")
    each = lambda key: F.transform("_groups", lambda lines: child(lines, key))
    made = each(key) if key is not None else bound(t.label_key(F.col(label)), each)
    return rows.withColumn(name, F.when(F.size("_groups") >= 2, made).otherwise(F.array()).cast(_CHILD)).drop("_groups")


def with_shared_marks(children: Column, most: Column) -> Column:
    """What the parent's mark leaves is shared among the unmarked children, if there are two children or more."""

    def shared(kids: Column, open_: Column) -> Column:
        left = most - F.aggregate(kids, F.lit(0.0), lambda a, x: a + F.coalesce(x["max_mark"], F.lit(0.0)))
        with_share = lambda share: F.transform(kids, lambda x: x.withField("max_mark", F.coalesce(x["max_mark"], share)))
        return bound(F.when(open_ > 0, left), lambda rest: F.when(rest > 0, bound(F.round(rest / open_, 2), with_share)).otherwise(kids))

    return bound(children, lambda kids: F.when(F.size(kids) >= 2, bound(F.size(F.filter(kids, lambda x: x["max_mark"].isNull())), lambda n: shared(kids, n))).otherwise(kids))


def sections(docs: DataFrame, key: str = "assessment") -> DataFrame:
    """A header line opens a section that owns the lines up to the next header; what precedes the first is dropped.

    docs: key, text. Returns a row for each section: key, ord, label, label_key, max_mark, weight_text, body (lines after the
    header), question, marking, children, anchors, evidence, dependencies. A document is folded inside its row: no shuffle."""
    split = with_groups(docs.select(key, t.lines_of(F.col("text")).alias("lines")), "lines", t.is_header, "groups")
    # the outer form, as the inner one has Spark filter by the size of the groups, which it makes once more for that
    return read(split.select(key, F.posexplode_outer("groups").alias("pos", "rows")).where(F.col("rows").isNotNull()), key)


def read(grouped: DataFrame, *key: str) -> DataFrame:
    """sections() of their lines: rows of key, pos (from 0) and rows (the header and what it owns)."""
    rows = grouped.select(*key, (F.col("pos") + 1).cast("long").alias("ord"), F.col("rows")[0].alias("head"), _rest(F.col("rows")).alias("rest"))
    rows = rows.withColumn("label", t.canonical_label(F.regexp_extract("head", t.TOP_HEADER, 1))).withColumn("split", split_marking(F.col("rest")))
    rows = rows.withColumn("label_key", t.label_key(F.col("label"))).withColumn("weight", t.weight_found(F.col("head")))
    rows = rows.withColumn("asked", F.col("split.question")).withColumn("question", F.array_join(F.concat(F.array("head"), "asked"), "\n")).withColumn("marking", F.array_join("split.marking", "\n"))
    rows = _with_subparts(rows.withColumn("both", F.concat_ws("\n", "question", F.nullif("marking", F.lit("")))).withColumn("said", F.concat(F.array("head"), "asked", t.trimmed_lines(F.col("split.marking")))), "label", "asked", "children", F.col("label_key"))
    return rows.select(
        *key, "ord", "label", "label_key", t.mark_in(F.col("weight")).alias("max_mark"), t.weight_in(F.col("weight")).alias("weight_text"), F.array_join("rest", "\n").alias("body"), "question", "marking", "children",
        t.cued(F.col("said"), t.ANCHOR_CUES).alias("anchors"), t.cued(F.col("said"), t.EVIDENCE_CUES).alias("evidence"), t.dependency_labels(F.col("both"), F.col("label"), F.col("label_key")).alias("dependencies"),
    )


def children(parsed: DataFrame, key: str = "assessment") -> DataFrame:
    """A row for each subpart, with its share of the parent's mark."""
    each = parsed.select(key, F.col("label_key").alias("parent_key"), F.explode_outer(with_shared_marks(F.col("children"), F.col("max_mark"))).alias("child")).where(F.col("child").isNotNull())
    return each.select(key, "parent_key", "child.label_key", "child.max_mark")


def assessment_map(docs: DataFrame, key: str = "assessment") -> DataFrame:
    """Key, label, label_key and max_mark of each unit. A section with two marked subparts or more gives these, another
    itself; a document without sections is one unit. No shuffle."""
    kind = "array<struct<label:string,label_key:string,max_mark:double>>"
    split = with_groups(docs.select(key, t.lines_of(F.col("text")).alias("lines")), "lines", t.is_header, "groups")
    rows = split.select(key, F.explode_outer("groups").alias("rows")).select(key, F.get("rows", F.lit(0)).alias("head"), _rest(F.col("rows")).alias("rest"))
    rows = rows.select(key, t.canonical_label(F.regexp_extract("head", t.TOP_HEADER, 1)).alias("label"), t.mark_of(F.col("head")).alias("max_mark"), split_marking(F.col("rest"))["question"].alias("asked"))
    rows = _with_subparts(rows, "label", "asked", "kids")
    rows = rows.select(key, "label", "max_mark", with_shared_marks(F.col("kids"), F.col("max_mark")).alias("kids"))
    rows = rows.select(key, "label", "max_mark", F.filter("kids", lambda x: x["max_mark"].isNotNull()).alias("kids"))
    own = F.array(F.struct(F.coalesce("label", F.lit("Whole Submission")), t.label_key(F.coalesce("label", F.lit("Whole Submission"))), "max_mark")).cast(kind)
    each = F.transform("kids", lambda x: F.struct(x["label"], x["label_key"], x["max_mark"])).cast(kind)
    # never empty; the outer form, as the inner one has Spark make all units once more to filter by them
    return rows.select(key, F.explode_outer(F.when(F.size("kids") >= 2, each).otherwise(own)).alias("u")).select(key, "u.*")


def scale_confidence(units: DataFrame, key: str = "assessment") -> DataFrame:
    """95 where any unit of a map has a mark, else 60."""
    return units.groupBy(key).agg(F.when(F.max("max_mark").isNotNull(), 95).otherwise(60).alias("scale_confidence"))


def expected_subparts(parsed: DataFrame, key: str = "assessment", require_marks: bool = True) -> DataFrame:
    """The subparts that a submission should have, if a section has two or more: label, anchor_text (its last word,
    where it has a Q), focus_hint, max_mark and task_type, which is the parent's where the subpart's is generic."""
    shared = with_shared_marks(F.col("children"), F.col("max_mark"))
    kids = F.filter(shared, lambda x: x["max_mark"].isNotNull()) if require_marks else shared
    rows = parsed.select(key, F.col("label").alias("parent"), F.col("question").alias("parent_text"), kids.alias("kids")).withColumn("above", F.when(F.size("kids") >= 2, t.task_type(F.col("parent"), F.col("parent_text"))))
    # filtered after the kids are rows: before that, the filter would make all kids once more
    rows = rows.select(key, "parent", "parent_text", "above", F.posexplode_outer(F.when(F.size("kids") >= 2, F.col("kids"))).alias("idx", "kid")).where(F.col("kid").isNotNull()).select(key, "parent", "parent_text", "above", "idx", "kid.*")
    generic = ("evaluative_discussion", "deterministic_derivation", "whole_submission_holistic")
    own = t.task_type(F.col("label"), F.coalesce(F.nullif("text", F.lit("")), "parent_text"))
    anchor = F.when(F.contains("label", F.lit(" Q")), F.element_at(F.split("label", " "), -1)).otherwise(F.col("label"))
    rows = rows.withColumn("own", own)
    task = F.when(F.col("own").isin(*generic) & ~F.col("above").isin(*generic), F.col("above")).otherwise(F.col("own"))
    return rows.select(key, "parent", "idx", "label", anchor.alias("anchor_text"), F.trim(F.substring_index("text", "\n", 1)).alias("focus_hint"), "max_mark", task.alias("task_type"))


def merged(parsed: DataFrame, key: str = "assessment") -> DataFrame:
    """Sections of one label: the richest body (lines, then length, then the first), the first mark."""
    rich = F.struct((F.size(F.split("body", "\n"))).alias("lines"), F.length("body").alias("long"), (-F.col("ord")).alias("first"))
    return parsed.groupBy(key, "label_key").agg(F.min("ord").alias("ord"), F.max_by("body", rich).alias("body"), F.min_by("max_mark", F.when(F.col("max_mark").isNotNull(), F.col("ord"))).alias("max_mark"))


def reconciled(prompt: DataFrame, scheme: DataFrame, key: str = "assessment") -> DataFrame:
    """Full outer on the label; the scheme decides unless its text is damaged and the prompt's is not."""
    p, s = (x.select(key, "label_key", F.col("max_mark").alias(f"{n}_mark"), F.col("body").alias(f"{n}_body")) for x, n in ((prompt, "p"), (scheme, "s")))
    out = p.join(s, [key, "label_key"], "full_outer")
    worse = t.damaged(F.col("s_body")) & F.col("p_body").isNotNull() & ~t.damaged(F.col("p_body"))
    body = F.when(F.col("s_body").isNull() | F.coalesce(worse, F.lit(False)), F.coalesce("p_body", "s_body")).otherwise(F.col("s_body"))
    side = F.when(F.col("s_body").isNull(), "prompt").when(F.col("p_body").isNull(), "scheme").otherwise("both")
    return out.select(key, "label_key", F.coalesce("s_mark", "p_mark").alias("max_mark"), body.alias("body"), side.alias("side"))


#: D14. A line of a table of contents; how many make one, and in which part of the text.
TOC_LINE = r"^[^\S\n]*\S[^\n]*?[.\u2026\u2014\u2013-]{2,}[^\S\n]*\d{1,3}[^\S\n]*$"
TOC_LINES, TOC_PART = 3, 0.18


def _quoted(label: Column) -> Column:
    """A label as a pattern that stands for itself."""
    return F.regexp_replace(label, r"([^A-Za-z0-9_\s])", r"\\\\$1")


def first_place(text: Column, pattern: Column) -> Column:
    """Start of the first match, counted from 0; null without one. What follows the match is not searched."""
    return bound(F.split(text, pattern, F.lit(2)), lambda cut: F.when(F.size(cut) > 1, F.length(cut[0])))


def toc_range(text: Column, labels: Column) -> Column:
    """Struct (start, end) of a table of contents: lines that name a label and end in dots and a page, if there are enough
    of them at the beginning of the text; else null. Ends count from 0, the end exclusive."""
    head = F.split(F.substring(text, F.lit(1), F.floor(F.length(text) * TOC_PART).cast("int")), "\n")
    named = lambda line: F.exists(labels, lambda x: F.regexp_like(line, F.concat(F.lit(r"(?i)\b"), _quoted(x), F.lit(r"\b"))))
    at = lambda lines: F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(TOC_LINE) & named(line), i)), lambda i: i.isNotNull())
    before = lambda lines, n: F.length(F.array_join(F.slice(lines, F.lit(1), n), "\n"))

    def ends(lines: Column, hits: Column) -> Column:
        first, last = F.get(hits, F.lit(0)), F.element_at(hits, -1)
        start = F.when(first > 0, before(lines, first) + 1).otherwise(0)
        return F.when(F.size(hits) >= TOC_LINES, F.struct(start.alias("start"), before(lines, last + 1).alias("end")))

    return F.when(F.size(labels) >= TOC_LINES, bound(head, lambda lines: bound(at(lines), lambda hits: ends(lines, hits))))


def _unless(wrong: Callable[[Column], Column], instead: Column) -> Callable[[Column], Column]:
    return lambda p: F.when(wrong(p), instead).otherwise(p)


def _anchor(text: Column, toc: Column, *names: Column) -> Column:
    """Where a part begins, from 0: as a header outside the table of contents, as a word outside it, as a header or a word
    inside; at each level the first of its names that is found. Null: nowhere. A text is searched up to its first match, and from
    an end of the contents where that match lies on their other side."""
    within = lambda p: F.coalesce((p >= toc["start"]) & (p < toc["end"]), F.lit(False))
    after = lambda p, pattern: p + first_place(F.substring(text, p + 1, F.length(text)), pattern)
    outside, inside = [], []
    for tail in (r"(?im)^\s*{}(?:\b|\s*[:.)\]-])", r"(?i)\b{}\b"):
        start, end = tail.split("{}")
        for name in names:
            pattern = F.concat(F.lit(start), _quoted(name), F.lit(end))
            # the contents end with a line, so what follows them begins one
            beyond = after(toc["end"] + 1, pattern)
            outside.append(bound(first_place(text, pattern), _unless(within, beyond)))
            inside.append(bound(after(toc["start"], pattern), lambda p: F.when(within(p), p)))
    return F.coalesce(*outside, *inside)


def _sliced(rows: DataFrame, key: list[str], few: Column) -> DataFrame:
    """Anchored rows (array `parts` of part_idx, label, pos) cut from `text`: the first part of a position keeps it, each goes
    to the next anchor; where there are too few, all have the whole text."""
    once = F.filter("parts", lambda x: x["pos"].isNotNull() & ~F.exists("parts", lambda y: y["pos"].eqNullSafe(x["pos"]) & (y["part_idx"] < x["part_idx"])))
    rows = rows.withColumn("found", F.array_sort(F.transform(once, lambda x: F.struct(x["pos"].alias("pos"), x["part_idx"].alias("part_idx"), x["label"].alias("label")))))
    cut = F.transform("found", lambda x, i: F.struct(x["part_idx"].alias("part_idx"), x["label"].alias("label"), F.substring(F.col("text"), x["pos"] + 1, F.coalesce(F.get("found", i + 1)["pos"], F.length("text")) - x["pos"]).alias("section_text")))
    whole = F.transform("parts", lambda x: F.struct(x["part_idx"].alias("part_idx"), x["label"].alias("label"), F.col("text").alias("section_text")))
    return rows.select(*key, F.explode(F.when(few, whole).otherwise(cut)).alias("x")).select(*key, "x.*")


def segmented(submissions: DataFrame, expected: DataFrame, key: str = "submission_id") -> DataFrame:
    """The text is cut at the anchors of the expected parts (key, part_idx, label and maybe anchor_text). Fewer
    anchors than max(1, n // 2): every part gets the whole text. The parts of a submission come to its row as an array, so that
    its text is not copied for each."""
    names = ("anchor_text", "label") if "anchor_text" in expected.columns else ("label",)
    parts = expected.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part_idx", "label", *(n for n in names if n != "label")))).alias("wanted"))
    both = submissions.select(key, F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text")).join(parts, key)
    both = both.withColumn("toc", toc_range(F.col("text"), F.transform("wanted", lambda x: F.trim(x["label"]))))
    placed = F.transform("wanted", lambda x: F.struct(x["part_idx"].alias("part_idx"), x["label"].alias("label"), _anchor(F.col("text"), F.col("toc"), *(F.trim(x[n]) for n in names)).alias("pos")))
    both = both.withColumn("parts", placed)
    distinct = F.size(F.array_distinct(F.filter(F.transform("parts", lambda x: x["pos"]), lambda p: p.isNotNull())))
    return _sliced(both, [key], distinct < F.greatest(F.lit(1), F.floor(F.size("parts") / 2)))


#: D16. How a subpart with a number N begins, in this order.
SUBPART_STARTS = (r"(?im)^\s*Q{}\b", r"(?im)^\s*Question\s+{}\b", r"(?im)^\s*{}\.\s", r"(?im)^\s*{}\)\s", r"(?im)^\s*\({}\)\s")


def subpart_anchor(text: Column, label: Column) -> Column:
    """Where a subpart begins, from 0, by the first of the forms that the text has; null for labels without a Q number."""
    number = F.nullif(F.regexp_extract(label, r"(?i)\bQ(\d+)\b", 1), F.lit(""))
    return F.coalesce(*(first_place(text, F.concat(F.lit(p.split("{}")[0]), number, F.lit(p.split("{}")[1]))) for p in SUBPART_STARTS))


def repaired(text: Column, start: Column, end: Column, question: Column) -> Column:
    """A slice (from 0, the end exclusive) that is damaged or too short for its question is widened by 260 characters each
    way, 420 where the question asks for more than one thing, and begins and ends with lines where these do so within that."""

    def widened(own: Column) -> Column:
        wide = F.when(t.needs_context(question), 420).otherwise(260)
        low, high = F.greatest(F.lit(0), start - wide), F.least(F.length(text), end + wide)
        ahead, behind = F.substring(text, low + 1, start - low), F.substring(text, end + 1, high - end)
        last, next_ = F.instr(F.reverse(ahead), "\n"), F.instr(behind, "\n")
        left = F.when((low > 0) & (last > 0), start - last + 1).otherwise(low)
        right = F.when((high < F.length(text)) & (next_ > 0), end + next_ - 1).otherwise(high)
        return F.coalesce(F.nullif(stripped(F.substring(text, left + 1, right - left)), F.lit("")), own)

    return bound(stripped(F.substring(text, start + 1, end - start)), lambda own: F.when(t.incomplete(own, question), widened(own)).otherwise(own))


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


#: D18. Fixed value: the task whose subparts are read with all that precedes them.
CUMULATIVE_TASK = "critique_and_revision"
#: D19. Fixed value: words for each subpart below which no detector is asked.
WORDS_FOR_DETECTION = 10


def subpart_segments(parts: DataFrame, wanted: DataFrame, *key: str, detected: DataFrame | None = None) -> DataFrame:
    """Parts (key, label, section_text and others) refined to their subparts.

    wanted: key, part_idx, label, and question and task_type, which tell what is a repair and what is cumulative. A part with fewer
    than two wanted subparts passes through (resolved = whole). Slices go from anchor to anchor of its text, if max(2, n // 2 + 1)
    subparts have one of their own; else, where the text has ten words for each, a detector's labels (detected: key, label) that are
    wanted decide which of them are sought. A slice that is damaged or too short for its question is cut again up to the next
    anchor of another subpart, and widened (anchored). A subpart without a slice inherits the whole text (inherited). Subparts of
    the cumulative task with an anchor get all up to the next one (cumulative). The subparts come to the row of their part as an
    array: its text is not copied before the cut, and one pass over the array sees all anchors."""
    has = lambda c: F.col(c) if c in wanted.columns else F.lit("")
    each = wanted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part_idx", "label", has("question").alias("question"), has("task_type").alias("task_type")))).alias("_wanted"))
    rows = parts.withColumn("_text", F.replace("section_text", F.lit("\r\n"), F.lit("\n"))).join(each, list(key), "left")
    seen = F.array().cast("array<string>")
    if detected is not None:
        labels = detected.groupBy(*key).agg(F.collect_set(t.label_key(F.col("label"))).alias("_detected"))
        rows, seen = rows.join(labels, list(key), "left"), F.coalesce("_detected", seen)
    rows = rows.withColumn("_at", F.transform("_wanted", lambda x: subpart_anchor(F.col("_text"), x["label"])))
    rows = rows.withColumn("_asked", F.transform("_wanted", lambda x: F.array_contains(seen, t.label_key(x["label"]))))
    # the first subpart at a position has it
    own = lambda among: F.transform(among, lambda p, i: F.when(p.isNotNull() & (F.array_position(among, p) == i + 1), p))
    found = lambda of: F.size(F.filter(of, lambda p: p.isNotNull()))
    rows = rows.withColumn("_first", own(F.col("_at")))
    rows = rows.withColumn("_some", F.transform(F.arrays_zip("_at", "_asked"), lambda x: F.when(x["_asked"], x["_at"])))
    rows = rows.withColumn("_some", own(F.col("_some")))
    n, asked = F.size("_wanted"), F.size(F.filter("_asked", lambda x: x))
    by_anchor = found(F.col("_first")) >= F.greatest(F.lit(2), F.floor(n / 2) + 1)
    by_detector = (asked >= 2) & (t.word_count(F.col("_text")) >= n * WORDS_FOR_DETECTION) & (found(F.col("_some")) >= F.greatest(F.lit(2), F.floor(asked / 2) + 1))
    rows = rows.withColumn("_cuts", F.when(stripped(F.col("_text")) == "", F.transform("_first", lambda p: F.lit(None).cast("int"))).when(by_anchor, F.col("_first")).when(by_detector, F.col("_some")).otherwise(F.transform("_first", lambda p: F.lit(None).cast("int"))))
    rows = rows.withColumn("_places", F.array_sort(F.filter("_at", lambda p: p.isNotNull()))).withColumn("_sorted", F.array_sort(F.filter("_cuts", lambda p: p.isNotNull())))
    end, text = F.length("_text"), F.col("_text")
    next_of = lambda places, p: F.coalesce(F.get(F.filter(places, lambda q: q > p), F.lit(0)), end)

    def resolved(x: Column) -> Column:
        spec, at, cut = x["_wanted"], x["_at"], x["_cuts"]
        again = lambda said: F.when(t.incomplete(said, spec["question"]) & at.isNotNull(), repaired(text, at, next_of(F.col("_places"), at), spec["question"])).otherwise(said)
        sliced = bound(repaired(text, cut, next_of(F.col("_sorted"), cut), spec["question"]), again)
        before = F.nullif(repaired(text, F.lit(0), next_of(F.col("_places"), at), spec["question"]), F.lit(""))
        cumulative = F.when((spec["task_type"] == CUMULATIVE_TASK) & at.isNotNull() & (stripped(text) != ""), before)
        said = F.coalesce(cumulative, F.when(cut.isNotNull(), sliced), F.col("section_text"))
        how = F.when(cumulative.isNotNull(), "cumulative").when(cut.isNotNull(), "anchored").otherwise("inherited")
        return F.struct(spec["part_idx"].cast("int").alias("part_idx"), spec["label"].alias("label"), said.alias("section_text"), how.alias("resolved"))

    whole = F.array(F.struct(F.lit(None).cast("int").alias("part_idx"), (F.col("label") if "label" in parts.columns else F.lit(None).cast("string")).alias("label"), F.col("section_text").alias("section_text"), F.lit("whole").alias("resolved")))
    children = F.transform(F.arrays_zip("_wanted", "_at", "_cuts"), resolved)
    keep = [c for c in parts.columns if c not in ("label", "section_text", *key)]
    return rows.select(*key, *keep, F.explode(F.when(F.coalesce(n, F.lit(0)) < 2, whole).otherwise(children)).alias("_x")).select(*key, *keep, "_x.*")


def merged_spans(spans: DataFrame, *key: str, most: int | None = None) -> DataFrame:
    """Overlapping intervals (start, end) are joined; optionally the first so many islands of each key."""
    w = W.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    out = islands.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return out.where(F.col("island") <= most) if most else out


def distinct_capped(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """The first so many values of each key, each once whatever its case and closing stop."""
    low = F.regexp_replace(F.lower(value), r"\.+$", "")
    first = rows.withColumn("_low", low).groupBy(key, "_low").agg(F.min(F.struct(order, value)).alias("first"))
    nth = F.row_number().over(W.partitionBy(key).orderBy("first"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select(key, "nth", F.col("first")[value].alias(value))
