"""Scorers (U1 to U3, U6): requests whose payloads are canonical JSON and whose keys are digests of them, calls that give error rows
instead of exceptions, answers that are written once, and a bounded number of attempts with a note on what was wrong."""

from __future__ import annotations

import os
import re
import tempfile
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import guidance as g
from scriptorium.operators.jsons import envelope, json_object

#: U1. Seconds that an answer may take, by default and at least and most.
TIMEOUT, LEAST_TIMEOUT, MOST_TIMEOUT = 300, 10, 900
#: U3. Errors after which the same scorer is asked again, and how often it is asked in all.
RETRY_PART = ("comment_missing", "not_a_list", "wrong_name", "wrong_status", "blank_note", "strengths_not_a_list", "weaknesses_not_a_list", "evidence_not_a_list")
ATTEMPTS = 2

# U6. Tasks that are judged as a whole, and the scales of criteria.
WHOLE_TASKS = ("critique_and_revision", "evaluative_discussion", "synthesis_across_sources", "whole_submission_holistic")
JUDGEMENT, CHECK = ("likert_judgement", ("weak", "developing", "clear", "strong")), ("verification_check", ("missing_or_wrong", "partial", "secure"))

SYSTEM = "You mark one section of a submission. The payload holds all that counts. Answer with one JSON object."


class Scorer(Protocol):
    """Requests (profile, request_key, attempt, payload), each key once, to answers: request_key, response (the envelope as text)
    and error, a row for each request that was answered or failed."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def timeout_seconds(raw: str | None) -> int:
    """A configured timeout within its bounds; the default where it is no whole number."""
    found = (raw or "").strip()
    return max(LEAST_TIMEOUT, min(MOST_TIMEOUT, int(found))) if re.fullmatch(r"[+-]?\d+", found) else TIMEOUT


def replayed(responses: DataFrame) -> Scorer:
    """A scorer that looks answers up by the digest of the request (request_key, response): a join, the same at any size and time."""
    known = responses.select("request_key", "response").dropDuplicates(["request_key"])
    return lambda requests: requests.select("request_key").join(known, "request_key", "left").withColumn("error", F.when(F.col("response").isNull(), "not_recorded"))


def over_http(url: str, timeout: float = TIMEOUT, tries: int = 1, wait: float = 0.5) -> Scorer:
    """A scorer that posts each payload, one request at a time in each task. A call that fails, stalls or is refused gives a row with
    an error; one that fails on the way is tried `tries` times. Requests carry their key, so that a server can tell a repeated one."""

    def answer(key: str, payload: str) -> tuple[str | None, str | None]:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        error = None
        for nth in range(tries):
            if nth:
                time.sleep(wait * 2 ** (nth - 1))
            try:
                with urlopen(Request(url, payload.encode(), {"Content-Type": "application/json", "Idempotency-Key": key}), timeout=timeout) as got:
                    return got.read().decode("utf-8", "replace"), None
            except HTTPError as e:
                error = f"http_{e.code}"
                if e.code < 500 and e.code not in (408, 429):
                    break
            except TimeoutError:
                error = "timeout"
            except URLError as e:
                error = "timeout" if isinstance(e.reason, TimeoutError) else "no_connection"
            except OSError:
                error = "no_connection"
        return None, error

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [answer(key, payload) for key, payload in zip(frame["request_key"], frame["payload"], strict=True)]
            yield pd.DataFrame({"request_key": frame["request_key"], "response": [s for s, _ in said], "error": [e for _, e in said]}, dtype=object)

    return lambda requests: requests.select("request_key", "payload").mapInPandas(ask, "request_key string, response string, error string")


def options(profile: Column) -> Column:
    """The options of an inference profile as a request states them."""
    whole = ("num_ctx", "seed", "num_predict")
    return F.struct(*(g.profile(profile, name).cast("int" if name in whole else "double").alias(name) for name in g.PROFILE))


def body(model: str, profile: Column, *messages: tuple[str, Column]) -> Column:
    """What is posted: model, format, messages (role, content), stream and the profile's options."""
    said = F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in messages))
    return F.struct(F.lit(model).alias("model"), F.lit("json").alias("format"), said.alias("messages"), F.lit(False).alias("stream"), options(profile).alias("options"))


def with_note(asked: Column, note: Column) -> Column:
    """A body with one more message of the user."""
    return asked.withField("messages", F.concat(asked["messages"], F.array(F.struct(F.lit("user").alias("role"), note.alias("content")))))


def request_key(profile: Column, payload: Column) -> Column:
    """The digest that names a request: equal requests, and they alone, have equal keys."""
    return F.sha2(F.concat_ws("\n", profile, payload).cast("binary"), 256)


def _said(number: Column) -> Column:
    """A number without needless decimals."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.round(number, 2).cast("string"))


def criterion_mode(mode: Column, task: Column) -> Column:
    """Abstract or deterministic, as stated or by the task."""
    return F.when(mode.isin("abstract", "deterministic"), mode).when(task.isin(*WHOLE_TASKS), "abstract").otherwise("deterministic")


def part_payload(parts: DataFrame) -> Column:
    """The payload of a part, as JSON whose fields stand in one order; null fields are left out.

    parts: label, max_mark, question, section_text, and, if they are there, task_type, task_goal, required_steps, criteria (array of
    structs), criterion_mode, marking_guidance and focus_hint. Texts are whole."""
    has = lambda c, kind="string": F.col(c) if c in parts.columns else F.lit(None).cast(kind)
    filled = lambda *cs: F.coalesce(*(F.when(F.trim(c) != "", c) for c in cs[:-1]), cs[-1])
    task, most = has("task_type"), F.col("max_mark")
    abstract = criterion_mode(has("criterion_mode"), task) == "abstract"
    field = F.when(most.isNull(), "provisional_score_0_to_100").otherwise("provisional_score")
    labels = F.when(abstract, F.array(*map(F.lit, JUDGEMENT[1]))).otherwise(F.array(*map(F.lit, CHECK[1])))
    steps = has("required_steps", "array<string>")
    question = F.struct(filled(F.col("question"), has("focus_hint"), F.col("label")).alias("text"), filled(task, F.lit("unspecified")).alias("task_type"), has("task_goal").alias("task_goal"), F.when(F.size(steps) > 0, steps).alias("required_steps"))
    rules = F.concat(F.array(F.concat(field, F.lit(" lies between 0 and "), F.coalesce(_said(most), F.lit("100")), F.lit(".")), F.lit("Nothing outside this section counts.")), g.scoring_rules(has("marking_guidance")))
    scale = F.struct(F.when(abstract, JUDGEMENT[0]).otherwise(CHECK[0]).alias("type"), labels.alias("labels"))
    scoring = F.struct(F.when(task.isin(*WHOLE_TASKS), "classification_then_score").otherwise("criterion_evaluation").alias("method"), scale.alias("scale"), has("criteria", "array<struct<criterion_name:string,check:string>>").alias("criteria"), rules.alias("rules"))
    contract = F.array(
        F.concat(F.lit("Keys: section_label, "), field, F.lit(", criterion_notes, strengths, weaknesses, evidence, coverage_comment.")),
        F.concat(F.lit("criterion_notes lists {criterion_name, status, note}; a status is one of: "), F.array_join(labels, ", "), F.lit("; a note has two to five words.")),
        F.lit("Two strengths, two weaknesses and one piece of evidence at least; coverage_comment is not empty."),
    )
    answer = F.struct(filled(F.col("section_text"), has("focus_hint"), F.col("label")).alias("text"))
    return F.to_json(F.struct(F.col("label").alias("section_id"), F.coalesce(most, F.lit(100.0)).alias("max_mark"), question.alias("question"), scoring.alias("scoring"), answer.alias("student_response"), contract.alias("output_contract")))


def part_requests(parts: DataFrame, model: str, profile: str = "part_scoring") -> DataFrame:
    """Parts with profile and body, ready for answers(). Blank parts are left out: they cost no call."""
    rows = parts.where(F.trim("section_text") != "")
    user = F.concat(F.lit("scoring_payload:\n"), part_payload(rows))
    return rows.withColumns({"profile": F.lit(profile), "body": body(model, F.lit(profile), ("system", F.lit(SYSTEM)), ("user", user))})


def keyed(requests: DataFrame) -> DataFrame:
    """requests (profile, body) with payload, the body as canonical JSON, and request_key."""
    return requests.withColumn("payload", F.to_json("body")).withColumn("request_key", request_key(F.col("profile"), F.col("payload")))


def retry_note(error: Column) -> Column:
    return F.concat(F.lit("Your last answer was refused: "), error, F.lit(". Answer again, with the required JSON object alone."))


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once and stored in the shared folder that the session names: what reads it later asks no scorer again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = os.path.join(tempfile.gettempdir(), "checkpoints")
        context.setCheckpointDir(found)
    return df.checkpoint(eager=True)


def answers(requests: DataFrame, scorer: Scorer, check: Callable[[DataFrame], DataFrame], retryable: tuple[str, ...] = RETRY_PART, note: Callable[[Column], Column] = retry_note, attempts: int = ATTEMPTS) -> DataFrame:
    """Requests (profile, body and others) with what check() makes of their answers, error_code and attempts (made).

    check gets the requests with content, the JSON object of an answer, and adds its columns and error_code. Equal requests are asked
    once. An answer with a retryable error is asked for again with a note, `attempts` times at most; requests that are settled drop
    out, and no round is made where none is left. Errors of a call or its envelope are final. Each round's answers are written once."""
    columns = [c for c in requests.columns if c != "body"]
    pending, settled = requests, []
    for nth in range(1, attempts + 1):
        sent = keyed(pending).withColumn("attempt", F.lit(nth))
        got = kept(scorer(sent.select("profile", "request_key", "attempt", "payload").dropDuplicates(["request_key"])))
        read = sent.join(got.select("request_key", F.struct("response", "error").alias("_got")), "request_key", "left")
        read = read.withColumn("_said", envelope(F.col("_got.response")))
        read = read.withColumn("_object", json_object(F.col("_said.content")))
        failed = F.coalesce(F.col("_got.error"), F.when(F.col("_got").isNull(), "not_answered"), F.col("_said.error_code"), F.col("_object.error_code"))
        read = read.withColumn("_failed", failed).withColumn("content", F.when(failed.isNull(), F.col("_object.object")))
        checked = check(read).withColumn("error_code", F.coalesce("_failed", "error_code")).withColumn("attempts", F.lit(nth))
        checked = kept(checked.drop("_got", "_said", "_object", "_failed", "payload", "attempt"))
        again = F.coalesce(F.col("error_code").isin(*retryable), F.lit(False)) if nth < attempts else F.lit(False)
        settled.append(checked.where(~again).drop("body"))
        rest = checked.where(again)
        if nth == attempts or rest.isEmpty():
            break
        pending = rest.select(*columns, with_note(F.col("body"), note(F.col("error_code"))).alias("body"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out
