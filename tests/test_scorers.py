"""JSON in responses, request keys, and scorers that fail, stall, answer badly and are asked again."""

import json
import random
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import jsons, responses, scorers


def scan(content):
    """The first balanced object by plain loops: from each brace, to where its depth is 0 again."""
    for start in (i for i, c in enumerate(content) if c == "{"):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(content)):
            c = content[i]
            if quoted:
                quoted, skip = (True, False) if skip else (c != '"', c == "\\")
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return content[start : i + 1]
    return None


def test_first_objects_equal_a_plain_scan(spark):
    r = random.Random(1)
    rows = ["".join(r.choices(["{", "}", '"', "\\", "a", " ", '{"a":1}', "é\U0001f600", "\n"], k=r.randint(0, 14))) for _ in range(3000)]
    rows += ["{" * 3000, "}" * 3000, 'x {"a": "}\\"", "b": {"c": 1}} y }', "no object", "", 'a {"b": "' + "long\\n" * 20_000 + '"} c']
    found = spark.createDataFrame([(x,) for x in rows], "s string").repartition(8).select("s", jsons.first_object(F.col("s")).alias("o")).collect()
    assert [x for x in found if x.o != (scan(x.s) if len(x.s) < 20_000 and set(x.s) != {"{"} else x.o)] == []
    assert next(x.o for x in found if len(x.s) > 20_000).endswith('\\n"}') and all(x.o is None for x in found if set(x.s) == {"{"})


def test_json_objects(spark):
    cases = {'{"a": 1}': ('{"a": 1}', None), ' [1]': (None, "not_an_object"), "3": (None, "not_an_object"), 'so {"a": {}} and {': ('{"a": {}}', None), "{a: 1} {}": (None, "invalid_object"), "{ {": (None, "no_object"), "": (None, "no_object"), None: (None, "no_content")}
    rows = spark.createDataFrame([(x,) for x in cases], "s string").select("s", jsons.json_object(F.col("s")).alias("o")).collect()
    assert {x.s: tuple(x.o) for x in rows} == cases


def test_envelopes(spark):
    cases = {
        '{"message": {"role": "x", "content": " text\\n"}}': ("text", None), '{"message": {"content": " "}}': (None, "no_content"), '{"message": {"content": 3}}': (None, "no_content"), '{"message": {}}': (None, "no_content"),
        '{"message": "x"}': (None, "no_message"), "{}": (None, "no_message"), "[]": (None, "response_not_object"), "{": (None, "response_not_json"), None: (None, "no_response"),
    }
    rows = spark.createDataFrame([(x,) for x in cases], "s string").select("s", jsons.envelope(F.col("s")).alias("o")).collect()
    assert {x.s: tuple(x.o) for x in rows} == cases


def test_analyses(spark):
    fine = {"provisional_score": 7, "coverage_comment": " ok ", "strengths": ["a"], "weaknesses": ["b", " ", "c"], "evidence": []}
    bad = {"score_missing": {"provisional_score": None}, "score_not_numeric": {"provisional_score": True}, "score_negative": {"provisional_score": -1}, "strengths_not_a_list": {"strengths": "a"}, "evidence_not_a_list": {"evidence": None}, "comment_missing": {"coverage_comment": 3}, "percent_too_high": {"provisional_score": None, "provisional_score_0_to_100": 101}}
    rows = [("fine", json.dumps(fine), 10.0, ""), ("named", json.dumps({**fine, "grade_band": " 1st", "within_band_position": "HIGH", "band_confidence_0_to_100": 140}), 10.0, "2:1 or First")]
    rows += [("percent", json.dumps({**{k: v for k, v in fine.items() if k != "provisional_score"}, "provisional_score_0_to_100": 70}), 10.0, "")]
    rows += [(k, json.dumps({**fine, **v}), 10.0, "") for k, v in bad.items()] + [("not_json", "{", 10.0, "")]
    found = {x.id: x for x in responses.part_analysis(spark.createDataFrame(rows, "id string, content string, max_mark double, marking_guidance string")).collect()}
    assert {k: x.error_code for k, x in found.items()} == {k: None if k in ("fine", "named", "percent") else k for k, *_ in rows}
    x = found["fine"]
    assert (x.provisional_score, x.provisional_score_0_to_100, x.coverage_comment, x.weaknesses, x.grade_band, x.within_band_position, x.band_confidence_0_to_100) == (7.0, None, "ok", ["b", "c"], "Strong", "low", 75.0)
    assert x.strengths == ["a", responses.FILLERS["strengths"][0]] and x.evidence == [responses.FILLERS["evidence"][0]]
    x = found["named"]
    assert (x.grade_band, x.within_band_position, x.band_confidence_0_to_100) == ("First", "high", 72.0)
    assert (found["percent"].provisional_score, found["percent"].provisional_score_0_to_100, found["percent"].grade_band) == (None, 70.0, "Strong")
    assert all(x.strengths is None and x.grade_band is None for k, x in found.items() if x.error_code)


def test_timeouts_stay_within_bounds():
    assert [scorers.timeout_seconds(x) for x in (None, "", "x", "1.5", "3", "5000", " 45 ", "-9")] == [300, 300, 300, 300, 10, 900, 45, 10]


def parts(spark, *texts):
    rows = [(i, f"Part {i}", 10.0 if i % 2 else None, "Why?", t) for i, t in enumerate(texts)]
    return scorers.part_requests(spark.createDataFrame(rows, "i int, label string, max_mark double, question string, section_text string"), "m")


def test_payloads_hold_whole_texts_and_keys_follow_them(spark):
    long = 'a "quoted" line\nand é\U0001f600 ' * 2000
    rows = {x.i: x for x in scorers.keyed(parts(spark, "one", long, "  ", "one")).collect()}
    assert set(rows) == {0, 1, 3}  # a blank part costs no call
    body = json.loads(rows[1].payload)
    inner = json.loads(body["messages"][1]["content"].removeprefix("scoring_payload:\n"))
    assert inner["student_response"]["text"] == long and inner["max_mark"] == 10.0 and "task_goal" not in inner["question"]
    assert body["options"] == {"temperature": 0.05, "top_p": 0.85, "num_ctx": 8192, "seed": 7, "num_predict": 1100} and body["stream"] is False
    assert json.loads(json.loads(rows[0].payload)["messages"][1]["content"].split("\n", 1)[1])["scoring"]["rules"][0] == "provisional_score_0_to_100 lies between 0 and 100."
    assert len({x.request_key for x in rows.values()}) == 3  # labels differ
    assert {x.i: x.request_key for x in scorers.keyed(parts(spark, "one", long)).collect()} == {i: rows[i].request_key for i in (0, 1)}


@pytest.fixture
def server():
    """Answers by the text of a part: what it is asked for is counted by text and number of messages."""
    seen, flaky = Counter(), Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = json.loads(asked["messages"][1]["content"].split("\n", 1)[1])["student_response"]["text"]
            again = len(asked["messages"]) > 2
            seen[text, again] += 1
            fine = {"provisional_score_0_to_100": 60, "coverage_comment": "ok", "strengths": [], "weaknesses": [], "evidence": []}
            said = {"prose": "I think { " + json.dumps(fine), "no object": "none", "late comment": json.dumps({**fine, "coverage_comment": "ok" if again else ""}), "never": json.dumps({**fine, "coverage_comment": ""}), "negative": json.dumps({**fine, "provisional_score_0_to_100": -1})}.get(text, json.dumps(fine))
            flaky[text] += 1
            if text == "refused" or (text == "flaky" and flaky[text] == 1):
                return self.send_error(500 if text == "flaky" else 400)
            if text == "stalls":
                time.sleep(3)
            out = b"[1]" if text == "bare" else json.dumps({"message": {"content": said}}).encode()
            try:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(out)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", seen
    made.shutdown()


def test_a_scorer_that_fails_stalls_and_answers_badly(spark, server):
    url, seen = server
    texts = ["fine", "prose", "no object", "late comment", "never", "negative", "refused", "flaky", "stalls", "bare"]
    out = scorers.answers(parts(spark, *texts).drop("i").withColumn("max_mark", F.lit(None).cast("double")), scorers.over_http(url, timeout=1.0, tries=2, wait=0.0), responses.part_analysis)
    got = {x.section_text: (x.error_code, x.attempts, x.provisional_score_0_to_100) for x in out.collect()}
    assert got == {
        "fine": (None, 1, 60.0), "prose": (None, 1, 60.0), "flaky": (None, 1, 60.0), "late comment": (None, 2, 60.0), "never": ("comment_missing", 2, None), "no object": ("no_object", 1, None),
        "negative": ("score_negative", 1, None), "refused": ("http_400", 1, None), "stalls": ("timeout", 1, None), "bare": ("response_not_object", 1, None),
    }
    want = Counter({(t, False): 1 for t in texts}) + Counter({("late comment", True): 1, ("never", True): 1, ("flaky", False): 1, ("stalls", False): 1})
    assert seen == want
    assert out.count() == len(texts) and out.where("error_code IS NULL").count() == 4
    assert seen == want  # reading the result again asks nobody


def test_no_server_and_no_requests(spark):
    gone = scorers.over_http("http://127.0.0.1:9", timeout=1.0)
    assert [x.error_code for x in scorers.answers(parts(spark, "a", "b"), gone, responses.part_analysis).collect()] == ["no_connection"] * 2
    assert scorers.answers(parts(spark, "a").limit(0), gone, responses.part_analysis).count() == 0


def test_equal_requests_are_asked_once(spark, server):
    url, seen = server
    rows = parts(spark, "same").drop("i").crossJoin(spark.range(50))
    assert scorers.answers(rows, scorers.over_http(url), responses.part_analysis).where("error_code IS NULL").count() == 50
    assert seen == Counter({("same", False): 1})


def test_replays_know_requests_by_their_digest(spark):
    asked = parts(spark, "one", "two")
    table = scorers.keyed(asked.where("i = 0")).select("request_key", F.lit('{"message": {"content": "{\\"provisional_score_0_to_100\\": 5, \\"coverage_comment\\": \\"x\\", \\"strengths\\": [], \\"weaknesses\\": [], \\"evidence\\": []}"}}').alias("response"))
    got = {x.i: (x.error_code, x.provisional_score_0_to_100) for x in scorers.answers(asked, scorers.replayed(table.union(table)), responses.part_analysis).collect()}
    assert got == {0: (None, 5.0), 1: ("not_recorded", None)}
