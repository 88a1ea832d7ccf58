"""Queries on marks, bands and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import bands
from scriptorium.operators import benchmark, scoring
from scriptorium.operators.medians import medians


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _parts(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("part_idx"), F.col("l_quantity").alias("score"), (F.col("l_quantity") * 2).alias("percent"), "l_discount", "l_returnflag", "l_suppkey")


def _orders(spark, sf) -> DataFrame:
    return _t(spark, sf, "orders")


def total_mark_per_submission(spark, sf):
    out = scoring.total_marks(_parts(spark, sf))
    p = F.col("total_mark")
    out = out.withColumns({"analytical_band": bands.analytical(p), "band": bands.deterministic(p)})
    return out.withColumn("position", bands.position(p, F.col("band"), F.lit("")))


def percent_part_total(spark, sf):
    """A1: parts without a score have a percentage of their maximum; some have neither maximum nor score."""
    open_ = F.col("part_idx") % 3 == 0
    parts = _parts(spark, sf).withColumn("max_mark", F.when((F.col("part_idx") != 5) | ~open_, (F.col("l_suppkey") % 4 + 1) * 5.0))
    parts = parts.withColumn("max_mark", F.when((F.col("part_idx") == 6) & (F.col("submission_id") % 2 == 0), None).otherwise(F.col("max_mark"))).withColumn("score", F.when(~open_, F.col("score")))
    return scoring.total_marks(parts)


def missing_part_zero_credit(spark, sf):
    subs = _orders(spark, sf).select(F.col("o_orderkey").alias("submission_id"))
    out = scoring.with_missing(subs, _parts(spark, sf))
    return out.groupBy("submission_id").agg(F.sum("score").alias("total"), F.count_if(F.col("state") == "Missing").alias("n_missing"), F.max("confidence").alias("confidence"))


_NAMED = ("", "Upper Second", "pass", "Secure", "1st", "nonsense")
_GUIDANCE = ("Marks by steps.", "First class work argues well.", "Award 2:1 for sound work.")


def grade_bands(spark, sf):
    """Bands as named or by percentage, on the scale that the guidance is on."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    p = F.col("percent")
    out = _parts(spark, sf).select("percent", pick(_NAMED, F.col("part_idx") % 6).alias("said"), pick(_GUIDANCE, F.col("l_suppkey") % 3).alias("guidance")).groupBy("percent", "said", "guidance").agg(F.count("*").alias("n"))
    out = out.withColumn("band", bands.band(F.col("said"), p, F.col("guidance")))
    return out.withColumns({"position": bands.position(p, F.col("band"), F.col("guidance")), "confidence": bands.default_confidence(F.col("band"), F.col("guidance")), "ordinal": bands.ordinal(F.col("band"))})


def moderation_gate(spark, sf):
    parts = _parts(spark, sf).withColumn("ordinal", bands.ordinal(bands.deterministic(F.col("percent"))))
    return scoring.moderation_gate(parts, "submission_id", "l_returnflag")


def verifier_cap(spark, sf):
    flag = F.when(F.col("l_returnflag") == "R", "too_generous").otherwise("agree")
    advice = F.when(F.col("part_idx") % 2 == 0, "lower_score").otherwise("keep")
    out = _parts(spark, sf).withColumn("capped", scoring.capped(F.col("score"), flag, advice, F.lit(20.0)))
    return out.groupBy("submission_id").agg(F.sum("capped").alias("capped_total"), F.count_if(F.col("capped") < F.col("score")).alias("n_capped"))


def moderated_scores_merge(spark, sf):
    parts = _parts(spark, sf).groupBy("submission_id", "part_idx").agg(F.max("score").alias("score")).withColumn("most", F.lit(50.0))
    adjusted = parts.where(F.col("part_idx") % 2 == 0).select("submission_id", "part_idx", (F.col("score") + 3).alias("adjusted"))
    return scoring.moderated(parts, adjusted, "submission_id", "part_idx").groupBy("status").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"), F.sum("new_score").alias("new_score"))


def calibration_merge(spark, sf):
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cohort"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("mark"))
    marks = o.where("id % 11 <> 0").select("id", (F.col("mark") + 1).alias("calibrated"))
    return scoring.calibrated(o, marks, "id", "cohort")


def part_compare_zero_fill(spark, sf):
    parts = _parts(spark, sf)
    side = lambda flag, name: parts.where(F.col("l_returnflag") == flag).groupBy("submission_id", "part_idx").agg(F.sum("score").alias(name))
    both = benchmark.zero_filled(side("A", "human"), side("R", "model"), "submission_id", "part_idx")
    return both.groupBy("submission_id").agg(F.sum("abs_delta").alias("abs_delta_sum"), F.count("*").alias("n_labels"))


def variant_comparison(spark, sf):
    o = _orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", F.floor("o_totalprice").alias("mark"))
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.sum("mark").alias(n))
    return side("F", "baseline").join(side("O", "candidate"), "o_custkey").withColumn("delta", F.col("candidate") - F.col("baseline"))


def benchmark_aggregate(spark, sf):
    o = _orders(spark, sf).select("o_orderstatus", F.floor("o_totalprice").alias("delta"))
    return benchmark.by_and_overall(o, F.col("o_orderstatus"), F.count("*").alias("n"), F.sum("delta").alias("delta"), F.max("delta").alias("worst"))


def amortised_summary(spark, sf):
    o = _orders(spark, sf).select(F.col("o_orderstatus").alias("variant"), F.lit(1.0).alias("extraction"), (F.col("o_orderkey") % 8).cast("double").alias("latency"), F.lit(100.0).alias("preparation"))
    return benchmark.amortised(o)


def worst_runs(spark, sf):
    o = _orders(spark, sf).select("o_orderkey", F.abs(F.floor("o_totalprice") - 50000).alias("abs_delta"))
    return o.orderBy(F.col("abs_delta").desc(), "o_orderkey").limit(10)


def stage_latency_breakdown(spark, sf):
    e = _t(spark, sf, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_s"), F.countDistinct("user_id").alias("scripts"))
    middle = medians(e, ["event_type"], median_s=F.col("value")).withColumnRenamed("event_type", "_type")
    return sums.join(middle, F.col("event_type").eqNullSafe(F.col("_type"))).drop("_type")


def error_rollup(spark, sf):
    e = _t(spark, sf, "events").where("value > 50")
    return e.groupBy("event_type").agg(F.countDistinct(F.struct("user_id", F.to_date("ts"))).alias("scripts_with_errors"), F.count("*").alias("n_errors"))


def mark_distribution(spark, sf):
    return _parts(spark, sf).groupBy("l_returnflag", "score").agg(F.count("*").alias("n"))


def cross_model_average(spark, sf):
    p = _parts(spark, sf).groupBy("submission_id").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("score"))
    held = F.filter(F.array("A", "N", "R"), lambda x: x.isNotNull())
    return p.select("submission_id", (F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)).alias("average_mark"), F.abs(F.col("A") - F.col("R")).alias("difference"))


def top_suppliers_of_errors(spark, sf):
    return benchmark.top_values(_parts(spark, sf).where("score < 5"), "l_suppkey", 5, "l_returnflag").select("l_returnflag", "l_suppkey", "n", "nth")


def natural_label_sort_rank(spark, sf):
    from pyspark.sql import Window as W

    p = _parts(spark, sf).groupBy(F.concat(F.lit("Part "), F.col("part_idx").cast("string")).alias("label")).agg(F.sum("score").alias("total"))
    return p.withColumn("rank", F.row_number().over(W.orderBy(F.regexp_extract("label", r"(\d+)", 1).cast("int"))))


_DET = "CASE WHEN p >= 85 THEN 'Excellent' WHEN p >= 70 THEN 'Strong' WHEN p >= 55 THEN 'Secure' WHEN p >= 40 THEN 'Adequate' WHEN p >= 25 THEN 'Developing' WHEN p > 0 THEN 'Weak' ELSE 'Missing' END"
_ANA = "CASE WHEN p >= 70 THEN 'First' WHEN p >= 60 THEN '2:1' WHEN p >= 50 THEN '2:2' WHEN p >= 40 THEN 'Third/Pass' WHEN p <= 20 THEN 'Missing/unfinished' ELSE 'Fail' END"
_THIRDS = "CASE WHEN p < {lo} + ({hi} - {lo}) / 3 THEN 'low' WHEN p > {hi} - ({hi} - {lo}) / 3 THEN 'high' ELSE 'mid' END"
_POS = "CASE d " + " ".join(f"WHEN '{n}' THEN {_THIRDS.format(lo=f'{lo}::DOUBLE', hi=f'{hi}::DOUBLE')}" for n, lo, hi in (("Excellent", 85, 100), ("Strong", 70, 84.99), ("Secure", 55, 69.99), ("Adequate", 40, 54.99), ("Developing", 25, 39.99), ("Weak", 0.01, 24.99))) + " ELSE 'low' END"
_APOS = "CASE d " + " ".join(f"WHEN '{n}' THEN {_THIRDS.format(lo=f'{lo}::DOUBLE', hi=f'{hi}::DOUBLE')}" for n, lo, hi in (("First", 70, 100), ("2:1", 60, 69.99), ("2:2", 50, 59.99), ("Third/Pass", 40, 49.99), ("Fail", 20.01, 39.99), ("Missing/unfinished", 0, 20))) + " END"
_ORD = "CASE d WHEN 'Missing' THEN 0 WHEN 'Weak' THEN 1 WHEN 'Developing' THEN 2 WHEN 'Adequate' THEN 3 WHEN 'Secure' THEN 4 WHEN 'Strong' THEN 5 ELSE 6 END"

SQL = {
    "total_mark_per_submission": f"SELECT submission_id, p AS total_mark, n_parts, {_ANA} AS analytical_band, d AS band, {_POS} AS position FROM (SELECT *, {_DET} AS d FROM (SELECT l_orderkey AS submission_id, least(100.0, sum(l_quantity)) AS p, count(*) AS n_parts FROM lineitem GROUP BY 1))",
    "percent_part_total": "SELECT l_orderkey AS submission_id, CASE WHEN count(*) = 1 AND max(CASE WHEN s IS NULL AND m IS NULL THEN pct END) IS NOT NULL THEN least(100.0, round(max(pct), 2)) WHEN count(*) FILTER (s IS NULL AND m IS NULL) = 0 THEN greatest(0.0, least(100.0, round(coalesce(sum(s), 0) + coalesce(sum(CASE WHEN s IS NULL THEN pct * m / 100 END), 0), 2))) END AS total_mark, count(*) AS n_parts FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS s, l_quantity * 2 AS pct, CASE WHEN l_linenumber = 6 AND l_orderkey % 2 = 0 THEN NULL ELSE (l_suppkey % 4 + 1) * 5.0::DOUBLE END AS m FROM lineitem) GROUP BY 1",
    "missing_part_zero_credit": "SELECT o_orderkey AS submission_id, coalesce(sum(l_quantity), 0) AS total, count(*) FILTER (l_orderkey IS NULL) AS n_missing, max(CASE WHEN l_orderkey IS NULL THEN 95 ELSE 75 END)::INT AS confidence FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "grade_bands": f"SELECT p AS percent, said, guidance, n, d AS band, CASE WHEN g = 0 THEN {_POS} ELSE {_APOS} END AS position, CASE WHEN g = 0 THEN 75.0 WHEN d IN ('Fail', 'Missing/unfinished') THEN 78.0 ELSE 72.0 END::DOUBLE AS confidence, CASE d WHEN 'Missing/unfinished' THEN 0 WHEN 'Missing' THEN 0 WHEN 'Fail' THEN 1 WHEN 'Weak' THEN 1 WHEN 'Third/Pass' THEN 2 WHEN 'Developing' THEN 2 WHEN '2:2' THEN 3 WHEN 'Adequate' THEN 3 WHEN '2:1' THEN 4 WHEN 'Secure' THEN 4 WHEN 'First' THEN 5 WHEN 'Strong' THEN 5 ELSE 6 END AS ordinal FROM (SELECT *, CASE WHEN g = 0 THEN CASE said WHEN 'Secure' THEN 'Secure' ELSE {_DET} END ELSE CASE said WHEN 'Upper Second' THEN '2:1' WHEN 'pass' THEN 'Third/Pass' WHEN '1st' THEN 'First' ELSE {_ANA} END END AS d FROM (SELECT l_quantity * 2 AS p, ({list(_NAMED)})[l_linenumber % 6 + 1] AS said, l_suppkey % 3 AS g, ({list(_GUIDANCE)})[l_suppkey % 3 + 1] AS guidance, count(*) AS n FROM lineitem GROUP BY ALL))",
    "moderation_gate": f"SELECT *, reason = 'eligible' AS should_moderate FROM (SELECT submission_id, l_returnflag, size, spread, gap, CASE WHEN size < 2 THEN 'single_part' WHEN spread > 15 THEN 'spread' WHEN gap > 1 THEN 'band_gap' ELSE 'eligible' END AS reason FROM (SELECT submission_id, l_returnflag, count(*) AS size, max(p) - min(p) AS spread, max({_ORD}) - min({_ORD}) AS gap FROM (SELECT l_orderkey AS submission_id, l_returnflag, l_quantity * 2 AS p, {_DET.replace(' p ', ' l_quantity * 2 ')} AS d FROM lineitem) GROUP BY ALL))",
    "verifier_cap": "SELECT submission_id, sum(c) AS capped_total, count(*) FILTER (c < q) AS n_capped FROM (SELECT l_orderkey AS submission_id, l_quantity AS q, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 AND l_quantity > 20 THEN 20.0::DOUBLE ELSE l_quantity END AS c FROM lineitem) GROUP BY 1",
    "moderated_scores_merge": "SELECT status, count(*) AS n, sum(new_score - score) AS delta, sum(new_score) AS new_score FROM (SELECT score, CASE WHEN n % 2 <> 0 THEN 'no_change' WHEN score + 3 > 50 THEN 'out_of_range' ELSE 'ok' END AS status, CASE WHEN n % 2 = 0 AND score + 3 <= 50 THEN score + 3 ELSE score END AS new_score FROM (SELECT l_orderkey, l_linenumber AS n, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2)) GROUP BY 1",
    "calibration_merge": "SELECT id, cohort, mark, CASE WHEN ok THEN mark + 1 ELSE mark END AS final_mark, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS calibration_delta, CASE WHEN ok THEN 'ok' ELSE 'calibration_failed' END AS status FROM (SELECT *, min((id % 11 <> 0 AND mark + 1 BETWEEN 0 AND 100)::INT) OVER (PARTITION BY cohort) = 1 AS ok FROM (SELECT o_orderkey AS id, o_custkey AS cohort, floor(o_totalprice / 5000)::DOUBLE AS mark FROM orders))",
    "part_compare_zero_fill": "SELECT submission_id, sum(abs(coalesce(h, 0) - coalesce(m, 0))) AS abs_delta_sum, count(*) AS n_labels FROM (SELECT l_orderkey AS submission_id, l_linenumber, sum(l_quantity) FILTER (l_returnflag = 'A') AS h, sum(l_quantity) FILTER (l_returnflag = 'R') AS m FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2) GROUP BY 1",
    "variant_comparison": "SELECT o_custkey, b AS baseline, c AS candidate, c - b AS delta FROM (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT) FILTER (o_orderstatus = 'F')::BIGINT AS b, sum(floor(o_totalprice)::BIGINT) FILTER (o_orderstatus = 'O')::BIGINT AS c FROM orders GROUP BY 1) WHERE b IS NOT NULL AND c IS NOT NULL",
    "benchmark_aggregate": "SELECT o_orderstatus, count(*) AS n, sum(floor(o_totalprice)::BIGINT)::BIGINT AS delta, max(floor(o_totalprice)::BIGINT) AS worst FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus))",
    "amortised_summary": "SELECT variant, n, batch, round(1.0::DOUBLE + l + 100.0::DOUBLE / batch, 4) AS amortised FROM (SELECT o_orderstatus AS variant, count(*) AS n, avg((o_orderkey % 8)::DOUBLE) AS l FROM orders GROUP BY 1) CROSS JOIN (SELECT unnest([1, 5, 10, 25, 50]) AS batch)",
    "worst_runs": "SELECT o_orderkey, abs(floor(o_totalprice)::BIGINT - 50000) AS abs_delta FROM orders ORDER BY 2 DESC, 1 LIMIT 10",
    "stage_latency_breakdown": "SELECT event_type, count(*) AS n, median(value) AS median_s, max(value) AS max_s, count(DISTINCT user_id) AS scripts FROM events GROUP BY 1",
    "error_rollup": "SELECT event_type, count(DISTINCT (user_id, ts::DATE)) AS scripts_with_errors, count(*) AS n_errors FROM events WHERE value > 50 GROUP BY 1",
    "mark_distribution": "SELECT l_returnflag, l_quantity AS score, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "cross_model_average": "SELECT submission_id, (coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0)) / ((a IS NOT NULL)::INT + (n IS NOT NULL)::INT + (r IS NOT NULL)::INT) AS average_mark, abs(a - r) AS difference FROM (SELECT l_orderkey AS submission_id, max(l_quantity) FILTER (l_returnflag = 'A') AS a, max(l_quantity) FILTER (l_returnflag = 'N') AS n, max(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)",
    "top_suppliers_of_errors": "SELECT l_returnflag, l_suppkey, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey)::INT AS nth FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY 1, 2) QUALIFY nth <= 5",
    "natural_label_sort_rank": "SELECT 'Part ' || l_linenumber AS label, sum(l_quantity) AS total, row_number() OVER (ORDER BY l_linenumber)::INT AS rank FROM lineitem GROUP BY l_linenumber",
}
QUERIES = {name: globals()[name] for name in SQL}
