"""Medians by rank against the standard library: hot groups, ties, nulls, odd and even numbers, empty tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.medians import medians


@pytest.mark.parametrize("case", ["hot", "ties", "few", "nulls"])
def test_medians_equal_brute_force(spark, case):
    r = random.Random(case)
    rows = {
        "hot": [(r.choice([None, 1, 1, 1, 1, 2]), r.uniform(-5, 5), r.randint(0, 3)) for _ in range(3000)],
        "ties": [(i % 2, 7.0 if i % 3 else 8.0, 1) for i in range(500)],
        "few": [(i, float(i), None) for i in range(40)] + [(1, 4.0, 2), (2, 9.0, 5)],
        "nulls": [(1, None, None), (1, float("nan"), None), (2, None, 3), (None, 2.5, None)],
    }[case]
    found = medians(spark.createDataFrame(rows, "g int, a double, b int").repartition(5), ["g"], a=F.col("a"), twice=F.col("b") * 2).collect()

    def middle(g, i, times=1):
        own = [x[i] * times for x in rows if x[0] == g and x[i] is not None and x[i] == x[i]]
        return statistics.median(own) if own else None

    assert {x.g: (x.a, x.twice) for x in found} == {g: (middle(g, 1), middle(g, 2, 2)) for g in {x[0] for x in rows}}


def test_no_group_and_no_rows(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(100)], "a double")
    assert medians(rows, [], a=F.col("a")).head().a == 49.5
    assert medians(rows.limit(0).withColumn("g", F.lit(1)), ["g"], a=F.col("a")).count() == 0
