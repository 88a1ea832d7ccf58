"""Several answers to one request: retries of the same scorer, and scorers that stand in for each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import any_of

# Parts of the messages after which a second attempt is made.
RETRY_PART = ("criterion_notes", "too few items for strengths", "too few items for weaknesses", "too few items for evidence", "did not return a coverage_comment")
RETRY_FINAL = ("shorter than the required minimum length", "did not explicitly cover all detected sections")


def retried(attempts: DataFrame, key: str, retryable: tuple[str, ...]) -> DataFrame:
    """The first attempt, or the second where the first failed with a message that allows another one.

    attempts: key, attempt (1 or 2), value, error; of repeated rows the greatest counts. A second attempt that is not there
    leaves the first one's error; one that was not allowed is passed over. Returns key, value, error, attempts (made)."""
    answer = lambda n: F.max(F.when(F.col("attempt") == n, F.struct("value", "error")))
    by = attempts.groupBy(key).agg(answer(1).alias("_first"), answer(2).alias("_second"))
    again = F.coalesce(any_of(F.col("_first")["error"], retryable), F.lit(False)) & F.col("_second").isNotNull()
    used = F.when(again, F.col("_second")).otherwise(F.col("_first"))
    fine = used["error"].isNull()
    error = F.when(F.col("_first").isNull(), "no_answer").otherwise(used["error"])
    return by.select(key, F.when(fine, used["value"]).alias("value"), error.alias("error"), F.when(F.col("_first").isNull(), 0).when(again, 2).otherwise(1).alias("attempts"))


def fallen_back(answers: DataFrame, key: str) -> DataFrame:
    """U4: the answer of the first scorer in rank that gave one, else the error of the last that was asked.

    answers: key, rank, scorer, value, error. Returns key, scorer, value, error."""
    by = answers.groupBy(key).agg(
        F.min(F.when(F.col("error").isNull(), F.struct("rank", "scorer", "value"))).alias("_best"),
        F.max(F.struct("rank", "scorer", "error")).alias("_last"),
    )
    none = F.col("_best").isNull()
    return by.select(key, F.coalesce(F.col("_best")["scorer"], F.col("_last")["scorer"]).alias("scorer"), F.col("_best")["value"].alias("value"), F.when(none, F.col("_last")["error"]).alias("error"))
