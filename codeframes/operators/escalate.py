"""Gate and two-tier reading: doubtful frames are read again, and the second reading counts if it is code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.functions.scoring import code_score


def gate(extractions: DataFrame, score_threshold: float = 0.4) -> DataFrame:
    """Extractions whose score reaches the threshold."""
    return extractions.withColumn("score", code_score("text")).filter(F.col("score") >= score_threshold)


def doubtful(passed: DataFrame, escalate_below: float = 0.6) -> DataFrame:
    return passed.filter(F.col("confidence") < escalate_below)


def adopt(passed: DataFrame, second: DataFrame, score_threshold: float = 0.4) -> DataFrame:
    """Each frame once: the second reading where it was taken and scores as code, the first one otherwise."""
    keys = ["video_id", "seq"]
    taken = second.withColumn("second_score", code_score("text")).select(
        *keys, F.col("text").alias("second_text"), F.col("confidence").alias("second_confidence"), F.col("backend").alias("second_backend"), "second_score"
    )
    use = F.coalesce(F.col("second_score") >= score_threshold, F.lit(False))
    both = passed.join(taken, keys, "left").withColumn("escalated", F.col("second_score").isNotNull())
    for name in ("text", "confidence", "backend"):
        both = both.withColumn(name, F.when(use, F.col(f"second_{name}")).otherwise(F.col(name)))
    return both.withColumn("adopted", use).drop("second_text", "second_confidence", "second_backend", "second_score")
