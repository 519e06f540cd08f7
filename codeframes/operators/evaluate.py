"""Accuracy of extraction backends over labelled frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframes.functions.text import similarity, token_accuracy


def score_predictions(predictions: DataFrame) -> DataFrame:
    """``predictions`` (backend, name, truth, text, error) with both metrics."""
    return predictions.withColumn("levenshtein", similarity("text", "truth")).withColumn("token_acc", token_accuracy("text", "truth"))


def benchmark(scored: DataFrame) -> DataFrame:
    """Means per backend; a backend that failed on any frame is left out."""
    means = scored.groupBy("backend").agg(
        F.avg("levenshtein").alias("mean_levenshtein"), F.avg("token_acc").alias("mean_token_acc"), F.count(F.lit(1)).alias("n_frames"),
        F.bool_or(F.coalesce(F.col("error").isNotNull(), F.lit(False))).alias("failed") if "error" in scored.columns else F.lit(False).alias("failed"),
    )
    return means.filter(~F.col("failed")).drop("failed").withColumn("aggregate", (F.col("mean_levenshtein") + F.col("mean_token_acc")) / 2)


def winner(report: DataFrame, order: DataFrame) -> DataFrame:
    """The backend with the largest aggregate, on ties the first in ``order`` (backend, ordinal); null without any."""
    return report.join(order, "backend").agg(F.max_by("backend", F.struct("aggregate", (-F.col("ordinal")).alias("first"))).alias("winner"))


# The report's columns, and what stands below them.
COLUMNS = {"backend": "backend", "levenshtein": "mean_levenshtein", "token_acc": "mean_token_acc", "aggregate": "aggregate"}
WINNER = "Winner: {}  (recommended default, over {} labeled frame(s))"
NO_WINNER = "Winner: (no backends benchmarked)"


def report_text(report: DataFrame, order: DataFrame) -> DataFrame:
    """One row, ``text``: the report as a table of fixed width, a line per backend in ``order`` (backend, ordinal), and the winner.

    Columns are as wide as their longest cell; made by expressions over the one row that the few backends gather to."""
    cell = lambda name: F.col(name) if name == "backend" else F.format_string("%.3f", F.col(name))
    lines = report.join(order, "backend").select("ordinal", "aggregate", "backend", "n_frames", F.array(*(cell(c) for c in COLUMNS.values())).alias("cells"))
    best = F.max_by(F.struct("backend", "n_frames"), F.struct("aggregate", (-F.col("ordinal")).alias("first")))
    gathered = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "cells"))), lambda r: r["cells"]).alias("body"), best.alias("best"))
    head = F.array(*map(F.lit, COLUMNS))
    table = gathered.select("best", F.concat(F.array(head), "body").alias("body"))
    widths = F.transform(F.sequence(F.lit(0), F.lit(len(COLUMNS) - 1)), lambda c: F.array_max(F.transform("body", lambda row: F.length(row[c]))))
    wide = table.select("*", widths.alias("widths"))
    shown = F.transform("body", lambda row: F.array_join(F.zip_with(row, "widths", lambda text, n: F.rpad(text, n, " ")), "  "))
    rule = F.array_join(F.transform("widths", lambda n: F.repeat(F.lit("-"), n)), "  ")
    before, between, after = WINNER.split("{}")
    last = F.when(F.col("best").isNull(), F.lit(NO_WINNER)).otherwise(F.concat(F.lit(before), "best.backend", F.lit(between), F.col("best.n_frames").cast("string"), F.lit(after)))
    parts = wide.select(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, F.lit(2), F.size(shown)), F.array(F.lit(""), last)).alias("lines"))
    return parts.select(F.array_join("lines", "\n").alias("text"))


def format_report(report: DataFrame, order: list[str]) -> str:
    """``report_text`` for backends in the order of a list."""
    ordinals = report.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order)], "backend string, ordinal int")
    return report_text(report, ordinals).first().text
