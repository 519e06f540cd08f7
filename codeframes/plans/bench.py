"""The comparison of backends over a folder of labelled pictures.

Every backend reads every picture in tasks of its own; a picture that a backend fails on becomes a row with the error, and
the backend is left out by an anti-join, while the others are compared.

Defined results: a folder without labelled pictures gives every backend means of 0.0 over no frames, and no winner; a
backend that can't be set up fails on every picture, and on none where there are none; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframes.operators import evaluate
from codeframes.sources.logs import labelled_frames

Setup = Callable[[], Callable[[list[bytes]], list[tuple[str, float]]]]
PREDICTION = "backend string, name string, truth string, text string, error string"


def predictions(pictures: DataFrame, backends: Sequence[tuple[str, Setup]]) -> DataFrame:
    """(backend, name, truth, text, error) of every backend over ``pictures`` (name, truth, png)."""
    empty = pictures.sparkSession.createDataFrame([], PREDICTION)
    for name, setup in backends:
        empty = empty.unionByName(_read(pictures.select("name", "truth", "png"), name, setup))
    return empty


def _read(pictures: DataFrame, backend: str, setup: Setup) -> DataFrame:
    def work(batches):
        import pandas as pd

        reader = broken = None
        for batch in batches:
            rows = []
            for name, truth, png in batch.itertuples(index=False, name=None):
                text = error = None
                try:
                    if broken is not None:
                        raise broken
                    if reader is None:
                        reader = setup()
                    ((text, _),) = reader([bytes(png)])
                except Exception as e:  # noqa: BLE001  one backend's failure is a row, whatever it is
                    error = f"{type(e).__name__}: {e}"
                    broken = e if reader is None else None
                rows.append((backend, name, truth, text or "", error))
            yield pd.DataFrame(rows, columns=["backend", "name", "truth", "text", "error"])

    return pictures.mapInPandas(work, PREDICTION)


def compare(read: DataFrame, backends: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The report of the ``backends`` that failed on no picture, and (backend, name, error) of all failures."""
    asked = read.sparkSession.createDataFrame([(n,) for n in backends], "backend string")
    failures = read.filter(F.col("error").isNotNull()).select("backend", "name", "error")
    left = asked.join(failures.select("backend").distinct(), "backend", "left_anti")
    means = evaluate.benchmark(evaluate.score_predictions(read))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast(dict(means.dtypes)[name])).alias(name)
    report = left.join(means, "backend", "left").select("backend", *(zero(c) for c in means.columns if c != "backend"))
    return report, failures


def run_folder(spark: SparkSession, directory: str, backends: Sequence[tuple[str, Setup]]) -> tuple[str, str | None, list[tuple[str, str, str]]]:
    """The report's text, the winner's name, and one failure of each backend that was left out."""
    from codeframes.plans.pipeline import materialised

    found = labelled_frames(spark, directory)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(directory).select("path", F.col("content").alias("png"))
    read = materialised(predictions(found.join(content, "path"), backends), "bench-readings")
    names = [n for n, _ in backends]
    report, failures = compare(read, names)
    order = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "backend string, ordinal int")
    best = evaluate.winner(report.filter("n_frames > 0"), order).first().winner
    first = failures.groupBy("backend").agg(F.min(F.struct("name", "error")).alias("f")).select("backend", "f.name", "f.error").orderBy("backend")
    return evaluate.format_report(report, names), best, [tuple(r) for r in first.collect()]
