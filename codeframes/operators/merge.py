"""Merging of extractions: first-fit clusters, representatives, notes, scripts and provenance.

Clusters are found in one pass over each video's extractions in order: a task holds the first texts of the running
video's clusters, with an index of their segments, and no rows.  All steps share one partitioning by video.

Defined results: a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from codeframes.functions.distance import SeedIndex
from codeframes.functions.text import normalize, two_digits
from codeframes.schemas import check_bounds

SIMILARITY, LOW_CONFIDENCE, CONFLICT_MARGIN = 0.85, 0.5, 0.1


def cluster(extractions: DataFrame, similarity_threshold: float = SIMILARITY) -> DataFrame:
    """``extractions`` with ``norm`` and ``cluster_id``: in order of seq, each joins the first cluster whose first
    member is similar enough, or starts one.  A text is measured against the seeds only that ``SeedIndex`` can't rule out."""
    check_bounds(similarity_threshold=similarity_threshold)
    rows = extractions.withColumn("norm", F.coalesce(normalize("text"), F.lit("")))

    def fold(batches):
        import pyarrow as pa

        video, seeds = object(), SeedIndex(similarity_threshold)
        for batch in batches:
            ids = []
            for v, norm in zip(batch.column("video_id").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                if v != video:
                    video, seeds = v, SeedIndex(similarity_threshold)
                found = seeds.first(norm)
                if found is None:
                    found = seeds.add(norm)
                ids.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32())], names=[*batch.schema.names, "cluster_id"])

    n = int(extractions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*rows.schema.fields, StructField("cluster_id", IntegerType())])
    return rows.repartition(n, "video_id").sortWithinPartitions("video_id", "seq").mapInArrow(fold, schema)


def snippets(clustered: DataFrame, low_confidence: float = LOW_CONFIDENCE, conflict_margin: float = CONFLICT_MARGIN) -> DataFrame:
    """One row per cluster: the best text, sources, and what is doubtful, in order of the first source."""
    check_bounds(low_confidence_threshold=low_confidence, conflict_margin=conflict_margin)
    best = F.struct((-F.col("confidence")).alias("c"), "timestamp_ms", "path", "seq")
    grouped = clustered.groupBy("video_id", "cluster_id").agg(
        F.min_by(F.struct("text", "norm", "confidence"), best).alias("rep"),
        F.sort_array(F.collect_list(F.struct("timestamp_ms", "path"))).alias("at"),
        F.collect_list(F.struct("norm", "confidence")).alias("variants"),
        F.count_distinct("norm").alias("n_variants"),
    )
    others = F.filter("variants", lambda v: v["norm"] != F.col("rep.norm"))
    runner_up = F.array_max(F.transform(others, lambda v: v["confidence"]))
    rows = grouped.select(
        "video_id", "cluster_id", F.col("rep.text").alias("code"), F.transform("at", lambda s: F.struct(s["path"].alias("path"), s["timestamp_ms"].alias("timestamp_ms"))).alias("sources"),
        F.col("rep.confidence").alias("rep_confidence"), runner_up.alias("runner_up_confidence"), "n_variants",
    )
    flagged = rows.withColumn("low_confidence", F.col("rep_confidence") < low_confidence).withColumn(
        "conflict", F.coalesce(F.col("rep_confidence") - F.col("runner_up_confidence") <= conflict_margin, F.lit(False))
    )
    order = Window.partitionBy("video_id").orderBy(F.col("sources")[0]["timestamp_ms"], F.col("sources")[0]["path"], "cluster_id")
    return flagged.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


# The notes' words.
LOW_NOTE = ("low confidence: representative confidence ", " < ")
CONFLICT_NOTE = ("conflict: ", " differing transcriptions with near-equal confidence (representative ", " vs runner-up ", "); kept the highest-confidence one")


def notes(low_confidence: float = LOW_CONFIDENCE) -> Column:
    """The flags of a snippet in words, joined by ``; ``."""
    low = F.concat(F.lit(LOW_NOTE[0]), two_digits("rep_confidence"), F.lit(LOW_NOTE[1] + f"{low_confidence:.2f}"))
    a, b, c, d = map(F.lit, CONFLICT_NOTE)
    conflict = F.concat(a, F.col("n_variants").cast("string"), b, two_digits("rep_confidence"), c, two_digits("runner_up_confidence"), d)
    return F.concat_ws("; ", F.when(F.col("low_confidence"), low), F.when(F.col("conflict"), conflict))


def with_merge_function(found: DataFrame, clustered: DataFrame, merge: Column) -> DataFrame:
    """Replace each snippet's code by ``merge``, an expression over ``members``: its extractions in order of seq."""
    members = clustered.groupBy("video_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "confidence", "path", "timestamp_ms"))).alias("members"))
    return found.join(members, ["video_id", "cluster_id"]).withColumn("code", merge).drop("members")


def provenance(clustered: DataFrame, found: DataFrame) -> DataFrame:
    """One row per extraction with its cluster's code, by membership alone."""
    code = found.select("video_id", "cluster_id", "position", F.col("code").alias("cleaned_code"))
    rows = clustered.select("video_id", "cluster_id", "seq", "timestamp_ms", "path", "text").join(code, ["video_id", "cluster_id"])
    order = Window.partitionBy("video_id").orderBy("timestamp_ms", "path", "position", "seq")
    return rows.select(
        "video_id", (F.row_number().over(order) - 1).cast("long").alias("entry"), F.col("timestamp_ms").alias("timestamp"), F.col("path").alias("screenshot"), F.col("text").alias("raw_ocr"), "cleaned_code"
    )


def scripts(found: DataFrame) -> DataFrame:
    """Per video the codes that aren't blank, two blank lines between, one newline at the end."""
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda s: s["code"]), lambda c: c.rlike(r"(?U)[^\s\x1c-\x1f]"))
    rows = found.groupBy("video_id").agg(parts.alias("parts"))
    joined = F.concat(F.array_join(F.transform("parts", lambda c: F.regexp_replace(c, r"\n+\z", "")), "\n\n\n"), F.lit("\n"))
    return rows.select("video_id", F.when(F.size("parts") > 0, joined).otherwise(F.lit("")).alias("script"))
