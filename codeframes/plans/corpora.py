"""Inputs of the queries, derived from the driver's tables; each has its SQL twin in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_ONLY = r"[^\x00-\x7F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions: a conversation is a video, a turn a frame whose text is code, misread code or prose."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    prose = F.regexp_replace(F.coalesce("text", F.lit("")), ASCII_ONLY, "")
    text = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("def f_"), conv, F.lit("(x):\n    return x")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("def f_"), conv, F.lit("(x):\n    retvrn x")))
        .when(F.col("turn") % 4 == 2, prose)
        .otherwise(F.concat(F.lit("import os\nx = "), turn))
    )
    rows = c.select(
        conv.alias("video_id"), (F.col("turn") * 1000).cast("long").alias("timestamp_ms"), F.concat(F.lit("/frames/"), conv, F.lit("/"), F.lpad(turn, 6, "0"), F.lit(".jpg")).alias("path"),
        ((30 + (F.col("conv_id") * 7 + F.col("turn") * 3) % 70) / 100.0).cast("double").alias("confidence"), text.alias("text"), F.lit("first").alias("backend"),
    )
    from codeframes.operators.frames import with_seq

    return with_seq(rows)


def second_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading of every frame: misread code comes right, prose every other turn turns to code."""
    first = takes(spark, sf_dir)
    text = F.when(F.col("seq") % 4 == 1, F.replace("text", F.lit("retvrn"), F.lit("return"))).when(F.col("seq") % 8 == 2, F.lit("x = open('f')\nprint(x)")).otherwise(F.col("text"))
    return first.withColumn("text", text).withColumn("confidence", F.lit(0.9)).withColumn("backend", F.lit("second"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with small hashes: the events of a user are a video."""
    e = table(spark, sf_dir, "events")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    from codeframes.operators.frames import with_seq

    rows = e.select(
        F.col("user_id").cast("string").alias("video_id"), F.concat(F.lit("/f/"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("path"), ms.alias("timestamp_ms"),
        F.floor("value").cast("long").alias("phash"), "event_id", "event_type", "value",
    )
    return with_seq(rows)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes: an order is an image, its lines are boxes."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") * 20).cast("int").alias("x"), F.pmod("l_partkey", F.lit(40)).cast("int").alias("y"),
        F.lit(15).alias("width"), (5 + F.col("l_quantity").cast("long") % 7).cast("int").alias("height"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a language model: fenced, plain, cut off or empty."""
    t = takes(spark, sf_dir)
    content = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("```python\n\n"), "text", F.lit("\n```\nDone ``` here")))
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("\n"), "text", F.lit(" [?] and [?]\n\n")))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit("Sure:\n```\n  "), "text"))
        .otherwise(F.lit("  \n"))
    )
    return t.select("video_id", "seq", content.alias("content"), F.when(F.col("seq") % 3 == 0, "length").otherwise("stop").alias("finish_reason"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three backends make of the benchmark texts: one copies, one errs, one fails on some."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("truth"))
    copy = b.select(F.lit("copy").alias("backend"), "name", "truth", F.col("truth").alias("text"), F.lit(None).cast("string").alias("error"))
    errs = b.select(F.lit("errs").alias("backend"), "name", "truth", F.replace("truth", F.lit("e"), F.lit("c")).alias("text"), F.lit(None).cast("string").alias("error"))
    fails = b.select(F.lit("fails").alias("backend"), "name", "truth", F.col("truth").alias("text"), F.when(F.col("name").cast("int") % 7 == 0, F.lit("timeout")).alias("error"))
    return copy.unionByName(errs).unionByName(fails)


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings: a customer is a course, an order one lesson."""
    o = table(spark, sf_dir, "orders")
    stream = (F.col("o_orderstatus") != "P") | (F.col("o_custkey") % 2 == 0)
    return o.select(
        F.col("o_custkey").alias("course"), stream.alias("has_stream"), (stream & (F.col("o_orderkey") % 11 != 0)).alias("downloaded"),
        (1279 + F.col("o_custkey") % 2 + F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 3).otherwise(0)).cast("int").alias("width"), (719 + F.col("o_custkey") % 3).cast("int").alias("height"),
    )


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, prose and markup: takes, page sources and lines made of parts."""
    t = takes(spark, sf_dir).select(F.concat(F.lit("t"), "video_id", F.lit("_"), F.col("seq").cast("string")).alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.regexp_replace(F.coalesce("html", F.lit("")), ASCII_ONLY, "").alias("text"))
    k = F.col("p_partkey").cast("string")
    kinds = ["const a{0} = f(b{0});", "$ pip install p{0}", "select a.id from t{0} a", "select one of the {0} from it", "if x{0}:  # go", "class T{0} {{", "item(s) {0}", "  -> crop {0}", "x = = {0}", "#include <m{0}>", "for (;;) {{\n  y{0} += 1; // n\n}}", "plain words {0}"]
    text = F.lit("")
    for i, kind in enumerate(kinds):
        before, after = kind.replace("{{", "\x01").replace("}}", "\x02").split("{0}", 1)
        pieces = [before, *after.split("{0}")]
        made = F.concat(*[x for j, p in enumerate(pieces) for x in ([k] if j else []) + [F.lit(p.replace("\x01", "{").replace("\x02", "}"))]])
        text = F.when(F.col("p_partkey") % len(kinds) == i, made).otherwise(text)
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), k).alias("id"), text.alias("text"))
    return t.unionByName(pages).unionByName(parts)
