"""Exact similarity join of texts: which texts are at most a share of edits apart.

Equal texts become one class first.  Each class is cut into segments, so many that a similar text must hold some of them
unchanged (``distance.segments``), and meets the windows of all texts that aren't shorter; pairs that share enough
segments near their own place are measured by the engine's bounded edit distance.  Texts too short for segments
are met by length.  No pair is lost: the segments only rule pairs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeframes.functions.text import similar

#: Below this the segments of a text would be single characters.
LEAST_THRESHOLD = 0.75


def _most(longest: Column, threshold: float) -> Column:
    return F.least(longest, F.floor((1 - threshold) * longest + 1e-9).cast("int"))


def _plan(length: Column, threshold: float) -> Column:
    """For texts of a length: the most edits to any text that isn't shorter, the segments needed, and their number."""
    k = _most(F.floor(length / threshold + 1e-9).cast("int"), threshold)
    need = (k / 4).cast("int") + 1
    count = F.when((k + need > (length / 2).cast("int")) & ~((k == 0) & (length > 0)), F.lit(0)).otherwise(k + need)
    return F.struct(k.alias("k"), need.alias("need"), count.alias("count"))


def _lengths(length: Column, threshold: float) -> Column:
    """Lengths of texts that aren't longer and can be similar."""
    return F.sequence(F.ceil(length * threshold - 1e-9).cast("int"), length)


def links(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of similar classes, once each, from distinct ``texts`` (class_id, text)."""
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must lie between {LEAST_THRESHOLD} and 1, not {threshold}")
    sized = texts.select("class_id", "text", F.length("text").alias("n"))
    planned = sized.withColumn("plan", _plan(F.col("n"), threshold))
    size, longer = F.floor(F.col("n") / F.col("plan.count")).cast("int"), F.col("n") % F.col("plan.count")
    start = lambda i: i * size + F.least(i, longer)
    cut = F.transform(F.sequence(F.lit(0), F.col("plan.count") - 1), lambda i: F.struct(i.alias("i"), start(i).alias("at"), F.substring(F.col("text"), start(i) + 1, size + (i < longer).cast("int")).alias("part")))
    segments = planned.filter(F.col("plan.count") > 0).select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "plan.k", "plan.need", F.explode(cut).alias("s"))
    segments = segments.select("a", "n_a", "k", "need", "s.i", F.col("s.at").alias("at_a"), F.xxhash64("s.part").alias("part"))

    def windows_of(length: Column) -> Column:
        plan = _plan(length, threshold)
        return F.array(F.floor(length / plan["count"]).cast("int"), F.ceil(length / plan["count"]).cast("int"))

    some = F.filter(_lengths(F.col("n"), threshold), lambda n: _plan(n, threshold)["count"] > 0)
    sizes = F.array_distinct(F.flatten(F.transform(some, windows_of)))
    spots = sized.select("class_id", "text", "n", F.explode(sizes).alias("size")).filter(F.col("size") <= F.col("n"))
    window = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: F.struct(i.alias("at"), F.xxhash64(F.substring(F.col("text"), i + 1, F.col("size"))).alias("part")))
    windows = spots.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.explode(window).alias("w")).select("b", "n_b", F.col("w.at").alias("at_b"), F.col("w.part").alias("part"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    shared = segments.join(windows, "part").filter(ordered & (F.col("n_a") + 1e-9 >= threshold * F.col("n_b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= F.col("k")))
    near = shared.select("a", "b", "need", "i").distinct().groupBy("a", "b", "need").count().filter(F.col("count") >= F.col("need")).select("a", "b")
    # texts too short for segments meet by length
    short = planned.filter(F.col("plan.count") == 0).select(F.col("class_id").alias("a"), F.col("n").alias("n_a"))
    few = sized.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.explode(F.filter(_lengths(F.col("n"), threshold), lambda n: _plan(n, threshold)["count"] == 0)).alias("n_a"))
    small = short.join(few, "n_a").filter(ordered).select("a", "b")
    own = lambda side: texts.select(F.col("class_id").alias(side), F.col("text").alias(f"text_{side}"))
    pairs = near.unionByName(small).join(own("a"), "a").join(own("b"), "b")
    return pairs.filter(similar(F.col("text_a"), F.col("text_b"), threshold)).select("a", "b")


def similarity_join(rows: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``rows`` with ``class_id``, the least ``key`` among equal texts, and ``n_links``, the number of other classes whose text
    is similar.

    Defined results: a null text counts as empty; of rows that repeat a key each keeps its own text's class; a class whose
    keys are all null has a null class_id, and its links count; an empty table gives no rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    classes = rows.groupBy(body.alias("__text")).agg(F.min(key).alias("class_id"))
    # a key can be the least of several texts: classes are told apart by their text
    texts = classes.select(F.sha2("__text", 256).alias("class_id"), F.col("__text").alias("text"))
    found = links(texts, threshold)
    ends = found.select(F.explode(F.array("a", "b")).alias("__class"))
    counted = ends.groupBy("__class").agg(F.count(F.lit(1)).alias("n_links"))
    told = classes.join(counted, F.sha2("__text", 256) == F.col("__class"), "left").select("__text", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.withColumn("__body", body).join(told, F.col("__body") == F.col("__text")).drop("__body", "__text")
