"""Reading order from text boxes: pixel boxes, lines and extractions, folded inside the JVM per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "struct<y: int, x: int, ord: int, width: int, height: int, text: string>"
_LINE = f"struct<anchor: double, tall: int, items: array<{_ITEM}>>"


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A box in fractions from the bottom left as pixels from the top left: edges clamped, then rounded half-even."""
    x, y, w, h = (box[i] for i in range(4))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    edge = lambda v, size: F.rint(unit(v) * size).cast("int")
    left, right = edge(x, width), edge(x + w, width)
    top, bottom = edge(1.0 - (y + h), height), edge(1.0 - y, height)
    span = lambda a, b: F.greatest(F.lit(0), b - a)
    return F.struct(left.alias("x"), top.alias("y"), span(left, right).alias("width"), span(top, bottom).alias("height"))


def box_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest box around all boxes of each group."""
    low = boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"))
    return low.select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"))


def lines(items: Column) -> Column:
    """Boxes (y, x, ord, width, height, text) as lines from the top, each from the left.

    Top-down, a box joins the first line whose first box has its centre within half the taller height."""

    def step(found: Column, it: Column) -> Column:
        centre = it["y"] + it["height"] / 2
        near = lambda line: F.abs(centre - line["anchor"]) <= F.greatest(line["tall"], it["height"]) * 0.5
        at = F.array_position(F.transform(found, near), F.lit(True))
        joined = F.transform(found, lambda line, i: F.when(i + 1 == at, F.struct(line["anchor"].alias("anchor"), line["tall"].alias("tall"), F.concat(line["items"], F.array(it)).alias("items"))).otherwise(line))
        fresh = F.struct(centre.alias("anchor"), it["height"].alias("tall"), F.array(it).alias("items"))
        return F.when(at > 0, joined).otherwise(F.concat(found, F.array(fresh)))

    folded = F.aggregate(F.array_sort(items), F.array().cast(f"array<{_LINE}>"), step)
    keyed = F.transform(folded, lambda line, i: F.struct(F.array_min(F.transform(line["items"], lambda it: it["y"])).alias("top"), i.alias("i"), line["items"].alias("items")))
    across = lambda a, b: F.when(a["x"] != b["x"], F.signum(a["x"] - b["x"]).cast("int")).otherwise(
        F.when(a["y"] != b["y"], F.signum(a["y"] - b["y"]).cast("int")).otherwise(F.signum(a["ord"] - b["ord"]).cast("int"))
    )
    return F.transform(F.array_sort(keyed), lambda k: F.array_sort(k["items"], across))


def reading_text(lined: Column) -> Column:
    return F.array_join(F.transform(lined, lambda line: F.array_join(F.transform(line, lambda it: it["text"]), " ")), "\n")


def extractions(annotations: DataFrame, backend: str = "boxes") -> DataFrame:
    """Annotations of each image as one extraction; boxes without four numbers or a numeric confidence are skipped."""
    good = F.filter("ann", lambda a: (F.size(a["box"]) == 4) & F.forall(a["box"], lambda v: v.isNotNull()) & a["confidence"].try_cast("double").isNotNull())

    def item(a: Column, i: Column) -> Column:
        b = pixel_box(a["box"], F.col("img_width"), F.col("img_height"))
        return F.struct(b["y"].alias("y"), b["x"].alias("x"), i.alias("ord"), b["width"].alias("width"), b["height"].alias("height"), a["text"].alias("text"))

    made = annotations.withColumn("__good", good).withColumn("__lines", lines(F.transform("__good", item)))
    total = F.aggregate("__good", F.lit(0.0), lambda acc, a: acc + a["confidence"].try_cast("double"))
    boxes = F.transform(F.flatten("__lines"), lambda it: F.struct(it["x"].alias("x"), it["y"].alias("y"), it["width"].alias("width"), it["height"].alias("height")))
    return made.select(
        "video_id", "path", "timestamp_ms", reading_text(F.col("__lines")).alias("text"),
        F.when(F.size("__good") > 0, total / F.size("__good")).otherwise(F.lit(0.0)).alias("confidence"), boxes.alias("bboxes"), F.lit(backend).alias("backend"),
    )
