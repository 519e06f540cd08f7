"""License scans by diagonal voting, with DataFrame functions only.

A template is a phrase of a license and its label.  All rolling k-grams of words of a document (k = 2 for templates of
``SHORT`` words or fewer, else 3) are hashed; those whose hash a template has, a literal set, are kept, and joined by Spark
to the template positions that hold them, where the gram itself must be equal.  Such a pair votes for a diagonal, the
document's position less the template's.  Votes are counted by document, template and diagonal; a template's diagonals
that lie within ``SLACK`` words of the one before are one place, as words that are added or missing shift a copy's rest.
A place is a license if the template words its grams cover are at least ``LEAST`` percent of the template; base phrases
must lie on one diagonal, whole.

The first pass leaves a table with a row per document and its few hits; nothing reads the texts again.

Defined results: a null text is empty and has no words; rows that repeat a doc_id, or have none, are scanned one by one; an
empty table gives no rows; of all columns only doc_id and text are read; long texts are scanned whole, and a text that
holds a license many times costs a row a hit.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeframes.llm.common import written

LEAST = 60
SLACK = 4
#: Templates of so many words or fewer vote by pairs of words.
SHORT = 3


class Template(NamedTuple):
    label: str
    words: str
    base: bool = False


# Phrases of licenses, in lower case and without marks; the first three are the base.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
HIT = "array<struct<at: int, gram: string>>"


def words_of(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def _grams(template: Template) -> list[tuple[int, str]]:
    words = template.words.split()
    k = 2 if len(words) <= SHORT else 3
    return [(i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(gram, template, label, base, size, pos) of every template position: as many rows as the templates have words."""
    rows = [(g, t, x.label, x.base, len(x.words.split()), i) for t, x in enumerate(templates) for i, g in _grams(x)]
    return spark.createDataFrame(rows, "gram string, template int, label string, base boolean, size int, pos int")


def _hits(words: Column, spark: SparkSession, templates: tuple[Template, ...]) -> Column:
    """Positions of the words at which a gram stands whose hash some template has, with the gram."""

    def of(k: int) -> Column:
        grams = sorted({g for t in templates for _, g in _grams(t) if len(g.split()) == k})
        if not grams:
            return F.array().cast(HIT)
        gram = lambda i: [F.get(words, i + j) for j in range(k)]
        # the templates' hashes, a literal set, are the key set of the join below
        hashes = [r[0] for r in spark.createDataFrame([tuple(g.split()) for g in grams], [f"w{j}" for j in range(k)]).select(F.xxhash64("*")).collect()]
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        found = F.filter(starts, lambda i: F.xxhash64(*gram(i)).isin(hashes))
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *gram(i)).alias("gram")))

    return F.concat(of(2), of(3))


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A written row per document: key, doc_id, n_words, and its hits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), words_of(text).alias("words"))
    found = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.size("words").cast("long").alias("n_words"), _hits(F.col("words"), docs.sparkSession, templates).alias("hits"))
    return written(found, "license-hits")


def places(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(key, template, label, base, start, stop, covered, size) of every verified place, by votes for diagonals."""
    hit = found.filter(F.size("hits") > 0).select("key", F.explode("hits").alias("hit"))
    grams = F.broadcast(template_grams(found.sparkSession, templates))  # as long as the templates
    votes = hit.select("key", F.col("hit.at").alias("at"), F.col("hit.gram").alias("gram")).join(grams, "gram")
    span = F.size(F.split("gram", " "))
    near = votes.groupBy("key", "template", "label", "base", "size", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.min("at").alias("start"),
        F.max(F.col("at") + span).alias("stop"),
        F.collect_set(F.struct("pos", span.alias("span"))).alias("grams"),
    )
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    numbered = near.withColumn("apart", apart.cast("int")).withColumn("place", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("key", "template", "label", "base", "size", "place").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("grams", lambda g: F.sequence(g["pos"], g["pos"] + g["span"] - 1)))))
    told = merged.select("key", "template", "label", "base", "size", "start", "stop", covered.alias("covered"))
    return told.filter(F.when(F.col("base"), F.col("covered") == F.col("size")).otherwise(100 * F.col("covered") >= LEAST * F.col("size")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, label, start, stop, score) of every place; words from 0, stop exclusive."""
    found = hits(docs, templates)
    rows = places(found, templates).join(found.select("key", "doc_id"), "key")
    return rows.select("doc_id", "label", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), (F.col("covered") / F.col("size")).alias("score"))


def report(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    found = hits(docs, templates)
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = places(found, templates).groupBy("key").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max(F.col("covered") / F.col("size")).alias("score"),
    )
    zero = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    return found.join(told, "key", "left").select(
        "doc_id", "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0)
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The report as SQL, of which the templates are a list of rows."""
    values = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, '{t.words}')" for k, t in enumerate(templates))
    return rf"""
WITH t(template, label, base, phrase) AS (VALUES {values}),
tw AS (SELECT template, label, base, string_split(phrase, ' ') AS ws, CASE WHEN len(string_split(phrase, ' ')) <= {SHORT} THEN 2 ELSE 3 END AS k FROM t),
tg AS (SELECT template, label, base, len(ws) AS size, k, pos, array_to_string(ws[pos + 1:pos + k], ' ') AS gram
       FROM (SELECT *, unnest(range(0, len(ws) - k + 1)) AS pos FROM tw)),
d AS (SELECT row_number() OVER () AS key, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT key, spot, k, array_to_string(ws[spot + 1:spot + k], ' ') AS gram
      FROM (SELECT key, ws, k, unnest(range(0, len(ws) - k + 1)) AS spot FROM d, (VALUES (2), (3)) v(k))),
v AS (SELECT DISTINCT key, template, label, base, size, g.k, spot - pos AS diagonal, pos, spot FROM g JOIN tg ON g.gram = tg.gram AND g.k = tg.k),
dg AS (SELECT DISTINCT key, template, base, diagonal FROM v),
mk AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY key, template ORDER BY diagonal) > {SLACK}, true) THEN 1 ELSE 0 END AS apart FROM dg),
pl AS (SELECT *, sum(apart) OVER (PARTITION BY key, template ORDER BY diagonal) AS place FROM mk),
cv AS (SELECT v.key, v.template, label, v.base, size, place, spot, unnest(range(pos, pos + k)) AS w FROM v JOIN pl USING (key, template, diagonal)),
sp AS (SELECT key, template, label, base, size, place, min(spot) AS start, count(DISTINCT w) AS covered FROM cv GROUP BY ALL),
ok AS (SELECT * FROM sp WHERE CASE WHEN base THEN covered = size ELSE 100 * covered >= {LEAST} * size END),
r AS (SELECT key, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(CAST(covered AS DOUBLE) / size) AS score FROM ok GROUP BY key)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (key)
"""


ORACLE = oracle()
