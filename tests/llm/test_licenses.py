"""Op 13 against a loop over words, and its plan against Python."""

import re

from codeframes.llm import licenses
from tests.llm.helpers import DOCS, empty_docs, odd_docs, odd_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    "All rights reserved. All Rights  reserved! all-rights_reserved", "cc by cc by CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "GNU General\nPublic License general public license",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "x " * 50 + MIT + " y" * 40 + " " + MIT,
    "Permission is now hereby granted, free of any charge, to any kind person obtaining a copy of this software and associated documentation files",
    "permission is hereby granted", "écc by ccé by by cc 9cc by cc by9", "of this software and associated " * 30, "ALL RIGHTS", "rights reserved all", None, "", "...",
]


def rows():
    import random

    rng = random.Random(3)
    odd = [(1000 + i, t, None, None, 0) for i, t in enumerate(TEXTS)]
    return odd_rows() + odd + [odd[0], (None, TEXTS[3], None, None, 0), (5000, sentence(rng, 20_000) + " " + MIT + " " + sentence(rng, 20_000), None, None, 0)]


def brute(doc_id, text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, base_labels, labels, score = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        want = t.words.split()
        k = 2 if len(want) <= licenses.SHORT else 3
        votes = {}
        for at in range(len(words) - k + 1):
            for pos in range(len(want) - k + 1):
                if words[at : at + k] == want[pos : pos + k]:
                    votes.setdefault(at - pos, []).append((at, pos))
        places, last = [], None
        for diagonal in sorted(votes):
            if t.base or last is None or diagonal - last > licenses.SLACK:
                places.append([])
            places[-1] += votes[diagonal]
            last = diagonal
        for hits in places:
            covered = len({pos + j for _, pos in hits for j in range(k)})
            if covered == len(want) if t.base else 100 * covered >= licenses.LEAST * len(want):
                labels.add(t.label)
                score = max(score, covered / len(want))
                if t.base:
                    base_labels.add(t.label)
                    starts.append(min(at for at, _ in hits))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return (doc_id, len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


def test_equals_the_loop(spark):
    data = rows()
    got = sorted((tuple(r) for r in licenses.report(spark.createDataFrame(data, DOCS).repartition(5)).collect()), key=repr)
    assert got == sorted((brute(r[0], r[1]) for r in data), key=repr)


def test_base_places_are_those_of_the_phrases(spark):
    """Every place of a base phrase counts, and nothing else, by a search in the joined words."""
    data = rows()
    for r in licenses.report(spark.createDataFrame(data, DOCS)).filter("doc_id >= 1000").dropDuplicates(["doc_id"]).collect():
        text = next(t for i, t, *_ in data if i == r["doc_id"])
        line = " " + " ".join(WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))) + " "
        assert r["n_base"] == sum(len(re.findall(f"(?= {t.words} )", line)) for t in licenses.TEMPLATES if t.base)


def test_changed_copies_are_found(spark):
    docs = spark.createDataFrame([(1, TEXTS[7], None, None, 0), (2, TEXTS[8], None, None, 0)], DOCS)
    told = {r["doc_id"]: r for r in licenses.report(docs).collect()}
    assert told[1]["labels"] == "mit" and 0.6 <= told[1]["score"] < 1 and told[2]["labels"] == ""
    (place,) = licenses.scan(docs).collect()
    assert (place["doc_id"], place["label"], place["start"]) == (1, "mit", 3)


def test_no_python_in_the_plan(spark):
    found = licenses.report(spark.createDataFrame(rows(), DOCS))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_columns_and_empty(spark):
    assert licenses.report(odd_docs(spark)).count() == len(odd_rows())
    assert licenses.report(empty_docs(spark)).count() == 0
