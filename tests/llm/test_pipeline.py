"""The pipeline's stages over a small corpus, and where nothing is left."""

import shutil

import pytest

from .helpers import CLASHING, empty_docs, odd_docs, save, sentence

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402


def test_stages_keep_columns_and_decide(spark, tmp_path):
    import random

    rng = random.Random(9)
    clean = sentence(rng, 200)
    rows = [(1, clean, "en"), (2, clean, "en"), (3, clean + " token=abcdef99", "en"), (4, sentence(rng, 90), "en"), (5, "a | b | c | d " * 30, "en"), (6, "1 2 3. " * 60, "en"), (7, None, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        path = str(tmp_path / name)
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = sorted(r.doc_id for r in now.collect())
    assert seen["quality_rules"] == [1, 2, 3, 4] and seen["language_id"] == [1, 2, 3, 4]
    assert seen["near_dedup"] in ([1, 4], [1, 3, 4])
    packed = cp.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in packed.collect()}) == seen["near_dedup"]
    shutil.rmtree(tmp_path)


def test_odd_and_empty_documents_pass_every_stage(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        cp.STAGES[-1][1](spark, docs, "").count()


def test_sequences_hold_one_language_as_identified(spark, tmp_path):
    import zlib

    from .test_langid import corpus

    truth = {i: lang for i, _, lang in corpus()}
    rows = [(i, text, lang if zlib.crc32(str(i).encode()) % 5 else (None, "yy")[i % 2], "s", len(text)) for i, text, lang in corpus()]  # held out: no label, or a wrong one
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    held, got = {}, cp.run(spark, str(tmp_path)).collect()
    for r in got:
        held.setdefault(r.sequence_id, []).append(truth[r.doc_id])
    assert {r.doc_id for r in got} == set(truth) and all(len(set(v)) == 1 for v in held.values())
    assert max(map(len, held.values())) > 1


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "language_id", "near_dedup", "secret_scan", "best_fit_packing"]
    assert CLASHING and save


def plain_clean(text):
    """The text without failing lines, or None if the document goes."""
    import re

    from codeframes.llm import quality

    from .test_quality import plain

    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def passes(line):
        trimmed = line.strip(quality.BLANKS)
        words = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        separators = len(re.findall(quality.SEPARATORS, line))
        return (
            (trimmed[-1] in quality.CLOSING or bool(re.search(r"[.!?…][\x20\x09-\x0D]", trimmed)))
            and 2 * len(re.findall(quality.MARKS, line)) < words
            and not (separators >= 2 and 5 * separators >= words)
            and not any(p in line.lower() for p in quality.BOILERPLATE)
        )

    left = [x for x in lines if passes(x)]
    if plain(text)[5] or 2 * sum(map(len, left)) < sum(map(len, lines)):
        return None
    return "\n".join(left)


def plain_mask(text):
    from codeframes.llm.secret_scan import MASK

    from .test_secret_scan import plain

    out, at = "", 0
    for start, _, end, _ in plain(text):
        if start >= at:
            out += text[at:start] + MASK
        at = max(at, end)
    return out + text[at:]


def test_the_whole_run_against_plain_stages(spark, tmp_path):
    """Every stage once more, document by document, on a corpus with copies, hot passages, repeated and missing ids."""
    import random
    import zlib

    import numpy as np

    from .test_simhash import plain_components, plain_fingerprint
    from .test_tokenizers import BYTE, check_sequences, plain

    rng = random.Random(31)
    passage = sentence(rng, 40)
    bodies = [sentence(rng, rng.choice([60, 90, 300])) + "\n" + passage for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(bodies)]
    rows += [(100 + i, bodies[0] if i % 2 else bodies[0] + " ") for i in range(30)]  # copies
    rows += [(200, bodies[1] + "\nHome | News | Sport | Log in."), (201, bodies[2] + "\ntoken=abcdef123 and " + "0" * 30 + "."), (202, "1 2 3. " * 60), (203, None), (204, ""), (205, "too short."), (206, "a b c " * 90 + ".")]
    rows += [(None, sentence(rng, 80)), (None, sentence(rng, 85)), (7, sentence(rng, 95)), (207, sentence(rng, 30_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))

    kept = [(i, t) for i, t in ((i, plain_clean(t)) for i, t in rows) if t is not None and any(c.isalpha() for c in t)]
    numbers = list(range(len(kept)))
    groups: dict[int, list] = {}
    for k, g in zip(numbers, plain_components(numbers, [plain_fingerprint(t) for _, t in kept]), strict=True):
        groups.setdefault(g, []).append(kept[k])
    got = cp.run(spark, str(tmp_path)).collect()
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got])
    ids_of, want, pieces = plain(BYTE), [], {}
    for r in got:
        pieces.setdefault((r.doc_id, r.ids_crc32, r.piece, r.start, r.length), []).append(r)
    from codeframes.llm.packing import piece_bounds

    def rows_of(i, text):
        ids = np.array([*ids_of(plain_mask(text)), 0], "<u4")
        return [(i, zlib.crc32(ids[s : s + n].tobytes()), k, s, n) for k, (s, n) in enumerate(piece_bounds(len(ids)))]

    for members in groups.values():
        least = min((i is None, i or 0) for i, _ in members)
        choices = [(i, t) for i, t in members if (i is None, i or 0) == least]
        stays = [c for c in choices if all(p in pieces for p in rows_of(*c))]
        assert stays, members  # one of the group with the smallest id, as a whole
        want += rows_of(*stays[0])
    assert sorted(want, key=str) == sorted((p for p, rs in pieces.items() for _ in rs), key=str)
    assert len(groups) > 40 and any(p[2] > 5 for p in pieces)
