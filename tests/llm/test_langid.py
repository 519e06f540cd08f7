import random
import zlib

import numpy as np

from codeframes.llm import langid

from .helpers import empty_docs, odd_docs, odd_rows, sentence

STEMS = {"xx": ("ba", "do", "ki"), "yy": ("lu", "me", "no"), "zz": ("ra", "si", "tuß")}


def corpus(n=90):
    rng = random.Random(1)
    return [(i, sentence(rng, 80, STEMS[lang]), lang) for i, lang in ((i, sorted(STEMS)[i % 3]) for i in range(n))]


def longest_match_phrases(train: list[int], text: list[int], block: int) -> int:
    """Cross-parsing by substring search; an unseen symbol is a phrase of its own start."""
    hay, count = bytes(train), 0
    for b in range(0, len(text), block):
        part, i, first = bytes(text[b : b + block]), 0, True
        count += 1
        while i < len(part):
            j = i
            while j < len(part) and part[i : j + 1] in hay:
                j += 1
            if j == i:  # unseen: the automaton stays at its root, which a phrase ends at
                count += 1
                j = i + 1
                if j < len(part) and part[j : j + 1] in hay:
                    pass
            elif j < len(part):
                if part[j : j + 1] in hay:
                    count += 1
            i, first = j, False
    return count


def test_phrase_counts_are_those_of_longest_matches():
    rng = random.Random(3)
    texts = {"xx": sentence(rng, 300, STEMS["xx"]), "yy": sentence(rng, 300, STEMS["yy"])}
    model = langid.Model({k: [t] for k, t in texts.items()})
    docs = [model.encode(sentence(rng, n, STEMS[k])) for n, k in ((1, "xx"), (40, "yy"), (900, "xx"))]
    got = model.phrases(docs)
    for d, row in zip(docs, got, strict=True):
        for k, lang in enumerate(model.langs):
            train = model.encode(texts[lang].lower()).tolist()
            assert row[k] == longest_match_phrases(train, d.tolist(), langid.BLOCK)


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(8)
    for size in (5, 400):
        s = [rng.randrange(1, size) for _ in range(300)]
        nexts = langid.suffix_automaton(s)
        automaton = langid.Automaton(nexts, size)
        every = np.arange(size)
        for state, row in enumerate(nexts):
            to, ends = automaton.step(np.full(size, state), every)
            assert {k: int(to[k]) for k in every.tolist() if not ends[k]} == row
            assert all(to[k] == nexts[0].get(k, 0) for k in every.tolist() if ends[k])
        for a in range(0, len(s), 7):
            state = 0
            for x in s[a : a + 40]:
                state = nexts[state][x]


ALPHABETS = {
    "el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "th": "กขคงจฉชซญดตถทธนบปผพฟมยรลวศสหอ", "ko": "".join(map(chr, range(0xAC00, 0xAE00))), "zh": "".join(map(chr, range(0x4E00, 0x5400))), "en": "abcdefghijklmnopqrstuvwxyz",
    "de": "abcdefghijklmnopqrstuvwxyzäöüß", "ja": "".join(map(chr, range(0x3041, 0x3097))) + "".join(map(chr, range(0x5000, 0x5300))),
}


def test_many_scripts():
    rng = random.Random(11)
    stems = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(120)] for k, v in ALPHABETS.items()}
    text = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(n))
    model = langid.Model({k: [text(k, 400) for _ in range(4)] for k in ALPHABETS})
    tests = [(k, text(k, 60)) for k in ALPHABETS for _ in range(5)]
    assert model.predict([t for _, t in tests])[0] == [k for k, _ in tests]


def plain_prediction(model, train, text):
    """Longest matches by substring search, block by block; the smallest rate wins."""
    symbols = model.encode(text).tolist()
    rates = []
    for lang in model.langs:
        n = len(model.encode(" ".join(train[lang]).lower()))
        rates.append(longest_match_phrases(model.encode(" ".join(train[lang]).lower()).tolist(), symbols, langid.BLOCK) * np.log2(n) / len(symbols))
    return model.langs[int(np.argmin(rates))], rates


def test_whole_identification_against_substring_search(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            train.setdefault(lang, []).append(text)
    model = langid.fit(docs)
    train = {k: v for k, v in train.items()}
    for r in langid.identify(docs.limit(12)).collect():
        assert r.lang_pred in train
    for i, text, _ in rows[:12]:
        lang, rates = plain_prediction(model, train, text)
        assert model.predict([text])[0] == [lang]
    tie = langid.Model({"bb": ["same text"], "aa": ["same text"]})
    assert tie.predict(["same", "other"])[0] == ["aa", "aa"] and tie.predict(["same"])[1][0] == 0.5


def test_the_filter_rejects_only_texts_without_letters(spark):
    rows = [*corpus(30), (500, "12 34", "xx"), (501, None, "xx"), (502, "漢字", "xx")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [*range(30), 502]


def test_the_filter_tells_the_language_it_found(spark):
    rows = [(i, text, lang if zlib.crc32(str(i).encode()) % 5 else (None, "yy")[i % 2], 1) for i, text, lang in corpus()]  # held out: no label, or a wrong one
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, Lang string, score int"))
    assert kept.columns == ["doc_id", "text", "Lang", "score"]
    assert {(r.doc_id, r.text, r.Lang, r.score) for r in kept.collect()} == {(i, text, lang, 1) for i, text, lang in corpus()}


def test_held_out_accuracy_and_contract(spark):
    docs = spark.createDataFrame([(*r, "row") for r in corpus()], "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: lang for i, _, lang in corpus()}
    assert all(r.lang_pred == truth[r.doc_id] for r in got) and all(0 <= r.score <= 1 for r in got)


def test_odd_inputs(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, text, *_ in odd_rows():
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].lang_pred in ("en", "fr")
    assert langid.identify(docs).count() == docs.count()
    assert langid.keep_identified(docs).columns == docs.columns
    assert langid.identify(empty_docs(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_a_long_text_counts_to_its_end():
    rng = random.Random(5)
    texts = {k: sentence(rng, 400, v) for k, v in STEMS.items()}
    model = langid.Model({k: [t] for k, t in texts.items()})
    text = sentence(rng, 50, STEMS["xx"]) + " " + sentence(rng, 3000, STEMS["yy"])
    assert model.predict([text, None, "12 34"])[0] == ["yy", "und", "und"]
    assert np.isfinite(model.predict([text])[1]).all()
