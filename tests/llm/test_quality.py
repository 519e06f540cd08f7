import re
from collections import Counter

from codeframes.llm import quality

from .helpers import empty_docs, odd_docs, odd_rows


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_against_brute_force(spark):
    got = sorted((r.doc_id, *(r[c] for c in BASE)) for r in quality.report(odd_docs(spark)).collect())
    assert got == sorted((r[0], *plain(r[1])) for r in odd_rows())


def test_repeats_on_hostile_texts(spark):
    texts = ["a a a a", "a b c a b c", "a b c b c a b", " ".join("xyz"[i * i % 3] for i in range(3000)), "q " * 5000]
    got = [r.n_repeat_words for r in quality.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [plain(t)[4] for t in texts]


def test_a_very_long_text(spark):
    words = [f"w{i % 70_001}" for i in range(150_000)]
    for k in (0, 5, 149_990):
        words[k : k + 3] = ["same", "three", "words"]
    text = " ".join(words)
    row = quality.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[c] for c in BASE) == plain(text)


def test_flags_change_no_verdict(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    lines = ["SHARE THIS page with all.", "a | b.", "a | b | c | d.", "Ok! Ok! Ok!", "Fine words here.", "Cookie Policy."]
    rows = [(i, prose + "\n" + "\n".join(lines[:i] + lines[i + 1 :])) for i in range(len(lines))]
    got = {r.doc_id: r.text.split("\n")[1:] for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = spark.createDataFrame([(x,) for x in lines], "line string")
    good = [r.line for r in one.filter(quality.line_passes(one.line)).collect()]
    assert good == ["a | b.", "Fine words here."]
    assert got == {i: [x for x in lines[:i] + lines[i + 1 :] if x in good] for i in range(len(lines))}


def test_lines_that_pass(spark):
    prose = "The quick fox ran over the hill and slept."
    lines = [prose, "Home | About | News | Contact us.", "BUY!! NOW!! CHEAP!! STUFF!!", "All rights reserved.", "no end mark here", "w*** t### s$$$ z&&&", "It ended. Then it was cut"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(quality.line_passes(df.line)).collect()]
    assert got == [True, False, False, False, False, False, True]


def test_clean_removes_lines_and_keeps_columns(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, prose + "\nHome | News | Sport | Log in.\nAll rights reserved."), (2, "\n".join(["Home | News | Sport | Log in."] * 3 + [f"w{i} | x{i} | y{i}" for i in range(40)])), (3, None)]
    docs = spark.createDataFrame([(i, t, 5, 0) for i, t in rows], "doc_id long, text string, kept int, n_chars long")
    got = quality.clean(docs).collect()
    assert [(r.doc_id, r.text, r.kept, r.n_chars) for r in got] == [(1, prose, 5, len(prose))]
    assert quality.clean(odd_docs(spark)).columns == odd_docs(spark).columns


def test_no_python_in_the_plan_and_no_documents(spark):
    df = quality.report(empty_docs(spark))
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
