"""Line-first cleaning with DataFrame functions only.

Every line is judged by itself; failing lines are removed; then a document goes if too much of it was removed.
A line fails if it
  * neither ends in closing punctuation nor holds the end of a sentence, or carries a shouting or symbol mark
    for at least every second word,
  * is navigation: two or more separators, one for at most five words,
  * is boilerplate: it holds one of ``BOILERPLATE`` (letters in either case).
A document is kept if it passes the base limits and its passing lines hold at least ``MIN_LEFT`` percent of the
characters of all its lines that have a word.

Repeated three-word windows are found without a shuffle, and only where some hash of a window repeats: windows are then
sorted by hash and words, so that equal ones are neighbours, whatever collides.

Defined results: a null text counts as empty (no words, base_failed); rows that repeat a doc_id, or have none, are judged
row by row; an empty table gives no rows; all other columns pass through untouched, whatever their names; texts of any
length take the same path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeframes.llm.common import ASCII_SPACE, let

BLANKS = " \t\n\x0b\f\r"
MIN_WORDS = 50
MAX_REPEATED = 50
MIN_LEFT = 50

# Fixed values of the rules.
CLOSING = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")
SENTENCE_END = "[.!?…][\\x20\\x09-\\x0D]"
MARKS = "[!#*$%&<>]"
SEPARATORS = "[|»›•·>]"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "copyright (c)", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "subscribe to our",
    "click here", "share this", "skip to content",
)

_P = "__line_first_"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{ASCII_SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{ASCII_SPACE}]")


def line_passes(line: Column, boiler: Column | bool = True, separated: Column | bool = True, marked: Column | bool = True) -> Column:
    """Whether a line that has a word passes all rules; the flags tell whether its text holds any boilerplate, separator
    or mark at all, and so whether the line must be searched for them."""
    boiler, separated, marked = (F.lit(x) if isinstance(x, bool) else x for x in (boiler, separated, marked))
    trimmed = F.btrim(line, F.lit(BLANKS))
    words = F.size(F.split(trimmed, f"[{ASCII_SPACE}]+"))
    count = lambda cls: F.length(line) - F.length(F.regexp_replace(line, cls, ""))
    few = let(count(SEPARATORS), lambda n: (n < 2) | (n * 5 < words))
    return (
        (F.right(trimmed, F.lit(1)).isin(*CLOSING) | trimmed.rlike(SENTENCE_END))
        & (~marked | (count(MARKS) * 2 < words))
        & (~separated | few)
        & (~boiler | ~let(F.lower(line), _holds_boilerplate))
    )


def _holds_boilerplate(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def _covered(words: Column, windows: Column) -> Column:
    """Number of words in windows that occur twice or more."""
    row = lambda h, i: F.struct(h.alias("h"), words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))

    def repeats(rows: Column) -> Column:
        def twin(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        hit = F.filter(rows, lambda x, k: ((k > 0) & twin(F.get(rows, k - 1), x)) | ((k + 1 < F.size(rows)) & twin(x, F.get(rows, k + 1))))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(F.transform(windows, row)), repeats))


def assess(docs: DataFrame) -> DataFrame:
    """``row`` (the input row as a struct), the base numbers, ``base_failed``, ``kept``, and ``cleaned`` text."""
    c = lambda name: F.col(_P + name)
    one = docs.select(F.struct("*").alias(_P + "row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(_P + "text"))
    two = one.select("*", _words(c("text")).alias(_P + "words"), F.filter(F.split(c("text"), "\n"), _has_word).alias(_P + "lines"))
    n = F.size(c("words"))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(c("words")[i], c("words")[i + 1], c("words")[i + 2]))).otherwise(
        F.array().cast("array<bigint>")
    )
    flags = two.select(
        "*",
        _holds_boilerplate(F.lower(c("text"))).alias(_P + "boiler"),
        c("text").rlike(SEPARATORS).alias(_P + "separated"),
        c("text").rlike(MARKS).alias(_P + "marked"),
    )
    passing = F.filter(c("lines"), lambda line: line_passes(line, c("boiler"), c("separated"), c("marked")))
    four = flags.select("*", windows.alias(_P + "windows"), passing.alias(_P + "passing"))
    text_chars = lambda lines: F.length(F.array_join(lines, ""))
    five = four.select(
        c("row").alias("row"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(c("words"), "")).cast("long").alias("word_chars"),
        (F.length(c("text")) - F.length(F.regexp_replace(c("text"), "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias("n_dup_lines"),
        _covered(c("words"), c("windows")).cast("long").alias("n_repeat_words"),
        text_chars(c("lines")).cast("long").alias("line_chars"),
        text_chars(c("passing")).cast("long").alias("left_chars"),
        F.array_join(c("passing"), "\n").alias("cleaned"),
        F.monotonically_increasing_id().alias("barrier"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return five.select("*", failed.alias("base_failed"), (~failed & (100 * F.col("left_chars") >= MIN_LEFT * F.col("line_chars"))).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return assess(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows with their failing lines removed; n_chars, where there is one, follows the text."""
    # the barrier, not being deterministic, stops Catalyst from pushing the filter below the arrays, where it
    # would compute them anew for every element
    kept = assess(docs).filter(F.col("kept") & (F.col("barrier") >= 0))
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return kept.select(*(changed.get(name, F.col("row").getField(name)).alias(name) for name in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
q AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, ls,
             list_filter(ls, lambda l:
               (regexp_matches(l, '[.!?…][\x20\x09-\x0D]+[^\x20\x09-\x0D]')
                OR list_contains(['.', '!', '?', '…', ':', ';', '"', '''', '”', '’', '»', ')', ']', '。', '！', '？'], right(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), 1)))
               AND 2 * (length(l) - length(regexp_replace(l, '[!#*$%&<>]', '', 'g'))) < len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
               AND NOT (length(l) - length(regexp_replace(l, '[|»›•·>]', '', 'g')) >= 2
                        AND 5 * (length(l) - length(regexp_replace(l, '[|»›•·>]', '', 'g'))) >= len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
               AND NOT regexp_matches(lower(l), 'all rights reserved|licensed under|released under the|copyright \(c\)|terms of use|terms of service|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|subscribe to our|click here|share this|skip to content')
             ) AS ps FROM w),
b AS (SELECT q.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed
      FROM q LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * length(array_to_string(ps, '')) >= 50 * length(array_to_string(ls, '')) AS kept
FROM b
"""
