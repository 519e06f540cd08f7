"""Code-likeness of a text: seventeen signals, each counted once if it occurs.

A signal is a condition on a text, on one of its lines, or on what stands before or between certain words; the words
are lists of their own.  Weights are hundredths and sums are integers, so a score doesn't depend on the order of the
addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signals' weights in hundredths.
WEIGHTS = {
    "definition": 50, "brace_header": 30, "import": 40, "sql": 40, "control_flow": 35, "shell": 35, "tag": 30, "operator": 30, "assignment": 25,
    "typed_declaration": 25, "call": 25, "semicolon": 25, "indentation": 20, "bracket": 15, "identifier": 12, "comment": 10, "keyword": 5,
}

# The signals' words and marks.
DEFINERS = ("def", "function", "fn")
FLOW = ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "match", "case", "switch")
INSTALLERS = ("pip install", "npm install", "apt-get")
TYPES = ("const", "let", "var", "final", "static", "public", "private", "int", "float", "double", "long", "char", "bool", "boolean", "string", "auto")
KEYWORDS = ("def", "class", "import", "from", "return", "elif", "lambda", "yield", "async", "await", "const", "let", "var", "void", "struct")
PROSE = ("the", "of", "to", "please", "your", "our", "you", "this", "that", "these", "those")
OPERATORS = ("==", "!=", "<=", ">=", "=>", "->", "&&", "||", "+=", "-=", "::")
BRACKETS = ("{", "}", "[", "]")
OPENERS = ("\"", "'", "(", "[", "{")
PLURALS = ("s", "es")
SQL_GAP = 120

DEFAULT_THRESHOLD = 0.4

_MODES = "(?Ud)"  # word characters and white space are Unicode ones, lines end at newlines only


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_MODES + pattern)


def _found(text: Column, pattern: str) -> Column:
    """What the pattern's group takes, at every match."""
    return F.regexp_extract_all(text, F.lit(_MODES + pattern), F.lit(1))


def _among(found: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, words)))


def _contains(text: Column, marks: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | text.contains(m)
    return hit


def _some_line(text: Column, holds: Callable[[Column], Column]) -> Column:
    return F.exists(F.split(text, "\n"), holds)


def _either(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def _closed_by(line: Column, marks: str) -> Column:
    """A line whose last character before a comment and blanks is one of the marks."""
    return _has(line, rf"[{marks}]\s*(?:\z|#|//)")


def _definition(text: Column) -> Column:
    return _among(_found(text, r"\b(\w+)\s+\w+\s*\("), DEFINERS) | _among(_found(text, r"\b(\w+)\s+[A-Z]\w*\s*[:({]"), ("class",))


def _import(text: Column) -> Column:
    # looked ahead only, as the next line may begin inside
    one = _among(_found(text, r"(?m)^\s*(\w+)(?=\s+[.\w])"), ("import",))
    both = _among(_found(text, r"(?m)^\s*from\s+[.\w]+\s+(\w+)"), ("import",))
    return one | both | _has(text, r"#include\b")


def _sql(text: Column) -> Column:
    gaps = _found(text, rf"(?is)\bselect\b(?=(.{{0,{SQL_GAP}}}?)\bfrom\b)")
    return F.exists(gaps, lambda gap: ~_has(gap, "(?i)" + _either(PROSE)) & ~_has(gap, r"(?i)\ban?\s"))


def _control_flow(text: Column) -> Column:
    head = lambda line: F.regexp_extract(line, _MODES + r"\A\s*(\w+)", 1)
    return _some_line(text, lambda line: head(line).isin(*FLOW) & _closed_by(line, ":{"))


def _bare(line: Column) -> Column:
    """A line without the white space before it."""
    return F.regexp_replace(line, _MODES + r"\A\s+", "")


def _plain(text: Column, more: str = "") -> Column:
    """Whether a text has characters, all of them word characters or among ``more``."""
    return (text != "") & ~_has(text, rf"[^\w{more}]")


def _brace_header(text: Column) -> Column:
    """A brace that follows a closed parenthesis and has nothing behind it on its line."""
    parts = F.split(text, r"\{")

    def opens(part: Column, i: Column) -> Column:
        ends_line = part.contains("\n") | (i == F.size(parts) - 1)
        return (i > 0) & _has(F.get(parts, i - 1), r"\)\s*\z") & ends_line & ~_has(F.substring_index(part, "\n", 1), r"\S")

    return F.size(F.filter(parts, opens)) > 0


def _assignment(text: Column) -> Column:
    """A name, with its dots, quotes and brackets, alone on its line before a single ``=``."""
    parts = F.split(text, "=")

    def target(part: Column, i: Column) -> Column:
        ends = F.regexp_replace(part, _MODES + r"\s+\z", "")
        at_line_start = (i == 0) | ends.contains("\n")
        single = (i < F.size(parts) - 1) & ((F.get(parts, i + 1) != "") | (i == F.size(parts) - 2))
        return single & at_line_start & _plain(_bare(F.substring_index(ends, "\n", -1)), r""".'"\[\]""")

    return F.size(F.filter(parts, target)) > 0


def _typed_declaration(text: Column) -> Column:
    """A line whose part before ``=`` is a type and a name."""

    def declares(line: Column) -> Column:
        words = F.split(F.regexp_replace(_bare(F.substring_index(line, "=", 1)), _MODES + r"\s+\z", ""), r"(?U)\s+")
        return line.contains("=") & (F.size(words) == 2) & words[0].isin(*TYPES) & _plain(F.get(words, F.lit(1)))

    return _some_line(text, declares)


def _indentation(text: Column) -> Column:
    """A line that begins with blanks and goes on with a word, a quote or an opening bracket."""
    first = lambda line: F.left(F.ltrim(line, F.lit(" \t")), F.lit(1))
    return _some_line(text, lambda line: F.left(line, F.lit(1)).isin(" ", "\t") & (first(line).isin(*OPENERS) | _plain(first(line))))


def _shell(text: Column) -> Column:
    return _some_line(text, lambda line: _bare(line).startswith("$ ")) | _has(text, _either(INSTALLERS)) | _has(text, r"\bcargo\s+\w")


def _tag(text: Column) -> Column:
    """Something behind a ``<`` that is the rest of a tag."""
    rest = lambda part, k: (k > 0) & _has(part, r"\A/?[A-Za-z][:\w-]*(?:/?>|[ \t][^>\n]*>)")
    return F.size(F.filter(F.split(text, "<"), rest)) > 0


def _call(text: Column) -> Column:
    return F.exists(_found(text, r"\w\(([^)\n]*)\)"), lambda inside: ~F.lower(inside).isin(*PLURALS))


CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "definition": _definition,
    "brace_header": _brace_header,
    "import": _import,
    "sql": _sql,
    "control_flow": _control_flow,
    "shell": _shell,
    "tag": _tag,
    "operator": lambda text: _contains(text, OPERATORS),
    "assignment": _assignment,
    "typed_declaration": _typed_declaration,
    "call": _call,
    "semicolon": lambda text: _some_line(text, lambda line: _closed_by(line, ";")),
    "indentation": _indentation,
    "bracket": lambda text: _contains(text, BRACKETS),
    "identifier": lambda text: _has(text, r"\w[_.]\w|\b[a-z]+[A-Z]"),
    "comment": lambda text: _has(text, r"(?<!\S)(?:#|/[/*])"),
    "keyword": lambda text: _has(text, _either(KEYWORDS)),
}


def signal(text: Column | str, name: str) -> Column:
    """Whether one signal occurs."""
    return CONDITIONS[name](F.col(text) if isinstance(text, str) else text)


def hundredths(text: Column | str) -> Column:
    total = F.lit(0)
    for name, weight in WEIGHTS.items():
        total = total + F.when(signal(text, name), F.lit(weight)).otherwise(F.lit(0))
    return F.least(F.lit(100), total)


def code_score(text: Column | str) -> Column:
    """0 to 1; blank text has 0."""
    return hundredths(text) / 100.0
