"""Text functions on columns: no Python runs per row.

Patterns carry ``(?U)`` so that word characters and white space are Unicode ones, and ``(?d)`` where a line ends
at a newline only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def timecode(ms: Column | str) -> Column:
    """Milliseconds as HH:MM:SS.mmm; hours may take more digits."""
    ms = _c(ms).cast("long")
    whole = lambda n: F.floor(ms / n)
    return F.format_string("%02d:%02d:%02d.%03d", whole(3_600_000), F.pmod(whole(60_000), F.lit(60)), F.pmod(whole(1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def normalize(text: Column | str) -> Column:
    """Right-stripped lines without blank ones at either end; blank lines inside stay."""
    unified = F.regexp_replace(_c(text), r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    stripped = F.regexp_replace(unified, r"(?:(?U:[^\S\n])|[\x1f])+(?=\n|\z)", "")
    return F.regexp_replace(stripped, r"\A\n+|\n+\z", "")


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length, in code points; 1 if both are empty."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def similar(a: Column, b: Column, threshold: float) -> Column:
    """``similarity(a, b) >= threshold``.  Lengths too different rule it out before any distance, and the distance
    stops early at the most that the threshold allows (one more, against rounding)."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    most = F.floor((1 - threshold) * longest).cast("int") + 1
    near = F.call_function("levenshtein", a, b, most)
    exact = (near >= 0) & (1.0 - near / longest >= threshold)
    return F.when(longest == 0, F.lit(True)).when(shortest + 1e-9 < threshold * longest, F.lit(False)).otherwise(exact)


def tokens(text: Column | str) -> Column:
    """Words and single other characters that aren't white space."""
    return F.regexp_extract_all(_c(text), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def token_accuracy(predicted: Column | str, truth: Column | str) -> Column:
    """Share of the truth's tokens, with repeats, that the prediction has too."""
    p, t = tokens(predicted), tokens(truth)
    shared = F.aggregate(
        F.array_distinct(t), F.lit(0), lambda acc, k: acc + F.least(F.size(F.filter(p, lambda x: x == k)), F.size(F.filter(t, lambda x: x == k)))
    )
    return F.when(F.size(t) > 0, shared / F.size(t)).when(F.size(p) > 0, F.lit(0.0)).otherwise(F.lit(1.0))


def strip_fence(content: Column | str) -> Column:
    """Inside of the first fenced block, which ends at a fence at a line's start or at the end; newlines around go."""
    content = F.coalesce(_c(content), F.lit(""))
    # Fixed value: how replies fence code.
    fence = r"(?smd)```[^\n]*\n(.*?)(?:^```|\z)"
    inside = F.when(content.rlike(fence), F.regexp_extract(content, fence, 1)).otherwise(content)
    return F.regexp_replace(inside, r"\A\n+|\n+\z", "")


def transcript_confidence(text: Column | str, finish_reason: Column | str | None = None) -> Column:
    """0.9 less 0.1 for each [?], at least 0.1, which blank text has; a cut-off reply has 0.3 at most."""
    text = _c(text)
    marks = F.floor((F.length(text) - F.length(F.replace(text, F.lit("[?]"), F.lit("")))) / 3)
    found = F.when(text.rlike(r"(?U)\S"), F.greatest(F.lit(0.1), 0.9 - 0.1 * marks)).otherwise(F.lit(0.1))
    if finish_reason is None:
        return found
    return F.when(F.coalesce(_c(finish_reason) == "length", F.lit(False)), F.least(found, F.lit(0.3))).otherwise(found)


def data_uri(path: Column | str, content: Column | str, most: int = 20 << 20) -> Column:
    """An image as a data URI; its type comes from the path, png if unknown; too large a one is an error."""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
    mime = F.lit("image/png")
    for k, v in kinds.items():
        mime = F.when(ext == k, F.lit(v)).otherwise(mime)
    plain = F.regexp_replace(F.base64(_c(content)), "[\r\n]", "")
    too_large = F.raise_error(F.concat(F.lit("image over the size limit: "), _c(path))).cast("string")
    return F.when(F.octet_length(_c(content)) > most, too_large).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), plain))


def artifact_base(path: Column | str) -> Column:
    """File name without its last extension, ``extracted`` if nothing is left."""
    name = F.regexp_extract(_c(path), r"([^/]*)/*$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("extracted"))


def url_slug(url: Column | str, default: str = "") -> Column:
    """Last path segment of a URL, other characters than letters, digits and ._- as single dashes, none at the ends."""
    path = F.regexp_replace(F.coalesce(F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("")), "/+$", "")
    segment = F.regexp_extract(path, r"([^/]*)$", 1)
    slug = F.regexp_replace(F.regexp_replace(segment, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def hms_to_seconds(hms: Column | str) -> Column:
    """h:m:s with a fraction; null unless there are three parts."""
    parts = F.split(_c(hms), ":")
    value = F.get(parts, F.lit(0)).try_cast("double") * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.get(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 3, value)


def clock(seconds: Column | str) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(_c(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def hours_minutes(seconds: Column | str) -> Column:
    s = F.floor(_c(seconds)).cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def _one_digit(n: Column, unit: int) -> Column:
    """``n / unit`` as a double, printed with one digit as its exact value rounds.

    Only where n is halfway between two tenths does the double's own error decide: 20 times the double, as a sum of
    two exact products and its rounding error, is compared with the odd number halfway."""
    tenth = unit // 10
    low = F.floor(n / tenth).cast("long")
    rest = n - low * tenth
    x = n.cast("double") / float(unit)
    total = x * 16.0 + x * 4.0
    over = (total - (low * 2 + 1).cast("double")) + (x * 4.0 - (total - x * 16.0))
    up = (rest * 2 > tenth) | ((rest * 2 == tenth) & ((over > 0) | ((over == 0) & (low % 2 == 1))))
    tenths = F.when(up, low + 1).otherwise(low)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def two_digits(x: Column | str) -> Column:
    """A double from 0 to 100 printed with two digits as its exact value rounds, halves to even.

    200 times the double, as a sum of three exact products and its rounding errors, is compared with the odd number
    halfway between two hundredths."""
    x = _c(x)
    low = F.floor(x * 100)
    a, b, c = x * 128.0, x * 64.0, x * 8.0
    ab = a + b
    whole = ab + c
    rest = (b - (ab - a)) + (c - (whole - ab))
    over = (whole - (low * 2 + 1).cast("double")) + rest
    hundredths = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def size_text(n: Column | str) -> Column:
    """Decimal units with one digit."""
    n = _c(n).cast("long")
    shown = lambda unit, name: F.concat(_one_digit(n, unit), F.lit(f" {name}"))
    return (
        F.when(n >= 10**9, shown(10**9, "GB")).when(n >= 10**6, shown(10**6, "MB")).when(n >= 10**3, shown(10**3, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def percent_done(done: Column | str, total: Column | str) -> Column:
    """Whole percent, 100 at most; null without a total."""
    return F.when(_c(total) > 0, F.least(F.lit(100), F.floor(_c(done) / _c(total) * 100).cast("int")))
