"""Addresses on pages: the links of a page's source and their resolution against the page's own address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of an address (the pattern of the URI standard), schemes with relative addresses, and the named
# character references that addresses hold.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
RELATIVE = ("http", "https", "ftp", "file", "ws", "wss")
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}

_ATTRIBUTE = r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def decoded(text: Column) -> Column:
    """Character references decoded, once each."""
    named = F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair))
    digits = lambda part: F.regexp_extract(part, r"\A#([0-9]{1,7});", 1)
    hexed = lambda part: F.regexp_extract(part, r"\A#[xX]([0-9a-fA-F]{1,6});", 1)
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(part: Column) -> Column:
        rest = F.substr(part, F.locate(";", part) + 1)
        name = F.try_element_at(named, F.regexp_extract(part, r"\A([a-z]+);", 1))
        valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        number = F.coalesce(digits(part).try_cast("long"), F.conv(F.nullif(hexed(part), F.lit("")), 16, 10).cast("long"))
        return F.when(name.isNotNull(), F.concat(name, rest)).when(valid(number), F.concat(char(number), rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    joined = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(text.contains("&"), joined).otherwise(text)


def anchors(html: Column) -> Column:
    """The href of every anchor in order, quoted or not; comments, scripts and styles hold no anchors."""
    plain = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    for name in ("script", "style"):
        plain = F.regexp_replace(plain, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    inside = F.regexp_extract_all(plain, F.lit(r"""(?i)<a(\s(?:[^>"']|"[^"]*"|'[^']*')*)>"""), F.lit(1))

    def href(attributes: Column) -> Column:
        names = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(2))
        at = F.array_position(F.transform(names, F.lower), "href").cast("int")
        value = F.get(values, at - 1)
        quoted = F.left(value, F.lit(1)).isin('"', "'")
        return F.when(at > 0, decoded(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)))

    return F.filter(F.transform(inside, href), lambda h: h.isNotNull())


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def _folded(segments: Column) -> Column:
    """Segments without ``.`` and ``..``, each of which takes one back."""

    def step(stack: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(s == ".", stack).otherwise(F.array_append(stack, s))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def _path(base: Column, path: Column) -> Column:
    own = F.split(base, "/")
    folder = F.when(F.element_at(own, -1) == "", own).otherwise(F.slice(own, F.lit(1), F.size(own) - 1))
    joined = F.concat(folder, F.split(path, "/"))
    # empty segments inside a path that was put together go, its first and last stay
    inner = F.filter(joined, lambda s, i: (i == 0) | (i == F.size(joined) - 1) | (s != ""))
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(inner)
    return _let(F.array_join(_let(segments, _folded), "/"), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def resolve(base: Column, link: Column) -> Column:
    """The address that ``link`` means on the page ``base``; null if either is null."""
    clean = lambda u: F.regexp_replace(F.regexp_replace(u, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return _let(F.struct(clean(base).alias("base"), clean(link).alias("link")), lambda u: _resolved(u["base"], u["link"], base, link))


def _resolved(base: Column, link: Column, raw_base: Column, raw_link: Column) -> Column:
    scheme, own = F.lower(_part(base, 1)), F.lower(_part(link, 1))
    same = (own == "") | (own == scheme)
    host = F.when(link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]"), _part(link, 2))
    path, query, fragment = _part(link, 3), _part(link, 4), _part(link, 5)
    kept = path == ""
    full_path = F.when(host.isNotNull(), path).when(kept, _part(base, 3)).otherwise(_path(_part(base, 3), path))
    full_query = F.when(host.isNull() & kept & (query == ""), _part(base, 4)).otherwise(query)
    authority = F.coalesce(host, _part(base, 2))
    rooted = F.when((authority != "") & (full_path != "") & ~full_path.startswith("/"), F.concat(F.lit("/"), full_path)).otherwise(full_path)
    lead = F.when(authority != "", F.concat(scheme, F.lit("://"), authority)).otherwise(F.concat(scheme, F.lit(":")))
    put = lambda mark, part: F.when(part != "", F.concat(F.lit(mark), part)).otherwise(F.lit(""))
    made = F.concat(lead, rooted, put("?", full_query), put("#", fragment))
    return F.when(raw_base == "", raw_link).when(raw_link == "", raw_base).when(~same | ~scheme.isin(*RELATIVE), raw_link).otherwise(made)
