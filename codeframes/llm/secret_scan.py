"""Secret scanning over a content-addressed ledger, with DataFrame functions only.

Every version of a file is a path and a text; its blob is the SHA-256 of the text.  The ledger holds what each
(blob, rule version) pair was found to contain, also where that is nothing.  A scan hashes all versions, takes
one version of each blob that the ledger lacks under the current rules, scans only those, extends the ledger,
and joins findings back to every path.  The join back is on the blob; only blobs with findings take part, and
Spark splits a blob that a third of the paths share.

A ledger is kept as a table at a path of its own (``Ledger``): a later scan of the same and of new versions reads it,
scans what is new, and adds that.

Spans are code points, end exclusive.  Where a rule matches, its matches are marked off in the text in one pass,
and the lengths of the parts between the marks add up to the positions, block by block (``running``).

Defined results: a null text is an empty blob; rows that repeat a path and text give a row each; rows that
repeat a path with another text are versions of it; a null path is a path like others; an empty table gives no rows and
extends the ledger by none; extra columns are not read, and ``redact`` passes them through, whatever their names; long
texts are scanned whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframes.llm.common import let, written


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int
    least: int


# A private key runs through its END line.  Where that is missing it runs to the end of the base64 lines, whose
# breaks may be escaped, quoted or, for long pieces, blanks; headers may come before them.
_BREAK = r"""(?:[\t\x20"'+,;>|#*]*+(?:[\r\n]|\\+[nr]))++[\t\x20"'>|#*]*+"""
_LINE = _BREAK + r"""(?:[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={0,2}+(?=[\t\x20]*+(?:[\r\n"'\\<]|\z)))"""
_PIECE = r"""[\t\x20]*+[A-Za-z0-9+/]{16,}+={0,2}+(?:[\t\x20]++[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\s"'\\<]|\z))?+"""
_HEADER = _BREAK + r"[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+"
_PEM = (
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"(?:(?:[^-]|-(?!----))*+-{{5,}}END (?:[A-Z]+ )*PRIVATE KEY-----|(?:{_HEADER})*+(?:{_LINE}|{_PIECE})++)?"
)

# The first three rules are the base, the others are added by this module.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", _PEM, 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++://[^\s/:@]++:[^\s/:@]++@", 0, 1),
)
BASE = 3
RULE_VERSION = "5"
MASK = "[REDACTED]"
#: Marks matches off; a character of its own kind stands for it where a text has it, which no rule tells apart.
_EDGE, _OTHER = "\ue000", "\ue001"

LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<start: int, rank: int, end: int, kind: string>>"
_EMPTY = "array<struct<start: int, rank: int, end: int, kind: string>>"


def running(values: Column, join, zero) -> Column:
    """``join`` of all values up to each place.  An array grows by copies, so values go in blocks of the cube root of their
    number: the work grows with the power 4/3 of it, however many there are."""
    return let(values, lambda v: _running(v, join, zero))


def _running(values: Column, join, zero) -> Column:
    size = F.greatest(F.ceil(F.cbrt(2 * F.size(values))).cast("int"), F.lit(1))

    def over(part: Column) -> Column:
        none = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("all"))

        def step(acc: Column, v: Column) -> Column:
            at = join(acc["at"], v)
            return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

        return F.aggregate(part, none, step)

    def joined(blocks: Column) -> Column:
        ends = over(F.transform(blocks, lambda b: b["at"]))["all"]

        def shifted(ends: Column) -> Column:
            before = lambda k: F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(zero))
            return F.flatten(F.transform(blocks, lambda b, k: F.transform(b["all"], lambda v: join(before(k), v))))

        return let(ends, shifted)

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / size).cast("int")), lambda k: over(F.slice(values, k * size + 1, size)))
    return F.when(F.size(values) > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))


def _spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches whose value is long enough."""
    value = f"${rule.group}"
    marked = F.regexp_replace(F.translate(text, _EDGE, _OTHER), F.lit(rule.pattern), F.lit(f"{_EDGE}$0{_EDGE}{value}{_EDGE}"))
    # lengths of a part before a match, the match, its value, the next part before a match, and so on
    sizes = F.transform(F.split(marked, _EDGE, -1), F.length)

    def found(sizes: Column) -> Column:
        places = F.sequence(F.lit(0), ((F.size(sizes) - 1) / 3).cast("int") - 1)
        ends = running(F.transform(places, lambda i: sizes[i * 3] + sizes[i * 3 + 1]), lambda a, b: a + b, 0)

        def span(end: Column, i: Column) -> Column:
            made = F.struct((end - sizes[i * 3 + 1]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            return F.when(sizes[i * 3 + 2] >= rule.least, made)

        return F.filter(F.transform(ends, span), lambda s: s.isNotNull())

    none = F.array().cast(_EMPTY)
    return F.when(text.rlike(rule.pattern), let(sizes, found)).otherwise(none)


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then rule; built only where some rule matches."""
    return F.array_sort(F.concat(*(_spans_of(text, rule, k) for k, rule in enumerate(rules))))


def _versions(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))


class Ledger:
    """A ledger as a table at ``path``, which every run that adds to it extends by files of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All rows; none while the table doesn't exist."""
        try:
            return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER_SCHEMA)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def extend_ledger(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Rows for the blobs of ``paths`` (path, blob of every version) that ``ledger`` lacks under ``version``.

    The versions that are due are a written list, by whose size Spark broadcasts it (few new versions: no text moves)
    or moves list and texts by path and blob."""
    firsts = paths.groupBy("blob").agg(F.min("path").alias("first"))
    if ledger is not None:
        firsts = firsts.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    due = written(firsts.select(F.col("first").alias("p"), F.col("blob").alias("b")), "secret-due")
    one = _versions(docs).join(due, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    return one.select("blob", F.lit(version).alias("rule_version"), spans(F.col("text"), rules).alias("spans")).dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: DataFrame | Ledger | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) of every version, and the ledger with what was new; both rest on written tables.

    A ``Ledger`` is extended in place."""
    known = ledger.read() if isinstance(ledger, Ledger) else ledger
    paths = written(_versions(docs).select("path", "blob"), "secret-paths")
    new = written(extend_ledger(docs, paths, known, rules, version), "secret-ledger")
    if isinstance(ledger, Ledger):
        ledger.add(new)
        full = ledger.read()
    else:
        full = new if known is None else known.unionByName(new)
    hits = full.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    found = paths.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(_EMPTY)).alias("spans"))
    return found, full


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    found, _ = scan(docs, ledger)
    base = F.filter("spans", lambda s: s["rank"] < BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *(count(r.kind) for r in RULES[:BASE]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def masked(text: Column, found: Column) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``MASK``.

    Parts are cut from the text as four bytes a character, where a place is reached without counting characters."""
    part = lambda wide, start, stop: F.decode(F.substring(wide, start * 4 + 1, (stop - start) * 4), "UTF-32")

    def cover(wide: Column, reach: Column) -> Column:
        # as far as the spans before reach
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
        lone = F.transform(found, lambda s, i: F.when(s["start"] >= before(i), F.concat(part(wide, before(i), s["start"]), F.lit(MASK))))
        rest = part(wide, F.element_at(reach, -1), (F.octet_length(wide) / 4).cast("int"))
        return F.concat(F.array_join(F.filter(lone, lambda x: x.isNotNull()), ""), rest)

    reach = running(F.transform(found, lambda s: s["end"]), F.greatest, 0)
    both = F.struct(F.encode(text, "UTF-32").alias("wide"), reach.alias("reach"))
    return F.when(F.size(found) > 0, let(both, lambda b: cover(b["wide"], b["reach"]))).otherwise(text)


def redact(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """All rows, secrets masked; n_chars, where there is one, follows the text."""
    _, full = scan(docs, ledger)
    hits = full.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select(F.col("blob").alias("__hit_blob"), F.col("spans").alias("__hit_spans"))
    blob = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct("*").alias("__row"), blob.alias("__blob")).join(hits, F.col("__blob") == F.col("__hit_blob"), "left")
    text = F.when(F.col("__hit_spans").isNotNull(), masked(F.col("__row.text"), F.col("__hit_spans"))).otherwise(F.col("__row.text"))
    made = rows.select("__row", text.alias("__text"))
    changed = {"text": F.col("__text"), "n_chars": F.coalesce(F.length("__text").cast("long"), F.lit(0))}
    return made.select(*(changed.get(n, F.col("__row").getField(n)).alias(n) for n in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 6 AS least, string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ps,
         regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ms,
         regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS vs FROM d
  UNION ALL SELECT doc_id, 'access', 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 'jwt', 4, 1, string_split_regex(t, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') FROM d
  UNION ALL SELECT doc_id, 'url_login', 5, 1, string_split_regex(t, '[A-Za-z0-9+.-]+://[^\s/:@]+:[^\s/:@]+@'), regexp_extract_all(t, '[A-Za-z0-9+.-]+://[^\s/:@]+:[^\s/:@]+@'), regexp_extract_all(t, '[A-Za-z0-9+.-]+://[^\s/:@]+:[^\s/:@]+@') FROM d),
k0 AS (SELECT doc_id, string_split_regex(t, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----') AS ps, regexp_extract_all(t, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----') AS hs
       FROM d WHERE contains(t, 'PRIVATE KEY-----')),
k1 AS (SELECT doc_id, unnest(ps[:-2]) AS gap, unnest(hs) AS head, unnest(ps[2:]) AS body, generate_subscripts(hs, 1) AS i FROM k0 WHERE len(hs) > 0),
-- through the END line, if the first five dashes behind the header are its; else through the lines of base64.  In the body each
-- place behind base64 that a line may end at is marked, as RE2 can't look ahead
k2 AS (SELECT *, strpos(body, '-----') AS dash,
              regexp_replace(regexp_replace(translate(body, chr(57344) || chr(57345), '  '), '([A-Za-z0-9+/]={0,2})([\t ]*(?:[\r\n"''\\<]|\z))', '\1' || chr(57344) || '\2', 'g'),
                             '([A-Za-z0-9+/]={0,2})(' || chr(57344) || '?(?:[\s"''\\<]|\z))', '\1' || chr(57345) || '\2', 'g') AS marked FROM k1),
k3 AS (SELECT *, CASE WHEN dash > 0 THEN regexp_extract(body[dash:], '^-{5,}END (?:[A-Z]+ )*PRIVATE KEY-----') ELSE '' END AS close,
              regexp_extract(marked, replace(replace(replace(replace(replace(
                '^(?:BREAK[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*)*(?:BREAK(?:[A-Za-z0-9+/]{16,}={0,2}NM|[A-Za-z0-9+/]+={0,2}NL)|[\t ]*[A-Za-z0-9+/]{16,}={0,2}NM(?:[\t ]+[A-Za-z0-9+/]{1,15}={0,2}@M)?)+',
                'BREAK', '(?:[\t "''+,;>|#*@L]*(?:[\r\n]|\\+[nr]NM))+[\t "''>|#*]*'), 'N', chr(57345) || '?'), '@', chr(57345)), 'M', chr(57344) || '?'), 'L', chr(57344))) AS lines_m FROM k2),
k4 AS (SELECT doc_id, i, gap, head, CASE WHEN close <> '' THEN body[:dash - 1] || close ELSE translate(lines_m, chr(57344) || chr(57345), '') END AS tail FROM k3),
k5 AS (SELECT doc_id, CAST(sum(length(gap) + length(head)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS head_stop, length(head) AS n, length(tail) AS extra FROM k4),
e AS (SELECT doc_id, kind, rank, least, unnest(ps[1:len(ms)]) AS gap, unnest(ms) AS mt, unnest(vs) AS v, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT doc_id, kind, rank, least, length(v) AS n, length(mt) AS size,
             CAST(sum(length(gap) + length(mt)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM e),
k AS (SELECT doc_id, kind, rank, stop - size AS start, stop FROM s WHERE n >= least
      UNION ALL SELECT doc_id, 'pem', 3, head_stop - n, head_stop + extra FROM k5),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
