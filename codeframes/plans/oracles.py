"""DuckDB SQL that must give the rows of each query.

Folds are recursive over the ordinal of a row; patterns are written for RE2, which has no lookahead, so three
signals differ in form from those of the columns."""

from __future__ import annotations


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASCII = "[^\\x00-\\x7F]"

TAKES = f"""
takes AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn * 1000 AS BIGINT) AS timestamp_ms,
         '/frames/' || conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') || '.jpg' AS path,
         CAST((30 + (conv_id * 7 + turn * 3) % 70) / 100.0 AS DOUBLE) AS confidence,
         CASE turn % 4 WHEN 0 THEN 'def f_' || conv_id || '(x):' || chr(10) || '    return x'
                       WHEN 1 THEN 'def f_' || conv_id || '(x):' || chr(10) || '    retvrn x'
                       WHEN 2 THEN regexp_replace(coalesce(text, ''), '{ASCII}', '', 'g')
                       ELSE 'import os' || chr(10) || 'x = ' || turn END AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq
  FROM conversations)"""

SECOND = """
second AS (
  SELECT video_id, seq, CASE WHEN seq % 4 = 1 THEN replace(text, 'retvrn', 'return')
                             WHEN seq % 8 = 2 THEN 'x = open(''f'')' || chr(10) || 'print(x)' ELSE text END AS text, 0.9 AS confidence
  FROM takes)"""

SIGNALS = """
signals AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, '/f/' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS path,
         date_diff('millisecond', TIMESTAMP '2024-01-01', ts) AS timestamp_ms, CAST(floor(value) AS BIGINT) AS phash, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY date_diff('millisecond', TIMESTAMP '2024-01-01', ts), event_id) - 1 AS seq
  FROM events)"""

BOXES = """
boxes AS (
  SELECT l_orderkey, l_linenumber AS ord, CAST(l_linenumber * 20 AS INTEGER) AS x, CAST(l_partkey % 40 AS INTEGER) AS y, 15 AS width,
         CAST(5 + CAST(floor(l_quantity) AS BIGINT) % 7 AS INTEGER) AS height, l_returnflag || l_linenumber AS text
  FROM lineitem)"""

TRANSCRIPTS = """
transcripts AS (
  SELECT video_id, seq, CASE seq % 4 WHEN 0 THEN '```python' || chr(10) || chr(10) || text || chr(10) || '```' || chr(10) || 'Done ``` here'
                                     WHEN 1 THEN chr(10) || text || ' [?] and [?]' || chr(10) || chr(10)
                                     WHEN 2 THEN 'Sure:' || chr(10) || '```' || chr(10) || '  ' || text
                                     ELSE '  ' || chr(10) END AS content,
         CASE WHEN seq % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
  FROM takes),
stripped AS (
  SELECT *, regexp_replace(CASE WHEN regexp_matches(content, '(?sm)```[^\\n]*\\n(.*?)(?:^```|\\z)')
                           THEN regexp_extract(content, '(?sm)```[^\\n]*\\n(.*?)(?:^```|\\z)', 1) ELSE content END, '\\A\\n+|\\n+\\z', '', 'g') AS text
  FROM transcripts)"""

PREDICTIONS = f"""
truths AS (SELECT CAST(item_id AS VARCHAR) AS name, coalesce(text, '') AS truth FROM benchmark),
predictions AS (
  SELECT 'copy' AS backend, name, truth, truth AS text, NULL AS error FROM truths
  UNION ALL SELECT 'errs', name, truth, replace(truth, 'e', 'c'), NULL FROM truths
  UNION ALL SELECT 'fails', name, truth, truth, CASE WHEN CAST(name AS INTEGER) % 7 = 0 THEN 'timeout' END FROM truths)"""

LESSONS = """
lessons AS (
  SELECT o_custkey AS course, (o_orderstatus <> 'P' OR o_custkey % 2 = 0) AS has_stream,
         (o_orderstatus <> 'P' OR o_custkey % 2 = 0) AND o_orderkey % 11 <> 0 AS downloaded,
         CAST(1279 + o_custkey % 2 + CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 3 ELSE 0 END AS INTEGER) AS width, CAST(719 + o_custkey % 3 AS INTEGER) AS height
  FROM orders)"""

_KINDS = ["const a{0} = f(b{0});", "$ pip install p{0}", "select a.id from t{0} a", "select one of the {0} from it", "if x{0}:  # go", "class T{0} {", "item(s) {0}", "  -> crop {0}", "x = = {0}", "#include <m{0}>", "for (;;) {\n  y{0} += 1; // n\n}", "plain words {0}"]
_PARTS = " ".join(f"WHEN {i} THEN replace({_q(k)}, '{{0}}', CAST(p_partkey AS VARCHAR))" for i, k in enumerate(_KINDS))

CODE_TEXTS = f"""
code_texts AS (
  SELECT 't' || video_id || '_' || seq AS id, text FROM takes
  UNION ALL SELECT 'p' || page_id, regexp_replace(coalesce(html, ''), '{ASCII}', '', 'g') FROM pages
  UNION ALL SELECT 'k' || p_partkey, CASE p_partkey % {len(_KINDS)} {_PARTS} END FROM part)"""

# The signals once more, from tokens (words and single other characters, line ends among them) and lines: conditions on
# columns w, l and t.  Fixed values: weights in hundredths, words and marks.
def _in(value: str, words: str) -> str:
    return f"{value} IN ({', '.join(_q(w) for w in words.split())})"


def _tokens_hold(span: int, condition: str) -> str:
    """Some run of ``span`` tokens that ``condition`` on i, its first place, holds for."""
    return f"len(list_filter(range(1, len(w) - {span - 2}), lambda i: {condition})) > 0"


def _lines_hold(condition: str) -> str:
    return f"len(list_filter(l, lambda x: {condition})) > 0"


_CLOSE = "rtrim(regexp_replace(regexp_replace(x, '([:{;])[ \\t\\r\\f\\v]*(#|//).*$', '\\1'), '\\s+$', ''))"
_SIGNALS = (
    ("definition", 50, _tokens_hold(3, f"({_in('w[i]', 'def function fn')} AND regexp_full_match(w[i + 1], '\\w+') AND w[i + 2] = '(')"
        f" OR (w[i] = 'class' AND w[i + 1][1] BETWEEN 'A' AND 'Z' AND {_in('w[i + 2]', '( { :')})").replace("w[", "v[").replace("len(w)", "len(v)")),
    ("brace_header", 30, "regexp_matches(t, '\\)\\s*\\{[ \\t\\r\\f\\v]*(\\n|\\z)')"),
    ("import", 40, _lines_hold("string_split_regex(trim(x, chr(32) || chr(9) || chr(13)), '\\s+')[1] = 'import' AND regexp_matches(x, 'import\\s+[a-zA-Z0-9_.]') OR regexp_matches(x, '^\\s*from\\s+[a-zA-Z0-9_.]+\\s+import($|[^a-zA-Z0-9_])')")
        + " OR regexp_matches(t, '#include($|[^a-zA-Z0-9_])')"),
    ("sql", 40, "sql"),
    ("control_flow", 35, _lines_hold(f"regexp_extract(x, '^\\s*([a-zA-Z0-9_]+)', 1) IN ('if', 'elif', 'else', 'for', 'while', 'try', 'except', 'finally', 'with', 'match', 'case', 'switch') AND ({_CLOSE} LIKE '%:' OR {_CLOSE} LIKE '%{{')")),
    ("shell", 35, _lines_hold("starts_with(ltrim(x, chr(32) || chr(9) || chr(13)), '$ ')")
        + " OR " + _tokens_hold(2, f"{_in('v[i]', 'pip npm')} AND v[i + 1] = 'install'").replace("len(w)", "len(v)") + " AND (contains(t, 'pip install') OR contains(t, 'npm install'))"
        + " OR " + _tokens_hold(3, "v[i] = 'apt' AND v[i + 1] = '-' AND v[i + 2] = 'get'").replace("len(w)", "len(v)") + " AND contains(t, 'apt-get')"
        + " OR " + _tokens_hold(2, "v[i] = 'cargo' AND regexp_full_match(v[i + 1], '\\w+')").replace("len(w)", "len(v)")),
    ("tag", 30, "len(list_filter(string_split(t, '<')[2:], lambda x: regexp_matches(x, '^/?[A-Za-z][A-Za-z0-9_:-]*(/?>|[ \\t][^>\\n]*>)'))) > 0"),
    ("operator", 30, " OR ".join(f"contains(t, {_q(o)})" for o in "== != <= >= => -> && || += -= ::".split())),
    ("assignment", 25, "regexp_matches(t, '(^|\\n)\\s*[a-zA-Z0-9_.\\[\\]\"'']+\\s*=($|[^=])')"),
    ("typed_declaration", 25, _tokens_hold(3, f"(i = 1 OR v[i - 1] = chr(10)) AND {_in('v[i]', 'const let var final static public private int float double long char bool boolean string auto')} AND regexp_full_match(v[i + 1], '\\w+') AND v[i + 2] = '='")
        .replace("len(w)", "len(n)").replace("v[", "n[")),
    ("call", 25, "len(list_filter(regexp_extract_all(t, '[a-zA-Z0-9_]\\(([^)\\n]*)\\)', 1), lambda x: lower(x) NOT IN ('s', 'es'))) > 0"),
    ("semicolon", 25, _lines_hold(f"{_CLOSE} LIKE '%;'")),
    ("indentation", 20, _lines_hold("x[1] IN (chr(32), chr(9)) AND regexp_matches(ltrim(x, chr(32) || chr(9)), '^[a-zA-Z0-9_({\\[\"'']')")),
    ("bracket", 15, " OR ".join(f"contains(t, '{c}')" for c in "{}[]")),
    ("identifier", 12, "len(list_filter(v, lambda x: regexp_matches(x, '._.') OR regexp_matches(x, '^[a-z]+[A-Z]'))) > 0 OR regexp_matches(t, '[a-zA-Z0-9_][.][a-zA-Z0-9_]')"),
    ("comment", 10, "len(list_filter(string_split_regex(t, '\\s'), lambda x: starts_with(x, '#') OR starts_with(x, '//') OR starts_with(x, '/*'))) > 0"),
    ("keyword", 5, f"list_has_any(v, [{', '.join(_q(k) for k in 'def class import from return elif lambda yield async await const let var void struct'.split())}])"),
)

_STOPS = r"\b(?:the|of|to|please|your|our|you|this|that|these|those)\b|\ban?\s"


def _sql_signal(text: str) -> str:
    pieces = rf"string_split_regex(lower({text}), '\bfrom\b')"
    last = r"string_split_regex(p, '\bselect\b')"
    ok = f"len({last}) > 1 AND length({last}[-1]) <= 120 AND NOT regexp_matches({last}[-1], {_q(_STOPS)})"
    return f"len(list_filter(({pieces})[1:-2], lambda p: {ok})) > 0"


def _signal(name: str, condition: str) -> str:
    return _sql_signal("t") if name == "sql" else f"({condition})"


def _signalled(source: str) -> str:
    """``source`` with its text as t, tokens as v, tokens and line ends without other white space as n, and lines as l."""
    return (
        rf"(SELECT *, text AS t, regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_\s]') AS v, regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \t\r\f\v]') AS n,"
        rf" string_split(text, chr(10)) AS l FROM {source})"
    )


def _scored(source: str) -> str:
    """``source`` with its text's score."""
    return f"(SELECT * EXCLUDE (t, v, n, l), {_score()} AS score FROM {_signalled(source)})"


def _score() -> str:
    total = " + ".join(f"CASE WHEN {_signal(n, c)} THEN {w} ELSE 0 END" for n, w, c in _SIGNALS)
    return f"CAST(least(100, {total}) / 100.0 AS DOUBLE)"


def _letters(source: str, column: str) -> str:
    """Two strings for ``translate``: the characters of ``source`` beyond ASCII, and as many ASCII ones that no text of it has, as
    ``levenshtein`` counts bytes; an error where there are too few."""
    return f"""
seen AS (SELECT DISTINCT unnest(string_split({column}, '')) AS c FROM {source}),
letters AS (
  SELECT coalesce((SELECT string_agg(c, '' ORDER BY c) FROM seen WHERE ord(c) > 127), '') AS beyond,
         coalesce((SELECT string_agg(chr(n), '' ORDER BY n) FROM (SELECT unnest(range(1, 128))::INTEGER AS n) WHERE chr(n) NOT IN (SELECT c FROM seen)), '') AS unused),
alphabet AS (SELECT CASE WHEN length(beyond) > length(unused) THEN error('too many letters') ELSE beyond END AS beyond, left(unused, length(beyond)) AS stand FROM letters)"""


_WORD = r"[\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_\s]"

# Links of pages once more: attributes one after the other inside each tag, and a path built as one text whose last part
# a ".." takes away.
_PAGE_LINKS = r"""
WITH plain AS (
  SELECT page_id, url AS base, regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g'), '(?is)(<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>)', '', 'g') AS h FROM pages WHERE html IS NOT NULL),
tags AS (SELECT page_id, base, unnest(regexp_extract_all(h, '(?i)<a\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag, generate_subscripts(regexp_extract_all(h, '(?i)<a\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>'), 1) AS pos FROM plain),
attributes AS (SELECT *, regexp_extract_all(tag, '[^\s=>"''/]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)') AS own FROM tags),
raw AS (
  SELECT page_id, base, pos, regexp_replace(list_filter(own, lambda x: regexp_matches(x, '^(?i:href)\s*='))[1], '^[^=]*=\s*', '') AS v FROM attributes),
bare AS (SELECT page_id, base, pos, CASE WHEN v[1] IN ('"', '''') THEN v[2:-2] ELSE v END AS v FROM raw WHERE v IS NOT NULL),
href AS (
  SELECT page_id, base, pos, string_split(v, '&')[1] || array_to_string(list_transform(string_split(v, '&')[2:], lambda p:
    CASE WHEN regexp_matches(p, '^(amp|lt|gt|quot|apos|nbsp);') THEN CASE split_part(p, ';', 1) WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '"' WHEN 'apos' THEN '''' ELSE chr(160) END || p[length(split_part(p, ';', 1)) + 2:]
         WHEN regexp_matches(p, '^#[0-9]{1,7};') THEN chr(CAST(split_part(p, ';', 1)[2:] AS INTEGER)) || p[length(split_part(p, ';', 1)) + 2:]
         WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{1,6};') THEN chr(CAST('0x' || split_part(p, ';', 1)[3:] AS INTEGER)) || p[length(split_part(p, ';', 1)) + 2:]
         ELSE '&' || p END), '') AS l FROM bare),
u AS (
  SELECT page_id, pos, base, regexp_replace(regexp_replace(l, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g') AS l, l AS given, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
         split_part(split_part(base, '#', 1), '?', 1) AS front, regexp_extract(base, '^[^?#]*\?([^#]*)', 1) AS base_query FROM href WHERE contains(l, '/')),
w AS (
  SELECT *, lower(regexp_extract(l, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS own, regexp_extract(front, '^[^:/]*://([^/]*)', 1) AS host, regexp_replace(front, '^[^:/]*://[^/]*', '') AS folder,
         regexp_replace(split_part(split_part(l, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest, regexp_extract(l, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(l, '^[^#]*#(.*)$', 1) AS fragment FROM u),
p AS (
  SELECT *, CASE WHEN starts_with(rest, '/') THEN rest ELSE regexp_replace('/' || regexp_extract(folder, '^(.*/)', 1) || rest, '/{2,}', '/', 'g') END AS path,
         regexp_matches(rest, '^//[^/]') AS whole FROM w),
done AS (
  SELECT *, list_reduce(list_prepend('', string_split(path[2:], '/')), lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END)
            || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END AS folded FROM p),
links AS (
  SELECT page_id, pos, CASE WHEN own <> '' AND own <> scheme THEN given
      WHEN whole THEN scheme || ':' || rest
      ELSE scheme || '://' || host || CASE WHEN rest = '' THEN folder ELSE folded END END
      || CASE WHEN own <> '' AND own <> scheme THEN '' ELSE
           CASE WHEN query <> '' THEN '?' || query WHEN rest = '' AND base_query <> '' THEN '?' || base_query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END END AS link FROM done),
f AS (SELECT page_id, link, min(pos) AS pos FROM links GROUP BY ALL)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position FROM f
"""


def _norm(text: str) -> str:
    lines = rf"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10))"
    return rf"regexp_replace({lines}, '\A\n+|\n+\z', '', 'g')"


def _similar(a: str, b: str, threshold: float) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN true ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) >= {threshold} END"


def _clusters(source: str, threshold: float = 0.85) -> str:
    """First-fit clusters of ``source`` (video_id, seq, text, ...), by recursion over a dense ordinal."""
    return f"""
normed AS (SELECT *, {_norm("text")} AS norm, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n FROM {source}),
fold AS (
  SELECT video_id, n, [norm] AS seeds, 0 AS cluster_id FROM normed WHERE n = 1
  UNION ALL
  SELECT video_id, n, CASE WHEN p = 0 THEN list_append(seeds, norm) ELSE seeds END, CAST(CASE WHEN p = 0 THEN len(seeds) ELSE p - 1 END AS INTEGER)
  FROM (SELECT f.video_id, x.n, f.seeds, x.norm,
               coalesce(list_position(list_transform(f.seeds, lambda s: {_similar("s", "x.norm", threshold)}), true), 0) AS p
        FROM fold f JOIN normed x ON x.video_id = f.video_id AND x.n = f.n + 1)),
clustered AS (SELECT normed.*, cluster_id FROM normed JOIN fold USING (video_id, n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster_id ORDER BY confidence DESC, timestamp_ms, path, seq) AS r FROM clustered),
reps AS (SELECT video_id, cluster_id, text AS code, norm AS rep_norm, confidence AS rep_confidence FROM ranked WHERE r = 1),
grouped AS (
  SELECT c.video_id, c.cluster_id, min(c.timestamp_ms * 1000 + c.seq) AS first_key, string_agg(c.path, '|' ORDER BY c.timestamp_ms, c.path) AS sources,
         count(DISTINCT c.norm) AS n_variants, max(c.confidence) FILTER (c.norm <> r.rep_norm) AS runner_up
  FROM clustered c JOIN reps r USING (video_id, cluster_id) GROUP BY ALL),
snippets AS (
  SELECT g.*, r.code, r.rep_confidence, row_number() OVER (PARTITION BY g.video_id ORDER BY first_key, g.cluster_id) - 1 AS position
  FROM grouped g JOIN reps r USING (video_id, cluster_id))"""


def _script() -> str:
    return r"""
scripts AS (
  SELECT video_id, coalesce(string_agg(regexp_replace(code, '\n+\z', ''), chr(10) || chr(10) || chr(10) ORDER BY position) FILTER (regexp_matches(code, '\S')) || chr(10), '') AS script
  FROM snippets GROUP BY video_id)"""


GATED = f"gated AS (SELECT * FROM {_scored('takes')} WHERE score >= 0.4)"

_READ = f"""
kept AS (SELECT * FROM (SELECT *, timestamp_ms // 2000 AS h, lag(timestamp_ms // 2000) OVER (PARTITION BY video_id ORDER BY seq) AS before FROM takes) WHERE before IS NULL OR h <> before),
passed AS (SELECT * FROM {_scored("kept")} WHERE score >= 0.4),
rated AS (SELECT * FROM {_scored("second")}),
adopted AS (
  SELECT p.video_id, p.seq, p.timestamp_ms, p.path, p.confidence < 0.6 AS escalated,
         CASE WHEN p.confidence < 0.6 AND s.score >= 0.4 THEN s.text ELSE p.text END AS text,
         CASE WHEN p.confidence < 0.6 AND s.score >= 0.4 THEN s.confidence ELSE p.confidence END AS confidence
  FROM passed p JOIN rated s USING (video_id, seq))"""


def _line_fold(source: str, ties: str) -> str:
    """Boxes (g, y, x, height, ...) to lines, by recursion over their top-down ordinal."""
    return f"""
placed AS (SELECT *, y + height / 2 AS centre, row_number() OVER (PARTITION BY g ORDER BY y, x, {ties}) AS n FROM {source}),
fold AS (
  SELECT g, n, [{{'c': centre, 'h': height}}] AS lines, 1 AS line FROM placed WHERE n = 1
  UNION ALL
  SELECT g, n, CASE WHEN p = 0 THEN list_append(lines, {{'c': centre, 'h': height}}) ELSE lines END, CAST(CASE WHEN p = 0 THEN len(lines) + 1 ELSE p END AS INTEGER)
  FROM (SELECT f.g, x.n, f.lines, x.centre, x.height,
               coalesce(list_position(list_transform(f.lines, lambda l: abs(x.centre - l.c) <= greatest(l.h, x.height) * 0.5), true), 0) AS p
        FROM fold f JOIN placed x ON x.g = f.g AND x.n = f.n + 1)),
lined AS (SELECT placed.*, line FROM placed JOIN fold USING (g, n)),
texts AS (SELECT g, line, min(y) AS top, string_agg(text, ' ' ORDER BY x, y, {ties}) AS t FROM lined GROUP BY g, line)"""


_URL = """CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/' ELSE regexp_replace(url, '[?#].*$', '') || '/a (b)~c-/?q=1' END"""
_SLUG = rf"""regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_extract({_URL}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')"""
_S = "CAST(floor(o_totalprice / 20) AS BIGINT)"

ORACLES = {
    "timecode": f"WITH {SIGNALS} SELECT event_id, printf('%02d:%02d:%02d.%03d', timestamp_ms // 3600000, timestamp_ms // 60000 % 60, timestamp_ms // 1000 % 60, timestamp_ms % 1000) AS timecode FROM signals",
    "frame_union": f"""WITH {SIGNALS}, u AS (SELECT video_id, path, timestamp_ms FROM signals WHERE event_type = 'click' OR (event_type = 'view' AND value / 100 > 0.3))
        SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_ms, path) - 1 AS seq FROM u""",
    "fps_sample": f"""WITH {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, floor(timestamp_ms * 0.00001::DOUBLE / 1000) ORDER BY timestamp_ms, path) AS r FROM signals)
        SELECT video_id, event_id, timestamp_ms FROM r WHERE r = 1""",
    "showinfo_pts": """SELECT event_id, CAST(greatest(0, round_even(CASE WHEN event_id % 5 = 0 THEN -value ELSE value END * 1000, 0)) AS BIGINT) AS pts_ms FROM events WHERE event_id % 3 <> 0""",
    "pair_frames": f"""WITH {SIGNALS}, a AS (SELECT video_id, event_id AS frame_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS ordinal FROM signals WHERE event_type = 'click'),
        b AS (SELECT video_id, event_id AS time_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS ordinal FROM signals WHERE event_type = 'view')
        SELECT video_id, ordinal, frame_id, time_id FROM a FULL JOIN b USING (video_id, ordinal)""",
    "suffix_order": "SELECT event_id, CAST(event_id * 7 % 1000 AS INTEGER) AS number FROM events",
    "dedup_runs": f"""WITH RECURSIVE {SIGNALS}, fold AS (
          SELECT video_id, seq, phash, phash AS last, true AS keep FROM signals WHERE seq = 0
          UNION ALL SELECT s.video_id, s.seq, s.phash, CASE WHEN bit_count(xor(s.phash, f.last)) > 3 THEN s.phash ELSE f.last END, bit_count(xor(s.phash, f.last)) > 3
          FROM fold f JOIN signals s ON s.video_id = f.video_id AND s.seq = f.seq + 1)
        SELECT video_id, seq, phash FROM fold WHERE keep""",
    "sign_hash": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64),
        m AS (SELECT *, (list_sort(x)[32] + list_sort(x)[33]) / 2 AS m FROM e)
        SELECT vec_id, array_to_string(list_transform(x, lambda v: CASE WHEN v > m THEN '1' ELSE '0' END), '') AS bits FROM m""",
    "bbox_pixels": """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 9 AS x, l_tax * 12 AS y, l_quantity / 100 AS w, l_discount + 0.05::DOUBLE AS h FROM lineitem),
        e AS (SELECT l_orderkey, l_linenumber, CAST(round_even(greatest(0.0, least(1.0, x)) * 1920, 0) AS INTEGER) AS l, CAST(round_even(greatest(0.0, least(1.0, x + w)) * 1920, 0) AS INTEGER) AS r,
                     CAST(round_even(greatest(0.0, least(1.0, 1.0::DOUBLE - (y + h))) * 1080, 0) AS INTEGER) AS t, CAST(round_even(greatest(0.0, least(1.0, 1.0::DOUBLE - y)) * 1080, 0) AS INTEGER) AS b FROM b)
        SELECT l_orderkey, l_linenumber, l AS x, t AS y, greatest(0, r - l) AS width, greatest(0, b - t) AS height FROM e""",
    "line_groups": f"""WITH RECURSIVE {BOXES}, given AS (SELECT l_orderkey AS g, * FROM boxes), {_line_fold("given", "ord, height, text")}
        SELECT g AS l_orderkey, count(*) AS n_lines, string_agg(t, '/' ORDER BY top, line) AS text FROM texts GROUP BY g""",
    "annotation_text": f"""WITH RECURSIVE {BOXES}, good AS (SELECT l_orderkey AS g, ord, text, height / 16 AS confidence, x / 256.0::DOUBLE AS fx, y / 64.0::DOUBLE AS fy, height / 64.0::DOUBLE AS fh FROM boxes WHERE ord NOT IN (5, 6)),
        given AS (SELECT g, ord, text, confidence, CAST(round_even(greatest(0.0, least(1.0, fx)) * 256, 0) AS INTEGER) AS x,
                         CAST(round_even(greatest(0.0, least(1.0, 1.0 - (fy + fh))) * 64, 0) AS INTEGER) AS y,
                         CAST(round_even(greatest(0.0, least(1.0, 1.0 - fy)) * 64, 0) AS INTEGER) - CAST(round_even(greatest(0.0, least(1.0, 1.0 - (fy + fh))) * 64, 0) AS INTEGER) AS height FROM good),
        {_line_fold("given", "ord, text, CAST(confidence AS VARCHAR)")}, t AS (SELECT g, string_agg(t, '/' ORDER BY top, line) AS text FROM texts GROUP BY g),
        c AS (SELECT g, round(avg(confidence), 6) AS confidence, count(*) AS n_boxes FROM given GROUP BY g)
        SELECT CAST(o.l_orderkey AS VARCHAR) AS video_id, coalesce(text, '') AS text, coalesce(confidence, 0.0) AS confidence, coalesce(n_boxes, 0) AS n_boxes
        FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN t ON t.g = o.l_orderkey LEFT JOIN c ON c.g = o.l_orderkey""",
    "box_union": f"WITH {BOXES} SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM boxes GROUP BY l_orderkey",
    "crop_name": f"""WITH {SIGNALS} SELECT event_id, regexp_extract(path, '([^/]*)$', 1) || '.v1_' || timestamp_ms || '_' || left(sha256(path || '.v1.jpg'), 8) || '_1_2_30_40.png' AS name FROM signals""",
    "artifact_names": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'talk.' || page_id ELSE 'extracted' END AS base FROM pages",
    "data_uris": "SELECT page_id, sha256('data:image/' || CASE WHEN page_id % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || base64(encode(coalesce(html, '')))) AS uri_sha FROM pages",
    "fence_strip": f"WITH {TAKES}, {TRANSCRIPTS} SELECT video_id, seq, text FROM stripped",
    "llm_confidence": f"""WITH {TAKES}, {TRANSCRIPTS}, c AS (SELECT *, CASE WHEN regexp_matches(text, '\\S') THEN greatest(0.1::DOUBLE, 0.9::DOUBLE - 0.1::DOUBLE * ((length(text) - length(replace(text, '[?]', ''))) // 3)) ELSE 0.1::DOUBLE END AS c FROM stripped)
        SELECT video_id, seq, round(CASE WHEN finish_reason = 'length' THEN least(c, 0.3::DOUBLE) ELSE c END, 6) AS confidence FROM c""",
    "signal_hits": f"WITH {TAKES}, {CODE_TEXTS} SELECT id, " + ", ".join(f'{_signal(n, p)} AS "{n}"' for n, _, p in _SIGNALS) + f" FROM {_signalled('code_texts')}",
    "code_score": f"WITH {TAKES}, {CODE_TEXTS} SELECT id, score FROM {_scored('code_texts')}",
    "gate": f"WITH {TAKES}, {GATED} SELECT video_id, seq, score FROM gated",
    "normalize_text": rf"""WITH d AS (SELECT doc_id, {_norm("chr(10) || ' ' || chr(10) || replace(coalesce(text, ''), '.', '. ' || chr(9) || chr(10)) || '  ' || chr(10) || chr(10)")} AS n FROM documents)
        SELECT doc_id, length(n) AS n_chars, sha256(n) AS sha FROM d""",
    "similarity_pairs": f"""WITH b0 AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark), {_letters("b0", "t")},
        b AS (SELECT item_id, translate(t, beyond, stand) AS t FROM b0, alphabet)
        SELECT l.item_id AS a, r.item_id AS b, levenshtein(l.t, r.t) AS distance, CASE WHEN greatest(length(l.t), length(r.t)) = 0 THEN 1.0 ELSE round(1.0 - levenshtein(l.t, r.t) / greatest(length(l.t), length(r.t)), 6) END AS similarity,
               {_similar("l.t", "r.t", 0.3)} AS near
        FROM b l JOIN b r ON r.item_id - l.item_id BETWEEN 1 AND 5""",
    "similarity_join": f"""WITH {PREDICTIONS}, {_letters("predictions", "text")},
        r AS (SELECT backend || '/' || name AS reading, translate(text, beyond, stand) AS t FROM predictions, alphabet),
        c AS (SELECT t, min(reading) AS class_id FROM r GROUP BY t),
        n AS (SELECT a.class_id, count(*) AS n FROM c a JOIN c b ON a.class_id <> b.class_id AND {_similar("a.t", "b.t", 0.8)} GROUP BY a.class_id)
        SELECT reading, class_id, coalesce(n, 0) AS n_links FROM r JOIN c USING (t) LEFT JOIN n USING (class_id)""",
    "clusters": f"WITH RECURSIVE {TAKES}, {_clusters('takes')} SELECT video_id, seq, cluster_id FROM clustered",
    "representatives": f"WITH RECURSIVE {TAKES}, {_clusters('takes')} SELECT video_id, cluster_id, code, sources, position FROM snippets",
    "notes": f"""WITH RECURSIVE {TAKES}, {_clusters('takes')}, f AS (SELECT *, rep_confidence < 0.5 AS low_confidence, coalesce(rep_confidence - runner_up <= 0.1::DOUBLE, false) AS conflict FROM snippets)
        SELECT video_id, cluster_id, low_confidence, conflict,
               concat_ws('; ', CASE WHEN low_confidence THEN 'low confidence: representative confidence ' || printf('%.2f', rep_confidence) || ' < 0.50' END,
                 CASE WHEN conflict THEN 'conflict: ' || n_variants || ' differing transcriptions with near-equal confidence (representative ' || printf('%.2f', rep_confidence) || ' vs runner-up ' || printf('%.2f', runner_up) || '); kept the highest-confidence one' END) AS notes FROM f""",
    "script": f"WITH RECURSIVE {TAKES}, {GATED}, {_clusters('gated')}, {_script()} SELECT video_id, script FROM scripts",
    "provenance": f"""WITH RECURSIVE {TAKES}, {GATED}, {_clusters('gated')}
        SELECT c.video_id, row_number() OVER (PARTITION BY c.video_id ORDER BY c.timestamp_ms, c.path, s.position, c.seq) - 1 AS entry, c.timestamp_ms AS "timestamp", c.path AS screenshot, c.text AS raw_ocr, s.code AS cleaned_code
        FROM clustered c JOIN snippets s USING (video_id, cluster_id)""",
    "merge_function": f"""WITH RECURSIVE {TAKES}, {_clusters('takes')}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster_id ORDER BY length(text) DESC, text DESC) AS k FROM clustered)
        SELECT video_id, cluster_id, text AS code FROM r WHERE k = 1""",
    "escalation": f"""WITH {TAKES}, {SECOND}, {GATED}, rated AS (SELECT * FROM {_scored("second")}), j AS (SELECT g.*, g.confidence < 0.6 AS escalated, s.text AS s_text, g.confidence < 0.6 AND s.score >= 0.4 AS adopted FROM gated g JOIN rated s USING (video_id, seq))
        SELECT video_id, seq, CASE WHEN adopted THEN s_text ELSE text END AS text, CASE WHEN adopted THEN 0.9::DOUBLE ELSE confidence END AS confidence, escalated, adopted FROM j""",
    "extract_plan": f"WITH RECURSIVE {TAKES}, {SECOND}, {_READ}, {_clusters('adopted')}, {_script()} SELECT video_id, script FROM scripts",
    "run_stats": f"""WITH RECURSIVE {TAKES}, {SECOND}, {_READ}, {_clusters('adopted')}, {_script()},
        a AS (SELECT video_id, count(*) AS n FROM takes GROUP BY 1), b AS (SELECT video_id, count(*) AS n FROM kept GROUP BY 1),
        c AS (SELECT video_id, count(*) AS n, count(*) FILTER (escalated) AS e FROM adopted GROUP BY 1), e AS (SELECT video_id, count(*) AS n FROM snippets GROUP BY 1)
        SELECT a.video_id, a.n AS frames_raw, b.n AS frames_after_dedup, coalesce(c.n, 0) AS frames_passed_scoring, coalesce(c.e, 0) AS escalated_count, coalesce(e.n, 0) AS snippets_merged,
               coalesce(length(script) - length(replace(script, chr(10), '')), 0) AS output_lines, coalesce(length(script), 0) AS output_chars
        FROM a LEFT JOIN b USING (video_id) LEFT JOIN c USING (video_id) LEFT JOIN e USING (video_id) LEFT JOIN scripts USING (video_id)""",
    "tokens": f"""WITH {PREDICTIONS}, t AS (SELECT backend, unnest(regexp_extract_all(text, '{_WORD}')) AS token, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) - 1 AS pos FROM predictions)
        SELECT backend, token, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY ALL""",
    "token_accuracy": f"""WITH {PREDICTIONS}, w AS (SELECT backend, name, regexp_extract_all(truth, '{_WORD}') AS t, regexp_extract_all(text, '{_WORD}') AS p FROM predictions)
        SELECT backend, name, round(CASE WHEN len(t) > 0 THEN coalesce(list_sum(list_transform(list_distinct(t), lambda k: least(len(list_filter(t, lambda x: x = k)), len(list_filter(p, lambda x: x = k))))), 0) / len(t)
                                    WHEN len(p) > 0 THEN 0.0 ELSE 1.0 END, 6) AS accuracy FROM w""",
    "backend_eval": f"""WITH {PREDICTIONS}, {_letters("predictions", "truth")},
        w AS (SELECT backend, error, translate(truth, beyond, stand) AS truth, translate(text, beyond, stand) AS text, regexp_extract_all(truth, '{_WORD}') AS t, regexp_extract_all(text, '{_WORD}') AS p FROM predictions, alphabet),
        m AS (SELECT backend, error, CASE WHEN greatest(length(text), length(truth)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(text, truth) / greatest(length(text), length(truth)) END AS l,
                     CASE WHEN len(t) > 0 THEN coalesce(list_sum(list_transform(list_distinct(t), lambda k: least(len(list_filter(t, lambda x: x = k)), len(list_filter(p, lambda x: x = k))))), 0) / len(t)
                          WHEN len(p) > 0 THEN 0.0 ELSE 1.0 END AS a FROM w)
        SELECT backend, round(avg(l), 6) AS mean_levenshtein, round(avg(a), 6) AS mean_token_acc, round((avg(l) + avg(a)) / 2, 6) AS aggregate, count(*) AS n_frames FROM m GROUP BY backend HAVING NOT bool_or(error IS NOT NULL)""",
    "winner": "",
    "page_links": _PAGE_LINKS,
    "stream_urls": r"""WITH h AS (SELECT page_id, coalesce(html, '') || CASE page_id % 3 WHEN 0 THEN '<script src="https://cdn.x/v' || page_id || '.m3u8?t=1">' WHEN 1 THEN '{''videoUrl'' : ''http://h/' || page_id || '.m3u8''}' ELSE '' END AS html FROM pages),
        a AS (SELECT page_id, list_filter(regexp_extract_all(html, 'https://[^"''\s]+'), lambda x: contains(x[10:], '.m3u8'))[1] AS direct, string_split(html, 'videoUrl') AS ps FROM h),
        v AS (SELECT page_id, direct, list_transform(list_filter(range(2, len(ps) + 1), lambda i: ps[i - 1][-1] IN ('"', '''') AND ps[i][1] IN ('"', '''')),
                     lambda i: string_split(replace(replace(ps[i][2:], chr(10), ' '), '"', ''''), '''')) AS fields FROM a),
        f AS (SELECT page_id, direct, list_filter(fields, lambda x: trim(x[1]) = ':' AND contains(x[2][2:], 'm3u8'))[1][2] AS body FROM v)
        SELECT page_id, coalesce(direct, body[1] || string_split(body[2:], 'm3u8')[1] || 'm3u8') AS stream FROM f""",
    "slugs": f"SELECT page_id, {_SLUG} AS lesson, coalesce(nullif({_SLUG}, ''), 'course') AS course FROM pages",
    "size_text": """WITH n AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * pow(10.0, l_linenumber - 3)) AS BIGINT) AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.1f KB', n / 1e3) ELSE n || ' B' END AS size FROM n""",
    "duration_text": f"""SELECT o_orderkey, CASE WHEN {_S} >= 3600 THEN printf('%d:%02d:%02d', {_S} // 3600, {_S} % 3600 // 60, {_S} % 60) ELSE printf('%d:%02d', {_S} // 60, {_S} % 60) END AS clock,
        CASE WHEN {_S} >= 3600 THEN printf('%dh %dm', {_S} // 3600, {_S} % 3600 // 60) ELSE printf('%dm', {_S} // 60) END AS hours, {_S} + 0.5::DOUBLE AS seconds, CAST(NULL AS DOUBLE) AS bad FROM orders""",
    "progress": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN CAST(least(100, floor(l_quantity * 3 / (l_linenumber * 20 - 20) * 100)) AS INTEGER) END AS percent FROM lineitem",
    "playlist_progress": """WITH line AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 0 ELSE CAST(round(sum(l_quantity) * 1000) AS BIGINT) END AS ms FROM lineitem GROUP BY l_orderkey, l_linenumber),
        s AS (SELECT l_orderkey, l_linenumber, ms, CAST(row_number() OVER o - 1 AS BIGINT) AS number, CAST(sum(ms) OVER o - ms AS BIGINT) AS start_ms FROM line WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
        total AS (SELECT l_orderkey, sum(ms) AS total_ms FROM line GROUP BY 1),
        r AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) * 5 AS BIGINT) - 9000 AS elapsed_ms FROM lineitem),
        -- of segments that begin together the last counts: those without a length share their start with the next
        b AS (SELECT l_orderkey, start_ms, max(number) AS number, max_by(l_linenumber, number) AS part FROM s GROUP BY ALL)
        SELECT r.l_orderkey, r.l_linenumber, r.elapsed_ms, b.number, 'part_' || b.part || '.ts' AS uri, b.start_ms,
               CAST(CASE WHEN total_ms > 0 THEN least(100, floor(elapsed_ms / total_ms * 100)) END AS INTEGER) AS percent
        FROM r ASOF LEFT JOIN b ON r.l_orderkey = b.l_orderkey AND r.elapsed_ms >= b.start_ms LEFT JOIN total ON total.l_orderkey = r.l_orderkey""",
    "probe_sizes": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS INTEGER) END AS width, CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey AS INTEGER) END AS height FROM lineitem""",
    "merge_mode": f"""WITH {LESSONS}, g AS (SELECT course, count(*) AS n_pages, count(*) FILTER (has_stream) AS n_streams, count(*) FILTER (has_stream AND downloaded) AS n_downloaded,
          count(DISTINCT CASE WHEN downloaded THEN width || 'x' || height END) AS n_sizes, max(width) + max(width) % 2 AS pad_width, max(height) + max(height) % 2 AS pad_height FROM lessons GROUP BY course)
        SELECT *, CASE WHEN n_downloaded = 0 OR n_downloaded < n_streams OR n_streams < n_pages THEN 'skip' WHEN n_sizes <= 1 THEN 'copy' ELSE 'recode' END AS mode FROM g""",
    "image_crop": """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + 1) * 127) AS INTEGER)))) AS g FROM embeddings WHERE len(embedding) = 64)
        SELECT vec_id, array_to_string(list_transform([11, 12, 13, 14, 19, 20, 21, 22, 27, 28, 29, 30], lambda i: lpad(upper(to_hex(g[i])), 2, '0')), '') AS pixels, 4 AS width, 3 AS height FROM p""",
}

# the best of the report's backends; of equal ones the first in the order errs, copy, fails
ORACLES["winner"] = f"WITH r AS ({ORACLES['backend_eval']}) SELECT backend AS winner FROM r ORDER BY aggregate DESC, list_position(['errs', 'copy', 'fails'], backend) LIMIT 1"

# the low frequencies of a cosine transform of the picture, enlarged four times, in two steps: along rows, then columns
ORACLES["image_phash"] = """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + 1) * 127) AS INTEGER)))) AS g FROM embeddings WHERE len(embedding) = 64),
    c AS (SELECT k, x // 4 AS i, sum(cos(pi() * (2 * x + 1) * k / 64)) AS c FROM range(8) a(k), range(32) b(x) GROUP BY ALL),
    e AS (SELECT vec_id, unnest(g) AS v, generate_subscripts(g, 1) - 1 AS spot FROM p),
    r AS (SELECT vec_id, k, spot % 8 AS j, sum(v * c) AS s FROM e JOIN c ON i = spot // 8 GROUP BY ALL),
    f AS (SELECT vec_id, r.k * 8 + c.k AS place, sum(s * c) AS low FROM r JOIN c ON c.i = r.j GROUP BY ALL),
    m AS (SELECT *, median(low) OVER (PARTITION BY vec_id) AS middle FROM f)
    SELECT vec_id, CAST(sum(CASE WHEN low <= middle THEN 0 WHEN place = 0 THEN -9223372036854775808 ELSE 1::BIGINT << CAST(63 - place AS INTEGER) END) AS BIGINT) AS phash FROM m GROUP BY vec_id"""

# pictures as frames of videos of fifty: those kept differ from the one kept before by more than 24 bits
ORACLES["read_pictures"] = f"""WITH RECURSIVE h AS ({ORACLES['image_phash']}),
    o AS (SELECT vec_id, phash, vec_id // 50 AS video, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id % 50, '/shots/' || vec_id || '.png') AS n FROM h),
    fold AS (SELECT video, n, vec_id, phash AS last, true AS keep FROM o WHERE n = 1
      UNION ALL SELECT o.video, o.n, o.vec_id, CASE WHEN bit_count(xor(o.phash, f.last)) > 24 THEN o.phash ELSE f.last END, bit_count(xor(o.phash, f.last)) > 24
      FROM fold f JOIN o ON o.video = f.video AND o.n = f.n + 1),
    p AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + 1) * 127) AS INTEGER)))) AS g FROM embeddings WHERE len(embedding) = 64)
    SELECT CAST(video AS VARCHAR) AS video_id, '/shots/' || vec_id || '.png' AS path, 'import m' || g[11] AS text, g[11] / 256.0::DOUBLE AS confidence FROM fold JOIN p USING (vec_id) WHERE keep"""
