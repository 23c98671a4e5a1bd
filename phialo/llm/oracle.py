"""DuckDB SQL with the results of the queries that SQL can express."""

from phialo.llm import secrets

#: The rules of op9 as SQL states them: rates, counts that are free.
RATES = {
    "symbols": ("n_symbols", "n_words", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "upper": ("n_upper", "word_chars", 1000),
    "word_length": ("word_chars", "n_words", 100),
}
FREE = {"symbols": "n_symbols <= 2", "dup_lines": "n_dup_lines <= 1"}


def _rate(name: str) -> str:
    a, b, scale = RATES[name]
    return f"CASE WHEN {b} > 0 THEN ({scale} * {a}) // {b} ELSE 0 END"


def _quantiles(name: str, sketch: str, by: str) -> str:
    """Quantiles of merged bucket counts, and how far a limit reaches above the third quartile."""
    reached = ", ".join(f"min(bucket) FILTER ({b} * u >= {a} * a) AS {q}" for q, a, b in (("q1", 1, 4), ("q2", 1, 2), ("q3", 3, 4), ("q9", 9, 10)))
    return f"""
{name} AS (
  SELECT *, greatest(3 * greatest(q3 - q1, q9 - q3), CASE WHEN q9 = q3 THEN tail / 2 ELSE 0 END) AS reach
  FROM (SELECT {by}, metric, max(a) AS n_rows, {reached}, coalesce(min(bucket) FILTER (bucket > 0 AND 10 * (u - z) >= a - z), 0) AS tail
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY {by}, metric) AS a,
                     coalesce(sum(n) FILTER (bucket = 0) OVER (PARTITION BY {by}, metric), 0) AS z FROM {sketch}) GROUP BY {by}, metric)),"""


QUALITY_CTES = (
    r"""
texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM texts)),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
counts AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM (
    SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM texts LEFT JOIN repeats USING (doc_id))),
rates AS (
"""
    + " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_rate(m)} AS v FROM counts WHERE NOT base_failed" for m in RATES)
    + """ UNION ALL SELECT lang, source, 'words', n_words FROM counts WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, metric, (((v >> d) + 1) << d) - 1 AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS d FROM rates) GROUP BY ALL),"""
    + _quantiles("own", "sketch", "lang, source")
    + _quantiles("whole", "(SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL)", "lang")
    + """
mixed AS (
  SELECT o.lang, o.source, o.metric, w.q2 AS half, w.q3 AS wf, w.reach AS wr,
         (o.n_rows * o.q3 + 100 * w.q3) / (o.n_rows + 100) AS gf, (o.n_rows * o.reach + 100 * w.reach) / (o.n_rows + 100) AS gr
  FROM own o JOIN whole w ON o.lang IS NOT DISTINCT FROM w.lang AND o.metric = w.metric),
limits AS (
  SELECT lang, source, max(half) FILTER (metric = 'words') AS typical, """
    + ", ".join(f"max(f) FILTER (metric = '{m}') AS from_{m}, max(r) FILTER (metric = '{m}') AS reach_{m}" for m in RATES)
    + """
  FROM (SELECT *, CASE WHEN (gf + gr, gf, gr) < (wf + wr, wf, wr) THEN gf ELSE wf END AS f, CASE WHEN (gf + gr, gf, gr) < (wf + wr, wf, wr) THEN gr ELSE wr END AS r FROM mixed)
  GROUP BY ALL),
verdicts AS (
  SELECT c.*, CASE WHEN base_failed THEN false ELSE """
    + " AND ".join(f"coalesce({_rate(m)} <= from_{m} + reach_{m} * sqrt(greatest(1.0, typical / n_words)){' OR ' + FREE[m] if m in FREE else ''}, true)" for m in RATES)
    + """ END AS kept
  FROM counts c LEFT JOIN limits l ON c.lang IS NOT DISTINCT FROM l.lang AND c.source IS NOT DISTINCT FROM l.source)
"""
)

CHAT = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations),
chats AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY n) AS said,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS chat
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, chat FROM chats a
WHERE NOT EXISTS (SELECT 1 FROM chats b WHERE b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)
  AND NOT EXISTS (SELECT 1 FROM chats b WHERE b.said = a.said AND b.conv_id < a.conv_id)
"""

DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ t JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * t.n >= 75 * (x.n + y.n - t.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least_ AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, least(doc_id, coalesce(b, doc_id)) = doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _placed(kind: int, pattern: str, group: int = 0) -> str:
    """Matches with their places: gaps and matches added up."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS k, upto - length(hit) AS s, upto AS e, v FROM (
      SELECT doc_id, hit, v, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
        SELECT doc_id, unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p}, 0)) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS v,
               unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS i FROM texts) WHERE hit IS NOT NULL)"""


#: Strings that are never secrets, as one pattern.
ALLOW = (
    r"^[0-9=_+/-]+$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|^[A-Za-z]+[0-9]{1,4}$"
    r"|^[0-9]{1,4}[A-Za-z]+$"
    r"|^[A-Za-z]*[a-z]{3,}([/_+=-]+([A-Za-z]?[a-z]*|[0-9]{1,4}))+$"
    r"|(?i)example|placeholder|xxxx|0000000"
)
_LIMITS = " ".join(f"WHEN regexp_matches(v, {_quoted(p)}) THEN {limit}" for p, _, limit in secrets.CLASSES if p)
_JOINED = "coalesce(string_agg(list_extract(['assign', 'access', 'hex', 'entropy'], k + 1) || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k), '')"
SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT * FROM ({_placed(0, secrets.ASSIGN, 2)}) WHERE length(v) >= 8
  UNION ALL SELECT * FROM ({_placed(1, "AKIA[A-Z0-9]+")}) WHERE length(v) >= 16
  UNION ALL SELECT * FROM ({_placed(2, "[0-9a-f]+")}) WHERE length(v) >= 32),
runs AS (
  SELECT * FROM ({_placed(3, "[A-Za-z0-9+/_=-]+")}) r
  WHERE length(v) >= 20 AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, {_quoted(ALLOW)})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND b.e > r.s)),
windows AS (SELECT DISTINCT v, unnest(range(1, length(v) - {secrets.WINDOW - 2})) AS i FROM runs),
letters AS (SELECT v, i, c, count(*) AS n FROM (SELECT v, i, unnest(string_split(substr(v, i, {secrets.WINDOW}), '')) AS c FROM windows) GROUP BY ALL),
peaks AS (
  SELECT v, max(h) AS h FROM (SELECT v, i, log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} AS h FROM letters GROUP BY v, i) GROUP BY v),
every AS (
  SELECT doc_id, k, s, e FROM base
  UNION ALL SELECT doc_id, k, s, e FROM runs JOIN peaks USING (v) WHERE h >= CASE {_LIMITS} ELSE {secrets.CLASSES[-1][2]} END - 1e-9),
of_base AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_JOINED} AS base_spans
  FROM base GROUP BY doc_id),
of_all AS (SELECT doc_id, {_JOINED} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN of_base USING (doc_id) LEFT JOIN of_all USING (doc_id)
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

#: Orders are walked one by one here; each document's failures are a list of letters.
AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM texts LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(k AS INTEGER) AS step, substr(o, 1, k - 1) AS before, substr(o, k, 1) AS x FROM orders, range(1, 6) r(k)),
each AS (
  SELECT part, o, step, x, f, n, good, toxic, contains(f, x) AS fails, before <> '' AND regexp_matches(f, '[' || if(before = '', '-', before) || ']') AS gone
  FROM steps, counts),
found AS (
  SELECT part, o AS filter_order, step, x, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (f = x), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM found
"""

ORACLES = {
    "op12_filter_audit": AUDIT,
    "op13_exact_dedup": EXACT,
    "op2_minhash_near_dedup": DUPLICATES,
    "op7_secret_scans": SECRETS,
    "op1_chat_formatting": CHAT,
    "op9_quality_rules": f"WITH {QUALITY_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts",
}
