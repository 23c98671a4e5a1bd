"""The registered queries in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from phialo.functions import fixed
from phialo.plans.registry import LEAFLETS

SEQ = f"""concat(lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR), 12, '0'),
 CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_returnflag, l_linestatus{"".join(f", lpad(CAST(CAST(round(100 * {c}) AS BIGINT) AS VARCHAR), 12, '0')" for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax"))})"""

ROWS = f"""
rows_ AS (
  SELECT {SEQ} AS seq, CAST(l_partkey AS VARCHAR) AS product_id, lower(s_name) AS adr_term,
         CASE l_returnflag WHEN 'A' THEN 'common' WHEN 'R' THEN 'rare' ELSE 'not known' END AS frequency,
         CASE WHEN l_linestatus = 'F' THEN 'UNKNOWN' WHEN l_linenumber % 2 = 0 THEN 'Nervous System Disorders' ELSE 'Other (New) Class' END AS soc,
         CASE WHEN l_linenumber > 3 AND l_suppkey % 3 > 0 THEN CAST(10000000 + l_suppkey AS VARCHAR) ELSE '0' END AS meddra_code,
         CASE WHEN l_linenumber > 5 AND l_suppkey % 4 > 0 THEN concat('K', l_suppkey % 90) ELSE 'UNKNOWN' END AS icd_code
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
ADR = """
adr AS (
  SELECT adr_term, adr_term AS meddra_preferred_term,
         coalesce(arg_min(meddra_code, seq) FILTER (meddra_code <> '0'), '0') AS meddra_code,
         coalesce(arg_min(icd_code, seq) FILTER (icd_code <> 'UNKNOWN'), 'UNKNOWN') AS icd_code,
         replace(adr_term, '#', '') AS slug
  FROM rows_ GROUP BY adr_term)"""
OCC = """
occ AS (
  SELECT product_id, adr_term,
         coalesce(arg_min(frequency, seq) FILTER (frequency <> 'not known'), 'not known') AS frequency,
         coalesce(arg_min(soc, seq) FILTER (soc <> 'UNKNOWN'), 'UNKNOWN') AS soc
  FROM rows_ GROUP BY product_id, adr_term)"""
DRUG = """
drug AS (
  SELECT product_id, label, atc_code, active_ingredient, CASE WHEN n = 1 THEN base ELSE concat(base, '_', n) END AS slug
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS label, replace(lower(p_name), ' ', '_') AS base, '' AS active_ingredient,
               CASE p_type WHEN 'STANDARD' THEN 'A10BA02' WHEN 'MEDIUM' THEN 'C09' WHEN 'PROMO' THEN 'N05AH03' WHEN 'LARGE' THEN 'bad' ELSE 'UNKNOWN' END AS atc_code,
               row_number() OVER (PARTITION BY replace(lower(p_name), ' ', '_') ORDER BY p_partkey) AS n
        FROM part WHERE p_size <= 45))"""
SMPC = """
smpc AS (SELECT product_id, 'smpc_' || product_id AS slug, 'https://www.medicines.org.uk/emc/product/' || product_id || '/smpc/print' AS source_url FROM drug)"""
FACT = """
fact AS (
  SELECT o.adr_term, o.product_id, frequency, soc, d.slug AS drug_id, s.slug AS smpc_id, a.slug AS adr_id,
         'occ_' || o.product_id || '_' || substr(sha1(o.product_id || '|' || o.adr_term), 1, 12) AS occ_id
  FROM occ o JOIN drug d USING (product_id) JOIN smpc s USING (product_id) JOIN adr a USING (adr_term))"""
ENTITIES = ",".join((ROWS, ADR, OCC, DRUG, SMPC, FACT))
TRIPLES = """
triple AS (
  SELECT slug AS s, unnest(['rdf:type', 'rdf:type', 'productId', 'drugLabel', 'atcCode']) AS p, unnest(['owl:NamedIndividual', 'Drug', product_id, label, atc_code]) AS o,
         unnest(['iri', 'iri', 'literal', 'literal', 'literal']) AS o_kind FROM drug
  UNION SELECT slug, unnest(['rdf:type', 'rdf:type', 'adrLabel', 'meddraPreferredTerm', 'meddraCode', 'icdCode']),
         unnest(['owl:NamedIndividual', 'AdverseDrugReaction', adr_term, meddra_preferred_term, meddra_code, icd_code]), unnest(['iri', 'iri', 'literal', 'literal', 'literal', 'literal']) FROM adr
  UNION SELECT slug, unnest(['rdf:type', 'rdf:type', 'productId', 'sourceUrl']), unnest(['owl:NamedIndividual', 'SmPCDocument', product_id, source_url]), unnest(['iri', 'iri', 'literal', 'literal']) FROM smpc
  UNION SELECT occ_id, unnest(['rdf:type', 'rdf:type', 'occurrenceOfAdr', 'refersToSmPC', 'productId', 'frequency', 'soc']),
         unnest(['owl:NamedIndividual', 'DrugAdrOccurrence', adr_id, smpc_id, product_id, frequency, soc]), unnest(['iri', 'iri', 'iri', 'iri', 'literal', 'literal', 'literal']) FROM fact
  UNION SELECT drug_id, 'hasOccurrence', occ_id, 'iri' FROM fact)"""


def _schema_rows() -> str:
    """The graph's constant triples, spelled out from the schema's fixed lists."""
    from phialo.functions import fixed

    rows = [(fixed.NAMESPACE, "rdf:type", "owl:Ontology", "iri"), (fixed.NAMESPACE, "rdfs:label", fixed.GRAPH_LABEL, "literal")]
    for kind, names in (("Class", fixed.CLASSES), ("ObjectProperty", fixed.OBJECT_PROPERTIES), ("DatatypeProperty", fixed.DATA_PROPERTIES)):
        for name, *middle, label in names:
            rows += [(name, "rdf:type", f"owl:{kind}", "iri"), (name, "rdfs:label", label, "literal")]
            domain = middle[0] if middle else None
            range_ = middle[1] if len(middle) > 1 else "xsd:string" if kind == "DatatypeProperty" else None
            rows += [(name, p, o, "iri") for p, o in (("rdfs:domain", domain), ("rdfs:range", range_)) if o]
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


LOG = """
log AS (
  SELECT ts AS timestamp, CAST(user_id AS VARCHAR) AS product_id,
         CASE event_type WHEN 'view' THEN 'SKIPPED_EXISTS' WHEN 'error' THEN 'HTTP_404' WHEN 'signup' THEN 'HTTP_ERROR' ELSE 'SUCCESS' END AS status,
         CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN '404' WHEN 'signup' THEN '500' ELSE '200' END AS http_status,
         CASE event_type WHEN 'signup' THEN 'Timeout' ELSE '' END AS error_type,
         CASE WHEN event_id % 4 = 3 THEN 'x' ELSE CAST(event_id % 4 AS VARCHAR) END AS attempt_count,
         CASE event_type WHEN 'view' THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS ms
  FROM events)"""


def _distributions(where: str = "true") -> str:
    return f"""WITH {LOG}, kept_ AS (SELECT * FROM log WHERE {where})
SELECT 'status' AS kind, status AS value, count(*) AS n FROM kept_ GROUP BY status
UNION ALL SELECT 'http_status', http_status, count(*) FROM kept_ WHERE http_status <> '' GROUP BY http_status
UNION ALL SELECT 'error_type', error_type, count(*) FROM kept_ WHERE error_type <> '' GROUP BY error_type
UNION ALL SELECT 'attempt_count', CASE attempt_count WHEN 'x' THEN '0' ELSE attempt_count END, count(*) FROM kept_ GROUP BY 2"""


RUNS = "runs AS (SELECT DISTINCT event_id % 3 AS run, CAST(user_id AS VARCHAR) AS product_id, event_type AS term, props AS frequency FROM events)"
SIDES = f"""
each AS (
  SELECT {SEQ} AS seq, CAST(l_partkey AS VARCHAR) AS product_id, s_name AS adr_term, replace(lower(s_name), '#', ' ') AS key, l_returnflag AS frequency, lower(l_returnflag) AS freq,
         l_linestatus AS soc, l_linenumber AS n, l_suppkey % 10 = 9 AS head
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
gold AS (SELECT * FROM each WHERE n <= 4 AND NOT head),
pred AS (SELECT * FROM each WHERE n >= 3 AND product_id IN (SELECT product_id FROM gold))"""


def _pairs(pred: str = "pred", move: str = "-1") -> str:
    return f"""
g1 AS (SELECT *, row_number() OVER (PARTITION BY product_id, key, freq ORDER BY seq) AS n1 FROM gold),
p1 AS (SELECT *, {move} AS mv, row_number() OVER (PARTITION BY product_id, key, freq ORDER BY {move}, seq) AS n1 FROM {pred}),
done AS (SELECT g1.*, p1.adr_term AS pt, p1.frequency AS pf, p1.soc AS ps, p1.freq AS pq FROM g1 JOIN p1 USING (product_id, key, freq, n1)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY product_id, key ORDER BY seq) AS n2 FROM g1 ANTI JOIN p1 USING (product_id, key, freq, n1)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY product_id, key ORDER BY mv, seq) AS n2 FROM p1 ANTI JOIN g1 USING (product_id, key, freq, n1)),
matched AS (
  SELECT product_id, 'TP' AS status, adr_term AS gt, pt, frequency AS gf, pf, soc AS gs, ps, freq = pq AS fo FROM done
  UNION ALL
  SELECT coalesce(g2.product_id, p2.product_id), CASE WHEN p2.seq IS NULL THEN 'FN' WHEN g2.seq IS NULL THEN 'FP' ELSE 'TP' END,
         g2.adr_term, p2.adr_term, g2.frequency, p2.frequency, g2.soc, p2.soc, g2.freq = p2.freq
  FROM g2 FULL JOIN p2 ON g2.product_id = p2.product_id AND g2.key = p2.key AND g2.n2 = p2.n2),
matches AS (
  SELECT product_id, status, coalesce(gt, '') AS gold_term, coalesce(pt, '') AS pred_term, coalesce(gf, '') AS gold_frequency, coalesce(pf, '') AS pred_frequency,
         coalesce(gs, '') AS gold_soc, coalesce(ps, '') AS pred_soc, CASE WHEN status = 'TP' THEN CAST(fo AS INTEGER) END AS freq_ok,
         CASE WHEN status = 'TP' THEN CAST(gs = ps AS INTEGER) END AS soc_ok, '' AS error_category FROM matched)"""


#: Sections of pages as SQL reads them: tags and texts by a pattern, open tags by recursion, markers by searching each tag's text.
SECTIONS = r"""
WITH RECURSIVE leaflets AS (SELECT page_id AS product_id, CASE page_id % 6 """ + " ".join(
    f"WHEN {form} THEN " + reduce(lambda sql, change: f"replace({sql}, '{change[0]}', '{change[1]}')", changes.items(), "html") for form, changes in LEAFLETS.items()
) + r""" ELSE html END AS html FROM pages),
tokens AS (
  SELECT product_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t
  FROM (SELECT product_id, regexp_extract_all(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>|</?[a-z][^>]*>|[^<]+') AS ts FROM leaflets)),
kinds AS (
  SELECT *, CASE WHEN t LIKE '</%' THEN 'end' WHEN t LIKE '<!--%' THEN 'comment' WHEN t LIKE '<!%' THEN 'none' WHEN t LIKE '<script%' OR t LIKE '<style%' THEN 'raw'
                 WHEN name IN ('br', 'meta') THEN 'void' WHEN t LIKE '<%' THEN 'start' ELSE 'text' END AS kind
  FROM (SELECT *, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS name FROM tokens)),
walk AS (
  SELECT product_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, name VARCHAR)[]) AS open_ FROM leaflets
  UNION ALL
  SELECT w.product_id, k.i, CASE WHEN kind = 'start' THEN list_append(open_, {'i': k.i, 'name': k.name})
    WHEN kind = 'end' AND list_contains(list_transform(open_, lambda x: x.name), k.name)
    THEN open_[1:len(open_) - list_position(list_reverse(list_transform(open_, lambda x: x.name)), k.name)] ELSE open_ END
  FROM walk w JOIN kinds k ON k.product_id = w.product_id AND k.i = w.i + 1),
steps AS (
  SELECT k.*, w.open_, b.open_ AS before, list_reverse(b.open_[len(w.open_) + 1:]) AS popped,
         regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS said
  FROM kinds k JOIN walk w USING (product_id, i) JOIN walk b ON b.product_id = k.product_id AND b.i = k.i - 1),
written AS (
  SELECT *, CASE kind WHEN 'end' THEN array_to_string(list_transform(popped, lambda x: '</' || x.name || '>'), '') WHEN 'none' THEN '' WHEN 'text' THEN replace(said, '&', '&amp;')
                      WHEN 'void' THEN t[:-2] || '/>' WHEN 'start' THEN regexp_replace(replace(said, '&', '&amp;'), ' +', ' ', 'g') ELSE t END AS o FROM steps),
ends AS (SELECT product_id, max(i) AS n, arg_max(open_, i) AS open_ FROM walk GROUP BY product_id),
nodes AS (
  SELECT s.product_id, s.i, s.name, s.before[len(s.before)].i AS parent, t LIKE '%spcWrapper%' AS spc,
         CASE WHEN kind = 'start' THEN coalesce((SELECT min(z.i) FROM steps z WHERE z.product_id = s.product_id AND z.i > s.i AND list_contains(list_transform(z.popped, lambda x: x.i), s.i)), n + 1) ELSE s.i + 1 END AS last
  FROM steps s JOIN ends e USING (product_id) WHERE kind IN ('start', 'void', 'raw')),
texts AS (
  SELECT n.product_id, n.i, coalesce((SELECT string_agg(x, ' ' ORDER BY j) FROM (
    SELECT k.i AS j, trim(regexp_replace(said, '\s+', ' ', 'g')) AS x FROM steps k WHERE k.product_id = n.product_id AND k.kind = 'text' AND k.i > n.i AND k.i < n.last) WHERE x <> ''), '') AS line,
    (SELECT string_agg(o, '' ORDER BY k.i) FROM written k WHERE k.product_id = n.product_id AND k.i >= n.i AND k.i < n.last)
    || coalesce((SELECT array_to_string(list_transform(list_filter(CASE WHEN n.last > e.n THEN list_reverse(e.open_) ELSE (SELECT popped FROM steps z WHERE z.product_id = n.product_id AND z.i = n.last) END, lambda x: x.i >= n.i), lambda x: '</' || x.name || '>'), '') WHERE n.i IN (SELECT s.i FROM steps s WHERE s.product_id = n.product_id AND s.kind = 'start')), '') AS markup
  FROM nodes n JOIN ends e USING (product_id)),
roots AS (SELECT product_id, arg_min({'i': i, 'last': last}, (CASE WHEN name = 'div' AND spc THEN 0 WHEN name = 'body' THEN 1 ELSE 2 END, i)) AS r FROM nodes GROUP BY product_id),
marks AS (
  SELECT n.*, regexp_matches(line, '(?i)\b4\.?\s*8\b.*\b(?:undesirable\s+effects|adverse\s+reactions)\b') AS a, regexp_matches(line, '(?i)\b4\.?\s*9\b(?:\s+overdose)?\b') AS z
  FROM nodes n JOIN texts USING (product_id, i) JOIN roots USING (product_id)
  WHERE n.i > r.i AND n.i < r.last AND line <> '' AND name IN ('summary', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'strong', 'b', 'div', 'span') AND (name NOT IN ('div', 'span', 'p') OR length(line) <= 220)),
firsts AS (SELECT product_id, min(i) AS first_ FROM marks WHERE a GROUP BY product_id),
both_ AS (SELECT product_id, first_, (SELECT min(i) FROM marks m WHERE m.product_id = f.product_id AND z AND i > first_) AS final_ FROM firsts f),
asked AS (SELECT product_id, 'first' AS what, first_ AS i FROM both_ UNION ALL SELECT product_id, 'final', final_ FROM both_ WHERE final_ IS NOT NULL),
climb AS (
  SELECT a.product_id, what, i AS tag, i AS box FROM asked a
  UNION ALL
  SELECT c.product_id, what, tag, n.parent FROM climb c JOIN nodes n ON n.product_id = c.product_id AND n.i = c.box JOIN nodes p ON p.product_id = c.product_id AND p.i = n.parent JOIN roots r ON r.product_id = c.product_id
  WHERE n.parent <> r.r.i AND p.name IN ('details', 'section', 'article', 'div', 'p')),
boxes AS (SELECT product_id, what, min(box) AS box FROM climb GROUP BY product_id, what),
sides AS (
  SELECT a.product_id, a.what, b.box, t.parent AS fold, t.name = 'summary' AND coalesce(p.name = 'details', false) AS folded
  FROM asked a JOIN boxes b USING (product_id, what) JOIN nodes t ON t.product_id = a.product_id AND t.i = a.i LEFT JOIN nodes p ON p.product_id = a.product_id AND p.i = t.parent),
pairs_ AS (SELECT x.product_id, x.box, x.fold, x.folded, y.box AS z_box, y.fold AS z_fold, coalesce(y.folded, false) AS z_folded, y.box IS NOT NULL AS end_found FROM sides x LEFT JOIN sides y ON y.product_id = x.product_id AND y.what = 'final' WHERE x.what = 'first'),
kin AS (SELECT n.product_id, n.i, n.last, coalesce(n.parent, 0) AS parent, markup FROM nodes n JOIN texts USING (product_id, i)),
spots AS (
  SELECT p.*, (SELECT min(s.i) FROM kin s JOIN kin o ON o.product_id = s.product_id AND o.i = p.fold WHERE s.product_id = p.product_id AND s.parent = o.parent AND s.markup = o.markup) AS fa,
         (SELECT min(s.i) FROM kin s JOIN kin o ON o.product_id = s.product_id AND o.i = p.fold JOIN kin e ON e.product_id = s.product_id AND e.i = p.z_fold WHERE p.z_folded AND s.product_id = p.product_id AND s.parent = o.parent AND s.markup = e.markup) AS fz,
         (SELECT min(s.i) FROM kin s JOIN kin o ON o.product_id = s.product_id AND o.i = p.box WHERE s.product_id = p.product_id AND s.parent = o.parent AND s.markup = o.markup) AS ba,
         (SELECT min(s.i) FROM kin s JOIN kin o ON o.product_id = s.product_id AND o.i = p.box JOIN kin e ON e.product_id = s.product_id AND e.i = p.z_box WHERE s.product_id = p.product_id AND s.parent = o.parent AND s.markup = e.markup) AS bz
  FROM pairs_ p),
picks AS (
  SELECT *, folded AND (fz IS NULL OR fz > fa) AS by_fold, CASE WHEN folded AND (fz IS NULL OR fz > fa) THEN fold ELSE box END AS own,
         CASE WHEN folded AND (fz IS NULL OR fz > fa) THEN fa WHEN bz <= ba THEN box ELSE ba END AS lo, CASE WHEN folded AND (fz IS NULL OR fz > fa) THEN fz WHEN bz <= ba THEN box + 1 ELSE bz END AS hi
  FROM spots),
chosen AS (SELECT p.product_id, s.i, s.last, s.markup FROM picks p JOIN kin o ON o.product_id = p.product_id AND o.i = p.own JOIN kin s ON s.product_id = p.product_id AND s.parent = o.parent AND s.i >= lo AND (hi IS NULL OR s.i < hi)),
inside AS (SELECT c.product_id, bool_or(n.name = 'table') AS tables_, bool_or(n.name IN ('ul', 'ol')) AS lists_ FROM chosen c JOIN nodes n ON n.product_id = c.product_id AND n.i >= c.i AND n.i < c.last GROUP BY c.product_id),
contents AS (SELECT product_id, trim(string_agg(markup, chr(10) ORDER BY i)) AS content FROM chosen GROUP BY product_id),
sections_ AS (
  SELECT l.product_id, p.product_id IS NOT NULL AS found, CASE WHEN p.product_id IS NULL THEN 'not_found' WHEN by_fold THEN 'details_summary' ELSE 'generic_fallback' END AS method, coalesce(end_found, false) AS end_found,
         coalesce(content, '') AS content, coalesce(tables_, false) AS has_table, coalesce(lists_, false) AS has_list
  FROM leaflets l LEFT JOIN picks p USING (product_id) LEFT JOIN contents USING (product_id) LEFT JOIN inside USING (product_id))"""


#: Strings of pages in order: what stands between tags, without scripts and styles.
STRINGS = r"""
WITH tokens AS (
  SELECT page_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>|</?[a-z][^>]*>|[^<]+') AS ts FROM pages)),
strings AS (
  SELECT page_id, i, CASE WHEN t = '<br>' THEN chr(10) ELSE regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') END AS s, t = '<br>' AS br
  FROM tokens WHERE t = '<br>' OR t NOT LIKE '<%')"""


def _values(table: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table.items())


MANUAL = """
manual AS (
  SELECT l_partkey AS move, CAST(l_partkey AS VARCHAR) AS product_id, replace(lower(min(s_name)), '#', ' ') AS gk, replace(lower(max(s_name)), '#', ' ') AS pk
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey HAVING min(s_name) <> max(s_name)),
used AS (SELECT * FROM manual SEMI JOIN (SELECT product_id, key AS gk FROM gold) USING (product_id, gk) SEMI JOIN (SELECT product_id, key AS pk FROM pred) USING (product_id, pk)),
moved AS (
  SELECT *, -1 AS move FROM pred
  UNION ALL SELECT pred.* REPLACE (gk AS key), move FROM pred JOIN used ON pred.product_id = used.product_id AND key = pk),
left_ AS (SELECT * FROM moved WHERE (product_id, key) NOT IN (SELECT (product_id, pk) FROM used))"""
RATES = """
SELECT CAST(TP AS BIGINT) AS TP, CAST(FP AS BIGINT) AS FP, CAST(FN AS BIGINT) AS FN, CAST(freq AS BIGINT) AS freq, CAST(soc AS BIGINT) AS soc, CAST(b AS BIGINT) AS both, CAST(TP + FP AS BIGINT) AS n_pred, CAST(TP + FN AS BIGINT) AS n_gold, CAST(TP AS BIGINT) AS n_tp,
  TP / (TP + FP) AS precision, TP / (TP + FN) AS recall, 2 * (TP / (TP + FP)) * (TP / (TP + FN)) / (TP / (TP + FP) + TP / (TP + FN)) AS f1,
  freq / TP AS frequency_accuracy, soc / TP AS soc_accuracy, b / TP AS all_fields_accuracy""" + "".join(
    f""", greatest(0.0, ({k} / {n} + 1.9208 / {n} - 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n})) AS {name}_ci95_low,
  least(1.0, ({k} / {n} + 1.9208 / {n} + 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n})) AS {name}_ci95_high"""
    for name, k, n in (("precision", "TP", "(TP + FP)"), ("recall", "TP", "(TP + FN)"), ("frequency", "freq", "TP"), ("soc", "soc", "TP"), ("all_fields", "b", "TP"))
)
TERMS = """
terms AS (
  SELECT o_orderkey AS seq, c_name AS adr_term, lower(c_name) AS term, o_custkey AS k,
         CASE WHEN o_custkey % 9 = 1 AND o_orderkey % 2 = 0 THEN CAST(10000000 + o_custkey AS VARCHAR) ELSE '0' END AS meddra_code
  FROM orders JOIN customer ON o_custkey = c_custkey),
found AS (
  SELECT DISTINCT adr_term, term, k, CASE WHEN k % 3 > 0 THEN CAST(10000000 + k AS VARCHAR) ELSE '' END AS code,
         CASE k % 3 WHEN 1 THEN c_name || ' ' || c_mktsegment WHEN 2 THEN upper(c_name) ELSE '' END AS matched_name,
         CASE k % 3 WHEN 1 THEN 'matched_words' WHEN 2 THEN 'matched_exact' ELSE 'not_found' END AS status
  FROM terms JOIN customer ON k = c_custkey),
firsts AS (
  SELECT term, k, coalesce(min(seq) FILTER (meddra_code <> '0'), min(seq)) AS seq, coalesce(max(meddra_code) FILTER (meddra_code <> '0'), '0') AS meddra_code FROM terms GROUP BY term, k)"""

ORACLES = {
    "g1_adr_per_drug": f"WITH {ENTITIES} SELECT label AS drugLabel, count(DISTINCT occ_id) AS numADR FROM fact JOIN drug USING (product_id) GROUP BY label",
    "g2_top_adrs": f"WITH {ENTITIES} SELECT adr_term AS adrLabel, count(DISTINCT drug_id) AS numDrugs FROM fact GROUP BY adr_term ORDER BY 2 DESC, 1 LIMIT 20",
    "g3_atc_categories": f"WITH {DRUG} SELECT substr(atc_code, 1, 1) AS atcCategory, count(*) AS count FROM drug GROUP BY 1",
    "g4_by_frequency": f"WITH {ENTITIES} SELECT label AS drugLabel, adr_term AS adrLabel, soc FROM fact JOIN drug USING (product_id) WHERE frequency = 'common'",
    "g5_soc_distribution": f"WITH {ENTITIES} SELECT soc, count(*) AS count FROM fact WHERE soc <> 'UNKNOWN' GROUP BY soc",
    "g6_drug_atc_summary": f"WITH {ENTITIES} SELECT label AS drugLabel, atc_code AS atcCode, count(DISTINCT occ_id) AS adrCount FROM fact JOIN drug USING (product_id) GROUP BY ALL",
    "g7_patient_scenario": f"""WITH {ENTITIES} SELECT d.product_id AS pid, label AS drugLabel, atc_code AS atcCode, coalesce(adr_term, '') AS adrLabel, coalesce(frequency, '') AS frequency, coalesce(soc, '') AS soc
        FROM drug d LEFT JOIN (SELECT fact.* FROM fact JOIN adr USING (adr_term) WHERE meddra_code = '10000001') f USING (product_id) WHERE d.product_id IN ('1', '2', '3', '7')""",
    "a5_adr_dim": f"WITH {ROWS}, {ADR} SELECT * FROM adr",
    "a6_occurrences": f"WITH {ROWS}, {OCC} SELECT * FROM occ",
    "j3_drug_dim": f"WITH {DRUG} SELECT * FROM drug",
    "t1_smpc_dim": f"WITH {DRUG}, {SMPC} SELECT * FROM smpc",
    "j4_occurrence_fact": f"WITH {ENTITIES} SELECT * FROM fact",
    "t2_triples": f"WITH {ENTITIES}, {TRIPLES} SELECT * FROM triple UNION {_schema_rows()}",
    "q1_cardinality": f"WITH {ENTITIES} SELECT occ_id AS s, 'soc' AS p, CAST(0 AS BIGINT) AS n FROM fact WHERE soc = 'UNKNOWN'",
    "q2_validate": f"WITH {ENTITIES}, {TRIPLES} SELECT 'VALID' AS verdict, (SELECT count(*) FROM triple) + 65 AS triples, (SELECT count(*) FROM fact) AS occurrences, CAST(0 AS BIGINT) AS violations, false AS forbidden",
    "j8_dangling": f"WITH {ENTITIES} SELECT DISTINCT smpc_id FROM fact WHERE product_id LIKE '%7'",
    "a12_quality_report": f"""WITH {ENTITIES}, codes AS (
        SELECT 'atc_code' AS "check", atc_code AS c, 'UNKNOWN' AS none, atc_code IN ('A10BA02', 'C09', 'N05AH03') AS ok FROM drug
        UNION ALL SELECT 'meddra_code', meddra_code, '0', regexp_full_match(meddra_code, '\\d{{7,8}}') FROM adr
        UNION ALL SELECT 'icd_code', icd_code, 'UNKNOWN', regexp_full_match(icd_code, '[A-Z]\\d{{1,2}}(\\.\\d+)?') FROM adr)
        SELECT "check", unnest(['total', 'filled', 'missing', 'bad_shape', 'percent']) AS metric,
               unnest([count(*), count(*) FILTER (c <> none), count(*) FILTER (c = none), count(*) FILTER (c <> none AND NOT ok), 100 * count(*) FILTER (c <> none) // count(*)]) AS value FROM codes GROUP BY "check"
        UNION ALL SELECT 'individuals', unnest(['drugs', 'adrs', 'smpcs', 'occurrences']), unnest([(SELECT count(*) FROM drug), (SELECT count(*) FROM adr), (SELECT count(*) FROM smpc), (SELECT count(*) FROM fact)])
        UNION ALL SELECT 'links', unnest(['references', 'targets', 'dangling', 'shared_names']), unnest([count(*), count(DISTINCT smpc_id), 0, 0]) FROM fact
        UNION ALL SELECT 'occurrences', unnest(['with_frequency', 'with_soc', 'with_adr', 'with_drug', 'frequency_filled', 'frequency_unknown', 'soc_filled', 'soc_unknown']),
          unnest([count(*), count(*), count(*), count(*), count(*) FILTER (frequency <> 'not known'), count(*) FILTER (frequency = 'not known'), count(*) FILTER (soc <> 'UNKNOWN'), count(*) FILTER (soc = 'UNKNOWN')]) FROM fact
        UNION ALL SELECT 'labels', unnest(['drug_labels', 'adr_labels', 'urls', 'bad_urls']), unnest([(SELECT count(*) FROM drug), (SELECT count(*) FROM adr), (SELECT count(*) FROM smpc), 0])""",
    "io9_turtle": f"""WITH {ENTITIES}
        SELECT 1 AS part, product_id AS key, chr(10) || ':' || slug || ' rdf:type owl:NamedIndividual ,' || chr(10) || '    :Drug ;' || chr(10) || '    :productId "' || product_id || '" ;' || chr(10) || '    :drugLabel "' || label || '" ;' || chr(10) || '    :atcCode "' || atc_code || '" .' AS block FROM drug
        UNION ALL SELECT 2, adr_term, chr(10) || ':' || slug || ' rdf:type owl:NamedIndividual ,' || chr(10) || '    :AdverseDrugReaction ;' || chr(10) || '    :adrLabel "' || adr_term || '" ;' || chr(10) || '    :meddraPreferredTerm "' || meddra_preferred_term || '" ;' || chr(10) || '    :meddraCode "' || meddra_code || '" ;' || chr(10) || '    :icdCode "' || icd_code || '" .' FROM adr
        UNION ALL SELECT 3, product_id, chr(10) || ':' || slug || ' rdf:type owl:NamedIndividual ,' || chr(10) || '    :SmPCDocument ;' || chr(10) || '    :productId "' || product_id || '" ;' || chr(10) || '    :sourceUrl "' || source_url || '" .' FROM smpc
        UNION ALL SELECT 4, product_id || '|' || adr_term, chr(10) || ':' || occ_id || ' rdf:type owl:NamedIndividual ,' || chr(10) || '    :DrugAdrOccurrence ;' || chr(10) || '    :occurrenceOfAdr :' || adr_id || ' ;' || chr(10) || '    :refersToSmPC :' || smpc_id || ' ;' || chr(10) || '    :productId "' || product_id || '" ;' || chr(10) || '    :frequency "' || frequency || '" ;' || chr(10) || '    :soc "' || soc || '" .' || chr(10) || ':' || drug_id || ' :hasOccurrence :' || occ_id || ' .' FROM fact""",
    "w1_slugs": """WITH RECURSIVE rows_ AS (
          SELECT p_partkey AS seq, p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(replace(lower(p_name), ' ', '_'), '_', 2 + p_size % 12) ELSE replace(lower(p_name), ' ', '_') END AS base,
                 row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part),
        taken AS (
          SELECT p_name, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT p_name FROM rows_)
          UNION ALL
          SELECT t.p_name, r.n, list_append(used, CASE WHEN NOT list_contains(used, base) THEN base
            ELSE concat(base, '_', list_min(list_filter(range(2, len(used) + 3), lambda k: NOT list_contains(used, concat(base, '_', k))))) END)
          FROM taken t JOIN rows_ r ON r.p_name = t.p_name AND r.n = t.n + 1)
        SELECT seq, base, used[len(used)] AS slug FROM rows_ JOIN taken USING (p_name, n)""",
    "a7_coverage": f"WITH {ROWS}, {ADR} SELECT count(*) FILTER (meddra_code <> '0') AS filled, count(*) AS total, 100 * count(*) FILTER (meddra_code <> '0') // count(*) AS percent FROM adr",
    "a9_adr_counts": "SELECT CAST(p_partkey AS VARCHAR) AS product_id, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey",
    "a1_log_summary": f"""WITH {LOG} SELECT count(*) AS total, count(*) FILTER (status <> 'SKIPPED_EXISTS') AS attempted, count(*) FILTER (status = 'SUCCESS') AS success,
        count(*) FILTER (status LIKE 'HTTP%') AS errors, round(avg(ms), 2) AS avg_duration_ms, CAST(max(ms) AS DOUBLE) AS max_duration_ms,
        round(100.0 * count(*) FILTER (status = 'SUCCESS') / count(*) FILTER (status <> 'SKIPPED_EXISTS'), 2) AS success_rate,
        round(100.0 * count(*) FILTER (status LIKE 'HTTP%') / count(*) FILTER (status <> 'SKIPPED_EXISTS'), 2) AS error_rate FROM log""",
    "a2_log_distributions": _distributions(),
    "f2_log_since": _distributions("timestamp >= TIMESTAMP '2024-01-15'"),
    "a3_run_summary": f"""WITH {LOG} SELECT count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'HTTP_404') AS http_404, count(*) FILTER (status = 'HTTP_ERROR') AS http_error,
        count(*) FILTER (status = 'REQUEST_ERROR') AS request_error, count(*) FILTER (status = 'SKIPPED_EXISTS') AS skipped_exists, (SELECT count(*) FROM part) AS ids_loaded, (SELECT count(*) FROM pages) AS manifest_rows FROM log""",
    "f3_fetch_status": "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'SKIPPED_EXISTS' WHEN event_type = 'click' THEN 'SUCCESS' WHEN event_type = 'error' THEN 'HTTP_404' WHEN event_type = 'signup' THEN 'HTTP_ERROR' ELSE 'REQUEST_ERROR' END AS status FROM events",
    "io10_failed_ids": f"WITH {LOG} SELECT DISTINCT product_id FROM log WHERE status = 'HTTP_ERROR'",
    "io10_missing_ids": f"WITH {LOG} SELECT DISTINCT product_id FROM log WHERE status = 'HTTP_404'",
    "status_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "j1_pending": f"WITH {LOG} SELECT CAST(c_custkey AS VARCHAR) AS product_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT product_id FROM log WHERE status = 'SUCCESS')",
    "j1_resumed": """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS brand_name, upper(p_name) AS active_substance,
        CASE WHEN p_name LIKE '%ring' THEN 'Failed' WHEN p_size <= 25 THEN 'Skipped' ELSE 'Success' END AS status FROM part""",
    "u5_product_ids": "SELECT DISTINCT page_id AS product_id FROM pages WHERE page_id % 3 < 2",
    "s2_sitemaps": "SELECT replace(url, '&', '') AS url, false AS is_sitemap FROM pages UNION ALL SELECT concat('http://a.b/', page_id, '.xml'), true FROM pages",
    "u1_run_membership": f"WITH {RUNS} SELECT runs, count(*) AS keys FROM (SELECT count(DISTINCT run) AS runs FROM runs GROUP BY product_id, term) GROUP BY runs",
    "u2_run_membership_full": f"WITH {RUNS} SELECT runs, count(*) AS keys FROM (SELECT count(DISTINCT run) AS runs FROM runs GROUP BY product_id, term, frequency) GROUP BY runs",
    "u3_compare_sets": f"""WITH {RUNS}, k AS (SELECT product_id, term, frequency, bool_or(run = 0) AS a, bool_or(run = 1) AS b FROM runs WHERE run < 2 GROUP BY ALL)
        SELECT product_id, count(*) FILTER (a) AS "left", count(*) FILTER (b) AS "right", count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right FROM k GROUP BY product_id""",
    "u4_run_row_counts": """WITH e AS (SELECT event_id % 3 AS run, CAST(user_id AS VARCHAR) AS product_id FROM events)
        SELECT concat('rows_', r.run) AS metric, p.product_id, count(e.run) AS value FROM (SELECT DISTINCT run FROM e) r CROSS JOIN (SELECT DISTINCT product_id FROM e) p LEFT JOIN e ON e.run = r.run AND e.product_id = p.product_id GROUP BY ALL""",
    "w4_match_table": f"WITH {SIDES}, {_pairs()} SELECT * REPLACE (coalesce(freq_ok, -1) AS freq_ok, coalesce(soc_ok, -1) AS soc_ok) FROM matches",
    "w3_manual_matches": f"WITH {SIDES}, {MANUAL}, {_pairs('left_', 'move')} SELECT product_id, count(*) FILTER (status = 'TP') AS TP, count(*) FILTER (status = 'FP') AS FP, count(*) FILTER (status = 'FN') AS FN FROM matches GROUP BY product_id",
    "s11_soc_map": f"""WITH {SIDES}, {_pairs()} SELECT status, count(*) AS n, count(*) FILTER (status = 'TP' AND replace(gold_soc, 'F', 'O') = replace(pred_soc, 'F', 'O')) AS soc,
        printf('%.1f%%', 100.0 * count(*) FILTER (status = 'TP' AND replace(gold_soc, 'F', 'O') = replace(pred_soc, 'F', 'O')) / count(*)) AS share FROM matches GROUP BY status""",
    "l1_first_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25",
    "a10_eval_summary": f"""WITH {SIDES}, {_pairs()}, t AS (SELECT CAST(count(*) FILTER (status = 'TP') AS DOUBLE) AS TP, count(*) FILTER (status = 'FP') AS FP, count(*) FILTER (status = 'FN') AS FN,
        count(*) FILTER (freq_ok = 1) AS freq, count(*) FILTER (soc_ok = 1) AS soc, count(*) FILTER (freq_ok = 1 AND soc_ok = 1) AS b FROM matches) {RATES} FROM t""",
    "a10_eval_per_product": f"""WITH {SIDES}, {_pairs()}, t AS (SELECT product_id, count(*) FILTER (status = 'TP') AS TP, count(*) FILTER (status = 'FP') AS FP, count(*) FILTER (status = 'FN') AS FN FROM matches GROUP BY product_id)
        SELECT *, TP / (TP + FP) AS precision, TP / (TP + FN) AS recall FROM t""",
    "a11_error_tally": f"WITH {SIDES}, {_pairs()} SELECT CASE WHEN gold_term <> '' THEN right(gold_term, 1) ELSE left(right(pred_term, 2), 1) END AS error_category, count(*) AS count FROM matches WHERE status <> 'TP' GROUP BY 1",
    "w5_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "w6_second_sample": """SELECT doc_id, lang, CAST(coalesce(n, 0) AS BIGINT) AS n FROM documents LEFT JOIN (SELECT doc_id, sum(quality) AS n FROM labels GROUP BY doc_id) USING (doc_id)
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND coalesce(n, 0) <= 0 ORDER BY md5('7:' || doc_id), doc_id LIMIT 5""",
    "w7_picks": """WITH d AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) % 97 AS INTEGER) AS n, lang = 'en' AS has_table FROM documents),
        a AS (SELECT *, 'long' AS reason, 0 AS pick FROM d WHERE chars > 8000 ORDER BY n, chars, doc_id LIMIT 1),
        b AS (SELECT *, 'table' AS reason, 1 AS pick FROM d WHERE has_table AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n, chars, doc_id LIMIT 1),
        c AS (SELECT *, 'free text' AS reason, 2 AS pick FROM d WHERE NOT has_table AND doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY n, chars, doc_id LIMIT 1),
        e AS (SELECT *, 'small' AS reason, 3 AS pick FROM d WHERE n < 40 AND doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b UNION ALL SELECT doc_id FROM c) ORDER BY n, chars, doc_id LIMIT 1),
        f AS (SELECT *, 'small too' AS reason, 4 AS pick FROM d WHERE n < 40 AND doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b UNION ALL SELECT doc_id FROM c UNION ALL SELECT doc_id FROM e) ORDER BY n, chars, doc_id LIMIT 1)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f""",
    "a8_length_stats": """SELECT count(*) AS n, count(*) FILTER (length(text) > 8000) AS over, 100.0 * count(*) FILTER (length(text) > 8000) / count(*) AS over_percent,
        quantile_cont(length(text), 0.5) AS median, quantile_cont(length(text), 0.9) AS p90, CAST(max(length(text)) AS BIGINT) AS longest FROM documents""",
    "x1_page_text": rf"""{STRINGS} SELECT page_id, coalesce(x, '') AS text FROM pages LEFT JOIN (
          SELECT page_id, string_agg(y, chr(10) ORDER BY i) AS x FROM (SELECT page_id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS y FROM strings WHERE NOT br) WHERE y <> '' GROUP BY page_id) USING (page_id)""",
    "x6_clean_text": rf"""{STRINGS} SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
        FROM pages LEFT JOIN (SELECT page_id, string_agg(s, ' ' ORDER BY i) AS x FROM strings GROUP BY page_id) USING (page_id)""",
    "j2_overrides": f"""WITH named(product_id, inn) AS (VALUES {_values(fixed.INGREDIENTS)}), wins(product_id, code) AS (VALUES {_values(fixed.ATC_OVERRIDES)}),
        found(inn, code) AS (VALUES ('ibuprofen', 'C01EB16'), ('sotalol', 'C07AA07'))
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, coalesce(n.inn, '') AS active_ingredient, coalesce(w.code, f.code, 'UNKNOWN') AS atc_code,
               CASE WHEN w.code IS NOT NULL THEN 'manual_who_atc' WHEN n.inn IS NULL THEN 'inn not in map' WHEN f.code IS NOT NULL THEN 'rxnorm_direct' ELSE 'not found in RxNorm' END AS atc_source
        FROM part LEFT JOIN named n ON n.product_id = CAST(p_partkey AS VARCHAR) LEFT JOIN wins w ON w.product_id = CAST(p_partkey AS VARCHAR) LEFT JOIN found f ON f.inn = n.inn""",
    "x3_sections": f"{SECTIONS} SELECT product_id, found, method, end_found, has_table, has_list, md5(content) AS content_md5 FROM sections_",
    "x4_section_blocks": f"""{SECTIONS}, good AS (SELECT *, found AND content <> '' AND product_id % 9 > 0 AS ok FROM sections_)
        SELECT product_id, CASE WHEN ok THEN 'Success' ELSE 'Failed' END AS status, ok AS found_4_8, ok AND has_table AS has_table, ok AND has_list AS has_list FROM good""",
    "a4_audit_summary": f"""{SECTIONS}, tallied AS (
          SELECT 'method' AS kind, method AS value FROM sections_ UNION ALL SELECT 'end_found', CAST(end_found AS VARCHAR) FROM sections_ UNION ALL SELECT 'small', CAST(length(content) < 500 AS VARCHAR) FROM sections_)
        SELECT kind, value, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM pages) AS percent FROM tallied GROUP BY kind, value""",
    "x8_drug_names": """WITH t AS (SELECT page_id, regexp_replace(replace(regexp_extract(html, '<article><h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;?', '&', 'g') AS name, html LIKE '%</body>%' AS there FROM pages)
        SELECT CAST(page_id AS VARCHAR) AS product_id, CASE WHEN there AND page_id % 6 IN (1, 2) THEN substr(trim(name), 1, 300) ELSE '' END AS brand_name,
        CASE WHEN NOT there THEN 'Failed' WHEN page_id % 6 IN (1, 2) AND trim(name) <> '' THEN 'Success' ELSE 'EmptyExtraction' END AS status FROM t""",
    "x9_prompts": "SELECT doc_id, md5('List all reactions.' || chr(10) || coalesce(text, '') || chr(10) || 'End.') AS prompt_md5 FROM documents",
    "x10_adr_rows": """SELECT event_id AS product_id, 0 AS pos, concat('T', event_id) AS adr_term, 'common' AS frequency, '' AS soc FROM events WHERE event_id % 5 > 0
        UNION ALL SELECT event_id, 1, event_type, '', '' FROM events WHERE event_id % 5 > 0""",
    "x10_adr_log": "SELECT event_id AS product_id, CASE WHEN event_id % 5 = 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS adr_count, CASE WHEN event_id % 5 = 0 THEN 'answer is no JSON object' ELSE '' END AS error FROM events",
    "x11_substances": "SELECT event_id AS product_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'ab ' || event_type END AS active_substance, CASE WHEN event_id % 5 = 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN event_id % 5 = 0 THEN 'empty_result' ELSE '' END AS error FROM events",
    "v1_lookup": f"WITH {TERMS} SELECT adr_term AS term, code, matched_name, 'MDR' AS source, status FROM found",
    "v2_meddra_second_pass": """WITH asked AS (
          SELECT lower(c_name) AS term FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name HAVING NOT bool_or(o_custkey % 9 = 1 AND o_orderkey % 2 = 0)),
        names AS (SELECT CAST(10000000 + c_custkey AS VARCHAR) AS code, CASE WHEN c_custkey % 3 = 1 THEN concat(c_name, ' ', c_mktsegment) ELSE upper(c_name) END AS name FROM customer WHERE c_custkey % 3 > 0),
        form AS (SELECT *, list_sort(string_split(replace(lower(name), '#', ' '), ' ')) AS words FROM names),
        hits AS (
          SELECT term, 0 AS mode, 0 AS edits, code, name FROM asked JOIN form ON list_sort(string_split(replace(term, '#', ' '), ' ')) = words
          UNION ALL SELECT term, 1, levenshtein(term, lower(name)), code, name FROM asked, names WHERE 1 - levenshtein(term, lower(name)) / greatest(length(term), length(name)) >= 0.8),
        best AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY mode, edits, length(name), code, name) AS n FROM hits)
        SELECT a.term AS original_term, a.term AS cleaned_candidate, coalesce(code, '0') AS meddra_code, coalesce(name, '') AS meddra_preferred_term FROM asked a LEFT JOIN best b ON a.term = b.term AND n = 1""",
    "v6_icd_targets": f"WITH {TERMS} SELECT term, seq, meddra_code, CASE WHEN meddra_code = '0' THEN 'freetext' ELSE 'crosswalk' END AS way FROM firsts",
    "j11_icd_crosswalk": f"""WITH {TERMS} SELECT term, meddra_code, CASE WHEN k % 2 = 0 THEN concat('K', k) ELSE 'UNKNOWN' END AS icd_code_new,
        CASE WHEN meddra_code <> '0' AND k % 2 = 0 THEN 'crosswalk' ELSE 'freetext' END AS source FROM firsts""",
    "j5_backfill": f"""WITH {TERMS} SELECT seq, CASE WHEN meddra_code = '0' AND k % 4 = 0 THEN CAST(20000000 + k AS VARCHAR) ELSE meddra_code END AS meddra_code,
        CASE WHEN meddra_code = '0' AND k % 4 = 0 THEN lower(c_mktsegment) ELSE '' END AS meddra_preferred_term FROM terms JOIN customer ON k = c_custkey""",
    "j6_apply_matches": f"""WITH {TERMS} SELECT seq, CASE WHEN k % 3 > 0 THEN CAST(10000000 + k AS VARCHAR) ELSE '0' END AS meddra_code, CASE WHEN k % 2 = 0 THEN concat('http://icd/K', k) ELSE 'UNKNOWN' END AS icd_code,
        adr_term AS meddra_preferred_term FROM terms""",
    "j10_icd_provenance": """SELECT CASE c_custkey % 3 WHEN 1 THEN 'pass1:ICD10CM' WHEN 2 THEN 'pass1:ambiguous' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'pass2:source_not_logged' ELSE 'unattributed' END END AS origin, count(*) AS count
        FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1""",
    "v7_atc_lookup": """WITH c AS (SELECT o_custkey AS t, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        b AS (SELECT t, arg_min(CASE WHEN k % 17 = 0 THEN k ELSE -k - 1 END, n) FILTER (k % 17 = 0 OR (k % 17 = 16 AND k + 1 IN (SELECT o_orderkey FROM orders))) AS k FROM c WHERE n <= 5 GROUP BY t)
        SELECT concat('s', c_custkey, ', other') AS inn, CASE WHEN k IS NULL THEN 'UNKNOWN' ELSE concat('A', abs(k)) END AS atc_code, CASE WHEN k IS NULL THEN 'not found in RxNorm' WHEN k >= 0 THEN 'rxnorm_direct' ELSE 'rxnorm_via_ingredient' END AS atc_source
        FROM customer LEFT JOIN b ON c_custkey = t""",
    "v8_atc_by_brand": """SELECT o_orderkey AS product_id, translate(concat('Brand', o_custkey), '0123456789', 'abcdefghij') AS query, CASE WHEN o_custkey % 2 = 0 THEN concat('A', o_custkey) ELSE 'UNKNOWN' END AS atc_code,
        CASE WHEN o_custkey % 2 = 0 THEN 'matched_exact' ELSE 'not_found' END AS status FROM orders""",
    "v9_lookup_log": f"""WITH {TERMS} SELECT 'drug' AS entity_type, p_name AS entity_value, p_name AS query_used, 'atc_code' AS target_field, 'ATC' AS source_vocab, 'UNKNOWN' AS matched_code, '' AS matched_name, 'not_found' AS status FROM part
        UNION ALL SELECT 'adr', terms.adr_term, terms.adr_term, 'meddra_code', 'MDR', CASE WHEN code = '' THEN '0' ELSE code END, matched_name, status FROM terms JOIN found USING (adr_term)
        UNION ALL SELECT 'adr', adr_term, adr_term, 'icd_code', 'ICD10CM', CASE WHEN k % 2 = 0 THEN concat('http://icd/K', k) ELSE 'UNKNOWN' END, CASE WHEN k % 2 = 0 THEN adr_term ELSE '' END, CASE WHEN k % 2 = 0 THEN 'matched_exact' ELSE 'not_found' END FROM terms""",
    "s_scalars": """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS INTEGER) AS safe_int, concat('a_b_x_', event_type, '_cd_', event_id % 10) AS slug,
        concat('occ_', user_id, '_', substr(sha1(concat(user_id, '|', event_type)), 1, 12)) AS occ_id, concat('a-b ', event_type, ' & c/d  ', event_id % 10) AS search_term,
        concat('a b x ', event_type, ' and c d ', event_id % 10) AS eval_term, concat('a b (x) ', event_type, ' & c/d ', event_id % 10) AS eval_frequency,
        concat('a-b (x) ', event_type, ' & c/d ', event_id % 10) AS run_term, replace(props, '"', chr(92) || '"') AS literal, concat('A-b (x) ', event_type, ' & C/d ', event_id % 10) AS tidy,
        concat('https://www.medicines.org.uk/emc/product/', user_id, '/smpc/print') AS url, upper(substr(event_type, 1, 1)) AS level, event_id % 300 < 100 AS icd_ok FROM events""",
}
