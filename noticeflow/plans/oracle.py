"""Equivalent DuckDB SQL for the table queries (the correctness oracle).

Plain SQL over the same parquet tables.  Fragments (text key, strict date
parse, URL split) are small SQL generators; the white-space classes, the date
and URL patterns and some constants are the implementation's own, so a wrong one
would agree with itself here (the function tests hold them against Python's
library).  Scope notes: the key uses ``strip_accents`` + ``lower`` (equal to the
NFKD/casefold key on Latin text, which is what the tables contain); the URL
join covers absolute, network-path and root-relative links (the page tables
have no dot segments).
"""

from __future__ import annotations

from .. import fixed_values as fv
from ..functions import dates as dtf
from ..functions import unicode_maps as um
from ..functions import urls as urf
from . import table_queries as tq

WS = um.java_class(um.python_whitespace())
JS_TRIM = um.java_class(um.js_trim_chars())
DMY = dtf.DMY_PATTERN
URL = urf.URL_PATTERN


def lit(s: str) -> str:
    """A SQL string expression for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def K(x: str) -> str:
    return (f"trim(regexp_replace(replace(lower(strip_accents(coalesce({x}, ''))), 'ß', 'ss'), "
            f"'{WS}+', ' ', 'g'))")


def CLEAN(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def PYSTRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def SK(x: str) -> str:
    return f"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '^{JS_TRIM}+|{JS_TRIM}+$', '', 'g')"


def ID(*parts: str, code: str | None = None) -> str:
    ps = [K(p) for p in parts]
    if code is not None:
        ps.append(f"CASE WHEN {code} IS NOT NULL AND {code} <> '' THEN {K(code)} END")
    return f"substr(sha256(concat_ws('|', {', '.join(ps)})), 1, 20)"


def BASE(*parts: str) -> str:
    return f"concat_ws('|', {', '.join(K(p) for p in parts)})"


def SLUG(x: str) -> str:
    s = f"regexp_replace({K(x)}, '[^a-z0-9]+', '-', 'g')"
    s = f"substr(regexp_replace({s}, '^-+|-+$', '', 'g'), 1, 80)"
    return f"regexp_replace(CASE WHEN {s} = '' THEN 'oferta' ELSE {s} END, '-+$', '')"


def FILE(ident: str, title: str) -> str:
    inner = ident + " || '-' || coalesce(" + title + ", '')"
    return "(" + SLUG(inner) + " || '.html')"


def DMYP(x: str) -> str:
    a = "^" + DMY.lstrip("^").rstrip("$") + "$"
    y, m, d = (f"regexp_extract({x}, '{a}', {i})" for i in (3, 2, 1))
    iso = f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad(trim({d}), 2, '0')"
    return (f"(CASE WHEN regexp_full_match({x}, '{DMY.lstrip('^').rstrip('$')}') AND {y} <> '0000' "
            f"THEN CAST(try_strptime({iso}, '%Y-%m-%d') AS DATE) END)")


def PREP(u: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({u}, ''), '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"


def G(u: str, i: int) -> str:
    return f"regexp_extract({PREP(u)}, '{URL}', {i})"


def SCHEME(u):
    return f"lower({G(u, 1)})"


def NETLOC(u):
    return G(u, 2)


def HOST(u):
    return f"lower(regexp_replace(regexp_replace({NETLOC(u)}, '^.*@', ''), ':.*$', ''))"


def PATH(u):
    return f"regexp_replace({G(u, 3)}, ';[^/]*$', '')"


def QUERY(u):
    return G(u, 4)


def FRAG(u):
    return G(u, 5)


def KP(u: str, name: str) -> str:
    n = len(name)
    first = f"list_filter(string_split({QUERY(u)}, '&'), lambda x: starts_with(x, '{name}=') AND length(x) > {n + 1})[1]"
    return f"coalesce(url_decode(substr({first}, {n + 2})), '')"


def HTTP(u: str) -> str:
    return f"({SCHEME(u)} IN ('http', 'https') AND {HOST(u)} <> '')"


def UNDER(h: str, domains) -> str:
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


def DIRECT(u: str) -> str:
    s = PYSTRIP(f"coalesce({u}, '')")
    h, p = HOST(s), f"regexp_replace({PATH(s)}, '/+$', '')"
    pairs = " AND ".join(f"NOT ({h} = '{bh}' AND {p} = '{bp}')" for bh, bp in fv.BLOCKED_DIRECT_PAIRS)
    blocked = ", ".join(f"'{b}'" for b in fv.BLOCKED_DIRECT_HOSTS)
    return f"({HTTP(s)} AND {h} NOT IN ({blocked}) AND {pairs})"


def VALID(u: str, blocked=fv.BLOCKED_APPLICATION_DOMAINS) -> str:
    return f"({HTTP(u)} AND NOT {UNDER(HOST(u), blocked)})"


def AGE(k: str) -> str:
    d = f"regexp_extract({k}, '{fv.AGE_DAYS_PATTERN}', 1)"
    w = f"regexp_extract({k}, '{fv.AGE_WEEKS_PATTERN}', 1)"
    zero = " OR ".join(f"contains({k}, '{z}')" for z in fv.AGE_ZERO_WORDS)
    return (f"(CASE WHEN {k} = '' THEN NULL WHEN contains({k}, 'mas de') THEN NULL WHEN {zero} THEN 0 "
            f"WHEN contains({k}, 'ayer') THEN 1 WHEN {d} <> '' THEN TRY_CAST({d} AS BIGINT) "
            f"WHEN {w} <> '' THEN TRY_CAST({w} AS BIGINT) * 7 ELSE NULL END)")


def _dmy(c):
    return f"strftime({c}, '%d/%m/%Y')"


CUST = ("(SELECT c.*, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "JOIN region r ON n.n_regionkey = r.r_regionkey)")


def _q_fresh_by_nation():
    return f"""
WITH o AS (SELECT o_orderkey, o_custkey, {_dmy('o_orderdate')} AS fecha_inicio FROM orders),
f AS (SELECT * FROM o WHERE date_diff('day', {DMYP('fecha_inicio')}, DATE '{tq.ORDERS_AS_OF}') BETWEEN 0 AND 7),
l AS (SELECT n.n_name AS label FROM f JOIN customer c ON f.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey),
cnt AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT CAST(n.n_nationkey AS BIGINT) AS ord, n.n_name AS district, COALESCE(cnt.n, 0) AS n_listings,
       (SELECT count(*) FROM l) AS total_listings, COALESCE(cnt.n, 0) > 0 AS visible
FROM nation n LEFT JOIN cnt ON cnt.label = n.n_name"""


def _q_text_key():
    return f"""
SELECT doc_id, sha256(k) AS key_sha256, CAST(length(k) AS BIGINT) AS key_chars,
       CAST(length({CLEAN('text')}) AS BIGINT) AS clean_chars
FROM (SELECT doc_id, text, {K('text')} AS k FROM documents)"""


def _q_stable_id():
    return f"""
WITH c AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'N' || CAST(c_nationkey AS VARCHAR)
                          WHEN c_acctbal < 1000 THEN '' END AS code FROM {CUST}),
x AS (SELECT c_custkey, c_name, {ID('c_name', 'c_mktsegment', 'n_name', 'r_name', code='code')} AS id,
             {BASE('c_name', 'c_mktsegment', 'n_name', 'r_name')} AS base_key FROM c)
SELECT c_custkey, id, base_key, {FILE('id', 'c_name')} AS file_name FROM x"""


def _q_slug_name():
    return f"""
WITH x AS (SELECT p_partkey, p_name, {ID('p_brand', 'CAST(p_partkey AS VARCHAR)', 'p_name', 'p_type')} AS id FROM part)
SELECT p_partkey, {SLUG('p_name')} AS slug, id, {FILE('id', 'p_name')} AS file_name FROM x"""


def _q_doc_slug():
    return f"""
WITH x AS (SELECT doc_id, text, lang, {ID('source', 'CAST(doc_id AS VARCHAR)', 'lang', 'text')} AS id FROM documents)
SELECT doc_id, {SLUG('text')} AS slug, {FILE('id', 'lang')} AS file_name FROM x"""


def _q_url_parts():
    return f"""
SELECT page_id, {SCHEME('url')} AS scheme, {HOST('url')} AS host, {PATH('url')} AS path,
       {QUERY('url')} AS query, {FRAG('url')} AS fragment FROM pages"""


def _q_url_canonical():
    path_url = f"regexp_replace({SCHEME('url')} || '://' || {NETLOC('url')} || {PATH('url')}, '/+$', '')"
    return f"""
SELECT page_id,
       CASE WHEN regexp_matches({PATH('url')}, '^/[a-z]{{2}}/[0-9]+') THEN {path_url} ELSE '' END AS canonical,
       {KP('url', 'page')} AS page_param, {KP('url', 'utm_source')} AS utm_source,
       regexp_replace(url, '#.*$', '') AS without_fragment
FROM pages"""


def _q_url_host_class():
    return f"""
SELECT page_id, {DIRECT('url')} AS direct, {UNDER(HOST('url'), tq.PAGES_OFFICIAL)} AS official,
       {VALID('url', tq.PAGES_BLOCKED)} AS valid_application FROM pages"""


def _q_reference_code():
    return "SELECT page_id, 'PG-' || upper(substr(sha256(url), 1, 10)) AS reference FROM pages"


def _q_age_days():
    phrase = ("CASE event_type WHEN 'view' THEN 'Hace ' || CAST(user_id AS VARCHAR) || ' días' "
              "WHEN 'click' THEN 'Publicado hace ' || CAST(user_id AS VARCHAR) || ' semanas' "
              "WHEN 'signup' THEN 'Actualizado ayer' "
              "WHEN 'purchase' THEN 'Hace más de ' || CAST(user_id AS VARCHAR) || ' días' "
              "ELSE 'Publicado hace ' || CAST(hour(ts) AS VARCHAR) || ' horas' END")
    return f"""
WITH e AS (SELECT event_id, {phrase} AS phrase FROM events),
a AS (SELECT event_id, phrase, {AGE(K('phrase'))} AS age_days FROM e),
r AS (SELECT *, (age_days IS NOT NULL AND age_days <= 7) AS recent FROM a),
p AS (SELECT *, CASE WHEN recent THEN DATE '{tq.EVENTS_AS_OF}' - CAST(age_days AS INTEGER) END AS published_on FROM r)
SELECT event_id, phrase, age_days, recent, published_on, strftime(published_on, '%d/%m/%Y') AS published_text FROM p"""


def _q_freshness_window():
    return f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%-d/%-m/%Y')
                                    WHEN o_orderpriority = '5-LOW' THEN ' ' || {_dmy('o_orderdate')}
                                    ELSE {_dmy('o_orderdate')} END AS fecha_inicio FROM orders),
p AS (SELECT *, {DMYP('fecha_inicio')} AS published_on FROM o)
SELECT o_orderkey, fecha_inicio, published_on, date_diff('day', published_on, DATE '{tq.ORDERS_AS_OF}') AS age_days
FROM p WHERE date_diff('day', published_on, DATE '{tq.ORDERS_AS_OF}') BETWEEN 0 AND 7"""


def _q_expiry():
    end = ("CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%-d/%-m/%Y') "
           f"WHEN 2 THEN ' ' || {_dmy('l_shipdate')} WHEN 3 THEN {_dmy('l_shipdate')} || ' ' "
           "WHEN 4 THEN strftime(l_shipdate, '%d/%m/%y') WHEN 5 THEN '' "
           f"ELSE {_dmy('l_shipdate')} END")
    return f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {end} AS fecha_fin FROM lineitem),
p AS (SELECT *, {DMYP(PYSTRIP("coalesce(fecha_fin, '')"))} AS closes_on, {DMYP('fecha_fin')} AS raw_close FROM t)
SELECT l_orderkey, l_linenumber, fecha_fin, closes_on,
       (raw_close IS NULL OR raw_close >= DATE '{tq.EXPIRY_AS_OF}') AS still_open
FROM p WHERE closes_on IS NULL OR closes_on >= DATE '{tq.EXPIRY_AS_OF}'"""


def _q_first_match_label():
    terms = ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(tq.DOC_TERMS))
    return f"""
WITH t AS (SELECT doc_id, {K('text')} AS k FROM documents),
d AS (SELECT * FROM (VALUES {terms}) v(ord, term)),
m AS (SELECT t.doc_id, arg_min(d.term, d.ord) AS label
      FROM t JOIN d ON contains(t.k, {K('d.term')}) GROUP BY t.doc_id)
SELECT t.doc_id, COALESCE(m.label, '') AS label FROM t LEFT JOIN m ON t.doc_id = m.doc_id"""


def _q_dedupe_last():
    return """
SELECT user_id, event_type, max(event_id) AS last_event_id, arg_max_null(value, event_id) AS value,
       min(event_id) AS first_event_id FROM events GROUP BY user_id, event_type"""


def _q_dedupe_first():
    return """
SELECT user_id, event_type, min(event_id) AS first_event_id, arg_min_null(value, event_id) AS value
FROM events GROUP BY user_id, event_type"""


def _q_topk_per_group():
    return """
SELECT o_custkey, o_orderkey, rank FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank
  FROM orders) WHERE rank <= 3"""


def _q_duplicate_ids():
    return f"""
WITH d AS (SELECT doc_id, substr(sha256({K('text')}), 1, 20) AS id FROM documents),
f AS (SELECT id, min(doc_id) AS m FROM d GROUP BY id)
SELECT d.doc_id, d.id FROM d JOIN f ON d.id = f.id WHERE d.doc_id > f.m"""


def _known():
    vals = ", ".join(f"({i}, '{s}')" for i, s in enumerate(tq.KNOWN_SOURCES))
    return f"(SELECT * FROM (VALUES {vals}) t(src_ord, fuente))"


def _q_source_fallback():
    return f"""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS fuente FROM orders),
prev AS (SELECT o_orderkey, fuente, 'prev' AS origin FROM o WHERE o_orderstatus <> 'O'),
new AS (SELECT o_orderkey, fuente, 'new' AS origin FROM o
        WHERE o_orderstatus = 'O' AND fuente IN ('1-URGENT', '3-MEDIUM', '5-LOW')),
answered AS (SELECT DISTINCT fuente FROM new WHERE fuente IN (SELECT fuente FROM {_known()})),
silent AS (SELECT fuente FROM {_known()} WHERE fuente NOT IN (SELECT fuente FROM answered))
SELECT * FROM prev WHERE fuente IN (SELECT fuente FROM silent) UNION ALL SELECT * FROM new"""


def _q_refresh_window():
    return f"""
WITH o AS (SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority AS fuente, {_dmy('o.o_orderdate')} AS fecha_inicio,
                  CASE WHEN o.o_custkey % 50 <> 0 THEN 'https://shop.example.com/c/' || CAST(o.o_custkey AS VARCHAR) END
                  AS url_oficial, coalesce(s.src_ord, 4) AS src_ord, s.fuente IS NOT NULL AS known
           FROM orders o LEFT JOIN {_known()} s ON o.o_orderpriority = s.fuente),
prev AS (SELECT * FROM o WHERE o_orderstatus <> 'O' AND known),
new AS (SELECT * FROM o WHERE o_orderstatus = 'O' AND fuente IN ('1-URGENT', '3-MEDIUM', '5-LOW')),
answered AS (SELECT DISTINCT fuente FROM new),
u AS (SELECT * FROM (SELECT * FROM prev WHERE fuente NOT IN (SELECT fuente FROM answered) UNION ALL SELECT * FROM new)
      WHERE url_oficial IS NOT NULL),
w AS (SELECT *, CAST(src_ord AS BIGINT) * 1000000000000 + o_orderkey AS p FROM u
      WHERE date_diff('day', {DMYP('fecha_inicio')}, DATE '{tq.ORDERS_AS_OF}') BETWEEN 0 AND 7)
SELECT url_oficial, arg_max(o_orderkey, p) AS o_orderkey, arg_max(fuente, p) AS fuente,
       arg_max(fecha_inicio, p) AS fecha_inicio, CAST(arg_min(src_ord, p) AS BIGINT) AS first_src_ord,
       arg_min(o_orderkey, p) AS first_orderkey
FROM w GROUP BY url_oficial"""


def _q_source_status():
    return f"""
WITH c AS (SELECT o_orderpriority AS fuente, count(*) AS n FROM orders
           WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1)
SELECT CAST(s.src_ord AS BIGINT) AS src_ord, s.fuente, COALESCE(c.n, 0) AS n_new,
       CASE WHEN COALESCE(c.n, 0) > 0 THEN 'updated' ELSE 'kept previous' END AS status
FROM {_known()} s LEFT JOIN c ON s.fuente = c.fuente"""


_UPSERT_U = f"""
prev AS (SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS pos, c_mktsegment AS segment,
                CAST(c_nationkey AS VARCHAR) AS nation, c_name AS name, CAST(NULL AS VARCHAR) AS status,
                CAST(NULL AS VARCHAR) AS fecha_fin, CAST(NULL AS VARCHAR) AS code FROM customer),
new AS (SELECT o_custkey AS id, o_orderkey AS pos,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT-SEG' WHEN o_orderpriority = '2-HIGH' THEN '' END AS segment,
               CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS nation,
               CAST(NULL AS VARCHAR) AS name, o_orderstatus AS status,
               strftime(CAST(o_orderdate AS DATE) + 10, '%d/%m/%Y') AS fecha_fin,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'M' END AS code
        FROM orders),
u AS (SELECT * FROM prev UNION ALL SELECT * FROM new),
up AS (SELECT id, arg_max(segment, pos) FILTER (WHERE segment IS NOT NULL) AS segment,
              arg_max(nation, pos) FILTER (WHERE nation IS NOT NULL) AS nation,
              arg_max_null(name, pos) AS name, arg_max_null(status, pos) AS status,
              arg_max_null(fecha_fin, pos) AS fecha_fin, arg_max_null(code, pos) AS code, max(pos) AS pos
       FROM u GROUP BY id)"""


def _q_carry_forward():
    return f"WITH {_UPSERT_U}\nSELECT id, segment, nation, name, status, pos FROM up"


def _q_superseded():
    return f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS VARCHAR) END AS code,
                  {BASE("'S' || CAST(l_suppkey % 2 AS VARCHAR)", 'CAST(l_orderkey AS VARCHAR)', 'l_linestatus', 'CAST(year(l_shipdate) AS VARCHAR)')} AS base_key FROM lineitem),
coded AS (SELECT DISTINCT base_key FROM t WHERE code IS NOT NULL AND code <> '')
SELECT l_orderkey, l_linenumber, (code IS NOT NULL AND code <> '') AS has_code FROM t
WHERE (code IS NOT NULL AND code <> '') OR base_key NOT IN (SELECT base_key FROM coded)"""


def _q_run_summary():
    close = DMYP(PYSTRIP("coalesce(fecha_fin, '')"))
    return f"""
WITH {_UPSERT_U},
k AS (SELECT *, {K('segment')} AS base_key FROM up),
coded AS (SELECT DISTINCT base_key FROM k WHERE code IS NOT NULL AND code <> ''),
merged AS (SELECT * FROM k WHERE NOT (code IS NOT NULL AND code <> '') AND base_key IN (SELECT base_key FROM coded)),
kept AS (SELECT *, {close} AS close FROM k WHERE (code IS NOT NULL AND code <> '') OR base_key NOT IN (SELECT base_key FROM coded)),
expd AS (SELECT * FROM kept WHERE close < DATE '{tq.OUTBOX_AS_OF}'),
aft AS (SELECT * FROM kept WHERE close IS NULL OR close >= DATE '{tq.OUTBOX_AS_OF}')
SELECT (SELECT count(*) FROM prev) AS n_before, (SELECT count(*) FROM aft) AS n_after,
       (SELECT count(*) FROM aft) - (SELECT count(*) FROM prev) AS n_new,
       (SELECT count(*) FROM expd) AS n_expired, (SELECT count(*) FROM merged) AS n_merged,
       (SELECT count(*) FROM aft WHERE coalesce(nation, '') <> '') AS n_documents"""


def _q_budget_selection():
    return """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'N')
ORDER BY l_orderkey, l_linenumber LIMIT 25"""


def _labelled():
    parts = (f"list_filter(list_transform(string_split(coalesce(ubicacion, ''), '-'), lambda x: {PYSTRIP('x')}), "
             "lambda x: x <> '')")
    return f"""
l0 AS (SELECT c_custkey, c_name AS titulo,
              CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN r_name ELSE concat_ws(' - ', r_name, c_mktsegment, n_name) END AS ubicacion
       FROM {CUST}),
l1 AS (SELECT *, {parts} AS parts FROM l0),
l AS (SELECT *, COALESCE(NULLIF(COALESCE(parts[3], ''), ''), NULLIF(COALESCE(parts[2], ''), ''),
                         COALESCE(parts[1], '{fv.DEFAULT_REGION_LABEL}')) AS label FROM l1)"""


def _q_dim_counts():
    return f"""
WITH {_labelled()},
cnt AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT CAST(n.n_nationkey AS BIGINT) AS ord, n.n_name AS district, COALESCE(cnt.n, 0) AS n_listings,
       (SELECT count(*) FROM l) AS total_listings, COALESCE(cnt.n, 0) > 0 AS visible
FROM nation n LEFT JOIN cnt ON cnt.label = n.n_name"""


def _q_dim_listing():
    return f"""
WITH {_labelled()}
SELECT CAST(n.n_nationkey AS BIGINT) AS ord, n.n_name AS district, l.c_custkey, l.titulo
FROM l JOIN nation n ON l.label = n.n_name"""


def _q_facets():
    return f"""
SELECT DISTINCT facet, value FROM (
  SELECT 'c_mktsegment' AS facet, c_mktsegment AS value FROM {CUST}
  UNION ALL SELECT 'n_name' AS facet, n_name AS value FROM {CUST})
WHERE value IS NOT NULL AND value <> ''"""


def _q_location_parts():
    parts = (f"list_filter(list_transform(string_split(coalesce(ubicacion, ''), '-'), lambda x: {PYSTRIP('x')}), "
             "lambda x: x <> '')")
    whole = CLEAN("ubicacion")
    tparts = f"list_filter(list_transform(string_split({whole}, ' - '), lambda x: {PYSTRIP('x')}), lambda x: x <> '')"
    return f"""
WITH o AS (SELECT o_orderkey, concat_ws(' - ', o_orderpriority, o_orderstatus) AS ubicacion,
                  CASE WHEN o_orderstatus = 'F' THEN 'LIMA' ELSE '' END AS departamento FROM orders),
p AS (SELECT *, {parts} AS parts, {tparts} AS tparts, {whole} AS whole FROM o),
q AS (SELECT o_orderkey,
             COALESCE(NULLIF(departamento, ''), parts[1], '{fv.DEFAULT_REGION_LABEL}') AS loc_department,
             COALESCE(parts[2], '') AS loc_province, COALESCE(parts[3], '') AS loc_district,
             CASE WHEN len(tparts) > 0 THEN tparts[1] ELSE whole END AS text_department,
             COALESCE(tparts[2], '') AS text_province, COALESCE(tparts[3], '') AS text_district FROM p)
SELECT o_orderkey, loc_department, loc_province, loc_district,
       COALESCE(NULLIF(loc_district, ''), NULLIF(loc_province, ''), loc_department) AS label,
       text_department, text_province, text_district FROM q"""


def _details_cte():
    return f"""
d0 AS (SELECT o.o_orderkey, c.c_name AS titulo, c.c_mktsegment AS entidad, c.n_name AS ubicacion,
              'C-' || CAST(o.o_custkey AS VARCHAR) AS numero_convocatoria,
              CASE WHEN o.o_orderpriority = '1-URGENT' THEN '2' ELSE '1' END AS vacantes,
              CASE WHEN o.o_orderstatus = 'P' THEN '' WHEN o.o_orderstatus = 'F' THEN 's/. ' || CAST(o.o_custkey AS VARCHAR)
                   ELSE CAST(o.o_custkey AS VARCHAR) END AS remuneracion,
              {_dmy('o.o_orderdate')} AS fecha_inicio,
              strftime(CAST(o.o_orderdate AS DATE) + 7, '%d/%m/%Y') AS fecha_fin,
              CASE WHEN o.o_orderpriority = '2-HIGH' THEN 'LinkedIn' ELSE 'SERVIR - Talento Perú' END AS fuente,
              CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN 'https://entidad.gob.pe/c/' || CAST(o.o_orderkey AS VARCHAR) END AS url_postulacion,
              CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'https://share.google/IovzweaQemtlVGF9i'
                   WHEN o.o_orderpriority = '5-LOW' THEN 'https://www.gob.pe/x' END AS url_consulta,
              CASE WHEN o.o_orderpriority = '1-URGENT' THEN CAST(o.o_custkey AS VARCHAR) END AS codigo_servir
       FROM orders o JOIN {CUST} c ON o.o_custkey = c.c_custkey),
d AS (SELECT *, {ID('entidad', 'numero_convocatoria', 'titulo', 'ubicacion', code='codigo_servir')} AS id,
             {PYSTRIP("coalesce(remuneracion, '')")} AS sal FROM d0)"""


def _salary(v: str, unspecified: bool) -> str:
    marked = f"CASE WHEN starts_with(upper({v}), 'S/.') THEN {v} ELSE 'S/. ' || {v} END"
    if not unspecified:
        return marked
    return f"CASE WHEN {v} = '' OR lower({v}) = 'no especificado' THEN 'No especificado' ELSE {marked} END"


def _q_display_fields():
    portal = "coalesce(fuente, '') IN (" + ", ".join(f"'{s}'" for s in fv.PORTAL_SOURCES) + ")"
    return f"""
WITH {_details_cte()}
SELECT o_orderkey,
       CASE WHEN coalesce(url_postulacion, '') <> '' THEN 'direct' WHEN coalesce(url_consulta, '') <> '' THEN 'portal'
            ELSE 'none' END AS action_kind,
       contains(coalesce(url_consulta, ''), '{fv.CERTIFICATE_NOTICE_LINK}') AS certificate_notice,
       CASE WHEN {portal} THEN 'publication' ELSE 'range' END AS date_label,
       CASE WHEN {portal} THEN fecha_inicio ELSE fecha_inicio || ' — ' || fecha_fin END AS date_text,
       CASE WHEN vacantes <> '1' THEN 'vacantes' ELSE 'vacante' END AS vacancy_label,
       {_salary('sal', True)} AS salary_site, {_salary('sal', False)} AS salary_msg,
       CASE WHEN codigo_servir IS NOT NULL AND codigo_servir <> '' THEN codigo_servir END AS code
FROM d"""


def _q_message():
    sheet = f"{lit('https://example.org/ofertas/')} || {FILE('id', 'titulo')}"
    cta = (f"CASE WHEN url_postulacion IS NOT NULL AND url_postulacion <> '' THEN "
           f"{lit('Postula directamente en el enlace oficial:' + chr(10))} || url_postulacion || "
           f"{lit(chr(10) + chr(10) + 'Requisitos, bases y resumen:' + chr(10))} || {sheet} "
           f"ELSE {lit('Requisitos y enlace de postulación:' + chr(10))} || {sheet} END")
    nl = chr(10)
    msg = (f"{lit(fv.MESSAGE_HEADER + nl + nl + '🔹 ')} || titulo || {lit(nl + '🏢 ')} || entidad || "
           f"{lit(nl + '📍 ')} || ubicacion || {lit(nl + '💰 Remuneración: ')} || {_salary('sal', False)} || "
           f"{lit(nl + '👥 Vacantes: ')} || vacantes || {lit(nl + '📅 Publicación: ')} || fecha_inicio || "
           f"{lit(' — Cierre: ')} || fecha_fin || {lit(nl + nl)} || {cta} || {lit(nl + nl + fv.MESSAGE_TAGS)}")
    return f"WITH {_details_cte()}\nSELECT o_orderkey, {msg} AS message FROM d"


def _q_newest_outbox():
    return f"""
WITH lst AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'C-' || CAST(o_custkey AS VARCHAR) AS numero_convocatoria,
                    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE {_dmy('o_orderdate')} END AS fecha_inicio,
                    strftime(CAST(o_orderdate AS DATE) + 30, '%d/%m/%Y') AS fecha_fin, o_orderkey AS pos FROM orders),
led AS (SELECT 'C-' || CAST(c_custkey AS VARCHAR) AS token FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
        UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R'),
q AS (SELECT *, {DMYP('fecha_inicio')} AS published_on FROM lst
      WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.token = lst.id)
        AND NOT EXISTS (SELECT 1 FROM led WHERE led.token = lst.numero_convocatoria)
        AND ({DMYP('fecha_fin')} IS NULL OR {DMYP('fecha_fin')} >= DATE '{tq.OUTBOX_AS_OF}'))
SELECT id, numero_convocatoria, fecha_inicio, published_on FROM q
ORDER BY published_on DESC NULLS LAST, pos LIMIT {fv.PUBLISH_LIMIT}"""


def _hay():
    return SK("concat_ws(' ', coalesce(text, ''), coalesce(source, ''), coalesce(lang, ''))")


def _q_search_docs():
    needle = SK(lit(tq.SEARCH_TEXT))
    return f"""
SELECT doc_id FROM documents
WHERE lang = '{tq.SEARCH_LANG}' AND ({needle} = '' OR contains({_hay()}, {needle}))
  AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""


def _q_search_sections():
    needle = SK(lit(tq.SEARCH_TEXT))
    return f"""
WITH v AS (SELECT source, ({needle} = '' OR contains({_hay()}, {needle})) AS visible FROM documents),
c AS (SELECT source, count_if(visible) AS n_visible, count(*) AS n_rows FROM v GROUP BY source),
dim AS (SELECT DISTINCT source FROM documents)
SELECT dim.source, COALESCE(c.n_visible, 0) AS n_visible, COALESCE(c.n_rows, 0) AS n_rows,
       COALESCE(c.n_visible, 0) > 0 AS section_visible
FROM dim LEFT JOIN c ON dim.source = c.source"""


def _q_search_index():
    return f"""
WITH h AS (SELECT doc_id, {_hay()} AS hay FROM documents),
g AS (SELECT DISTINCT doc_id, substr(hay, i::INTEGER, 3) AS gram FROM (
        SELECT doc_id, hay, unnest(range(1, length(hay) - 1)) AS i FROM h))
SELECT gram, count(*) AS n_docs FROM g GROUP BY gram"""


def _q_search_phrases():
    return " UNION ALL ".join(
        f"SELECT {lit(p)} AS needle, doc_id FROM documents WHERE contains({_hay()}, {SK(lit(p))})"
        for p in ("Licensed under", "  ÉS  ", "straße", "no such phrase here", "x"))


def _q_search_blank():
    return """
SELECT source, 0::BIGINT AS n_visible, count(doc_id) AS n_rows, source = 'none' AS section_visible,
       0::BIGINT AS n_visible_total
FROM (SELECT source, doc_id FROM documents UNION ALL SELECT 'none', NULL UNION ALL SELECT 'other', NULL) GROUP BY source"""


def _q_first_match_vocabulary():
    return f"""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS term FROM conversations),
d AS (SELECT term, row_number() OVER (ORDER BY term) AS ord FROM v),
t AS (SELECT doc_id, {K('text')} AS k FROM documents),
m AS (SELECT doc_id, arg_min(term, ord) AS label FROM t JOIN d ON contains(t.k, d.term) GROUP BY doc_id)
SELECT t.doc_id, COALESCE(m.label, '') AS label FROM t LEFT JOIN m ON t.doc_id = m.doc_id"""


def _q_place_detection():
    places = ", ".join(lit(p) for p in ("Asia", "ZUÑIGA", "Nuevo Imperial", "san vicente", "San Luis de Cañete",
                                        "Lunahuana", "Chincha", "Cerro  Azul", "Quilmaná", "MALAYA", ""))
    names = {"SAN VICENTE DE CAÑETE": "San Vicente de Cañete", "SAN LUIS": "San Luis de Cañete",
             "SAN ANTONIO": "San Antonio de Cañete"}
    first = " ".join(f"WHEN contains(k, {K(lit(names.get(d, d)))}) THEN {lit(d)}" for d in fv.DISTRICTS)
    return f"""
WITH c AS (SELECT c_custkey, concat_ws(', ', c_mktsegment, [{places}][c_custkey % 11 + 1],
                  CASE WHEN c_custkey % 3 = 0 THEN 'cerca de Mala' END) AS text FROM customer),
t AS (SELECT c_custkey, {K('text')} AS k FROM c),
d AS (SELECT c_custkey, CASE {first} ELSE '' END AS district FROM t)
SELECT c_custkey, district, district AS by_column FROM d"""


def _q_collated_rank():
    # Spanish base letters: n-tilde is a letter after n, every other accent is dropped
    word = "replace(strip_accents(replace(lower(regexp_extract(coalesce(text, ''), '\\p{L}+', 0)), 'ñ', 'n~')), 'ß', 'ss')"
    return f"SELECT doc_id, row_number() OVER (ORDER BY {word}, doc_id) AS row_no FROM documents"


def _q_saved_toggle():
    return """
WITH s AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
f AS (SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey HAVING count(*) % 2 = 1)
SELECT id FROM s WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id FROM f WHERE id NOT IN (SELECT id FROM s)"""


def _q_audit_violations():
    portal = "fuente IN (" + ", ".join(f"'{s}'" for s in fv.PORTAL_SOURCES) + ")"
    lower_portals = "(" + ", ".join(f"'{s.lower()}'" for s in fv.PORTAL_SOURCES) + ")"
    miss = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in fv.REQUIRED_FIELDS) + ")"
    h, p, q = HOST("url"), PATH("url"), QUERY("url")
    indiv = (f"(src = '{fv.SOURCE_COMPUTRABAJO.lower()}' AND NOT ({h} = '{fv.HOST_COMPUTRABAJO}' AND contains({p}, '/ofertas-de-trabajo/')))"
             f" OR (src = '{fv.SOURCE_INDEED.lower()}' AND NOT ({h} = '{fv.HOST_INDEED}' AND {p} = '/viewjob' AND contains({q}, 'jk=')))"
             f" OR (src = '{fv.SOURCE_LINKEDIN.lower()}' AND NOT ({h} = '{fv.HOST_LINKEDIN}' AND starts_with({p}, '/jobs/view/')))"
             f" OR (src = '{fv.SOURCE_BUMERAN.lower()}' AND NOT ({h} = '{fv.HOST_BUMERAN}' AND starts_with({p}, '/empleos/') AND ends_with({p}, '.html')))")
    return f"""
WITH a0 AS (SELECT o.o_orderkey AS pos, c.c_name AS titulo,
                   CASE WHEN o.o_orderpriority = '5-LOW' THEN '' ELSE c.c_mktsegment END AS entidad,
                   c.n_name AS ubicacion, 'C-' || CAST(o.o_custkey AS VARCHAR) AS numero_convocatoria, '1' AS vacantes,
                   CASE WHEN o.o_orderstatus = 'P' THEN 'sin fecha' ELSE {_dmy('o.o_orderdate')} END AS fecha_inicio,
                   strftime(CAST(o.o_orderdate AS DATE) + 7, '%d/%m/%Y') AS fecha_fin,
                   CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Computrabajo Perú' WHEN '2-HIGH' THEN 'LinkedIn'
                        WHEN '3-MEDIUM' THEN 'linkedin' WHEN '4-NOT SPECIFIED' THEN 'SERVIR - Talento Perú'
                        ELSE 'Indeed Perú' END AS fuente,
                   CASE o.o_orderstatus WHEN 'F' THEN 'https://pe.linkedin.com/jobs/view/' || CAST(o.o_orderkey AS VARCHAR)
                        WHEN 'O' THEN 'https://pe.computrabajo.com/ofertas-de-trabajo/o-' || CAST(o.o_orderkey AS VARCHAR)
                        ELSE 'https://www.gob.pe/x/' || CAST(o.o_orderkey AS VARCHAR) END AS url_oficial,
                   CASE WHEN o.o_custkey < 100 THEN 'https://share.google/abc'
                        WHEN o.o_custkey < 200 THEN 'https://convocatoriasdetrabajo.com/a'
                        WHEN o.o_custkey < 300 THEN 'https://entidad.gob.pe/p/' || CAST(o.o_orderkey AS VARCHAR) END AS url_postulacion
            FROM orders o JOIN {CUST} c ON o.o_custkey = c.c_custkey),
b AS (SELECT *, {ID('entidad', 'numero_convocatoria', 'titulo', 'ubicacion')} AS id, {DMYP('fecha_inicio')} AS pub,
             lower(coalesce(fuente, '')) AS src, coalesce(url_oficial, '') AS url, coalesce(url_postulacion, '') AS app,
             {portal} AS portal, {miss} AS miss FROM a0),
c AS (SELECT *, date_diff('day', pub, DATE '{tq.ORDERS_AS_OF}') AS age FROM b)
SELECT pos, id, 'missing_fields' AS rule, miss AS detail FROM c WHERE miss <> ''
UNION ALL SELECT pos, id, 'age_out_of_window', CAST(age AS VARCHAR) FROM c WHERE portal AND pub IS NOT NULL AND (age < 0 OR age > 7)
UNION ALL SELECT pos, id, 'invalid_date', fecha_inicio FROM c WHERE portal AND pub IS NULL
UNION ALL SELECT pos, id, 'not_individual_listing', url FROM c WHERE {indiv}
UNION ALL SELECT pos, id, 'not_official_source', url FROM c
          WHERE src NOT IN {lower_portals} AND url <> '' AND NOT {UNDER(h, fv.OFFICIAL_DOMAINS)}
UNION ALL SELECT pos, id, 'indirect_application_link', app FROM c WHERE app <> '' AND NOT ({VALID('app')} AND {DIRECT('app')})
UNION ALL SELECT c.pos, c.id, 'duplicate_id', c.id FROM c JOIN (SELECT id, min(pos) AS m FROM c GROUP BY id) f
          ON c.id = f.id WHERE c.pos > f.m"""


def _name_diff_cte():
    return f"""
nm AS (SELECT p_partkey, p_size, {FILE('CAST(p_partkey AS VARCHAR)', 'p_name')} AS name FROM part),
e AS (SELECT DISTINCT name FROM nm WHERE p_size <= 25),
a AS (SELECT DISTINCT name FROM nm WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
d AS (SELECT coalesce(e.name, a.name) AS name,
             CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'obsolete' ELSE 'ok' END AS status
      FROM e FULL OUTER JOIN a ON e.name = a.name)"""


def _q_name_diff():
    return f"WITH {_name_diff_cte()}\nSELECT name, status FROM d"


def _q_obsolete_report():
    return f"""
WITH {_name_diff_cte()},
obs AS (SELECT name FROM d WHERE status = 'obsolete')
SELECT (SELECT count(*) FROM obs) AS n_obsolete,
       coalesce((SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM obs ORDER BY name LIMIT 5)), '')
       AS first_obsolete"""


def _q_block_pages():
    return f"""
SELECT host, count(*) AS n_pages,
       count_if(CASE WHEN host LIKE '%com' THEN contains(h, 'captcha') WHEN host LIKE '%org' THEN contains(h, 'robot')
                     WHEN host LIKE '%net' THEN contains(h, 'track') ELSE false END) AS n_blocked
FROM (SELECT {HOST('url')} AS host, lower(html) AS h FROM pages) GROUP BY 1"""


def _q_nested_links():
    join = (f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href "
            f"WHEN starts_with(href, '//') THEN {SCHEME('base')} || ':' || href "
            f"WHEN starts_with(href, '/') THEN {SCHEME('base')} || '://' || {NETLOC('base')} || href "
            f"ELSE {SCHEME('base')} || '://' || {NETLOC('base')} || regexp_replace({PATH('base')}, '[^/]*$', '') || href END")
    doc_words = " OR ".join(f"contains(lt, '{w}')" for w in fv.DOC_WORDS)
    return f"""
WITH l AS (SELECT page_id, url AS base, list_filter(string_split(
                    regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '<a ')[2:],
                    lambda s: contains(split_part(s, '>', 1), 'href="') AND contains(s, '</a>')) AS parts FROM pages),
w AS (SELECT page_id, base, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS pos FROM l),
x AS (SELECT page_id, base, pos, split_part(split_part(part, 'href="', 2), '"', 1) AS href,
             regexp_replace(substr(split_part(part, '</a>', 1), instr(part, '>') + 1), '<[^>]*>', '', 'g') AS txt FROM w),
y AS (SELECT page_id, pos, u AS url, t AS text, lower(u || ' ' || t) AS lt
      FROM (SELECT page_id, pos, {join} AS u, {PYSTRIP('txt')} AS t FROM x)),
z AS (SELECT page_id, pos, url, {HTTP('url')} AND NOT ends_with({HOST('url')}, '{fv.OFFICIAL_HOST_SUFFIX}') AS eligible,
             (regexp_matches(lt, '{fv.DOC_EXTENSION_PATTERN}') OR {doc_words}) AS doc, {DIRECT('url')} AS direct FROM y),
e AS (SELECT * FROM z WHERE eligible),
fd AS (SELECT page_id, min(pos) AS dpos, arg_min(url, pos) AS url_postulacion FROM e WHERE NOT doc AND direct GROUP BY page_id),
agg AS (SELECT e.page_id, count(*) AS n_links, count_if(e.doc) AS n_documents,
               arg_min(e.url, e.pos) FILTER (WHERE NOT e.doc AND e.pos <> coalesce(fd.dpos, -1)) AS url_consulta
        FROM e LEFT JOIN fd ON e.page_id = fd.page_id GROUP BY e.page_id)
SELECT p.page_id, coalesce(agg.n_links, 0) AS n_links, coalesce(agg.n_documents, 0) AS n_documents,
       fd.url_postulacion, agg.url_consulta
FROM pages p LEFT JOIN agg ON p.page_id = agg.page_id LEFT JOIN fd ON p.page_id = fd.page_id"""


def _q_text_blocks():
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {PYSTRIP('x')}), lambda x: x <> '')"
    return f"""
WITH pl AS (SELECT conv_id, turn + 1 AS nt, {lines} AS lines FROM conversations),
j AS (SELECT c.conv_id, c.turn, c.role,
             CASE WHEN len(pl.lines) >= 2 THEN pl.lines[-2] ELSE '' END AS title,
             CASE WHEN len(pl.lines) >= 1 THEN pl.lines[-1] ELSE '' END AS entity
      FROM conversations c JOIN pl ON c.conv_id = pl.conv_id AND c.turn = pl.nt)
SELECT conv_id, turn, role, title, entity FROM j WHERE length(title) > 3 AND role IS NOT NULL AND role <> ''"""


def _q_doc_sections():
    from ..operators.extract import rx_quote
    t = CLEAN("text")
    cols = []
    for field, begin, end in tq.DOC_SECTIONS:
        pat = "(?i)" + rx_quote(begin) + "\\s*(.*?)\\s*" + rx_quote(end)
        v = f"regexp_replace(regexp_extract(t, '{pat}', 1), '^[ -]+|[ -]+$', '', 'g')"
        cols.append(f"CASE WHEN {v} <> '' AND upper({v}) <> '{fv.NOT_APPLICABLE}' THEN {v} END AS {field}")
    return f"SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, {t} AS t FROM documents)"


def _q_stream_refresh():
    return """
SELECT user_id, event_type, max(event_id) AS last_event_id, arg_max_null(value, event_id) AS value
FROM events GROUP BY user_id, event_type"""


def sql() -> dict:
    """Oracle SQL per query name (queries without one get the weaker rows-only check)."""
    out = {}
    for name in tq.QUERIES:
        fn = globals().get("_q_" + name)
        if fn is not None:
            out[name] = fn().strip()
    return out
