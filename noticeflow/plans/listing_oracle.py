"""DuckDB SQL for the listing queries; written from the rules, it imports nothing from the implementation."""

from __future__ import annotations

CUST = ("(SELECT c.*, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "JOIN region r ON n.n_regionkey = r.r_regionkey)")


def key(x: str) -> str:
    """Comparison key of plain text: lower case, white space runs as one space, trimmed."""
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[ \\t\\n\\r]+', ' ', 'g'))"


def slug(x: str) -> str:
    cut = f"substr(trim(regexp_replace({key(x)}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"
    return f"rtrim({cut}, '-')"


def ident(*parts: str, code: str = "NULL") -> str:
    keys = ", ".join(key(p) for p in parts)
    return f"substr(sha256(concat_ws('|', {keys}, CASE WHEN {code} <> '' THEN {key(code)} END)), 1, 20)"


LISTED = f"""
l0 AS (SELECT o.o_orderkey, o.o_orderdate, c.c_name AS titulo, c.c_mktsegment AS entidad, c.n_name AS ubicacion,
              'C-' || o.o_custkey AS numero, CASE o.o_orderpriority WHEN '1-URGENT' THEN '2' ELSE '1' END AS vacantes,
              CASE o.o_orderpriority WHEN '2-HIGH' THEN 'LinkedIn' ELSE 'SERVIR - Talento Perú' END AS fuente,
              CASE o.o_orderpriority WHEN '1-URGENT' THEN CAST(o.o_custkey AS VARCHAR) END AS code
       FROM orders o JOIN {CUST} c ON o.o_custkey = c.c_custkey),
l AS (SELECT *, {ident('entidad', 'numero', 'titulo', 'ubicacion', code='code')} AS id FROM l0)"""

RECORD_URL = "https://app.servir.gob.pe/DifusionOfertasExterno/faces/consultas/ofertas_laborales.xhtml"

SQL = {
    "snapshot_write": f"""WITH {LISTED}
SELECT fuente, vacantes, count(*) AS n_listings, max('https://shop.example.com/o/' || o_orderkey) AS last_url,
       count(code) AS n_coded FROM l GROUP BY 1, 2""",
    "keyed_scan": """SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(max(o_orderkey) AS VARCHAR) AS titulo,
       arg_max(o_orderpriority, o_orderkey) AS fuente FROM orders GROUP BY o_custkey""",
    "ledger_update": """SELECT CAST(c_custkey AS VARCHAR) AS token FROM customer WHERE c_acctbal < 2000
UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice > 100000""",
    "outbox_state": f"""WITH {LISTED},
q AS (SELECT id, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS k FROM l
      WHERE CAST(o_orderdate AS DATE) + 7 >= DATE '2001-08-01')
SELECT id, CASE WHEN k <= 20 THEN 1 ELSE 2 END AS run, true AS known FROM q WHERE k <= 40""",
    "outbox_replay": f"""WITH {LISTED.replace("'C-' || o.o_custkey", "'N-' || o.o_orderkey")},
q AS (SELECT id, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS k FROM l
      WHERE CAST(o_orderdate AS DATE) + 7 >= DATE '2001-08-01'),
c AS (SELECT id FROM q WHERE k > 40 OR (k <= 20 AND id < '5') QUALIFY row_number() OVER (ORDER BY k) <= 20)
SELECT id, 'a' AS taken_by, CASE WHEN id < '5' THEN 'failed' ELSE 'sent' END AS status FROM q WHERE k <= 20
UNION ALL SELECT id, 'b', 'pending' FROM q WHERE k BETWEEN 21 AND 40 UNION ALL SELECT id, 'c', 'pending' FROM c""",
    "guarded_snapshot": f"""WITH {LISTED}
SELECT fuente, count(*) AS n_listings, true AS empty_refused, 1 AS n_runs FROM l WHERE vacantes <> '1' GROUP BY fuente""",
    "stream_buckets": """WITH b AS (SELECT c_custkey AS k, ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 64
  AS bucket FROM customer),
hit AS (SELECT 0::BIGINT AS batch_id, bucket FROM b UNION SELECT 1, bucket FROM b WHERE k % 500 = 0
        UNION SELECT 2, bucket FROM b WHERE k = 7)
SELECT batch_id, count(DISTINCT bucket) AS n_buckets, count(k) AS n_rows FROM hit JOIN b USING (bucket) GROUP BY batch_id""",
    "stream_fresh": """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event_id,
       arg_max(value, (ts, event_id)) AS value FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id, event_type""",
    "array_snapshot": r"""SELECT CAST(o_orderkey AS VARCHAR) AS numero_convocatoria,
       '{"' || o_orderpriority || '"},[\ "' || o_orderkey AS titulo, CASE WHEN o_orderstatus = 'F' THEN '}, {' END AS first_link,
       CASE WHEN o_orderstatus = 'F' THEN 'https://example.org/' || o_custkey END AS first_url, true AS no_entity FROM orders""",
    "array_ledger": """SELECT DISTINCT 'a, "' || o_custkey || '" ]' AS token FROM orders""",
    "keyed_snapshot": f"""WITH {LISTED}
SELECT id, max(o_orderkey) AS o_orderkey, arg_max(vacantes, o_orderkey) AS vacantes, arg_max(fuente, o_orderkey) AS fuente
FROM l GROUP BY id""",
    "seed_table": """WITH d AS (
  SELECT * FROM (VALUES (100, 'MALA'), (101, 'ASIA'), (102, 'SAN VICENTE DE CAÑETE'), (103, 'CHILCA'), (104, 'SAN ANTONIO'),
    (105, 'CALANGO'), (106, 'CERRO AZUL'), (107, 'COAYLLO'), (108, 'IMPERIAL'), (109, 'LUNAHUANÁ'), (110, 'NUEVO IMPERIAL'),
    (111, 'PACARÁN'), (112, 'QUILMANÁ'), (113, 'SAN LUIS'), (114, 'SANTA CRUZ DE FLORES'), (115, 'ZÚÑIGA')) v(ord, district)
  UNION ALL SELECT n_nationkey::INTEGER, n_name FROM nation),
n AS (SELECT ord, district, regexp_replace(strip_accents(lower(district)), '[^a-z0-9]+', '-', 'g') AS slug,
  array_to_string(list_transform(string_split(lower(district), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM d)
SELECT 'Computrabajo Perú' AS source, ord, district, 'https://pe.computrabajo.com/empleos-en-lima-en-' || slug AS url FROM n
UNION ALL SELECT 'Indeed Perú', ord, district, 'https://pe.indeed.com/jobs?l=' || replace(url_encode(
  CASE WHEN district IN ('SAN LUIS', 'SAN ANTONIO') THEN title || ' de Cañete' ELSE title END || ', Lima'), '%20', '+')
  || '&sort=date' FROM n
UNION ALL SELECT 'Bumeran Perú', ord, district, 'https://www.bumeran.com.pe/empleos-en-' || slug ||
  CASE WHEN district IN ('SAN LUIS', 'SAN ANTONIO') THEN '-de-canete' ELSE '' END || '-lima.html' FROM n
UNION ALL SELECT 'LinkedIn', NULL, NULL, 'https://pe.linkedin.com/jobs/search?keywords=&location=Provincia%20de%20Ca%C3%B1ete%2C'
  || '%20Lima%2C%20Per%C3%BA&geoId=106443255&position=1&pageNum=0'""",
    "serve_details": f"""WITH {LISTED.replace("'C-' || o.o_custkey", "'N-' || o.o_orderkey").replace(
        'o.o_orderdate,', 'o.o_orderdate, o.o_orderpriority AS p,')}
SELECT id, ubicacion AS district, CASE WHEN p = '3-MEDIUM' THEN 'direct' WHEN p IN ('4-NOT SPECIFIED', '5-LOW') THEN 'portal'
       ELSE 'none' END AS action_kind, p = '4-NOT SPECIFIED' AS certificate_notice,
       concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN 'Requerimiento=r' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'Experiencia=e' END,
                 CASE WHEN o_orderkey % 5 = 0 THEN 'Competencias=c' END) AS requirements,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Descargar bases o anexo oficial=https://example.org/' || o_orderkey END AS documents FROM l""",
    "serve_counts": f"""WITH {LISTED}
SELECT 'count' AS kind, n_name AS name, (SELECT count(*) FROM l WHERE l.ubicacion = n_name) AS n FROM nation
UNION ALL SELECT DISTINCT 'facet', ubicacion, 0 FROM l""",
    "raw_links": """WITH r AS (SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 9 AS n FROM orders)
SELECT pos, id, 'links_not_a_list' AS rule, CASE n WHEN 1 THEN '{"titulo": "t", "url": "https://example.org/' || pos || '"}'
       WHEN 5 THEN '"text"' ELSE 'not json' END AS detail FROM r WHERE n IN (1, 5, 6)
UNION ALL SELECT pos, id, 'invalid_document_link', unnest(CASE n WHEN 4 THEN ['', ''] ELSE ['https://sub.perutrabajos.com/d', ''] END)
FROM r WHERE n IN (4, 7)""",
    "document_types": """WITH f AS (SELECT p_partkey AS k, 's3/root/d' || p_partkey || '/f' || (p_partkey % 40) ||
    ['.tmp', '.PDF', '', '.tmp', '.docx'][p_partkey % 5 + 1] AS name,
    CASE WHEN p_partkey % 5 = 0 THEN unhex('504B0304') ELSE encode('%PDF') END || encode(p_name) AS content FROM part)
SELECT name, substr(sha256(content), 1, 10) AS version, ['.docx', '.pdf', '.docx', '.tmp', '.docx'][k % 5 + 1] AS doc_ext FROM f
UNION ALL SELECT s_name, '1', NULL FROM supplier""",
    "document_renames": """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN './' ELSE '' END ||
    'd' || p_partkey || '/f' || (p_partkey % 40) || ['.docx', '.PDF', '', '.tmp', '.docx'][p_partkey % 5 + 1] END AS archivo_oficial,
    p_partkey % 7 <> 0 AND p_partkey % 5 = 0 AS renamed FROM part""",
    "text_records": f"""SELECT 'C-' || c_custkey AS numero_convocatoria, c_name AS titulo, c_mktsegment AS entidad,
       r_name || ' - ' || n_name || ' - ' || c_mktsegment AS ubicacion, r_name AS departamento, n_name AS provincia,
       c_mktsegment AS distrito, CAST(c_custkey % 4 AS VARCHAR) AS vacantes, 'S/. ' || c_nationkey AS remuneracion,
       '01/02/2001' AS fecha_inicio, '01/02/2001' AS fecha_fin FROM {CUST} WHERE length(c_name) > 3""",
    "service_codes": """SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber <> 3 AND l_partkey >= 1000 THEN CAST(l_partkey AS VARCHAR) END AS code FROM lineitem""",
    "crawl_completeness": """SELECT l_orderkey AS crawl, max(CASE WHEN l_returnflag <> 'A' THEN l_linenumber END)::BIGINT AS max_page,
       max(CASE WHEN l_returnflag <> 'A' THEN l_orderkey % 7 + 1 END)::BIGINT AS total,
       coalesce(max(CASE WHEN l_returnflag <> 'A' THEN l_linenumber END)
                >= max(CASE WHEN l_returnflag <> 'A' THEN l_orderkey % 7 + 1 END), true) AS complete
FROM lineitem GROUP BY l_orderkey""",
    "place_names": f"""WITH n AS (SELECT c_custkey, c_name, n_name, lower(n_name || ' ' || c_mktsegment) AS name FROM {CUST})
SELECT c_custkey,
       CASE name WHEN 'brazil machinery' THEN 'Brasil (Máquinas)' WHEN 'kenya building' THEN 'Nairobi'
            ELSE list_aggregate(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END AS place,
       CASE name WHEN 'brazil machinery' THEN 'brazil' WHEN 'kenya building' THEN 'kenya'
            ELSE trim(regexp_replace(name, '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
       sha256(c_name || chr(10) || '  ' || n_name || chr(10) || chr(10)) AS lines_sha256 FROM n""",
    "canonical_url": """SELECT page_id, CASE WHEN split_part(split_part(url, '://', 2), '/', 1) = 'm.tiontion.example.com'
       AND split_part(url, '/', 4) = 'en' AND contains(substr(split_part(url, '://', 2), 24), '/')
       THEN rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') ELSE '' END AS url FROM pages""",
    "key_param_url": """SELECT page_id, CASE WHEN page_id % 5 <> 0
       THEN 'https://pe.indeed.com/viewjob?jk=' || page_id ELSE '' END AS url FROM pages""",
    "seed_urls": """SELECT n_nationkey AS ord, 'https://' || replace(lower(r_name), ' ', '-') || '.example.com/empleos-en-'
       || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '.html' AS url
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "index_cards": f"""WITH {LISTED}
SELECT o_orderkey, titulo, entidad, trim(split_part(ubicacion, '-', 1)) AS loc_department, vacantes, code,
       fuente AS source_badge, {slug("id || '-' || titulo")} || '.html' AS file_name FROM l""",
    "listing_defaults": f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'LinkedIn' ELSE 'SERVIR - Talento Perú' END AS fuente,
       '{RECORD_URL}' AS url_oficial,
       {ident('CAST(o_custkey AS VARCHAR)', 'CAST(o_orderkey AS VARCHAR)', 'o_orderpriority', 'o_orderstatus')} AS id FROM orders""",
    "serve_views": f"""WITH {LISTED}
SELECT ubicacion AS label, count(*) AS n_cards, count(DISTINCT id) AS n_ids FROM l
WHERE ubicacion IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1""",
    "document_lookup": """WITH c AS (SELECT p_partkey, p_size % 5 <> 0 AS there,
       CASE WHEN p_size % 2 = 0 THEN 'docs/' || p_partkey || '.pdf' END AS own,
       CASE WHEN p_size % 3 = 0 THEN 'old/' || p_partkey || '.pdf' END AS prev FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN there AND coalesce(prev, own) IS NOT NULL THEN coalesce(prev, own) ELSE own END
       AS archivo_oficial, there AND coalesce(prev, own) IS NOT NULL AS has_document FROM c""",
    "link_rules": """SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS id, 'invalid_document_link' AS rule,
       CASE o_orderpriority WHEN '2-HIGH' THEN 'https://sub.perutrabajos.com/d/' || o_orderkey
            WHEN '3-MEDIUM' THEN 'ftp://example.com/a.pdf' ELSE '' END AS detail
FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "file_rules": f"""WITH r AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS id, p_size,
       {slug("CAST(p_partkey AS VARCHAR) || '-' || p_name")} || '.html' AS name FROM part)
SELECT pos, id, 'missing_detail_file' AS rule, name AS detail FROM r WHERE pos % 3 = 0
UNION ALL SELECT pos, id, 'forbidden_general_list', name FROM r WHERE pos % 3 <> 0 AND pos % 7 = 0
UNION ALL SELECT pos, id, 'forbidden_word_document', name FROM r WHERE pos % 3 <> 0 AND pos % 7 <> 0 AND pos % 11 = 0
UNION ALL SELECT pos, id, 'missing_document', 'd/' || id FROM r WHERE p_size % 2 = 0 AND pos % 4 <> 0""",
    "stream_upsert": """WITH o AS (SELECT *, year(o_orderdate) * 1000000000000 + o_orderkey AS pos FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderpriority, pos) AS titulo,
       CAST(arg_max(o_orderkey, pos) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR) AS requerimiento FROM o GROUP BY 1""",
    "page_cards": r"""WITH c AS (SELECT page_id, unnest(string_split(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>',
       ' ', 'g'), '<article')[2:]) AS rest, unnest(generate_series(0, len(string_split(html, '<article')) - 2)) AS card_pos FROM pages),
t AS (SELECT page_id, card_pos, '<article' || split_part(rest, '</article', 1) AS card FROM c),
v AS (SELECT *, regexp_replace(card, '<[^>]*>', ' ', 'g') AS seen, split_part(split_part(card, '<h1>', 2), '</h1>', 1) AS h FROM t)
SELECT page_id, card_pos::INTEGER AS card_pos, DECODED(h) AS title,
       (length(card) - length(replace(card, '<p>', ''))) // 3 AS n_paragraphs, length(DECODED(seen)) AS card_chars FROM v""",
}


def _decoded(sql: str) -> str:
    """DECODED(x): character references decoded, white space runs as one space, trimmed."""
    import re

    def body(m):
        x = m[1]
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "),
                           ("&amp;", "&")):
            x = f"replace({x}, '{name}', '{char}')"
        return f"trim(regexp_replace({x}, '[\\s ]+', ' ', 'g'))"

    return re.sub(r"DECODED\((\w+)\)", body, sql)


def sql() -> dict[str, str]:
    return {name: _decoded(text) for name, text in SQL.items()}
