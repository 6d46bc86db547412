"""DuckDB SQL for the portal queries: the listings follow from the customers that the pages were written from."""

from __future__ import annotations

# days since publication per age text, in the order of the queries' list; NULL is never recent
DAYS = "[2, 1, 9, 0, 7, NULL, 0][c_custkey % 7 + 1]"
DATE = f"strftime(DATE '2026-03-10' - {DAYS}::INTEGER, '%d/%m/%Y')"


def _final(prefix: str, limit: int, rows: str) -> str:
    return f"""WITH {rows},
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY c_custkey) AS k FROM listed WHERE {DAYS} <= 7)
SELECT page_id, titulo, entidad, ubicacion, distrito, remuneracion, {DATE} AS fecha_inicio, url_oficial,
       '{prefix}-' || upper(substr(sha256(url_oficial), 1, 10)) AS numero_convocatoria
FROM kept WHERE k <= {limit}"""


SQL = {
    "computrabajo_cards": _final("CT", 12, """c AS (
  SELECT *, c_custkey // 40 AS page_id, c_name AS titulo,
         ['Asia, Lima', 'Mala, Lima', 'Trujillo, La Libertad', 'Imperial, Cañete'][c_custkey % 4 + 1] AS ubicacion,
         'https://pe.computrabajo.com/ofertas-de-trabajo/p' || (c_custkey - CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END)
         || '?x=1&y' AS url_oficial,
         ['Hace 2 días', 'Ayer', 'Hace 9 días', 'Hoy', 'Hace 1 semana', 'hace más de 30 días', 'Hace 5 horas'][c_custkey % 7 + 1] AS age
  FROM customer),
listed AS (SELECT page_id, c_custkey, titulo, ubicacion, url_oficial, upper(split_part(ubicacion, ',', 1)) AS distrito,
         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN NOT starts_with(lower(age), 'hace ') THEN age
              WHEN c_custkey % 3 = 0 THEN 'S/. ' || c_nationkey ELSE 'Empresa no especificada' END AS entidad,
         CASE WHEN c_custkey % 3 = 0 THEN 'S/. ' || c_nationkey ELSE 'No especificado' END AS remuneracion
  FROM c WHERE c_custkey % 4 <> 2
  QUALIFY row_number() OVER (PARTITION BY page_id, url_oficial ORDER BY c_custkey) = 1)"""),
    "indeed_cards": _final("IN", 10, """listed AS (
  SELECT *, c_custkey // 25 AS page_id, c_name AS titulo, c_mktsegment AS entidad,
         ['Asia, Lima', 'San Luis de Cañete', 'Chincha'][c_custkey % 3 + 1] AS ubicacion,
         ['ASIA', 'SAN LUIS'][(c_custkey // 25) % 2 + 1] AS distrito,
         CASE WHEN c_custkey % 4 = 0 THEN 'S/. 5' ELSE 'No especificado' END AS remuneracion,
         'https://pe.indeed.com/viewjob?jk=' || c_custkey AS url_oficial
  FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 = (c_custkey // 25) % 2)"""),
    "linkedin_cards": _final("LI", 100, """c AS (
  SELECT *, c_custkey // 500 AS page_id, c_name || CASE WHEN c_custkey % 9 = 0 THEN ' en Quilmaná' ELSE '' END AS titulo,
         c_mktsegment AS entidad, 'No especificado' AS remuneracion,
         ['Lunahuaná', 'Lima', 'San Antonio, Lima', 'nuevo imperial'][c_custkey % 4 + 1] AS ubicacion,
         'https://pe.linkedin.com/jobs/view/p-' || c_custkey AS url_oficial FROM customer),
listed AS (SELECT *, CASE c_custkey % 4 WHEN 3 THEN 'IMPERIAL' WHEN 0 THEN 'LUNAHUANÁ' ELSE 'QUILMANÁ' END AS distrito
  FROM c WHERE c_custkey % 4 IN (0, 3) OR c_custkey % 9 = 0)"""),
    "bumeran_cards": _final("BU", 10, """listed AS (
  SELECT *, c_custkey // 30 AS page_id, c_name AS titulo, 'Empresa no especificada' AS entidad,
         CASE (c_custkey // 30) % 2 WHEN 0 THEN 'Cerro Azul, Lima' ELSE 'San Antonio de Cañete, Lima' END AS ubicacion,
         ['CERRO AZUL', 'SAN ANTONIO'][(c_custkey // 30) % 2 + 1] AS distrito, 'No especificado' AS remuneracion,
         'https://www.bumeran.com.pe/empleos/x-' || c_custkey || '.html' AS url_oficial
  FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey % 3 = 2 * ((c_custkey // 30) % 2))"""),
}


def sql() -> dict[str, str]:
    return dict(SQL)
