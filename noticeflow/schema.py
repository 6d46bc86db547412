"""Explicit schemas and small dimension tables.

Listings keep the wire strings (dates as dd/MM/yyyy text) and carry a lineage
triple ``(src_ord, page_id, card_pos)`` that replaces Python list order: every
first-wins / last-wins decision orders by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import fixed_values as fv

S = T.StringType()

LINK = T.StructType([T.StructField("titulo", S), T.StructField("url", S)])

LISTING_FIELDS = (
    "id", "titulo", "entidad", "ubicacion", "departamento", "provincia", "distrito",
    "numero_convocatoria", "vacantes", "remuneracion", "fecha_inicio", "fecha_fin",
    "fuente", "url_oficial",
)
OPTIONAL_FIELDS = (
    "url_postulacion", "url_consulta", "codigo_servir", "archivo_oficial", "requerimiento",
    "experiencia", "formacion_academica", "especializacion", "conocimiento", "competencias",
    "detalle_entidad",
)

LISTING = T.StructType(
    [T.StructField(n, S) for n in LISTING_FIELDS + OPTIONAL_FIELDS]
    + [T.StructField("enlaces_bases", T.ArrayType(LINK))]
)

LINEAGE = T.StructType([
    T.StructField("src_ord", T.IntegerType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("card_pos", T.IntegerType()),
])

LISTING_WITH_LINEAGE = T.StructType(LISTING.fields + LINEAGE.fields)

LEDGER = T.StructType([T.StructField("token", S)])
LEDGER_RUN = T.StructType([T.StructField("token", S), T.StructField("run", S)])

RAW_PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("source", S),
    T.StructField("district", S),
    T.StructField("url", S),
    T.StructField("html", S),
])


@dataclass(frozen=True)
class SourceSpec:
    """One portal: how its cards become listings."""
    name: str
    order: int
    prefix: str
    limit: int
    host: str
    base: str
    dedupe_before_age: bool      # page-level "seen" marked before the age test
    accent_sensitive_place: bool  # locality containment without accent folding


SOURCES = (
    SourceSpec(fv.SOURCE_COMPUTRABAJO, 0, fv.PREFIX_COMPUTRABAJO, fv.LIMIT_COMPUTRABAJO,
               fv.HOST_COMPUTRABAJO, fv.BASE_COMPUTRABAJO, True, True),
    SourceSpec(fv.SOURCE_INDEED, 1, fv.PREFIX_INDEED, fv.LIMIT_INDEED,
               fv.HOST_INDEED, fv.BASE_INDEED, False, False),
    SourceSpec(fv.SOURCE_LINKEDIN, 2, fv.PREFIX_LINKEDIN, fv.LIMIT_LINKEDIN,
               fv.HOST_LINKEDIN, fv.BASE_LINKEDIN, False, False),
    SourceSpec(fv.SOURCE_BUMERAN, 3, fv.PREFIX_BUMERAN, fv.LIMIT_BUMERAN,
               fv.HOST_BUMERAN, fv.BASE_BUMERAN, False, False),
)
SOURCE_BY_NAME = {s.name: s for s in SOURCES}


def districts_df(spark: SparkSession) -> DataFrame:
    """Dimension ``(ord int, district string)`` in declared order (16 rows)."""
    return spark.createDataFrame(list(enumerate(fv.DISTRICTS)), "ord int, district string")


def sources_df(spark: SparkSession) -> DataFrame:
    """Dimension ``(src_ord, fuente, host, prefix, limit)`` (4 rows)."""
    return spark.createDataFrame(
        [(s.order, s.name, s.host, s.prefix, s.limit) for s in SOURCES],
        "src_ord int, fuente string, host string, prefix string, card_limit int")


def empty_listings(spark: SparkSession, lineage: bool = False) -> DataFrame:
    return spark.createDataFrame([], LISTING_WITH_LINEAGE if lineage else LISTING)
