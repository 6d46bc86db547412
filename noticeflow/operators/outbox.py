"""Publication queue: ledger anti-join, still-open filter, newest-first top-N, message text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates as dt
from ..functions import text as tx
from .views import salary_display


def not_in_ledger(df: DataFrame, ledger: DataFrame, keys=("id", "numero_convocatoria"),
                  token: str = "token") -> DataFrame:
    """Rows whose id *and* reference are both absent from the ledger.

    ``a NOT IN L AND b NOT IN L`` is two chained equi anti joins; a single join
    on ``a = t OR b = t`` would plan as a nested loop.
    """
    tokens = ledger.select(F.col(token).alias("_tok")).distinct()
    out = df
    for k in keys:
        out = out.join(tokens, F.col(k) == F.col("_tok"), "left_anti")
    return out


def pending(df: DataFrame, ledger: DataFrame, as_of, limit: int = fv.PUBLISH_LIMIT,
            pos: str = "pos", start_col: str = "fecha_inicio", end_col: str = "fecha_fin") -> DataFrame:
    """Newest-first publication queue (unparsable dates last, ties in snapshot order)."""
    out = not_in_ledger(df, ledger).where(dt.still_open(F.col(end_col), as_of))
    out = out.withColumn("published_on", dt.parse_dmy(F.col(start_col)))
    return out.orderBy(F.col("published_on").desc_nulls_last(), F.col(pos).asc()).limit(limit)


def message(df: DataFrame, site_url: str = "https://example.org") -> DataFrame:
    """Adds ``message``: the multi-line announcement; the call to action depends on a direct link."""
    sheet = F.concat(F.lit(site_url.rstrip("/") + "/ofertas/"), tx.file_name("id", "titulo"))
    app = F.col("url_postulacion") if "url_postulacion" in df.columns else F.lit(None).cast("string")
    cta = F.when(tx.truthy(app), F.concat(
        F.lit("Postula directamente en el enlace oficial:\n"), app,
        F.lit("\n\nRequisitos, bases y resumen:\n"), sheet,
    )).otherwise(F.concat(F.lit("Requisitos y enlace de postulación:\n"), sheet))
    text = F.concat(
        F.lit(fv.MESSAGE_HEADER + "\n\n"),
        F.lit("🔹 "), F.col("titulo"), F.lit("\n"),
        F.lit("🏢 "), F.col("entidad"), F.lit("\n"),
        F.lit("📍 "), F.col("ubicacion"), F.lit("\n"),
        F.lit("💰 Remuneración: "), salary_display("remuneracion", handle_unspecified=False), F.lit("\n"),
        F.lit("👥 Vacantes: "), F.col("vacantes"), F.lit("\n"),
        F.lit("📅 Publicación: "), F.col("fecha_inicio"), F.lit(" — Cierre: "), F.col("fecha_fin"), F.lit("\n\n"),
        cta, F.lit("\n\n"),
        F.lit(fv.MESSAGE_TAGS),
    )
    return df.withColumn("message", text)


def outbox_rows(queue: DataFrame, as_of, site_url: str = "https://example.org") -> DataFrame:
    """The re-aimed sink: (id, message, as_of, status) rows of an outbox table.

    A row that lacks a part of its message has none and is not published; the
    audit reports it as ``missing_fields``.
    """
    return message(queue, site_url).where("message is not null").select(
        "id", "message", dt.as_date(as_of).alias("as_of"), F.lit("pending").alias("status"))
