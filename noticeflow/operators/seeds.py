"""Search addresses: every district on every source, each with its own names for ambiguous districts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx


def _named(aliases: dict) -> Column:
    return tx.place_display(F.col("district"), aliases)


def seed_urls(districts: DataFrame) -> DataFrame:
    """(source, ord, district, url) for a table of (ord, district); one source searches the province as a whole."""
    district = F.col("district")
    per_district = {
        fv.SOURCE_COMPUTRABAJO: F.concat(F.lit(fv.BASE_COMPUTRABAJO + fv.SEED_PATH_COMPUTRABAJO), tx.url_slug(district, {})),
        fv.SOURCE_INDEED: F.concat(F.lit(fv.BASE_INDEED + "/jobs?l="), F.url_encode(F.concat(
            _named(fv.PLACE_NAMES_INDEED), F.lit(", Lima"))), F.lit("&sort=date")),
        fv.SOURCE_BUMERAN: F.concat(F.lit(fv.BASE_BUMERAN + "/empleos-en-"), tx.url_slug(district, fv.SLUGS_BUMERAN),
                                    F.lit("-lima.html")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), u.alias("url")) for s, u in per_district.items()]))
    rows = districts.select("ord", "district", each.alias("s")).select("s.source", "ord", "district", "s.url")
    whole = districts.sparkSession.range(1).select(
        F.lit(fv.SOURCE_LINKEDIN).alias("source"), F.lit(None).cast(districts.schema["ord"].dataType).alias("ord"),
        F.lit(None).cast("string").alias("district"), F.lit(fv.BASE_LINKEDIN + fv.SEED_PATH_LINKEDIN).alias("url"))
    return rows.unionByName(whole)
