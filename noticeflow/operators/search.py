"""Interactive search over listings: filters, saved-set semi join, locale sort, section visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Two collations on purpose: search matches ñ with n (accent-insensitive),
# the locale sort keeps ñ after n (Spanish, case- and accent-insensitive).
SORT_COLLATION = "es_CI_AI"


def search(df: DataFrame, text: str | None = None, district: str | None = None,
           saved: DataFrame | None = None, fields=("titulo", "entidad", "distrito"),
           district_col: str = "distrito", key: str = "id") -> DataFrame:
    """Rows matching every non-empty parameter.

    ``text`` is normalized like the search box (NFD, marks removed, lower,
    trimmed) and must be a substring of the normalized ``title entity district``.
    ``saved`` (a DataFrame of ids) keeps only saved rows (left semi join).
    """
    out = df
    if district:
        out = out.where(F.col(district_col) == F.lit(district))
    if text:
        needle = tx.search_key(F.lit(text))
        hay = tx.search_key(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
        out = out.where(F.when(needle == "", F.lit(True)).otherwise(hay.contains(needle)))
    if saved is not None:
        out = out.join(saved.select(key).distinct(), key, "left_semi")
    return out


def visibility(df: DataFrame, text: str | None = None, district: str | None = None,
               saved: DataFrame | None = None, fields=("titulo", "entidad", "distrito"),
               district_col: str = "distrito", key: str = "id") -> DataFrame:
    """Every row with a ``visible`` flag (the search predicate as a column)."""
    flag = F.lit(True)
    if district:
        flag = flag & (F.col(district_col) == F.lit(district))
    if text:
        needle = tx.search_key(F.lit(text))
        hay = tx.search_key(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
        flag = flag & F.when(needle == "", F.lit(True)).otherwise(hay.contains(needle))
    out = df
    if saved is not None:
        marks = saved.select(key).distinct().withColumn("_saved", F.lit(True))
        out = out.join(marks, key, "left")
        flag = flag & F.coalesce(F.col("_saved"), F.lit(False))
    return out.withColumn("visible", flag).drop("_saved")


def section_visibility(df_with_visible: DataFrame, dim: DataFrame, section_col: str = "distrito",
                       dim_key: str = "district", text: str | None = None, district: str | None = None,
                       saved_only: bool = False) -> DataFrame:
    """Per dimension section: visible hits, total rows, and whether the section shows.

    A section shows when it has a visible hit, or when it is empty, selected,
    and neither text nor saved-only filtering is active; a text of blanks is none.
    """
    counts = (df_with_visible.groupBy(F.col(section_col).alias(dim_key))
              .agg(F.count_if("visible").alias("n_visible"), F.count(F.lit(1)).alias("n_rows")))
    out = dim.join(counts, dim_key, "left")
    nv = F.coalesce(F.col("n_visible"), F.lit(0)).cast("bigint")
    nr = F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint")
    blank = tx.search_key(F.lit(text or "")) == ""
    empty_selected = (nr == 0) & blank & F.lit(not saved_only) & (F.col(dim_key) == F.lit(district or ""))
    return out.select(*dim.columns, nv.alias("n_visible"), nr.alias("n_rows"),
                      ((nv > 0) | empty_selected).alias("section_visible"))


def locale_order(df: DataFrame, by: str = "titulo", pos: str = "pos") -> DataFrame:
    """Sort by a text column with Spanish base-strength collation, ties in original order."""
    return df.orderBy(F.collate(F.col(by), SORT_COLLATION), F.col(pos))


def toggle_saved(saved: DataFrame, toggles: DataFrame, key: str = "id") -> DataFrame:
    """Apply toggles to a saved set: an id toggled an odd number of times flips membership."""
    flips = toggles.groupBy(key).agg((F.count(F.lit(1)) % 2 == 1).alias("_odd")).where("_odd").select(key)
    s = saved.select(key).distinct().withColumn("_in", F.lit(True))
    f = flips.withColumn("_flip", F.lit(True))
    both = s.join(f, key, "full_outer")
    return both.where(F.col("_in").isNull() | F.col("_flip").isNull()).select(key)


def ledger_add(ledger: DataFrame, tokens: DataFrame, col: str = "token") -> DataFrame:
    """Set add, written unique and sorted."""
    return ledger.select(col).unionByName(tokens.select(col)).distinct().orderBy(col)
