"""Snapshot refresh: per-source fallback, freshness window, last-wins by URL.

Order matters and is kept: fallback -> freshness filter -> last-wins dedupe
(a stale later duplicate never replaces a fresh one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates as dt
from .common import lineage_pos
from .dedupe import last_wins


def source_fallback(prev: DataFrame, new: DataFrame, sources: DataFrame, source_col: str = "fuente") -> DataFrame:
    """Previous rows survive only for known sources that returned nothing now.

    Rows of unknown sources in ``prev`` are dropped.  The sources that answered
    are aggregated from ``new`` first; how the joins run is left to the planner,
    which sees the sizes.
    """
    answered = new.select(source_col).distinct()
    silent = sources.select(source_col).distinct().join(answered, source_col, "left_anti")
    return prev.join(silent, source_col, "left_semi").unionByName(new, allowMissingColumns=True)


def fresh(df: DataFrame, as_of, max_days: int = fv.MAX_AGE_DAYS, start_col: str = "fecha_inicio") -> DataFrame:
    """Keep rows published 0..max_days days before ``as_of``; unparsable dates are dropped."""
    return df.where(dt.age_in_window(F.col(start_col), as_of, max_days))


def refresh(prev: DataFrame, new: DataFrame, sources: DataFrame, as_of,
            max_days: int = fv.MAX_AGE_DAYS, url_col: str = "url_oficial") -> DataFrame:
    """The full refresh of a multi-source snapshot (lineage columns required).

    Rows without a URL have no identity to be deduplicated by: they are left to
    the audit (``rows_without_url``) and never merged with each other.
    """
    merged = source_fallback(prev, new, sources).where(F.col(url_col).isNotNull())
    return last_wins(fresh(merged, as_of, max_days), url_col, lineage_pos())


def rows_without_url(df: DataFrame, url_col: str = "url_oficial") -> DataFrame:
    """The rows that a refresh sets aside, for the audit."""
    return df.where(F.col(url_col).isNull())


def source_status(sources: DataFrame, new: DataFrame, source_col: str = "fuente") -> DataFrame:
    """Per source: rows returned now and whether the previous rows were kept."""
    counts = new.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_new"))
    out = sources.join(counts, source_col, "left")
    n = F.coalesce(F.col("n_new"), F.lit(0))
    return out.select(
        *sources.columns, n.alias("n_new"),
        F.when(n > 0, F.lit("updated")).otherwise(F.lit("kept previous")).alias("status"))


class EmptyResult(RuntimeError):
    pass


def require_rows(df: DataFrame, message: str = "no rows: the previous snapshot is kept") -> DataFrame:
    """Abort (keep the old snapshot) when a result is empty."""
    if df.isEmpty():
        raise EmptyResult(message)
    return df
