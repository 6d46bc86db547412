"""Keyed upsert with carry-forward, superseded-row removal, expiry, run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates as dt
from ..functions import text as tx


def carry_forward_upsert(prev: DataFrame, new: DataFrame, key: str = "id", pos: str = "pos",
                         carried=fv.CARRIED_COLUMNS, count_below: tuple | None = None) -> DataFrame:
    """Upsert ``new`` into ``prev`` by ``key``.

    ``count_below`` = (position, name) adds the number of versions below that
    position, which is how many rows of ``prev`` went into each key.

    The latest version (max ``pos``) wins whole; each carried column falls back
    to its latest *present* (non-NULL) value among earlier versions.  An empty
    string is present and blocks the fallback; NULL (absent) does not.  This is
    a keyed aggregation over ``prev UNION new`` -- equal to a full outer join
    plus coalesce, and also right when one key occurs several times in ``new``.
    ``prev`` rows must carry a ``pos`` lower than every ``new`` row.
    """
    both = prev.unionByName(new, allowMissingColumns=True)
    carried = [c for c in carried if c in both.columns]
    others = [c for c in both.columns if c not in (key, pos) and c not in carried]
    p = F.col(pos)
    aggs = [F.max_by(F.struct(*others), p).alias("_last"), F.max(p).alias(pos)]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), p)).alias(c) for c in carried]
    extra = []
    if count_below:
        extra = [count_below[1]]
        aggs.append(F.count_if(p < F.lit(count_below[0])).alias(extra[0]))
    out = both.groupBy(key).agg(*aggs)
    cols = [F.col(key)] + [F.col("_last." + c).alias(c) for c in others] + [F.col(c) for c in carried] + [F.col(pos)]
    return out.select(*cols, *extra).select(key, *[c for c in both.columns if c != key], *extra)


def with_base_key(df: DataFrame, entity="entidad", reference="numero_convocatoria", title="titulo",
                  location="ubicacion", name: str = "base_key") -> DataFrame:
    return df.withColumn(name, tx.base_key(entity, reference, title, location))


def with_superseded(df: DataFrame, code: str = "codigo_servir", key: str = "base_key") -> DataFrame:
    """Adds ``superseded``: a row without a code whose base key has a coded row.

    One left join against the *distinct* coded keys; AQE splits a hot key on the
    large side.
    """
    coded = df.where(tx.truthy(code)).select(F.col(key).alias("_coded")).distinct()
    out = df.join(coded, F.col(key) == F.col("_coded"), "left")
    return out.withColumn("superseded", F.col("_coded").isNotNull() & ~F.coalesce(tx.truthy(code), F.lit(False))).drop(
        "_coded")


def split_superseded(df: DataFrame, code: str = "codigo_servir", key: str = "base_key"):
    """(kept, removed) by ``with_superseded``."""
    flagged = with_superseded(df, code, key)
    return (flagged.where("not superseded").drop("superseded"), flagged.where("superseded").drop("superseded"))


def remove_superseded(df: DataFrame, code: str = "codigo_servir", key: str = "base_key") -> DataFrame:
    return split_superseded(df, code, key)[0]


def split_expired(df: DataFrame, as_of, end_col: str = "fecha_fin"):
    """(kept, removed): close date (stripped text) before ``as_of`` is expired; unparsable kept."""
    ok = dt.not_expired(F.col(end_col), as_of)
    return df.where(ok), df.where(~ok)


def remove_expired(df: DataFrame, as_of, end_col: str = "fecha_fin") -> DataFrame:
    return split_expired(df, as_of, end_col)[0]


def run_summary(rows: DataFrame, n_before: str = "n_before", base_key: str = "base_key",
                code: str = "codigo_servir", open_col: str = "open", document: str | None = None) -> DataFrame:
    """One row: before, after, new (= after - before, may be negative), expired, merged, documents.

    ``rows`` is the upsert result; ``n_before`` says how many previous rows went
    into each.  Rows without a code whose base key has a coded row are merged;
    of the rest those that are not open are expired.  Two aggregations, by base
    key and over all: no branch is computed twice.
    """
    coded = tx.truthy(code)
    has = F.lit(False) if document is None else tx.truthy(document)

    def n(cond):
        return F.count_if(cond)

    keys = rows.groupBy(base_key).agg(
        F.sum(n_before).alias("b"), n(coded).alias("coded"), n(~coded).alias("plain"),
        n(coded & F.col(open_col)).alias("coded_open"), n(~coded & F.col(open_col)).alias("plain_open"),
        n(coded & F.col(open_col) & has).alias("coded_docs"), n(~coded & F.col(open_col) & has).alias("plain_docs"))
    kept = F.when(F.col("coded") > 0, 0).otherwise(1)
    out = keys.agg(
        F.sum("b").alias("n_before"),
        F.sum(F.col("coded_open") + kept * F.col("plain_open")).alias("n_after"),
        F.sum(F.col("coded") - F.col("coded_open") + kept * (F.col("plain") - F.col("plain_open"))).alias("n_expired"),
        F.sum((1 - kept) * F.col("plain")).alias("n_merged"),
        F.sum(F.col("coded_docs") + kept * F.col("plain_docs")).alias("n_documents"))
    out = out.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in out.columns])
    return out.withColumn("n_new", F.col("n_after") - F.col("n_before"))


def document_lookup(new: DataFrame, prev: DataFrame, existing_files: DataFrame,
                    key: str = "id", doc_col: str = "archivo_oficial", path_col: str = "path") -> DataFrame:
    """Previous document path by key, else the row's own, kept only if the file exists."""
    prev_docs = prev.select(key, F.col(doc_col).alias("_prev_doc")).where(tx.truthy("_prev_doc"))
    cand = new.join(prev_docs, key, "left").withColumn(
        "_cand", F.coalesce(F.nullif(F.col("_prev_doc"), F.lit("")), F.nullif(F.col(doc_col), F.lit(""))))
    files = existing_files.select(F.col(path_col).alias("_cand")).distinct().withColumn("_exists", F.lit(True))
    out = cand.join(files, "_cand", "left")
    return out.withColumn(doc_col, F.when(F.col("_exists"), F.col("_cand")).otherwise(F.col(doc_col))) \
        .withColumn("has_document", F.coalesce(F.col("_exists"), F.lit(False))) \
        .drop("_prev_doc", "_cand", "_exists")


def budgeted_selection(df: DataFrame, order: list, budget: int, has_col: str = "has_document") -> DataFrame:
    """Work list: the first ``budget`` rows still lacking a document, in page order.

    Rows that already have one do not consume budget.  A global top-N
    (TakeOrderedAndProject: per-partition top-N, then a final merge of N rows).
    """
    return df.where(~F.col(has_col)).orderBy(*order).limit(budget)
