"""Composed jobs: refresh, keyed upsert, serving views, publication queue, audit.

Each job reads tables, runs the operators and writes new, versioned outputs
(``.../run=<as_of>``).  Snapshots are staged and published by a rename, and an
empty result is not published, so a failed or empty run leaves the previous
snapshot as it was.  Re-running a job for the same ``as_of`` gives the same
directory again; a publication run finds the messages it has already taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schema as sc
from .. import storage
from ..functions import dates as dt
from ..functions import text as tx
from ..operators import audit as au
from ..operators import extract as ex
from ..operators import merge as mg
from ..operators import outbox as ob
from ..operators import portals as pt
from ..operators import refresh as rf
from ..operators import views as vw
from ..session import materialize
from ..sources import files as fs


def _run_dir(root: str, as_of) -> str:
    return f"{root.rstrip('/')}/run={as_of}"


def write_snapshot(df: DataFrame, root: str, as_of, partition_by: str | None = "fuente") -> str:
    """SNK-1, AGG-9: a new versioned snapshot directory; the plan runs once.

    The rows are staged and counted in the same pass, and only a result with
    rows takes the name of the run: an empty one leaves the snapshot of that
    date as it was.
    """
    path = _run_dir(root, as_of)
    if storage.write_published(df, path, partition_by, allow_empty=False) is None:
        raise rf.EmptyResult("no rows: the previous snapshot is kept")
    return path


def refresh_job(spark: SparkSession, prev: DataFrame, pages: DataFrame, as_of, out_root: str) -> dict:
    """Pages -> portal listings -> fallback / freshness / last-wins -> versioned snapshot."""
    # Saved once (reliable checkpoint in the shared folder): the refresh and the
    # status both read it, and each would otherwise run the extraction again.
    new = materialize(pt.all_portal_listings(pages, as_of))
    sources = sc.sources_df(spark)
    snap = rf.refresh(prev, new, sources, as_of).drop("first_pos")
    path = write_snapshot(snap, out_root, as_of)
    status = rf.source_status(sources, new)
    return {"snapshot": path, "status": status}


def upsert_job(spark: SparkSession, prev: DataFrame, texts: DataFrame, as_of, out_root: str,
               details: DataFrame | None = None, crawl: DataFrame | None = None) -> dict:
    """Official-portal text pages -> records -> carry-forward upsert -> superseded -> expiry -> snapshot + summary.

    ``prev`` carries ``pos`` below every new row (e.g. -1); ``texts`` is (page_id, text);
    ``details`` optionally (numero_convocatoria, detail columns...), joined before the id is
    made; ``crawl`` optionally the result of ``crawl_completeness``: an incomplete one aborts.
    """
    if crawl is not None and not crawl.where("not complete").isEmpty():
        raise rf.EmptyResult("the crawl is incomplete: the previous snapshot is kept")
    recs = ex.text_records(texts)
    if details is not None:
        # Details come before the id: a service code found there is part of it.
        recs = recs.join(details, "numero_convocatoria", "left")
    recs = materialize(mg.with_base_key(vw.with_listing_columns(recs)))
    rf.require_rows(recs, "no records in the crawl: the previous snapshot is kept")
    new = recs.withColumn("pos", F.struct(F.lit(0).alias("b"), F.col("page_id").alias("p"), F.col("card_pos").alias("c")))
    old = mg.with_base_key(vw.with_listing_columns(prev)).withColumn(
        "pos", F.struct(F.lit(-1).alias("b"), F.lit(0).cast("bigint").alias("p"), F.lit(0).alias("c")))
    both = mg.carry_forward_upsert(old, new, key="id", pos="pos")
    up = materialize(mg.with_superseded(both).withColumn("open", dt.not_expired(F.col("fecha_fin"), as_of)))
    after = up.where("not superseded and open")
    path = write_snapshot(after.drop("pos", "base_key", "page_id", "card_pos", "superseded", "open"), out_root, as_of)
    known = old.select("id").distinct().withColumn("n_before", F.lit(1))
    summary = mg.run_summary(up.join(known, "id", "left").fillna(0, ["n_before"]), document="archivo_oficial"
                             if "archivo_oficial" in up.columns else None)
    return {"snapshot": path, "summary": summary}


def serve_views(spark: SparkSession, snapshot: DataFrame, dim: DataFrame, out_root: str, as_of) -> str:
    """SNK-3: index and detail view tables by district, counts and facets; returns their folder.

    The label travels with each row; listings of districts outside the dimension have no section.
    """
    lst = vw.with_listing_columns(snapshot)
    labelled = vw.location_parts(lst).withColumn("label", vw.group_label())
    listed = labelled.join(dim.select(F.col("district").alias("label")), "label", "left_semi")
    base = _run_dir(out_root, as_of)
    vw.index_cards(listed, "label").write.mode("overwrite").partitionBy("label").parquet(base + "/index_view")
    vw.detail_view(listed, keep=("id", "label")).write.mode("overwrite").partitionBy("label").parquet(
        base + "/detail_view")
    vw.district_counts(labelled, dim).write.mode("overwrite").parquet(base + "/district_counts")
    vw.facets(labelled, ["loc_district"]).write.mode("overwrite").parquet(base + "/facets")
    return base


def serve_job(spark: SparkSession, snapshot: DataFrame, out_root: str, as_of) -> dict:
    return {"root": serve_views(spark, snapshot, sc.districts_df(spark), out_root, as_of)}


def publish_job(spark: SparkSession, snapshot: DataFrame, ledger_path: str, as_of, outbox_root: str,
                limit: int = fv.PUBLISH_LIMIT, site_url: str = "https://example.org", pos: str = "pos",
                run=None) -> DataFrame:
    """SNK-2 (re-aimed): the newest pending rows become one outbox run, and their ids go into the ledger.

    ``run`` (the date by default) names the run.  A run that is started again
    finds its own messages and takes no others; if it was lost between its two
    writes, the ledger is completed from its messages.  ``snapshot`` carries its
    row order in ``pos``.
    """
    run = as_of if run is None else run
    path = _run_dir(outbox_root, run)
    if not storage.exists(spark, path):
        queue = ob.pending(vw.with_listing_columns(snapshot), fs.read_ledger(spark, ledger_path, "parquet"), as_of,
                           limit, pos=pos)
        storage.write_published(ob.outbox_rows(queue, as_of, site_url), path)
    rows = spark.read.parquet(path)
    fs.append_ledger(rows.select(F.col("id").alias("token")), ledger_path, run)
    return rows


def report_results(spark: SparkSession, results: DataFrame, ledger_path: str, outbox_root: str, run) -> DataFrame:
    """What a sender reports for a run, (id, status): failed ids leave the ledger, so a later run takes them again.

    Returns the run's messages with their status (sent, failed, pending).
    """
    failed = results.where(F.col("status") == "failed").select(F.col("id").alias("token"))
    rows = spark.read.parquet(_run_dir(outbox_root, run))
    own = rows.select(F.col("id").alias("token"))
    fs.release_ledger(failed.join(own, "token", "left_semi"), ledger_path, run)
    return mark_status(rows, results)


def mark_status(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Outbox rows with the status (sent, failed) that a sender reported by id; others stay pending."""
    r = results.select("id", F.col("status").alias("_status"))
    return outbox.join(r, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


class AuditFailed(RuntimeError):
    pass


def audit_job(spark: SparkSession, snapshot: DataFrame, detail_dir: str | None, as_of,
              documents_dir: str | None = None, strict: bool = False) -> DataFrame:
    """AUD-1..3 + JN-7: all violations; ``strict`` raises when any is found (the caller keeps the old site)."""
    rf.require_rows(snapshot, "empty snapshot: nothing to publish")
    lst = vw.with_listing_columns(snapshot)
    out = au.row_violations(lst, as_of)
    if detail_dir:
        gen = fs.file_inventory(spark, detail_dir, "*.html", with_content=True).select(
            "name", F.decode("content", "UTF-8").alias("content"))
        docs = fs.file_inventory(spark, documents_dir) if documents_dir else None
        out = out.unionByName(au.file_violations(lst, gen, docs))
        expected = lst.select(tx.file_name("id", "titulo").alias("name"))
        diff = au.name_diff(expected, gen.select("name"))
        obsolete = diff.where(F.col("status") == "obsolete").select(
            F.lit(None).cast(out.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("id"),
            F.lit("obsolete_file").alias("rule"), F.col("name").alias("detail"))
        out = out.unionByName(obsolete)
    out = out.withColumn("as_of", dt.as_date(as_of))
    if strict and not out.isEmpty():
        raise AuditFailed("the snapshot breaks rules: the previous site is kept")
    return out
