import os

import pytest
from pyspark.sql import functions as F

from noticeflow import fixed_values as fv
from noticeflow import storage
from noticeflow.operators import extract
from noticeflow.operators.refresh import EmptyResult
from noticeflow.plans import jobs
from noticeflow.sources import files
from noticeflow.streaming import ingest
from tests.test_operators import sample

AS_OF = "2027-05-10"


@pytest.fixture
def snapshot(spark):
    from noticeflow import schema as sc
    rows = [tuple(r.get(f.name) for f in sc.LISTING.fields) + (k,) for k, r in enumerate(sample())]
    return spark.createDataFrame(rows, "struct<" + sc.LISTING.simpleString()[7:-1] + ",pos:int>")


def test_serve_lists_only_the_dimension(spark, snapshot, tmp_dir):
    extra = snapshot.limit(1).withColumn("ubicacion", F.lit("LIMA - LIMA - OTRO")).withColumn("pos", F.lit(99))
    out = jobs.serve_job(spark, snapshot.unionByName(extra), os.path.join(tmp_dir, "site"), AS_OF)
    index = spark.read.parquet(out["root"] + "/index_view")
    assert index.count() == len(sample()) and "OTRO" not in {r.label for r in index.select("label").distinct().collect()}
    counts = {r.district: r for r in spark.read.parquet(out["root"] + "/district_counts").collect()}
    assert counts["MALA"].n_listings == sum(r["ubicacion"].endswith("MALA") for r in sample())
    assert {r.total_listings for r in counts.values()} == {len(sample()) + 1}


def test_publishing_advances_the_ledger_and_repeats_leave_one_copy(spark, snapshot, tmp_dir):
    outbox, ledger = os.path.join(tmp_dir, "outbox"), os.path.join(tmp_dir, "ledger")
    first = {r.id for r in jobs.publish_job(spark, snapshot, ledger, AS_OF, outbox, limit=15).collect()}
    second = {r.id for r in jobs.publish_job(spark, snapshot, ledger, "2027-05-11", outbox, limit=15).collect()}
    third = {r.id for r in jobs.publish_job(spark, snapshot, ledger, "2027-05-12", outbox, limit=15).collect()}
    assert (len(first), len(second), len(third)) == (15, 15, 10) and not first & second and not (first | second) & third
    assert {r.token for r in files.read_ledger(spark, ledger, "parquet").collect()} == first | second | third
    rows = spark.read.parquet(outbox + "/run=2027-05-12")
    done = jobs.mark_status(rows, spark.createDataFrame([(sorted(third)[0], "failed")], "id string, status string"))
    assert sorted(r.status for r in done.collect()) == ["failed"] + ["pending"] * 9


def test_a_run_started_again_finds_its_messages_and_failed_ones_are_taken_again(spark, snapshot, tmp_dir):
    outbox, ledger = os.path.join(tmp_dir, "outbox"), os.path.join(tmp_dir, "ledger")

    def publish(run):
        return {r.id for r in jobs.publish_job(spark, snapshot, ledger, AS_OF, outbox, limit=15, run=run).collect()}

    first = publish("a")
    assert publish("a") == first and spark.read.parquet(outbox + "/run=a").count() == 15
    second = publish("b")
    storage.delete(spark, ledger + "/run=b")                   # lost between the two writes
    assert publish("b") == second and not first & second
    results = spark.createDataFrame([(i, "failed" if k < 3 else "sent") for k, i in enumerate(sorted(first))], "id string, status string")
    assert sorted(r.status for r in jobs.report_results(spark, results, ledger, outbox, "a").collect()) == ["failed"] * 3 + ["sent"] * 12
    third = publish("c")
    assert set(sorted(first)[:3]) <= third and not third & second and len(third) == 13
    assert {r.token for r in files.read_ledger(spark, ledger, "parquet").collect()} == first | second | third


def test_an_empty_run_keeps_the_snapshot_of_its_date(spark, snapshot, tmp_dir):
    path = jobs.write_snapshot(snapshot, tmp_dir, AS_OF)
    with pytest.raises(EmptyResult):
        jobs.write_snapshot(snapshot.where("false"), tmp_dir, AS_OF)
    assert spark.read.parquet(path).count() == len(sample())


def test_audit_raises_when_strict(spark, snapshot):
    assert jobs.audit_job(spark, snapshot.where("pos % 12 between 2 and 9"), None, AS_OF, strict=True).count() == 0
    with pytest.raises(jobs.AuditFailed):
        jobs.audit_job(spark, snapshot.withColumn("vacantes", F.lit("")), None, AS_OF, strict=True)


def test_refresh_job_writes_versioned_snapshot(spark, tmp_dir):
    html = '<article><h2><a href="/ofertas-de-trabajo/9">Nadador</a></h2><p>Asia, Lima</p><p>Hoy</p></article>'
    pages = spark.createDataFrame([(1, fv.SOURCE_COMPUTRABAJO, "Asia", "u", html)],
                                  "page_id long, source string, district string, url string, html string")
    prev = files.read_snapshot(spark, os.path.join(tmp_dir, "none.json"))
    for c, t in (("src_ord", "int"), ("page_id", "bigint"), ("card_pos", "int")):
        prev = prev.withColumn(c, F.lit(None).cast(t))
    res = jobs.refresh_job(spark, prev, pages, "2026-08-22", os.path.join(tmp_dir, "snap"))
    assert res["snapshot"].endswith("run=2026-08-22") and spark.read.parquet(res["snapshot"]).count() == 1
    with pytest.raises(EmptyResult):
        jobs.refresh_job(spark, prev, pages.where("false"), "2026-08-23", os.path.join(tmp_dir, "snap"))


def record(n, title):
    return (f"{title}\nEntidad {n}\nUbicación: LIMA - CAÑETE - ASIA Número de Convocatoria: C{n} Cantidad de Vacantes: 1 "
            "Remuneración: S/. 5 Fecha Inicio de Publicación: 01/06/2027 Fecha Fin de Publicación: 20/06/2027\n")


def test_upsert_job_enriches_before_the_id_and_aborts_on_a_partial_crawl(spark, tmp_dir):
    prev = files.read_snapshot(spark, os.path.join(tmp_dir, "none.json"))
    texts = spark.createDataFrame([(1, record(1, "Soldador") + record(2, "Pintor"))], "page_id long, text string")
    details = spark.createDataFrame([("C1", "60001")], "numero_convocatoria string, codigo_servir string")
    crawl = extract.crawl_completeness(spark.createDataFrame([(1, "Página 1 de 2")], "c int, t string"), "c", "t")
    root = os.path.join(tmp_dir, "s")
    with pytest.raises(EmptyResult):
        jobs.upsert_job(spark, prev, texts, "2027-06-02", root, details, crawl)
    with pytest.raises(EmptyResult):
        jobs.upsert_job(spark, prev, texts.where("false"), "2027-06-02", root, details)
    plain = jobs.upsert_job(spark, prev, texts, "2027-06-02", root)
    ids = {r.titulo: r.id for r in spark.read.parquet(plain["snapshot"]).collect()}
    res = jobs.upsert_job(spark, spark.read.parquet(plain["snapshot"]), texts, "2027-06-03", root, details)
    rows = {r.titulo: r for r in spark.read.parquet(res["snapshot"]).collect()}
    assert set(rows) == {"Soldador", "Pintor"} and rows["Pintor"].id == ids["Pintor"]
    assert rows["Soldador"].codigo_servir == "60001" and rows["Soldador"].id != ids["Soldador"]
    assert res["summary"].first().asDict() == {"n_before": 2, "n_after": 2, "n_expired": 0, "n_merged": 1, "n_documents": 0,
                                               "n_new": 0}


def test_stream_batches_merge_and_a_replay_changes_nothing(spark, tmp_dir):
    landing, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    schema = "id string, pos int, titulo string, requerimiento string"
    for k, rows in enumerate([[("a", 1, "A1", "r"), ("b", 1, "B1", None)], [("a", 1, "A2", None)], [("b", 1, "B2", "s"), ("c", 1, "C", None)],
                              [("a", 2, "A4", None), ("a", 1, "A3", "t")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    typed = spark.createDataFrame([], schema).schema
    want = {"a": ("A4", "t"), "b": ("B2", "s"), "c": ("C", None)}
    for _ in range(2):
        snap = ingest.run_listing_upsert(spark, landing, typed, out, carried=("requerimiento",), checkpoint=ckpt)
        assert {r.id: (r.titulo, r.requerimiento) for r in snap.collect()} == want
