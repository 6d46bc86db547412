"""Listing operators applied to listings, texts and links that Spark shapes from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as sc
from .. import storage
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import audit as au
from ..operators import dedupe as dd
from ..operators import extract as ex
from ..operators import merge as mg
from ..operators import refresh as rf
from ..operators import search as se
from ..operators import seeds as sd
from ..operators import views as vw
from ..session import scratch_path
from ..sources import files as fs
from . import jobs
from . import table_queries as tq
from .table_queries import _s, table

AS_OF = "2001-08-01"


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _listings(spark, sf) -> DataFrame:
    """Orders as full listings; priority plays the source, nation the district."""
    return tq._order_details(spark, sf).withColumn("url_oficial", F.concat(
        F.lit("https://shop.example.com/o/"), _s("o_orderkey"))).withColumn("distrito", F.col("ubicacion"))


# ----------------------------------------------------------------- snapshots and ledgers
def snapshot_write(spark, sf):
    """SNK-1, AGG-9, SRC-1: a versioned snapshot, read back with the listing schema."""
    path = jobs.write_snapshot(_listings(spark, sf).drop("file_name", "o_orderkey"), _scratch(spark, "snapshot"), AS_OF)
    back = fs.read_snapshot(spark, path, "parquet")
    return back.groupBy("fuente", "vacantes").agg(
        F.count(F.lit(1)).alias("n_listings"), F.max("url_oficial").alias("last_url"),
        F.count("codigo_servir").alias("n_coded"))


def keyed_scan(spark, sf):
    """SRC-2: of a written snapshot the last row of every id."""
    o = table(spark, sf, "orders").select(_s("o_custkey").alias("id"), _s("o_orderkey").alias("titulo"),
                                          F.col("o_orderpriority").alias("fuente"), F.col("o_orderkey").alias("pos"))
    path = _scratch(spark, "keyed")
    o.write.parquet(path)
    rows = spark.read.parquet(path)
    return dd.last_wins(rows, "id", F.col("pos"), first_pos_as=None).select("id", "titulo", "fuente")


def _write_arrays(rows: DataFrame, order: str, value, path: str):
    """JSON array files of the rows' ``value``, one a range of the order."""
    from pyspark.sql import Window
    part = F.spark_partition_id()
    w = Window.partitionBy("part").orderBy(order)
    placed = rows.repartitionByRange(4, order).select(order, value.alias("v"), part.alias("part")).withColumn(
        "n", F.row_number().over(w)).withColumn("last", F.lead("n").over(w).isNull())
    line = F.concat(F.when(F.col("n") == 1, "[").otherwise(","), "v", F.when(F.col("last"), "]").otherwise(""))
    placed.select(line.alias("value"), "part").write.partitionBy("part").option("lineSep", "\n ").text(path)


def array_snapshot(spark, sf):
    """SRC-1: JSON array files of listings with braces, quotes and nested links in them, read in splits."""
    o = table(spark, sf, "orders")
    title = F.concat(F.lit('{"'), F.col("o_orderpriority"), F.lit('"},[\\ "'), _s("o_orderkey"))
    links = F.when(F.col("o_orderstatus") == "F", F.array(
        F.struct(F.lit("}, {").alias("titulo"), F.concat(F.lit("https://example.org/"), _s("o_custkey")).alias("url")),
        F.struct(F.lit("b").alias("titulo"), F.lit("u").alias("url"))))
    path = _scratch(spark, "arrays")
    _write_arrays(o, "o_orderkey", F.to_json(F.struct(
        _s("o_orderkey").alias("numero_convocatoria"), title.alias("titulo"), links.alias("enlaces_bases"))), path)
    return fs.read_snapshot(spark, path).select(
        "numero_convocatoria", "titulo", F.get("enlaces_bases", 0)["titulo"].alias("first_link"),
        F.get("enlaces_bases", 0)["url"].alias("first_url"), F.col("entidad").isNull().alias("no_entity"))


def array_ledger(spark, sf):
    """SRC-3: JSON array files of scalars, read in splits; tokens repeat and hold commas and quotes."""
    o = table(spark, sf, "orders")
    token = F.concat(F.lit('a, "'), _s("o_custkey"), F.lit('" ]'))
    path = _scratch(spark, "arrays")
    quoted = F.regexp_replace(F.to_json(F.struct(token.alias("t"))), r'^\{"t":|\}$', "")
    _write_arrays(o, "o_orderkey", quoted, path)
    return fs.read_ledger(spark, path)


def keyed_snapshot(spark, sf):
    """SRC-2: a snapshot scanned by ids made again; of each id the last row."""
    lst = _listings(spark, sf).drop("id")
    return vw.keyed_scan(lst, F.col("o_orderkey")).select("id", "o_orderkey", "vacantes", "fuente")


def ledger_update(spark, sf):
    """SRC-3, SRT-3: tokens added to a written ledger, unique."""
    path = _scratch(spark, "ledger")
    fs.write_ledger(table(spark, sf, "customer").where("c_acctbal < 2000").select(_s("c_custkey").alias("token")), path)
    new = table(spark, sf, "orders").where("o_totalprice > 100000").select(_s("o_custkey").alias("token"))
    grown = se.ledger_add(fs.read_ledger(spark, path, "parquet"), new)
    out = _scratch(spark, "ledger")
    fs.write_ledger(grown, out)
    return fs.read_ledger(spark, out, "parquet")


def outbox_state(spark, sf):
    """SNK-2: two publication runs; the second starts where the ledger of the first ends."""
    lst = _listings(spark, sf).withColumn("pos", F.col("o_orderkey")).drop("o_orderkey")
    outbox, ledger = _scratch(spark, "outbox"), _scratch(spark, "ledger")
    first = jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="a").select("id", F.lit(1).alias("run"))
    second = jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="b").select("id", F.lit(2).alias("run"))
    known = fs.read_ledger(spark, ledger, "parquet").withColumnRenamed("token", "id").withColumn("known", F.lit(True))
    return first.unionByName(second).join(known, "id", "left").select(
        "id", "run", F.coalesce("known", F.lit(False)).alias("known"))


def outbox_replay(spark, sf):
    """SNK-2: a run started again takes nothing new, a lost ledger write is made up for, failed rows are taken again.

    Run a is started twice; of run b only the messages were written before it
    was lost; some of a's messages fail; run c then takes these and what follows.
    """
    lst = _listings(spark, sf).withColumn("pos", F.col("o_orderkey")).withColumn(
        "numero_convocatoria", F.concat(F.lit("N-"), _s("o_orderkey"))).drop("o_orderkey")
    outbox, ledger = _scratch(spark, "outbox"), _scratch(spark, "ledger")
    jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="a")
    jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="a")
    jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="b")
    storage.delete(spark, f"{ledger}/run=b")
    jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="b")
    sent = spark.read.parquet(f"{outbox}/run=a").select(
        "id", F.when(F.col("id") < "5", "failed").otherwise("sent").alias("status"))
    status = jobs.report_results(spark, sent, ledger, outbox, "a").select("id", "status")
    jobs.publish_job(spark, lst, ledger, AS_OF, outbox, run="c")
    runs = spark.read.parquet(outbox).select("id", F.col("run").alias("taken_by"))
    return runs.join(status.withColumn("taken_by", F.lit("a")), ["id", "taken_by"], "left").select(
        "id", "taken_by", F.coalesce("status", F.lit("pending")).alias("status"))


def guarded_snapshot(spark, sf):
    """SNK-1, AGG-9: a second run of the same date replaces the snapshot, an empty third one is refused."""
    lst, root = _listings(spark, sf).drop("file_name", "o_orderkey"), _scratch(spark, "snapshot")
    jobs.write_snapshot(lst, root, AS_OF)
    path = jobs.write_snapshot(lst.where("vacantes <> '1'"), root, AS_OF)
    try:
        jobs.write_snapshot(lst.where("vacantes = 'none'"), root, AS_OF)
        refused = False
    except rf.EmptyResult:
        refused = True
    return spark.read.parquet(path).groupBy("fuente").agg(F.count(F.lit(1)).alias("n_listings")).withColumn(
        "empty_refused", F.lit(refused)).withColumn("n_runs", F.lit(len(storage.names(spark, root))))


# ----------------------------------------------------------------- texts
def text_records(spark, sf):
    """EXT-5: the listings of a nation written out as one page and split again."""
    c = tq._customer_listing(spark, sf)
    date = F.lit("01/02/2001")
    body = F.concat(
        F.lit("Listado\n  "), F.col("c_name"), F.lit("\n\n"), F.col("c_mktsegment"), F.lit(" \nUbicación: "),
        F.concat_ws(" - ", "r_name", "n_name", "c_mktsegment"), F.lit(" Número de Convocatoria: C-"), _s("c_custkey"),
        F.lit(" Cantidad de Vacantes: "), _s(F.col("c_custkey") % 4), F.lit(" Remuneración: S/. "),
        _s("c_nationkey"), F.lit("  Fecha Inicio de Publicación: "), date, F.lit(" Fecha Fin de Publicación: "), date,
        F.lit("\n"))
    pages = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", body.alias("b")))), lambda x: x["b"]),
                     "").alias("text"))
    pages = pages.withColumn("page_id", F.col("c_nationkey") * 1_000_000 + F.col("block"))
    return ex.text_records(pages).select(
        "numero_convocatoria", "titulo", "entidad", "ubicacion", "departamento", "provincia", "distrito", "vacantes",
        "remuneracion", "fecha_inicio", "fecha_fin")


def service_codes(spark, sf):
    """EXT-7, SCL-8: the code in a detail text; short numbers and other signs are none."""
    li = table(spark, sf, "lineitem")
    sign = F.when(F.col("l_linenumber") == 1, "N° ").when(F.col("l_linenumber") == 2, "nº").when(
        F.col("l_linenumber") == 3, "No ").otherwise("CAS N°  ")
    txt = F.concat(F.lit("Detalle de la plaza "), sign, _s("l_partkey"), F.lit(" vigente"))
    return li.select("l_orderkey", "l_linenumber", ex.service_code(txt).alias("code"))


def crawl_completeness(spark, sf):
    """EXT-10: per crawl the highest page seen against the announced total."""
    li = table(spark, sf, "lineitem")
    txt = F.concat(F.lit("Resultados\nPágina "), _s("l_linenumber"), F.lit("  de "), _s(F.col("l_orderkey") % 7 + 1))
    pages = li.select(F.col("l_orderkey").alias("crawl"), F.when(F.col("l_returnflag") != "A", txt).alias("text"))
    return ex.crawl_completeness(pages, "crawl", "text").select(
        "crawl", F.col("max_page").cast("bigint").alias("max_page"), F.col("total_pages").cast("bigint").alias("total"),
        "complete")


def place_names(spark, sf):
    """SCL-12, SCL-13: display names, URL slugs, and line ends without blanks."""
    c = tq._customer_listing(spark, sf)
    name = F.lower(F.concat_ws(" ", "n_name", "c_mktsegment"))
    aliases = {"brazil machinery": "Brasil (Máquinas)", "kenya building": "Nairobi"}
    lines = F.concat(F.col("c_name"), F.lit(" \t\n  "), F.col("n_name"), F.lit("  \n\n"))
    return c.select("c_custkey", tx.place_display(name, aliases).alias("place"),
                    tx.url_slug(name, {k: k.split()[0] for k in aliases}).alias("slug"),
                    F.sha2(tx.strip_trailing_blanks(lines), 256).alias("lines_sha256"))


# ----------------------------------------------------------------- URLs
def canonical_url(spark, sf):
    """URL-2: only listings of one host and path keep a URL, without query and fragment."""
    p = table(spark, sf, "pages")
    host = "m.tiontion.example.com"
    return p.select("page_id", ur.canonical_path_url("url", f"https://{host}", host, "/en/", strip_slash=True).alias("url"))


def key_param_url(spark, sf):
    """URL-3: the listing URL rebuilt from its key parameter."""
    p = table(spark, sf, "pages")
    href = F.concat(F.lit("/rc/clk?from=x&jk="), F.when(F.col("page_id") % 5 != 0, _s("page_id")).otherwise(""),
                    F.lit("&vjs=3"))
    return p.select("page_id", ur.key_param_url(href, "https://pe.indeed.com").alias("url"))


def seed_urls(spark, sf):
    """SRC-5: one search URL per source host and district."""
    n = table(spark, sf, "nation")
    hosts = table(spark, sf, "region").select(F.concat(F.lower("r_name"), F.lit(".example.com")).alias("host"), "r_regionkey")
    d = n.join(hosts, n.n_regionkey == hosts.r_regionkey)
    return d.select(F.col("n_nationkey").alias("ord"), F.concat(
        F.lit("https://"), F.regexp_replace("host", " ", "-"), F.lit("/empleos-en-"), tx.url_slug("n_name"),
        F.lit(".html")).alias("url"))


def seed_table(spark, sf):
    """SRC-5: the search addresses of the districts, and of the nations as further ones, on every source."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("district"))
    own = sc.districts_df(spark).withColumn("ord", F.col("ord") + 100)
    return sd.seed_urls(own.unionByName(n))


# ----------------------------------------------------------------- views
def index_cards(spark, sf):
    """PRJ-8: index cards."""
    cards = vw.index_cards(_listings(spark, sf).drop("distrito"), "o_orderkey")
    return cards.select("o_orderkey", "titulo", "entidad", "loc_department", "vacantes", "code", "source_badge", "file_name")


def listing_defaults(spark, sf):
    """PRJ-2: absent source and official URL get their defaults; the id is made again."""
    o = table(spark, sf, "orders")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("titulo"), _s("o_custkey").alias("entidad"),
                    F.col("o_orderstatus").alias("ubicacion"), _s("o_orderkey").alias("numero_convocatoria"),
                    F.when(F.col("o_orderstatus") == "F", F.lit("LinkedIn")).alias("fuente"))
    return vw.with_listing_columns(rows).select("o_orderkey", "fuente", "url_oficial", "id")


def serve_views(spark, sf):
    """SNK-3: the written index view of the districts in the dimension, counted."""
    lst = _listings(spark, sf).drop("file_name")
    dim = tq._nation_dim(spark, sf).where("ord % 2 = 0")
    root = jobs.serve_views(spark, lst, dim, _scratch(spark, "site"), AS_OF)
    return spark.read.parquet(root + "/index_view").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_cards"), F.countDistinct("id").alias("n_ids"))


def serve_details(spark, sf):
    """PRJ-4, SNK-3: the written detail view: requirements in display order, documents with a title, action and notice."""
    k = F.col("o_orderkey")
    lst = _listings(spark, sf).drop("file_name", "id").withColumns({
        "requerimiento": F.when(k % 2 == 0, "r"), "experiencia": F.when(k % 3 == 0, "").otherwise("e"),
        "competencias": F.when(k % 5 == 0, "c"), "numero_convocatoria": F.concat(F.lit("N-"), _s("o_orderkey")),
        "enlaces_bases": F.when(k % 4 == 0, F.array(
            F.struct(F.lit("").alias("titulo"), F.concat(F.lit("https://example.org/"), _s("o_orderkey")).alias("url")),
            F.struct(F.lit("x").alias("titulo"), F.lit("").alias("url"))))})
    root = jobs.serve_views(spark, lst, tq._nation_dim(spark, sf), _scratch(spark, "site"), AS_OF)
    return spark.read.parquet(root + "/detail_view").select(
        "id", F.col("label").alias("district"), "action_kind", "certificate_notice",
        F.array_join(F.transform("requirements", lambda x: F.concat(x.label, F.lit("="), x.text)), "|").alias("requirements"),
        F.array_join(F.transform("documents", lambda x: F.concat(x.titulo, F.lit("="), x.url)), "|").alias("documents"))


def serve_counts(spark, sf):
    """SNK-3: the written counts and facets."""
    lst = _listings(spark, sf).drop("file_name")
    root = jobs.serve_views(spark, lst, tq._nation_dim(spark, sf), _scratch(spark, "site"), AS_OF)
    counts = spark.read.parquet(root + "/district_counts").select(
        F.lit("count").alias("kind"), F.col("district").alias("name"), F.col("n_listings").cast("bigint").alias("n"))
    return counts.unionByName(spark.read.parquet(root + "/facets").select(
        F.lit("facet").alias("kind"), F.col("value").alias("name"), F.lit(0).cast("bigint").alias("n")))


def document_lookup(spark, sf):
    """JN-9: the previous document of an id, else the row's own, if the file exists."""
    p = table(spark, sf, "part")
    path = F.concat(F.lit("docs/"), _s("p_partkey"), F.lit(".pdf"))
    new = p.select(_s("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, path).alias("archivo_oficial"))
    prev = p.where("p_size % 3 = 0").select(_s("p_partkey").alias("id"),
                                            F.concat(F.lit("old/"), _s("p_partkey"), F.lit(".pdf")).alias("archivo_oficial"))
    there = p.where("p_size % 5 <> 0").select(F.explode(F.array(path, F.concat(
        F.lit("old/"), _s("p_partkey"), F.lit(".pdf")))).alias("path"))
    return mg.document_lookup(new, prev, there).select("id", "archivo_oficial", "has_document")


# ----------------------------------------------------------------- audit
def link_rules(spark, sf):
    """AUD-3: document links that are empty or not allowed."""
    o = table(spark, sf, "orders")
    link = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).when(
        F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("https://sub.perutrabajos.com/d/"), _s("o_orderkey"))).when(
        F.col("o_orderpriority") == "3-MEDIUM", F.lit("ftp://example.com/a.pdf")).when(
        F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("https://example.org/d/"), _s("o_orderkey"))))
    good = F.lit("https://example.org/good.pdf")
    rows = o.select(F.col("o_orderkey").alias("pos"), _s("o_orderkey").alias("id"), F.array(
        F.struct(F.lit("t").alias("titulo"), link.alias("url")),
        F.struct(F.lit("t").alias("titulo"), good.alias("url"))).alias("enlaces_bases"))
    out = au.link_violations(rows, "pos")
    return out.select("pos", "id", "rule", "detail")


def raw_links(spark, sf):
    """AUD-1, AUD-3: unparsed links: no list, elements that are no objects, empty and blocked addresses."""
    o, url = table(spark, sf, "orders"), F.concat(F.lit('{"titulo": "t", "url": "https://example.org/'), _s("o_orderkey"), F.lit('"}'))
    n = F.col("o_orderkey") % 9
    raw = F.when(n == 0, F.concat(F.lit("["), url, F.lit("]"))).when(n == 1, url).when(n == 2, "[]").when(n == 3, "{}").when(
        n == 4, '["https://example.org/x", {"url": ""}]').when(n == 5, '"text"').when(n == 6, "not json").when(
        n == 7, '[{"url": "https://sub.perutrabajos.com/d"}, 5]')
    rows = o.select(F.col("o_orderkey").alias("pos"), _s("o_orderkey").alias("id"), raw.alias("links_json"))
    return au.raw_link_violations(rows).select("pos", "id", "rule", "detail")


def file_rules(spark, sf):
    """AUD-2: missing detail files and documents, forbidden contents."""
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("pos"), _s("p_partkey").alias("id"), F.col("p_name").alias("titulo"),
                    F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("d/"), _s("p_partkey"))).alias("archivo_oficial"))
    content = F.when(F.col("pos") % 7 == 0, F.lit('<a class="btn-fuente">x</a>')).when(
        F.col("pos") % 11 == 0, F.lit("Talento Perú (Word)")).otherwise(F.lit("<p>ok</p>"))
    made = rows.where("pos % 3 <> 0").select(tx.file_name("id", "titulo").alias("name"), content.alias("content"))
    docs = rows.where("pos % 4 = 0").select(F.col("archivo_oficial").alias("path"))
    return au.file_violations(rows, made, docs).select("pos", "id", "rule", "detail")


# ----------------------------------------------------------------- files and streams
def file_inventory(spark, sf):
    """SRC-6: the table files of the input folder (no SQL equivalent)."""
    return fs.file_inventory(spark, sf, "*.parquet", recursive=True).groupBy("ext").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def _upserts(spark, sf) -> tuple[DataFrame, str]:
    """Orders landed in three parts, each upserted by a run of the stream; the snapshot and its folder."""
    from ..streaming import ingest
    landing, out, checkpoint = (_scratch(spark, n) for n in ("landing", "stream-upsert", "stream-checkpoint"))
    o = table(spark, sf, "orders").select(
        _s("o_custkey").alias("id"), (F.year("o_orderdate") * F.lit(10 ** 12) + F.col("o_orderkey")).alias("pos"),
        F.col("o_orderpriority").alias("titulo"),
        F.when(F.col("o_orderstatus") == "F", _s("o_orderkey")).alias("requerimiento"))
    for low, high in ((0, 1997), (1997, 1999), (1999, 9999)):
        span = o.where((F.col("pos") >= low * 10 ** 12) & (F.col("pos") < high * 10 ** 12))
        span.write.mode("append").parquet(landing)
        snap = ingest.run_listing_upsert(spark, landing, o.schema, out, carried=("requerimiento",),
                                         files_per_trigger=None, checkpoint=checkpoint)
    return snap, out


def _stored_files(spark, sf) -> DataFrame:
    """(path, name, content) of files as a written table: parts as documents of several kinds and folders."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    ext = F.when(k % 5 == 0, ".tmp").when(k % 5 == 1, ".PDF").when(k % 5 == 2, "").when(k % 5 == 3, ".tmp").otherwise(".docx")
    name = F.concat(F.lit("f"), _s(k % 40), ext)
    head = F.when(k % 5 == 0, F.unhex(F.lit("504B0304"))).otherwise(F.lit("%PDF").cast("binary"))
    path = _scratch(spark, "files")
    p.select(F.concat(F.lit("s3/root/d"), _s("p_partkey"), F.lit("/"), name).alias("path"), name.alias("name"),
             F.concat(head, F.col("p_name").cast("binary")).alias("content")).write.parquet(path)
    return spark.read.parquet(path)


def document_types(spark, sf):
    """SRC-7, SRC-9: the kind and the fingerprint of stored files, and the versions of wanted assets."""
    files = _stored_files(spark, sf).select(F.col("path").alias("name"), fs.document_extension("name", "content").alias(
        "doc_ext"), fs.fingerprint("content").alias("version"))
    wanted = files.select("name").unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return fs.asset_versions(wanted, files).join(files.select("name", "doc_ext"), "name", "left").select(
        "name", "version", "doc_ext")


def document_renames(spark, sf):
    """SRC-8: stored documents with a temporary suffix get their own; equal bare names lie in many folders."""
    docs = _stored_files(spark, sf).select("path", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("ext"),
                                           fs.document_extension("name", "content").alias("doc_ext"))
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    ext = F.when(k % 5 == 0, ".tmp").when(k % 5 == 1, ".PDF").when(k % 5 == 2, "").when(k % 5 == 3, ".tmp").otherwise(".docx")
    stored = F.concat(F.when(k % 3 == 0, "./").otherwise(""), F.lit("d"), _s(k), F.lit("/f"), _s(k % 40), ext)
    rows = p.select("p_partkey", F.when(k % 7 != 0, stored).alias("archivo_oficial"))
    return fs.rename_plan(rows, docs).select("p_partkey", "archivo_oficial", "renamed")


def stream_upsert(spark, sf):
    """STR-2: orders landed in three parts, upserted batch by batch with carry-forward."""
    return _upserts(spark, sf)[0].select("id", "titulo", "requerimiento")


def stream_buckets(spark, sf):
    """STR-2: the buckets and rows that each batch rewrote, once more after a landing that touches one customer in 50."""
    from ..streaming import buckets as bk
    from ..streaming import ingest
    landing, out, checkpoint = (_scratch(spark, n) for n in ("landing", "stream-upsert", "stream-checkpoint"))
    c = table(spark, sf, "customer").select(_s("c_custkey").alias("id"), F.col("c_custkey").alias("pos"),
                                            F.col("c_mktsegment").alias("titulo"))
    for part in (c, c.where("pos % 500 = 0"), c.where("pos = 7")):
        part.write.mode("append").parquet(landing)
        ingest.run_listing_upsert(spark, landing, c.schema, out, carried=("titulo",), files_per_trigger=None,
                                  checkpoint=checkpoint)
    return bk.batch_stats(spark, out)


def stream_fresh(spark, sf):
    """STR-1: events landed in six parts by time, kept per user and type while at most 7 days behind the newest."""
    from ..streaming import ingest
    landing, out, checkpoint = (_scratch(spark, n) for n in ("landing", "stream-fresh", "stream-checkpoint"))
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # every tenth event comes late, with the last part
    part = F.when(F.col("event_id") % 10 == 0, 5).otherwise(F.floor(F.dayofmonth("ts") / 7))
    for n in range(6):
        events.where(part == n).write.mode("append").parquet(landing)
        snap = ingest.run_keyed_refresh(spark, landing, events.schema, out, ["user_id", "event_type"], "event_id",
                                        files_per_trigger=None, checkpoint=checkpoint, event_time="ts", max_age="7 days")
    return snap.select("user_id", "event_type", F.col("event_id").alias("last_event_id"), "value")


QUERIES = {q.__name__: q for q in (
    snapshot_write, guarded_snapshot, array_snapshot, array_ledger, keyed_scan, keyed_snapshot, ledger_update, outbox_state, outbox_replay, text_records, service_codes, crawl_completeness, place_names,
    canonical_url, key_param_url, seed_urls, seed_table, index_cards, listing_defaults, serve_views, serve_details, serve_counts, document_lookup, link_rules, raw_links, document_types, document_renames,
    file_rules, file_inventory, stream_upsert, stream_buckets, stream_fresh)}
