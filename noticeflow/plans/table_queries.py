"""Operators applied to the driver's tables (TPC-H-like star schema, documents, pages, ...).

Each query maps the driver's columns onto the listing operators and returns a
DataFrame; ``oracle.py`` holds the equivalent DuckDB SQL.  Every query scans
its whole input tables; the only limits are where the limit is the feature
(the newest-first publication queue, the first-five obsolete report).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates as dt
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import audit as au
from ..operators import common as cm
from ..operators import dedupe as dd
from ..operators import extract as ex
from ..operators import matching as mt
from ..operators import merge as mg
from ..operators import outbox as ob
from ..operators import portals as pt
from ..operators import refresh as rf
from ..operators import search as se
from ..operators import search_index as sx
from ..operators import views as vw
from ..session import materialize, scratch_path

# Reference dates inside the driver tables (orders run 1995-01-01 .. 2001-08-01,
# lineitem ships to 2001-11-04, events cover January 2024).
ORDERS_AS_OF = "2001-08-01"
OUTBOX_AS_OF = "2001-06-01"
EXPIRY_AS_OF = "2000-01-01"
EVENTS_AS_OF = "2024-01-31"

# Registry of the refresh queries: the order-priority values play the sources.
KNOWN_SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")

# Domain lists passed to the URL predicates for the pages table.
PAGES_OFFICIAL = ("example.org",)
PAGES_BLOCKED = ("spam-farm.example.org", "cheap-pills.example.com")

# Search parameters for the documents table.
# Places that customers are given, as portals write them.
PLACES = ("Asia", "ZUÑIGA", "Nuevo Imperial", "san vicente", "San Luis de Cañete", "Lunahuana", "Chincha", "Cerro  Azul",
          "Quilmaná", "MALAYA", "")

SEARCH_TEXT = "QUÉ"
SEARCH_LANG = "fr"
SEARCH_PHRASES = ("Licensed under", "  ÉS  ", "straße", "no such phrase here", "x")

# Detail sections searched in the documents table (field, opening, closing).
DOC_SECTIONS = (
    ("license", "Licensed under the", "License"),
    ("released", "Released under the", "License"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _dmy(c) -> F.Column:
    return F.date_format(F.col(c), "dd/MM/yyyy")


# ----------------------------------------------------------------- scalars
def text_key(spark, sf):
    d = table(spark, sf, "documents")
    k = tx.text_key("text")
    return d.select("doc_id", F.sha2(k, 256).alias("key_sha256"), F.length(k).cast("bigint").alias("key_chars"),
                    F.length(tx.clean("text")).cast("bigint").alias("clean_chars"))


def _customer_listing(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    dims = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return c.join(dims, c.c_nationkey == dims.n_nationkey)


def stable_id(spark, sf):
    c = _customer_listing(spark, sf)
    code = (F.when(F.col("c_acctbal") < 0, F.concat(F.lit("N"), _s("c_nationkey")))
            .when(F.col("c_acctbal") < 1000, F.lit("")))
    named = tx.identity("c_name", "c_mktsegment", F.col("n_name"), "r_name", code)
    # the file name takes the title's key, so the title comes third
    out = c.select("c_custkey", named.alias("n"), tx.file_name(named["id"], "c_name").alias("file_name"))
    return out.select("c_custkey", "n.id", "n.base_key", "file_name")


def slug_name(spark, sf):
    p = table(spark, sf, "part")
    named = tx.identity("p_brand", _s("p_partkey"), "p_name", "p_type")
    return p.select("p_partkey", tx.slugify("p_name").alias("slug"), named.alias("n")).select(
        "p_partkey", "slug", "n.id", "n.file_name")


def doc_slug(spark, sf):
    d = table(spark, sf, "documents")
    keyed = d.select("doc_id", "source", "lang", tx.text_key("text").alias("k"))
    ident = tx.id_from_keys(tx.text_key("source"), tx.text_key(_s("doc_id")), tx.text_key("lang"), F.col("k"))
    return keyed.select("doc_id", tx.slug_from_key("k").alias("slug"), tx.file_name(ident, "lang").alias("file_name"))


def url_parts(spark, sf):
    p = table(spark, sf, "pages")
    u = F.col("url")
    return p.select("page_id", ur.scheme(u).alias("scheme"), ur.host(u).alias("host"), ur.path(u).alias("path"),
                    ur.query(u).alias("query"), ur.fragment(u).alias("fragment"))


def url_canonical(spark, sf):
    p = table(spark, sf, "pages")
    u = F.col("url")
    path_url = F.regexp_replace(ur.path_only(u), "/+$", "")
    individual = ur.path(u).rlike("^/[a-z]{2}/[0-9]+")
    return p.select(
        "page_id",
        F.when(individual, path_url).otherwise(F.lit("")).alias("canonical"),
        ur.key_param(u, "page").alias("page_param"),
        ur.key_param(u, "utm_source").alias("utm_source"),
        F.regexp_replace(u, "#.*$", "").alias("without_fragment"))


def url_host_class(spark, sf):
    p = table(spark, sf, "pages")
    u = F.col("url")
    return p.select("page_id", ur.is_direct_link(u).alias("direct"),
                    ur.is_official(u, PAGES_OFFICIAL).alias("official"),
                    ur.is_valid_application(u, PAGES_BLOCKED).alias("valid_application"))


def reference_code(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.reference_code("PG", "url").alias("reference"))


def _age_phrase() -> F.Column:
    uid = _s("user_id")
    return (F.when(F.col("event_type") == "view", F.concat(F.lit("Hace "), uid, F.lit(" días")))
            .when(F.col("event_type") == "click", F.concat(F.lit("Publicado hace "), uid, F.lit(" semanas")))
            .when(F.col("event_type") == "signup", F.lit("Actualizado ayer"))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("Hace más de "), uid, F.lit(" días")))
            .otherwise(F.concat(F.lit("Publicado hace "), F.hour("ts").cast("string"), F.lit(" horas"))))


def age_days(spark, sf):
    e = table(spark, sf, "events").select("event_id", _age_phrase().alias("phrase"))
    days = dt.age_days("phrase")
    recent = dt.is_recent("phrase")
    published = F.when(recent, F.date_sub(dt.as_date(EVENTS_AS_OF), days.cast("int")))
    return e.select("event_id", "phrase", days.alias("age_days"), recent.alias("recent"),
                    published.alias("published_on"), dt.date_text(published).alias("published_text"))


def _order_start_text() -> F.Column:
    return (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "d/M/yyyy"))
            .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit(" "), _dmy("o_orderdate")))
            .otherwise(_dmy("o_orderdate")))


def freshness_window(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _order_start_text().alias("fecha_inicio"))
    out = rf.fresh(o, ORDERS_AS_OF)
    pub = dt.parse_dmy("fecha_inicio")
    return out.select("o_orderkey", "fecha_inicio", pub.alias("published_on"),
                      F.datediff(dt.as_date(ORDERS_AS_OF), pub).cast("bigint").alias("age_days"))


def expiry(spark, sf):
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    end = (F.when(ln == 1, F.date_format("l_shipdate", "d/M/yyyy"))
           .when(ln == 2, F.concat(F.lit(" "), _dmy("l_shipdate")))
           .when(ln == 3, F.concat(_dmy("l_shipdate"), F.lit(" ")))
           .when(ln == 4, F.date_format("l_shipdate", "dd/MM/yy"))
           .when(ln == 5, F.lit(""))
           .otherwise(_dmy("l_shipdate")))
    rows = li.select("l_orderkey", "l_linenumber", end.alias("fecha_fin"))
    kept = mg.remove_expired(rows, EXPIRY_AS_OF)
    return kept.select("l_orderkey", "l_linenumber", "fecha_fin",
                       dt.parse_dmy_stripped("fecha_fin").alias("closes_on"),
                       dt.still_open("fecha_fin", EXPIRY_AS_OF).alias("still_open"))


# Ordered terms looked for in the documents: accents, case, overlap, one that is never there.
DOC_TERMS = ("LICENSED UNDER", "étion", "CIÓN", "Erlich", "worthless", "the th", "réé", "ß", "nowhere to be found", "the")


def first_match_label(spark, sf):
    d = table(spark, sf, "documents")
    terms = spark.createDataFrame(list(enumerate(DOC_TERMS)), "ord int, term string")
    return mt.first_match(d.select("doc_id", "text"), "text", terms, "ord", "term", out="label").select(
        "doc_id", "label")


def _vocabulary(spark, sf) -> DataFrame:
    """(ord, term): the words of at least eight letters that the conversations hold, in order."""
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("term")).distinct()
    return cm.global_row_number(words, ["term"], "ord")


def first_match_vocabulary(spark, sf):
    """JN-8: the first of thousands of terms in every document."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return mt.first_match(d, "text", _vocabulary(spark, sf), "ord", "term", out="label").select("doc_id", "label")


def place_detection(spark, sf):
    """LOC-2: the first district, in declared order, whose name the location or the title holds."""
    c = table(spark, sf, "customer")
    place = F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.col("c_custkey") % len(PLACES) + 1).cast("int"))
    text = F.concat_ws(", ", F.col("c_mktsegment"), place, F.when(F.col("c_custkey") % 3 == 0, "cerca de Mala"))
    dim = spark.createDataFrame([(i, d, fv.PLACE_NAMES_LINKEDIN.get(d, d.title())) for i, d in enumerate(fv.DISTRICTS)],
                                "ord int, district string, name string")
    found = mt.first_match(c.select("c_custkey", text.alias("text")), "text", dim, "ord", "name", out="name")
    return found.join(dim.select("name", "district"), "name", "left").select(
        "c_custkey", F.coalesce("district", F.lit("")).alias("district"), pt.detect_district(F.col("text")).alias("by_column"))


# ----------------------------------------------------------------- dedupe / top-k
def dedupe_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    out = dd.last_wins(e, ["user_id", "event_type"], F.col("event_id"), first_pos_as="first_event_id")
    return out.select("user_id", "event_type", F.col("event_id").alias("last_event_id"), "value", "first_event_id")


def dedupe_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    out = dd.first_wins(e, ["user_id", "event_type"], F.col("event_id"))
    return out.select("user_id", "event_type", F.col("event_id").alias("first_event_id"), "value")


def topk_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    out = dd.top_k_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


def duplicate_ids(spark, sf):
    d = table(spark, sf, "documents")
    ident = F.substring(F.sha2(tx.text_key("text"), 256), 1, 20)
    # The narrow (doc_id, id) projection feeds both the aggregate and the join;
    # it is checkpointed so the whole-text key is computed once.
    narrow = materialize(d.select("doc_id", ident.alias("id")))
    dup = dd.duplicate_rows(narrow, "id", F.col("doc_id"))
    return dup.select("doc_id", "id")


# ----------------------------------------------------------------- refresh
def _orders_as_listings(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("fuente"),
        _dmy("o_orderdate").alias("fecha_inicio"),
        F.when(F.col("o_custkey") % 50 != 0, F.concat(F.lit("https://shop.example.com/c/"), _s("o_custkey")))
        .alias("url_oficial"))


def _sources(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KNOWN_SOURCES)), "src_ord int, fuente string")


def source_fallback(spark, sf):
    o = _orders_as_listings(spark, sf)
    prev = o.where(F.col("o_orderstatus") != "O").withColumn("origin", F.lit("prev"))
    new = (o.where((F.col("o_orderstatus") == "O") & F.col("fuente").isin("1-URGENT", "3-MEDIUM", "5-LOW"))
           .withColumn("origin", F.lit("new")))
    out = rf.source_fallback(prev, new, _sources(spark))
    return out.select("o_orderkey", "fuente", "origin")


def refresh_window(spark, sf):
    o = _orders_as_listings(spark, sf)
    src = _sources(spark)
    lin = o.join(src, "fuente", "left").select(
        "fuente", "fecha_inicio", "url_oficial", "o_orderkey", "o_orderstatus",
        F.coalesce("src_ord", F.lit(len(KNOWN_SOURCES))).alias("src_ord"),
        F.col("o_orderkey").alias("page_id"), F.lit(0).alias("card_pos"))
    prev = lin.where(F.col("o_orderstatus") != "O")
    new = lin.where((F.col("o_orderstatus") == "O") & F.col("fuente").isin("1-URGENT", "3-MEDIUM", "5-LOW"))
    out = rf.refresh(prev, new, src, ORDERS_AS_OF)
    return out.select("url_oficial", "o_orderkey", "fuente", "fecha_inicio",
                      F.col("first_pos.s").cast("bigint").alias("first_src_ord"),
                      F.col("first_pos.p").alias("first_orderkey"))


def source_status(spark, sf):
    o = _orders_as_listings(spark, sf)
    new = o.where((F.col("o_orderstatus") == "O") & F.col("fuente").isin("1-URGENT", "3-MEDIUM"))
    out = rf.source_status(_sources(spark), new)
    return out.select(F.col("src_ord").cast("bigint").alias("src_ord"), "fuente", "n_new", "status")


# ----------------------------------------------------------------- merge
def _upsert_inputs(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders")
    prev = c.select(
        F.col("c_custkey").alias("id"), F.lit(-1).cast("bigint").alias("pos"),
        F.col("c_mktsegment").alias("segment"), _s("c_nationkey").alias("nation"),
        F.col("c_name").alias("name"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("fecha_fin"), F.lit(None).cast("string").alias("code"))
    new = o.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("URGENT-SEG"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("")).alias("segment"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("nation"),
        F.lit(None).cast("string").alias("name"), F.col("o_orderstatus").alias("status"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 10), "dd/MM/yyyy").alias("fecha_fin"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("M")).alias("code"))
    return prev, new


CARRIED_TEST = ("segment", "nation")


def carry_forward(spark, sf):
    prev, new = _upsert_inputs(spark, sf)
    out = mg.carry_forward_upsert(prev, new, key="id", pos="pos", carried=CARRIED_TEST)
    return out.select("id", "segment", "nation", "name", "status", "pos")


def superseded(spark, sf):
    li = table(spark, sf, "lineitem")
    code = F.when(F.col("l_returnflag") == "R", _s("l_linenumber"))
    rows = li.select("l_orderkey", "l_linenumber", code.alias("codigo_servir"),
                     tx.base_key(F.concat(F.lit("S"), _s(F.col("l_suppkey") % 2)), _s("l_orderkey"), "l_linestatus",
                                 _s(F.year("l_shipdate"))).alias("base_key"))
    kept = mg.remove_superseded(rows)
    return kept.select("l_orderkey", "l_linenumber", tx.truthy("codigo_servir").alias("has_code"))


def run_summary(spark, sf):
    prev, new = _upsert_inputs(spark, sf)
    up = mg.carry_forward_upsert(prev, new, key="id", pos="pos", carried=CARRIED_TEST, count_below=(0, "n_before"))
    up = up.withColumn("base_key", tx.text_key("segment")).withColumn(
        "open", dt.not_expired(F.col("fecha_fin"), OUTBOX_AS_OF))
    s = mg.run_summary(up, code="code", document="nation")
    return s.select("n_before", "n_after", "n_new", "n_expired", "n_merged", "n_documents")


def budget_selection(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("has_document"))
    out = mg.budgeted_selection(li, ["l_orderkey", "l_linenumber"], 25)
    return out.select("l_orderkey", "l_linenumber")


# ----------------------------------------------------------------- views
def _nation_dim(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord"),
                                             F.col("n_name").alias("district"))


def _labelled_customers(spark, sf) -> DataFrame:
    c = _customer_listing(spark, sf)
    ubic = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("r_name")).otherwise(
        F.concat_ws(" - ", "r_name", "c_mktsegment", "n_name"))
    lst = c.select("c_custkey", F.col("c_name").alias("titulo"), ubic.alias("ubicacion"),
                   F.lit(None).cast("string").alias("distrito"), F.col("c_custkey").alias("pos"))
    return vw.location_parts(lst).withColumn("label", vw.group_label())


def dim_counts(spark, sf):
    out = vw.district_counts(_labelled_customers(spark, sf), _nation_dim(spark, sf))
    return out.select("ord", "district", "n_listings", "total_listings", "visible")


def dim_listing(spark, sf):
    rows = vw.district_rows(_labelled_customers(spark, sf), _nation_dim(spark, sf))
    return rows.select("ord", "district", "c_custkey", "titulo")


def facets(spark, sf):
    c = _customer_listing(spark, sf)
    return vw.facets(c, ["c_mktsegment", "n_name"])


def fresh_by_nation(spark, sf):
    """Flagship: orders published within 7 days of as_of, counted per nation (zero rows kept)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", _dmy("o_orderdate").alias("fecha_inicio"))
    fresh = rf.fresh(o, ORDERS_AS_OF)
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation")
    lst = (fresh.join(c, fresh.o_custkey == c.c_custkey)
           .join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
           .select(F.col("n_name").alias("label")))
    out = vw.district_counts(lst, _nation_dim(spark, sf))
    return out.select("ord", "district", "n_listings", "total_listings", "visible")


def location_parts(spark, sf):
    o = table(spark, sf, "orders")
    lst = o.select("o_orderkey", F.concat_ws(" - ", "o_orderpriority", "o_orderstatus").alias("ubicacion"),
                   F.when(F.col("o_orderstatus") == "F", F.lit("LIMA")).otherwise(F.lit("")).alias("departamento"))
    lp = vw.location_parts(lst).withColumn("label", vw.group_label())
    tp = ex.split_text_location(F.col("ubicacion"))
    return lp.select("o_orderkey", "loc_department", "loc_province", "loc_district", "label",
                     tp["department"].alias("text_department"), tp["province"].alias("text_province"),
                     tp["district"].alias("text_district"))


def _order_details(spark, sf) -> DataFrame:
    c = _customer_listing(spark, sf)
    o = table(spark, sf, "orders")
    j = o.join(c, o.o_custkey == c.c_custkey)
    pr = F.col("o_orderpriority")
    return j.select(
        "o_orderkey",
        F.col("c_name").alias("titulo"), F.col("c_mktsegment").alias("entidad"), F.col("n_name").alias("ubicacion"),
        F.concat(F.lit("C-"), _s("o_custkey")).alias("numero_convocatoria"),
        F.when(pr == "1-URGENT", F.lit("2")).otherwise(F.lit("1")).alias("vacantes"),
        F.when(F.col("o_orderstatus") == "P", F.lit(""))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("s/. "), _s("o_custkey")))
        .otherwise(_s("o_custkey")).alias("remuneracion"),
        _dmy("o_orderdate").alias("fecha_inicio"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 7), "dd/MM/yyyy").alias("fecha_fin"),
        F.when(pr == "2-HIGH", F.lit("LinkedIn")).otherwise(F.lit("SERVIR - Talento Perú")).alias("fuente"),
        F.when(pr == "3-MEDIUM", F.concat(F.lit("https://entidad.gob.pe/c/"), _s("o_orderkey"))).alias("url_postulacion"),
        F.when(pr == "4-NOT SPECIFIED", F.lit("https://share.google/IovzweaQemtlVGF9i"))
        .when(pr == "5-LOW", F.lit("https://www.gob.pe/x")).alias("url_consulta"),
        F.when(pr == "1-URGENT", _s("o_custkey")).alias("codigo_servir"),
    ).withColumn("_n", tx.identity("entidad", "numero_convocatoria", "titulo", "ubicacion", "codigo_servir")).select(
        "*", "_n.id", "_n.file_name").drop("_n")


def display_fields(spark, sf):
    d = _order_details(spark, sf).withColumn(
        "salary_msg", vw.salary_display("remuneracion", handle_unspecified=False))
    j = vw.detail_view(d, keep=("o_orderkey", "salary_msg"))
    return j.select("o_orderkey", "action_kind", "certificate_notice", "date_label", "date_text", "vacancy_label",
                    F.col("salary").alias("salary_site"), "salary_msg", "code")


def message(spark, sf):
    d = _order_details(spark, sf)
    return ob.message(d).select("o_orderkey", "message")


def newest_outbox(spark, sf):
    o = table(spark, sf, "orders")
    lst = o.select(
        _s("o_orderkey").alias("id"), F.concat(F.lit("C-"), _s("o_custkey")).alias("numero_convocatoria"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(_dmy("o_orderdate")).alias("fecha_inicio"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "dd/MM/yyyy").alias("fecha_fin"),
        F.col("o_orderkey").alias("pos"))
    c = table(spark, sf, "customer")
    li = table(spark, sf, "lineitem")
    ledger = (c.where(F.col("c_mktsegment") == "AUTOMOBILE").select(F.concat(F.lit("C-"), _s("c_custkey")).alias("token"))
              .unionByName(li.where(F.col("l_returnflag") == "R").select(_s("l_orderkey").alias("token"))))
    q = ob.pending(lst, ledger, OUTBOX_AS_OF)
    return q.select("id", "numero_convocatoria", "fecha_inicio", "published_on")


# ----------------------------------------------------------------- search
def _doc_listings(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("titulo"), F.col("source").alias("entidad"),
                    F.col("lang").alias("distrito"))


_INDEXES: dict[tuple[str, str], str] = {}       # (application, tables) -> where this session built the index


def _build_index(spark, sf) -> str:
    path = scratch_path(spark, f"search-index-{uuid.uuid4().hex}")
    _INDEXES[spark.sparkContext.applicationId, sf] = sx.build(
        _doc_listings(spark, sf), path, keep=("id", "entidad", "distrito"))
    return path


def _index(spark, sf) -> str:
    """The search index of the documents, built at the session's first use."""
    return _INDEXES.get((spark.sparkContext.applicationId, sf)) or _build_index(spark, sf)


def search_index(spark, sf):
    """SCL-3, FLT-7: the postings of a new index: how many documents hold each trigram."""
    lists = sx.postings(spark, _build_index(spark, sf))
    return lists.groupBy("gram").agg(F.sum(F.size("rows")).alias("n_docs"))


def search_docs(spark, sf):
    saved = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    out = sx.search(spark, _index(spark, sf), text=SEARCH_TEXT, district=SEARCH_LANG, saved=saved)
    return out.select(F.col("id").alias("doc_id"))


def search_phrases(spark, sf):
    """FLT-7: needles of one, two and many characters."""
    out = None
    for text in SEARCH_PHRASES:
        found = sx.search(spark, _index(spark, sf), text=text).select(F.lit(text).alias("needle"), F.col("id").alias("doc_id"))
        out = found if out is None else out.unionByName(found)
    return out


def _doc_sources(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("district")).distinct()


def search_sections(spark, sf):
    out = sx.sections(spark, _index(spark, sf), _doc_sources(spark, sf), section_col="entidad", text=SEARCH_TEXT)
    return out.select(F.col("district").alias("source"), "n_visible", "n_rows", "section_visible")


def search_blank(spark, sf):
    """AGG-8: a text of blanks is no text: the selected section shows although it is empty; the hits of all sections."""
    dim = _doc_sources(spark, sf).unionByName(spark.createDataFrame([("none",), ("other",)], "district string"))
    out = sx.sections(spark, _index(spark, sf), dim, section_col="entidad", text="  ", district="none",
                      district_col="entidad")
    return out.withColumnRenamed("district", "source")


def collated_rank(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", r"\p{L}+", 0).alias("word"))
    out = cm.global_row_number(d, [F.collate(F.col("word"), se.SORT_COLLATION), F.col("doc_id")])
    return out.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"))


def saved_toggle(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders")
    saved = c.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    toggles = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"))
    return se.toggle_saved(saved, toggles)


# ----------------------------------------------------------------- audit
def _audit_input(spark, sf) -> DataFrame:
    c = _customer_listing(spark, sf)
    o = table(spark, sf, "orders")
    j = o.join(c, o.o_custkey == c.c_custkey)
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    ok = _s("o_orderkey")
    fuente = (F.when(pr == "1-URGENT", F.lit("Computrabajo Perú")).when(pr == "2-HIGH", F.lit("LinkedIn"))
              .when(pr == "3-MEDIUM", F.lit("linkedin")).when(pr == "4-NOT SPECIFIED", F.lit("SERVIR - Talento Perú"))
              .otherwise(F.lit("Indeed Perú")))
    url = (F.when(st == "F", F.concat(F.lit("https://pe.linkedin.com/jobs/view/"), ok))
           .when(st == "O", F.concat(F.lit("https://pe.computrabajo.com/ofertas-de-trabajo/o-"), ok))
           .otherwise(F.concat(F.lit("https://www.gob.pe/x/"), ok)))
    app = (F.when(F.col("o_custkey") < 100, F.lit("https://share.google/abc"))
           .when(F.col("o_custkey") < 200, F.lit("https://convocatoriasdetrabajo.com/a"))
           .when(F.col("o_custkey") < 300, F.concat(F.lit("https://entidad.gob.pe/p/"), ok)))
    rows = j.select(
        F.col("o_orderkey").alias("pos"), F.col("c_name").alias("titulo"),
        F.when(pr == "5-LOW", F.lit("")).otherwise(F.col("c_mktsegment")).alias("entidad"),
        F.col("n_name").alias("ubicacion"), F.concat(F.lit("C-"), _s("o_custkey")).alias("numero_convocatoria"),
        F.lit("1").alias("vacantes"),
        F.when(st == "P", F.lit("sin fecha")).otherwise(_dmy("o_orderdate")).alias("fecha_inicio"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 7), "dd/MM/yyyy").alias("fecha_fin"),
        fuente.alias("fuente"), url.alias("url_oficial"), app.alias("url_postulacion"))
    ident = rows.withColumn("id", tx.stable_id("entidad", "numero_convocatoria", "titulo", "ubicacion"))
    # Saved once: the row rules, the first positions and the join back all read it.
    return materialize(ident)


def audit_violations(spark, sf):
    out = au.row_violations(_audit_input(spark, sf), ORDERS_AS_OF)
    return out.select("pos", "id", "rule", "detail")


def _part_names(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_size", tx.file_name(_s("p_partkey"), "p_name").alias("name"))


def name_diff(spark, sf):
    names = _part_names(spark, sf)
    expected = names.where(F.col("p_size") <= 25).select("name")
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    actual = names.join(sold, "p_partkey", "left_semi").select("name")
    return au.name_diff(expected, actual)


def obsolete_report(spark, sf):
    return au.obsolete_report(name_diff(spark, sf))


def block_pages(spark, sf):
    p = table(spark, sf, "pages").select(ur.host("url").alias("host"), "html")
    words = [("com", "captcha"), ("org", "robot"), ("net", "track")]
    return ex.blocked_pages(p, "host", "html", words)


def nested_links(spark, sf):
    p = table(spark, sf, "pages")
    links = ex.harvest_links(p, "page_id", "url", "html")
    out = ex.classify_links(links, "page_id")
    return out.select("page_id", "n_links", "n_documents", "url_postulacion", "url_consulta")


def text_blocks(spark, sf):
    cv = table(spark, sf, "conversations")
    out = ex.previous_block_fields(cv, "conv_id", "turn", "text")
    out = out.where((F.length("title") > 3) & tx.truthy("role"))
    return out.select("conv_id", "turn", "role", "title", "entity")


def doc_sections(spark, sf):
    d = table(spark, sf, "documents")
    secs = ex.extract_sections(F.col("text"), DOC_SECTIONS)
    return d.select("doc_id", *[secs[f].alias(f) for f, _, _ in DOC_SECTIONS])


def page_cards(spark, sf):
    p = table(spark, sf, "pages")
    return ex.article_cards(p)


def stream_refresh(spark, sf):
    from ..streaming import ingest
    name = uuid.uuid4().hex
    landing = scratch_path(spark, f"stream-landing-{name}")
    events = table(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(landing)          # four files: four micro-batches
    snap = ingest.run_keyed_refresh(spark, landing, events.schema, scratch_path(spark, f"stream-refresh-{name}"),
                                    key=["user_id", "event_type"], pos="event_id")
    return snap.select("user_id", "event_type", F.col("event_id").alias("last_event_id"), "value")


QUERIES = {
    "fresh_by_nation": fresh_by_nation,
    "text_key": text_key,
    "stable_id": stable_id,
    "slug_name": slug_name,
    "doc_slug": doc_slug,
    "url_parts": url_parts,
    "url_canonical": url_canonical,
    "url_host_class": url_host_class,
    "reference_code": reference_code,
    "age_days": age_days,
    "freshness_window": freshness_window,
    "expiry": expiry,
    "first_match_label": first_match_label,
    "first_match_vocabulary": first_match_vocabulary,
    "place_detection": place_detection,
    "dedupe_last": dedupe_last,
    "dedupe_first": dedupe_first,
    "topk_per_group": topk_per_group,
    "duplicate_ids": duplicate_ids,
    "source_fallback": source_fallback,
    "refresh_window": refresh_window,
    "source_status": source_status,
    "carry_forward": carry_forward,
    "superseded": superseded,
    "run_summary": run_summary,
    "budget_selection": budget_selection,
    "dim_counts": dim_counts,
    "dim_listing": dim_listing,
    "facets": facets,
    "location_parts": location_parts,
    "display_fields": display_fields,
    "message": message,
    "newest_outbox": newest_outbox,
    "search_index": search_index,
    "search_docs": search_docs,
    "search_phrases": search_phrases,
    "search_blank": search_blank,
    "search_sections": search_sections,
    "collated_rank": collated_rank,
    "saved_toggle": saved_toggle,
    "audit_violations": audit_violations,
    "name_diff": name_diff,
    "obsolete_report": obsolete_report,
    "block_pages": block_pages,
    "nested_links": nested_links,
    "text_blocks": text_blocks,
    "doc_sections": doc_sections,
    "page_cards": page_cards,
    "stream_refresh": stream_refresh,
}
