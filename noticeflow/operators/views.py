"""Serving views: location breakdown, district sections and counts, facets, cards, detail view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions import text as tx
from .dedupe import last_wins


def location_parts(df: DataFrame, loc: str = "ubicacion", dept: str = "departamento",
                   prov: str = "provincia", dist: str = "distrito") -> DataFrame:
    """Explicit columns when non-empty, else the location split on '-' (no spaces needed)."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(loc), F.lit("")), "-"), lambda x: tx.py_strip(x)),
                     lambda x: x != "")

    def part(i):
        return F.try_element_at(parts, F.lit(i))

    def col_or_empty(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    return df.select(
        "*",
        F.coalesce(F.nullif(col_or_empty(dept), F.lit("")), part(1), F.lit(fv.DEFAULT_REGION_LABEL)).alias("loc_department"),
        F.coalesce(F.nullif(col_or_empty(prov), F.lit("")), part(2), F.lit("")).alias("loc_province"),
        F.coalesce(F.nullif(col_or_empty(dist), F.lit("")), part(3), F.lit("")).alias("loc_district"),
    )


def group_label(department="loc_department", province="loc_province", district="loc_district") -> Column:
    """First non-empty of district, province, department."""
    return F.coalesce(F.nullif(F.col(district), F.lit("")), F.nullif(F.col(province), F.lit("")), F.col(department))


def district_rows(listings: DataFrame, dim: DataFrame, label: str = "label",
                  dim_key: str = "district", title: str = "titulo", pos: str = "pos") -> DataFrame:
    """Listings of the dimension's districts, in section order then title (code-point) order.

    Listings whose label is not in the dimension are not listed.  The ordering
    is a global range-partitioned sort (no window partitioned by district, so a
    hot district does not land in one task).
    """
    return listings.join(dim, F.col(label) == F.col(dim_key)).orderBy("ord", title, pos)


def district_counts(listings: DataFrame, dim: DataFrame, label: str = "label", dim_key: str = "district") -> DataFrame:
    """Every dimension row with its listing count (0 kept), plus the overall total.

    One aggregation of the listings: the total, which also counts districts
    outside the dimension, is a sum over the counts (one row per district).
    """
    counts = listings.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("n_listings"))
    both = dim.withColumn("_in", F.lit(True)).join(counts, F.col(dim_key) == F.col("_label"), "full_outer")
    n = F.coalesce(F.col("n_listings"), F.lit(0)).cast("bigint")
    total = F.sum(n).over(Window.partitionBy())
    out = both.select("*", total.alias("total_listings")).where("_in")
    return out.select(*dim.columns, n.alias("n_listings"), "total_listings", (n > 0).alias("visible"))


def facets(df: DataFrame, columns) -> DataFrame:
    """Distinct non-empty values per column, sorted: (facet, value); one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    out = df.select(pairs.alias("p")).select("p.facet", "p.value").where(tx.truthy("value"))
    return out.distinct().orderBy("facet", "value")


def salary_display(c, handle_unspecified: bool = True) -> Column:
    """Salary text with the currency mark; the site variant maps empty/unspecified to the default."""
    v = tx.py_strip(F.coalesce(tx._c(c), F.lit("")))
    marked = F.when(F.upper(v).startswith(fv.SALARY_MARK), v).otherwise(F.concat(F.lit(fv.SALARY_MARK + " "), v))
    if not handle_unspecified:
        return marked
    unspecified = (v == "") | (F.lower(v) == fv.DEFAULT_SALARY.lower())
    return F.when(unspecified, F.lit(fv.DEFAULT_SALARY)).otherwise(marked)


def _opt(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def index_cards(df: DataFrame, *keep: str) -> DataFrame:
    """Index-card projection (id, title, entity, location parts, vacancies, code, badge, profile, file)."""
    lp = location_parts(df) if "loc_department" not in df.columns else df
    return lp.select(
        "id", "titulo", "entidad", "loc_department", "loc_province", "loc_district", "vacantes",
        F.when(tx.truthy(_opt(lp, "codigo_servir")), _opt(lp, "codigo_servir")).alias("code"),
        F.coalesce(_opt(lp, "fuente"), F.lit(fv.DEFAULT_SOURCE_BADGE)).alias("source_badge"),
        F.nullif(tx.py_strip(F.coalesce(_opt(lp, "formacion_academica"), F.lit(""))), F.lit("")).alias("profile"),
        tx.file_name("id", "titulo").alias("file_name"), *keep,
    )


def detail_view(df: DataFrame, keep=("id",)) -> DataFrame:
    """The data part of a detail page, as columns (no HTML); ``keep`` columns pass through."""
    app, consult = F.coalesce(_opt(df, "url_postulacion"), F.lit("")), F.coalesce(_opt(df, "url_consulta"), F.lit(""))
    action = F.when(app != "", F.lit("direct")).when(consult != "", F.lit("portal")).otherwise(F.lit("none"))
    portal = F.coalesce(_opt(df, "fuente"), F.lit("")).isin(*fv.PORTAL_SOURCES)
    sections = F.array(*[F.struct(F.lit(label).alias("label"), _opt(df, c).alias("text")) for label, c in fv.DETAIL_LABELS])
    links = _opt(df, "enlaces_bases") if "enlaces_bases" in df.columns else F.array().cast("array<struct<titulo:string,url:string>>")
    docs = F.transform(
        F.filter(links, lambda x: tx.truthy(x["url"])),
        lambda x: F.struct(F.coalesce(F.nullif(x["titulo"], F.lit("")), F.lit(fv.DEFAULT_DOC_TITLE)).alias("titulo"),
                           x["url"].alias("url")))
    return df.select(
        *keep,
        action.alias("action_kind"),
        consult.contains(fv.CERTIFICATE_NOTICE_LINK).alias("certificate_notice"),
        F.when(portal, F.lit("publication")).otherwise(F.lit("range")).alias("date_label"),
        F.when(portal, F.col("fecha_inicio"))
        .otherwise(F.concat(F.col("fecha_inicio"), F.lit(" — "), F.col("fecha_fin"))).alias("date_text"),
        F.when(F.col("vacantes") != "1", F.lit("vacantes")).otherwise(F.lit("vacante")).alias("vacancy_label"),
        salary_display("remuneracion").alias("salary"),
        F.filter(sections, lambda x: tx.truthy(x["text"])).alias("requirements"),
        docs.alias("documents"),
        F.when(tx.truthy(_opt(df, "codigo_servir")), _opt(df, "codigo_servir")).alias("code"),
    )


def with_listing_columns(df: DataFrame) -> DataFrame:
    """Default-column fill: source and official URL only when absent; recomputed id."""
    out = df
    if "fuente" not in out.columns:
        out = out.withColumn("fuente", F.lit(None).cast("string"))
    if "url_oficial" not in out.columns:
        out = out.withColumn("url_oficial", F.lit(None).cast("string"))
    code = F.col("codigo_servir") if "codigo_servir" in out.columns else None
    return (out.withColumn("fuente", F.coalesce("fuente", F.lit(fv.SOURCE_OFFICIAL)))
            .withColumn("url_oficial", F.coalesce("url_oficial", F.lit(fv.OFFICIAL_URL)))
            .withColumn("id", tx.stable_id("entidad", "numero_convocatoria", "titulo", "ubicacion", code)))


def keyed_scan(df: DataFrame, pos: Column) -> DataFrame:
    """SRC-2: the rows of a snapshot with their id made again; of each id the last row."""
    return last_wins(with_listing_columns(df), "id", pos, first_pos_as=None)
