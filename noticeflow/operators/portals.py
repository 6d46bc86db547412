"""Portal pages -> listing rows, by a registry of sources.

Input: a raw page table ``(page_id, source, district, url, html)``; for
Computrabajo ``district`` is the zone name of the search page (may be NULL).
``tag_table`` turns pages into elements and cards; every rule here is Column
code: URL canonical forms, locality containment, relative age.  Per-page
first-wins (before or after the age test, as each source does) and the per-page
top-k are the same for all.  ``register`` adds a source.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schema as sc
from ..functions import dates as dt
from ..functions import text as tx
from ..functions import urls as ur
from ..session import materialize
from . import tag_table as tt
from .dedupe import first_wins, top_k_per_group

KEEP = ("page_id", "district")


@dataclass(frozen=True)
class Portal:
    """A source: ``cards`` finds its cards in the rows of its pages, ``rule`` makes candidate listings of them.

    ``rule`` returns (page_id, card_pos, url, titulo, entidad, ubicacion,
    distrito, remuneracion, antiguedad); rows without a valid URL, title or
    place are already left out, age and repeats are not looked at.
    """
    spec: sc.SourceSpec
    cards: Callable[[DataFrame], DataFrame]
    rule: Callable[[DataFrame, sc.SourceSpec], DataFrame]


REGISTRY: dict[str, Portal] = {}


def register(portal: Portal) -> None:
    """Add a source, or replace the one of that name."""
    REGISTRY[portal.spec.name] = portal


def _tag(*names: str) -> Column:
    return F.coalesce(F.col("tag").isin(*names), F.lit(False)) & F.col("end").isNotNull()


def _has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split("class", r"\s+"), name), F.lit(False))


def _holds(column: str, part: str) -> Column:
    return F.coalesce(F.col(column).contains(part), F.lit(False))


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def contains_place(text: Column, place: Column, accent_sensitive: bool) -> Column:
    """LOC-1: whether a text names a place, with or without regard to accents; case never counts."""
    if accent_sensitive:
        return F.lower(text).contains(F.lower(place))
    return tx.text_key(text).contains(tx.text_key(place))


def _f(name: str) -> Column:
    return F.col("fields").getItem(name)


def _first(arr: Column, pred) -> Column:
    return F.try_element_at(F.filter(arr, pred), F.lit(1))


def _or_default(c: Column, default: str) -> Column:
    v = tx.clean(c)
    return F.when(v != "", v).otherwise(F.lit(default))


def _zone_words() -> list:
    return [d.lower() for d in fv.DISTRICTS] + [fv.PROVINCE_WORD]


def _computrabajo_cards(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_in_h2", tt.within(_tag("h2")))
    return tt.containers(rows, _tag("article"), _tag("a") & F.col("_in_h2") & _holds("href", "/ofertas-de-trabajo/"),
                         {"company": _tag("a") & _holds("href", "/empresas/")}, KEEP)


def _computrabajo(cards: DataFrame, spec: sc.SourceSpec) -> DataFrame:
    zone = F.lower(F.col("district"))
    texts = F.transform("paragraphs", lambda x: tx.clean(x))
    ubic = _first(texts, lambda t: t.contains(",") & F.when(
        zone.isNotNull(), contains_place(t, zone, spec.accent_sensitive_place)).otherwise(tx.contains_any(F.lower(t), _zone_words())))
    ubic = F.coalesce(ubic, F.lit(""))
    ambiguous_ok = F.when(zone.isin(*fv.AMBIGUOUS_ZONES),
                          F.lower(tx.clean("card_text")).contains(fv.PROVINCE_WORD)).otherwise(F.lit(True))
    url = ur.without_fragment(ur.join(F.lit(spec.base), F.col("href")))
    base = cards.select(
        "page_id", "card_pos", "district", url.alias("url"), tx.clean("link_text").alias("titulo"),
        ubic.alias("ubicacion"), ambiguous_ok.alias("_amb"), texts.alias("_texts"), "strings",
        tx.clean(_f("company")).alias("_company"))
    base = base.where(F.col("_amb") & (F.col("titulo") != "") & (F.col("ubicacion") != ""))
    texts = F.col("_texts")
    entity = F.coalesce(
        F.when(F.col("_company") != "", F.col("_company")),
        _first(texts, lambda t: (t != "") & (t != F.col("ubicacion")) & ~F.lower(t).startswith("hace ")),
        F.lit(fv.DEFAULT_COMPANY))
    salary = tx.let(_first(F.col("strings"), lambda x: x.contains(fv.SALARY_MARK)),
                    lambda x: F.when(x.isNull(), F.lit(fv.DEFAULT_SALARY)).otherwise(tx.clean(x)))
    age = F.coalesce(_first(texts, lambda t: F.lower(t).startswith("hace ") | F.lower(t).startswith("ayer")
                            | F.lower(t).startswith("hoy")), F.lit(fv.DEFAULT_AGE))
    district = F.upper(F.coalesce(F.col("district"), F.btrim(F.split(F.col("ubicacion"), ",").getItem(0))))
    return base.select("page_id", "card_pos", "url", "titulo", entity.alias("entidad"), "ubicacion",
                       district.alias("distrito"), salary.alias("remuneracion"), age.alias("antiguedad"))


def _place_names(aliases: dict) -> Column:
    out = F.initcap(F.col("district"))
    for k, v in aliases.items():
        out = F.when(F.col("district") == k, F.lit(v)).otherwise(out)
    return out


def _indeed_cards(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_in_title", tt.within(_tag("h2") & _has_class("jobTitle")))
    element = F.col("end").isNotNull()
    link = _tag("a") & (F.col("jk").isNotNull() | _has_class("jcs-JobTitle") | F.col("_in_title"))
    shell = _tag("div", "li") & (_has_class("job_seen_beacon") | _is("testid", "slider_item") | F.coalesce(
        F.lower("class").contains("result"), F.lit(False)))
    return tt.linked(rows, link, shell, {
        "location": element & (_is("testid", "text-location", "job-location") | _has_class("companyLocation")),
        "company": element & (_is("testid", "company-name", "companyName") | _has_class("companyName")),
        "salary": element & (_has_class("salary-snippet-container") | _has_class("salaryText") | _is(
            "testid", "attribute_snippet_testid")),
        "age": element & (_has_class("date") | _is("testid", "myJobsStateDate"))}, KEEP, shown=())


def _indeed(cards: DataFrame, spec: sc.SourceSpec) -> DataFrame:
    url = ur.key_param_url(F.col("href"), spec.base)
    loc = tx.clean(F.coalesce(_f("location"), F.lit("")))
    hit = contains_place(loc, F.col("district"), spec.accent_sensitive_place) | contains_place(
        loc, _place_names(fv.PLACE_NAMES_INDEED), spec.accent_sensitive_place)
    out = cards.select(
        "page_id", "card_pos", url.alias("url"), tx.clean("link_text").alias("titulo"),
        _or_default(_f("company"), fv.DEFAULT_COMPANY).alias("entidad"), loc.alias("ubicacion"),
        F.col("district").alias("distrito"), _or_default(_f("salary"), fv.DEFAULT_SALARY).alias("remuneracion"),
        _or_default(_f("age"), fv.DEFAULT_AGE).alias("antiguedad"), hit.alias("_hit"))
    return out.where((F.col("url") != "") & (F.col("ubicacion") != "") & F.col("_hit")).drop("_hit")


@functools.lru_cache(maxsize=None)
def _district_keys(names: tuple[str, ...]) -> tuple[str, ...]:
    """The comparison keys of a few names, made once."""
    rows = SparkSession.active().createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return tuple(r.k for r in rows.select("i", tx.text_key("n").alias("k")).orderBy("i").collect())


def detect_district(text: Column, aliases: dict = fv.PLACE_NAMES_LINKEDIN) -> Column:
    """First district (declared order) whose place-name key is contained in the text's key; '' if none."""
    keys = _district_keys(tuple(aliases.get(d, d.title()) for d in fv.DISTRICTS))

    def first(k):
        out = F.lit("")
        for d, name in reversed(list(zip(fv.DISTRICTS, keys))):
            out = F.when(k.contains(F.lit(name)), F.lit(d)).otherwise(out)
        return out
    return tx.let(tx.text_key(text), first)


def _linkedin_cards(rows: DataFrame) -> DataFrame:
    element = F.col("end").isNotNull()
    return tt.containers(
        rows, _tag("li") | (element & (_has_class("base-card") | _has_class("job-search-card"))),
        _tag("a") & _holds("href", "/jobs/view/"),
        {"title": element & (_has_class("base-search-card__title") | _tag("h3")),
         "company": element & (_has_class("base-search-card__subtitle") | _tag("h4")),
         "location": element & _has_class("job-search-card__location"), "age": _tag("time")}, KEEP, shown=())


def _linkedin(cards: DataFrame, spec: sc.SourceSpec) -> DataFrame:
    url = ur.canonical_path_url(F.col("href"), spec.base, spec.host, "/jobs/view/", strip_slash=True)
    title = tx.clean(F.when(F.map_contains_key("fields", "title"), _f("title")).otherwise(F.col("link_text")))
    loc = tx.clean(F.coalesce(_f("location"), F.lit("")))
    out = cards.select(
        "page_id", "card_pos", url.alias("url"), title.alias("titulo"),
        _or_default(_f("company"), fv.DEFAULT_COMPANY).alias("entidad"), loc.alias("ubicacion"),
        detect_district(F.concat_ws(" ", loc, title)).alias("distrito"),
        F.lit(fv.DEFAULT_SALARY).alias("remuneracion"), _or_default(_f("age"), fv.DEFAULT_AGE).alias("antiguedad"))
    return out.where((F.col("url") != "") & (F.col("titulo") != "") & (F.col("distrito") != ""))


def _bumeran_cards(rows: DataFrame) -> DataFrame:
    element = F.col("end").isNotNull()
    link = _tag("a") & _holds("href", "/empleos/") & F.coalesce(F.col("href").endswith(".html"), F.lit(False))
    return tt.linked(rows, link, _tag("article", "li", "div"), {
        "title": _tag("h2", "h3"), "company": element & (_holds("testid", "company") | _holds("class", "company"))},
        KEEP, fv.BUMERAN_CARD_MAX_CHARS, "(?iu)" + fv.BUMERAN_CARD_PATTERN, ("card_text",))


def _bumeran(cards: DataFrame, spec: sc.SourceSpec) -> DataFrame:
    url = ur.canonical_path_url(F.col("href"), spec.base, spec.host, "/empleos/", path_suffix=".html")
    card_text = tx.clean("card_text")
    place = _place_names(fv.PLACE_NAMES_BUMERAN)
    age = tx.clean(F.regexp_extract(card_text, "(?iu)" + fv.BUMERAN_AGE_PATTERN, 0))
    title = tx.clean(F.when(F.map_contains_key("fields", "title"), _f("title"))
                     .otherwise(F.when(tx.truthy("link_title"), F.col("link_title")).otherwise(F.col("link_text"))))
    out = cards.select(
        "page_id", "card_pos", url.alias("url"), title.alias("titulo"),
        _or_default(_f("company"), fv.DEFAULT_COMPANY).alias("entidad"),
        F.concat(place, F.lit(", Lima")).alias("ubicacion"), F.col("district").alias("distrito"),
        F.lit(fv.DEFAULT_SALARY).alias("remuneracion"), age.alias("antiguedad"),
        contains_place(card_text, place, spec.accent_sensitive_place).alias("_hit"))
    return out.where((F.col("url") != "") & F.col("_hit") & (F.col("titulo") != "")).drop("_hit")


for _spec, _cards, _rule in zip(sc.SOURCES, (_computrabajo_cards, _indeed_cards, _linkedin_cards, _bumeran_cards),
                                (_computrabajo, _indeed, _linkedin, _bumeran)):
    register(Portal(_spec, _cards, _rule))


def page_rows(pages: DataFrame) -> DataFrame:
    """The saved elements of the pages of all registered sources."""
    known = pages.where(F.col("source").isin(*REGISTRY))
    return tt.page_table(known, ("page_id", "district", "source"))


def portal_listings(pages: DataFrame, source: str, as_of, limit: int | None = None) -> DataFrame:
    """Listing rows (with lineage) from one portal's raw pages."""
    rows = page_rows(pages.where(F.col("source") == source))
    return listings_from_cards(REGISTRY[source].cards(rows), source, as_of, limit)


def listings_from_cards(cards: DataFrame, source: str, as_of, limit: int | None = None) -> DataFrame:
    """One portal's rules over a card table (page_id, card_pos, district, link, fields, texts)."""
    portal = REGISTRY[source]
    spec = portal.spec
    # saved, so that the planner does not look at the rules again after each of the joins that made the cards
    found = portal.rule(materialize(cards).withColumnRenamed("card", "card_pos"), spec)

    def distinct(rows: DataFrame) -> DataFrame:
        return first_wins(rows, ["page_id", "url"], F.col("card_pos"))

    def recent(rows: DataFrame) -> DataFrame:
        return rows.where(dt.is_recent("antiguedad"))

    # some pages' "seen" set is updated before the age test, others' after it
    picked = recent(distinct(found)) if spec.dedupe_before_age else distinct(recent(found))
    picked = top_k_per_group(picked, ["page_id"], ["card_pos"], limit or spec.limit, rank_as="_rank").drop("_rank")
    pub = dt.published_from_age(F.col("antiguedad"), as_of)
    ref = tx.reference_code(spec.prefix, "url")
    out = picked.select(
        "titulo", "entidad", "ubicacion", F.lit(fv.DEFAULT_DEPARTMENT).alias("departamento"),
        F.lit(fv.DEFAULT_PROVINCE).alias("provincia"), "distrito", ref.alias("numero_convocatoria"),
        F.lit(fv.DEFAULT_VACANCIES).alias("vacantes"), "remuneracion",
        dt.date_text(pub).alias("fecha_inicio"), dt.date_text(F.date_add(pub, 7)).alias("fecha_fin"),
        F.lit(source).alias("fuente"), F.col("url").alias("url_oficial"), F.col("url").alias("url_postulacion"),
        F.col("antiguedad").alias("detalle_entidad"),
        F.lit(spec.order).alias("src_ord"),
        F.col("page_id").cast("bigint").alias("page_id"), F.col("card_pos").cast("int").alias("card_pos"))
    return out.withColumn("id", tx.stable_id("entidad", "numero_convocatoria", "titulo", "ubicacion"))


def all_portal_listings(pages: DataFrame, as_of) -> DataFrame:
    """The listings of every registered source; the pages become rows once."""
    rows, out = page_rows(pages), None
    for source, portal in REGISTRY.items():
        part = listings_from_cards(portal.cards(rows.where(F.col("source") == source)), source, as_of)
        out = part if out is None else out.unionByName(part)
    return out
