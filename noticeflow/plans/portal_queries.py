"""The portals' cards and rules over pages that Spark writes from the customers: a card per customer, many a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import portals as pt
from .table_queries import _s, table

AS_OF = "2026-03-10"
AGES = ("Hace 2 días", "Ayer", "Hace 9 días", "Hoy", "Hace 1 semana", "hace más de 30 días", "Hace 5 horas")
RESULT = ("page_id", "titulo", "entidad", "ubicacion", "distrito", "remuneracion", "fecha_inicio", "url_oficial",
          "numero_convocatoria")


def pick(values, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def text(template: str, **parts: Column) -> Column:
    """The template with its ``{name}`` parts filled in."""
    out = []
    for piece in template.replace("}", "{").split("{"):
        out.append(parts[piece] if piece in parts else F.lit(piece))
    return F.concat(*out)


def pages(spark, sf, source: str, per_page: int, card: Column, district: Column, start: str = "", end: str = "") -> DataFrame:
    """Pages of ``per_page`` customers, in the order of their keys."""
    c = table(spark, sf, "customer")
    key = F.floor(F.col("c_custkey") / per_page).alias("page_id")
    made = c.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "c_custkey", card.alias("html")))), lambda x: x.html), "\n").alias("cards"))
    return made.select("page_id", F.lit(source).alias("source"), district.alias("district"), F.lit("u").alias("url"),
                       F.concat(F.lit(f"<html><body><!-- <article> --><script>'<li>'</script>{start}"), "cards",
                                F.lit(f"{end}</body></html>")).alias("html"))


K = F.col


def computrabajo_cards(spark, sf):
    """EXT-1, FLT-5, LOC-1: articles with an offer link in a heading; repeated addresses, unclosed paragraphs."""
    k = K("c_custkey")
    card = text('<article><p>{age}<p>{place}</p>{extra}<h2>oferta <a href="/ofertas-de-trabajo/p{key}?x=1&amp;y#f">'
                '<b>{name}</b></a></h2>{firm}</article>',
                age=pick(AGES, k), place=pick(("Asia, Lima", "Mala, Lima", "Trujillo, La Libertad", "Imperial,  Cañete"), k),
                extra=F.when(k % 3 == 0, F.concat(F.lit("<div><p>S/. "), _s("c_nationkey"), F.lit("<div>"))).otherwise(""),
                key=_s(k - F.when(k % 10 == 9, 1).otherwise(0)), name=K("c_name"),
                firm=F.when(k % 2 == 0, F.concat(F.lit('<a href="/empresas/x">'), "c_mktsegment", F.lit("</a>"))).otherwise(""))
    made = pages(spark, sf, fv.SOURCE_COMPUTRABAJO, 40, card, F.lit(None).cast("string"))
    return pt.portal_listings(made, fv.SOURCE_COMPUTRABAJO, AS_OF).select(*RESULT)


def indeed_cards(spark, sf):
    """EXT-2: the nearest marked ancestor of a link, inside a list that is marked as well; keys repeat across pages."""
    k = K("c_custkey")
    card = text('<div class="outer"><div class="a job_seen_beacon"><h2 class="jobTitle"><a {mark} href="/rc/clk?jk={key}'
                '&amp;x=1"><span>{name}</span></a></h2><div data-testid="text-location">{place}</div>'
                '<span class="companyName">{firm}</span>{pay}<span class="date">{age}</span></div>{close}',
                mark=F.when(k % 2 == 0, F.concat(F.lit('data-jk="'), _s(k), F.lit('"'))).otherwise(""),
                key=F.when(k % 11 == 0, "").otherwise(_s(k)), name=K("c_name"),
                place=pick(("Asia, Lima", "San Luis de Cañete", "Chincha"), k), firm=K("c_mktsegment"),
                pay=F.when(k % 4 == 0, '<div class="salary-snippet-container">S/. 5</div>').otherwise(""),
                age=pick(AGES, k), close=F.when(k % 6 == 0, "").otherwise("</div>"))
    made = pages(spark, sf, fv.SOURCE_INDEED, 25, card, pick(("ASIA", "SAN LUIS"), K("page_id")),
                 '<div class="resultlist">', "</div>")
    return pt.portal_listings(made, fv.SOURCE_INDEED, AS_OF).select(*RESULT)


def linkedin_cards(spark, sf):
    """EXT-3, LOC-2: nested cards of one listing count once; the district is the first named by place or title."""
    k = K("c_custkey")
    card = text('<li><div class="base-card x"><a class="base-card__full-link" href="https://pe.linkedin.com/jobs/view/p-{key}'
                '/?trk=a"></a><h3 class="base-search-card__title"> {title} </h3><h4>{firm}</h4>'
                '<span class="job-search-card__location">{place}</span><time>{age}</time></div>{close}',
                key=_s(k), title=F.concat("c_name", F.when(k % 9 == 0, " en Quilmaná").otherwise("")),
                firm=K("c_mktsegment"), place=pick(("Lunahuaná", "Lima", "San Antonio, Lima", "nuevo imperial"), k),
                age=pick(AGES, k), close=F.when(k % 5 == 0, "").otherwise("</li>"))
    made = pages(spark, sf, fv.SOURCE_LINKEDIN, 500, card, F.lit(None).cast("string"), "<ul>", "</ul>")
    return pt.portal_listings(made, fv.SOURCE_LINKEDIN, AS_OF).select(*RESULT)


def bumeran_cards(spark, sf):
    """EXT-4, LOC-1: the nearest ancestor of at most 3500 characters that says when it was published."""
    k = K("c_custkey")
    card = text('<div><article><div><a href="/empleos/x-{key}.html?q" title="{name}">ver</a><a href="/empleos/x-{key}.html"'
                ' title="{name}"><i>ver</i></a></div><span>{place}</span>{long}<p>Publicado {age}</article></div>',
                key=_s(k), name=K("c_name"), place=pick(("Cerro Azul", "Pisco", "SAN ANTONIO de canete"), k),
                long=F.when(k % 8 == 0, F.repeat(F.lit("palabra "), 500)).otherwise(""), age=F.lower(pick(AGES, k)))
    made = pages(spark, sf, fv.SOURCE_BUMERAN, 30, card, pick(("CERRO AZUL", "SAN ANTONIO"), K("page_id")))
    return pt.portal_listings(made, fv.SOURCE_BUMERAN, AS_OF).select(*RESULT)


QUERIES = {q.__name__: q for q in (computrabajo_cards, indeed_cards, linkedin_cards, bumeran_cards)}
