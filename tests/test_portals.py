"""Portal rules on pages built from the selectors and the rules: several cards a page, every alternative, bad cards."""

import pytest
from pyspark.sql import functions as F

from noticeflow import fixed_values as fv
from noticeflow.operators import portals
from noticeflow.operators import tag_table as tt

AS_OF = "2026-03-10"
PAGE = "page_id long, source string, district string, url string, html string"


def listings(spark, source, *pages, limit=None):
    rows = [(k, source, district, "u", html) for k, (district, html) in enumerate(pages)]
    out = portals.portal_listings(spark.createDataFrame(rows, PAGE), source, AS_OF, limit).collect()
    return sorted(out, key=lambda r: (r.page_id, r.card_pos))


def offer(n, place="Asia, Lima", age="Hoy", extra="", path="ofertas-de-trabajo"):
    return f'<article><p>{age}</p><p>{place}</p>{extra}<h2><a href="/{path}/p{n}?x={n}#f">Puesto {n}</a></h2></article>'


@pytest.mark.parametrize(("age", "kept"), [("Hace 7 días", True), ("Hace 8 días", False), ("Ayer", True),
                                           ("Hace 1 semana", True), ("Hace más de 30 días", False), ("Hoy", True)])
def test_computrabajo_ages(spark, age, kept):
    out = listings(spark, fv.SOURCE_COMPUTRABAJO, (None, offer(1, age=age)))
    assert len(out) == kept


def test_computrabajo_cards_of_one_page(spark):
    html = "".join([
        offer(1, extra='<a href="/empresas/x">Uno SAC</a><p>S/. 900</p>'),
        offer(1, place="Mala, Lima"),                                     # the address again
        offer(2, place="Trujillo, La Libertad"),                          # no zone of the province
        offer(3, path="perfil"),                                          # not an offer
        offer(4, place="San Luis, Lima"),                                 # found by its name
        offer(5, age="Hace 2 horas", extra="<p>Sin empresa ni sueldo</p>"),
    ])
    out = listings(spark, fv.SOURCE_COMPUTRABAJO, (None, html))
    assert [r.titulo for r in out] == ["Puesto 1", "Puesto 4", "Puesto 5"]
    assert (out[0].entidad, out[0].remuneracion, out[0].distrito) == ("Uno SAC", "S/. 900", "ASIA")
    assert out[2].entidad == "Sin empresa ni sueldo" and out[2].remuneracion == fv.DEFAULT_SALARY
    assert out[0].url_oficial.endswith("/ofertas-de-trabajo/p1?x=1")
    ambiguous = listings(spark, fv.SOURCE_COMPUTRABAJO, ("San Luis", offer(6, place="San Luis, Lima")),
                         ("San Luis", offer(7, place="San Luis, Lima", extra="<p>Provincia de Cañete</p>")))
    assert [r.titulo for r in ambiguous] == ["Puesto 7"]


def test_computrabajo_takes_a_limited_number_per_page(spark):
    many = "".join(offer(k) for k in range(20))
    out = listings(spark, fv.SOURCE_COMPUTRABAJO, (None, many), (None, many))
    assert [sum(r.page_id == p for r in out) for p in (0, 1)] == [fv.LIMIT_COMPUTRABAJO] * 2
    assert len(listings(spark, fv.SOURCE_COMPUTRABAJO, (None, many), limit=3)) == 3


@pytest.mark.parametrize(("shell", "place", "firm"), [
    ('<div class="job_seen_beacon">{}</div>', '<div data-testid="text-location">{}</div>', '<b data-testid="companyName">{}</b>'),
    ('<li data-testid="slider_item">{}</li>', '<p class="companyLocation">{}</p>', '<i class="companyName">{}</i>'),
    ('<div class="a searchresult b">{}</div>', '<span data-testid="job-location">{}</span>', '<u data-testid="company-name">{}</u>'),
])
def test_indeed_alternative_marks(spark, shell, place, firm):
    def card(key, where):
        return shell.format(f'<h3><a data-jk="{key}" href="/pagead?jk={key}&amp;sid=1">Plaza {key}</a></h3>'
                            + place.format(where) + firm.format("Firma " + key))
    html = card("a1", "Imperial, Cañete") + card("b2", "Chincha") + card("a1", "Imperial")
    out = listings(spark, fv.SOURCE_INDEED, ("IMPERIAL", html))
    assert [(r.url_postulacion, r.entidad, r.distrito) for r in out] == [
        ("https://pe.indeed.com/viewjob?jk=a1", "Firma a1", "IMPERIAL")]


def test_indeed_without_key_age_or_company(spark):
    html = ('<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/x?jk=">sin clave</a></h2><p class="companyLocation">Asia</p></div>'
            '<div class="job_seen_beacon"><a class="jcs-JobTitle" href="/x?jk=z9">vieja</a><p class="companyLocation">Asia</p>'
            '<p class="date">hace 3 semanas</p></div>'
            '<div class="job_seen_beacon"><a class="jcs-JobTitle" href="/x?jk=z8">buena</a><p class="companyLocation">Asia</p></div>')
    out = listings(spark, fv.SOURCE_INDEED, ("ASIA", html))
    assert [(r.titulo, r.entidad, r.detalle_entidad) for r in out] == [("buena", fv.DEFAULT_COMPANY, fv.DEFAULT_AGE)]


def test_linkedin_titles_places_and_hosts(spark):
    def card(n, place, title="", host="https://pe.linkedin.com", age="Hace 5 horas"):
        return (f'<li><h3>{title}</h3><a href="{host}/jobs/view/p-{n}/?trk=a">enlace {n}</a><h4>Firma</h4>'
                f'<b class="job-search-card__location">{place}</b><time>{age}</time></li>')
    html = "<ol>" + "".join([
        card(1, "Lunahuaná", "Guía"), card(2, "Lima", "Chofer en Quilmaná"), card(3, "San Antonio, Lima", "Cocina"),
        card(4, "San Antonio de Cañete", "Cocina"), card(5, "Mala", "Otra", host="https://www.example.com"),
        card(6, "Mala", "Tarde", age="Hace 9 días")]) + "</ol>"
    out = listings(spark, fv.SOURCE_LINKEDIN, (None, html))
    assert [(r.titulo, r.distrito) for r in out] == [("Guía", "LUNAHUANÁ"), ("Chofer en Quilmaná", "QUILMANÁ"),
                                                    ("Cocina", "SAN ANTONIO")]
    assert out[0].url_oficial == "https://pe.linkedin.com/jobs/view/p-1"


def test_first_district_in_declared_order(spark):
    df = spark.createDataFrame([("Asia y Mala",), ("nuevo imperial",), ("ZUNIGA",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(portals.detect_district(F.col("t"))).collect()] == ["MALA", "IMPERIAL", "ZÚÑIGA", "", ""]


def test_bumeran_link_cards(spark):
    def card(n, age, place="Cerro Azul", tag="article", end=".html"):
        return f'<{tag}><div><a href="/empleos/x-{n}{end}" title="Aviso {n}">ver</a></div><span>{place}</span><i>{age}</i></{tag}>'
    html = "".join([card(1, "Publicado hoy"), card(2, "Actualizado hace 2 semanas"), card(3, "Publicado ayer", place="Pisco"),
                    card(4, "Publicado hace 6 días", tag="li"), card(5, "Publicado hoy", end=".php"), card(1, "Publicado ayer")])
    out = listings(spark, fv.SOURCE_BUMERAN, ("CERRO AZUL", html))
    assert [(r.titulo, r.fecha_inicio, r.fecha_fin) for r in out] == [
        ("Aviso 1", "10/03/2026", "17/03/2026"), ("Aviso 4", "04/03/2026", "11/03/2026")]


def test_repeated_page_ids_do_not_multiply_cards(spark):
    rows = [(1, fv.SOURCE_COMPUTRABAJO, d, "u", offer(k, place=f"{d}, Lima")) for k, d in ((1, "Asia"), (2, "Mala"))]
    out = portals.portal_listings(spark.createDataFrame(rows, PAGE), fv.SOURCE_COMPUTRABAJO, AS_OF).collect()
    assert sorted((r.titulo, r.distrito) for r in out) == [("Puesto 1", "ASIA"), ("Puesto 2", "MALA")]


def test_every_portal_and_no_pages(spark):
    html = offer(1)
    df = spark.createDataFrame([(1, fv.SOURCE_COMPUTRABAJO, None, "u", html), (2, "other", None, "u", html)], PAGE)
    assert [r.fuente for r in portals.all_portal_listings(df, AS_OF).collect()] == [fv.SOURCE_COMPUTRABAJO]
    assert portals.all_portal_listings(df.limit(0), AS_OF).count() == 0


def cards(spark, source, html):
    df = spark.createDataFrame([(1, source, "Asia", "u", html)], PAGE)
    return portals.REGISTRY[source].cards(portals.page_rows(df)).collect()


def test_deep_and_unclosed_markup(spark):
    deep = "<article>" + "<div>" * 3000 + '<h2><a href="/ofertas-de-trabajo/1">x</a></h2>'
    assert cards(spark, fv.SOURCE_COMPUTRABAJO, deep)[0].href == "/ofertas-de-trabajo/1"
    flat = '<article><h2><a href="/ofertas-de-trabajo/1">x</a></h2>' + "<p>text " * 500
    assert [len(p) for p in cards(spark, fv.SOURCE_COMPUTRABAJO, flat)[0].paragraphs] == [4] * 500


def elements(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    rows = tt.page_table(df).collect()
    return {(r.tag, r.pos): r.end for r in rows if r.end is not None}, rows


def test_ends_of_closed_unclosed_and_stray_elements(spark):
    ends, _ = elements(spark, "<div><p>a<p>b<b>c</div></p><ul><li>d<li>e</ul><br/></div><i>f")
    # positions: div0 p1 a2 p3 b4 b5 c6 /div7 /p8 ul9 li10 d11 li12 e13 /ul14 br15 /div16 i17 f18
    assert ends == {("div", 0): 7, ("p", 1): 3, ("p", 3): 7, ("b", 5): 7, ("ul", 9): 14, ("li", 10): 14,
                    ("li", 12): 14, ("br", 15): 15, ("i", 17): tt.LAST}


def test_nested_elements_of_one_name_and_hidden_text(spark):
    ends, rows = elements(spark, "<div><!-- <p> --><script>'<div>'</script><div>x</div>y</div><div>z</div>")
    assert len(ends) == 3
    assert [r.text for r in sorted(rows, key=lambda r: r.pos) if r.kind == "text"] == ["x", "y", "z"]
    outer = min(ends)
    assert all(outer[1] < pos and end < ends[outer] for (_, pos), end in ends.items() if pos in range(1, ends[outer])
               and pos != outer[1])


def test_nearest_marked_element(spark):
    df = spark.createDataFrame([('<div class="m"><div><a>1</a><div class="m"><a>2</a></div><a>3</a></div></div><a>4</a>',)],
                               "html string")
    rows = tt.page_table(df).withColumn("m", F.col("class").isNotNull() & F.col("end").isNotNull())
    got = tt.innermost(rows.withColumn("m", F.coalesce("m", F.lit(False))), "m", "near")
    near = [r.near for r in got.where("tag = 'a' and kind = 'open'").orderBy("pos").collect()]
    starts = [r.pos for r in rows.where("m").orderBy("pos").collect()]
    assert near == [starts[0], starts[1], starts[0], None]


def test_references_and_attributes(spark):
    from noticeflow.functions import markup
    cases = [("&amp;#38; &#38; &#x41;&#65;", "&#38; & AA"), ("&ntilde;&eacute;&nbsp;&bogus; & &#128512;", "ñé\u00a0&bogus; & 😀"),
             ("&#0;&#xD800;", "\ufffd\ufffd"), ("plain", "plain"), (None, None)]
    df = spark.createDataFrame(cases, "raw string, want string")
    assert all(r.got == r.want for r in df.select("want", markup.decoded(F.col("raw")).alias("got")).collect())
    raws = [(' href="/a?b=1&amp;c=2" class=x', "/a?b=1&c=2"), (" HREF='q'", "q"), (" data-href=1 href=2", "2"),
            (' title="x href=9" href', ""), (' title="href=1"', None), ("", None)]
    df = spark.createDataFrame(raws, "raw string, want string")
    assert [r.got for r in df.select(markup.attribute(F.col("raw"), "href").alias("got")).collect()] == [w for _, w in raws]


def test_a_source_can_be_registered(spark):
    from noticeflow import schema as sc
    spec = sc.SourceSpec("Plain", 9, "PL", 2, "plain.example", "https://plain.example", False, False)

    def rule(found, s):
        return found.select("page_id", "card_pos", F.concat(F.lit(s.base), F.col("href")).alias("url"),
                            F.col("link_text").alias("titulo"), F.lit("e").alias("entidad"), F.lit("u").alias("ubicacion"),
                            F.col("district").alias("distrito"), F.lit("").alias("remuneracion"), F.lit("hoy").alias("antiguedad"))

    def found(rows):
        return tt.containers(rows, F.col("tag") == "li", F.col("tag") == "a", {}, portals.KEEP)

    portals.register(portals.Portal(spec, found, rule))
    try:
        out = listings(spark, "Plain", ("Asia", "<ul>" + "".join(f'<li><a href="/{k}">t{k}</a></li>' for k in range(5)) + "</ul>"))
        assert [(r.titulo, r.fuente, r.src_ord, r.url_oficial) for r in out] == [
            ("t0", "Plain", 9, "https://plain.example/0"), ("t1", "Plain", 9, "https://plain.example/1")]
    finally:
        del portals.REGISTRY["Plain"]


def test_pages_are_dealt_once_and_nested_cards_show_slices(spark):
    """Cards of a page are made where its rows lie: no shuffle, no join, no text per card but what is asked for."""
    item = '<li><a href="https://pe.linkedin.com/jobs/view/p-%d/">t%d</a><h3>%s</h3>'
    html = "<ul>" + "".join(item % (k, k, "x" * 50) for k in range(40)) + "</ul>"       # never closed: each holds the rest
    df = spark.createDataFrame([(1, fv.SOURCE_LINKEDIN, "Asia", "u", html)], PAGE)
    found = portals.REGISTRY[fv.SOURCE_LINKEDIN].cards(portals.page_rows(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "card_text" not in found.columns
    out = found.orderBy("card").collect()
    assert [(r.link_text, r.fields["title"]) for r in out] == [(f"t{k}", "x" * 50) for k in range(40)]
