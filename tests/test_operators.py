import hashlib
import json
import os

from pyspark.sql import functions as F

from noticeflow import fixed_values as fv
from noticeflow import schema as sc
from noticeflow.functions import text as tx
from tests.keys import plain_key
from noticeflow.operators import audit, common, dedupe, extract, matching, merge, outbox, refresh, search, views
from noticeflow.sources import files

def sample(n=40):
    """Listings of the whole dimension, with accents, codes and dates around the window."""
    rows = []
    for k in range(n):
        rows.append({
            "titulo": ("Médico/a", "Asistente  II", "Niñera", "Chófer")[k % 4] + f" {k}", "entidad": f"Entidad Ñ {k % 7}",
            "ubicacion": f"LIMA - CAÑETE - {fv.DISTRICTS[k % 5]}", "numero_convocatoria": f"N-{k}",
            "codigo_servir": (None, "", "55001")[k % 3], "vacantes": "1", "remuneracion": "S/. 10",
            "fecha_inicio": f"{1 + k % 12:02d}/05/2027", "fecha_fin": "30/05/2027", "fuente": "LinkedIn",
            "url_oficial": f"https://pe.linkedin.com/jobs/view/{k}"})
    return rows


def expected_id(r):
    parts = [r[c] for c in ("entidad", "numero_convocatoria", "titulo", "ubicacion")]
    parts += [r["codigo_servir"]] if r["codigo_servir"] else []
    return hashlib.sha256("|".join(map(plain_key, parts)).encode()).hexdigest()[:20]


def test_sample_snapshot_ids_files_and_district_counts(spark, tmp_dir):
    path = os.path.join(tmp_dir, "snapshot.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(sample(), f, ensure_ascii=False)
    df = files.read_snapshot_with_pos(spark, path)
    ident = tx.stable_id("entidad", "numero_convocatoria", "titulo", "ubicacion", F.col("codigo_servir"))
    rows = df.select("pos", ident.alias("rid"), tx.file_name(ident, "titulo").alias("fname")).orderBy("pos").collect()
    for r, want in zip(rows, sample(), strict=True):
        assert r.rid == expected_id(want) and r.fname == f"{r.rid}-{plain_key(want['titulo']).replace('/', '-').replace(' ', '-')}.html"
    fresh = refresh.fresh(df, "2027-05-10")
    want = [r for r in sample() if 3 <= int(r["fecha_inicio"][:2]) <= 10]
    assert fresh.count() == len(want)
    labelled = views.location_parts(fresh).withColumn("label", views.group_label())
    counts = {r.district: r.n_listings for r in views.district_counts(labelled, sc.districts_df(spark)).collect()}
    assert counts == {d: sum(r["ubicacion"].endswith("- " + d) for r in want) for d in fv.DISTRICTS}


def test_empty_index_keeps_all_districts(spark):
    counts = views.district_counts(sc.empty_listings(spark).withColumn("label", F.col("distrito")),
                                   sc.districts_df(spark)).collect()
    assert len(counts) == 16 and all(r.n_listings == 0 and not r.visible for r in counts)
    assert {r.total_listings for r in counts} == {0}


def _listing(spark, rows, extra="pos int"):
    cols = "titulo string, entidad string, ubicacion string, numero_convocatoria string, codigo_servir string, " + extra
    return spark.createDataFrame(rows, cols)


def test_superseded_by_base_key(spark):
    def row(title, code, pos):
        return (title, "Puerto Ñ", "ICA", "P-9", code, pos)
    df = merge.with_base_key(_listing(spark, [row("Gerente", None, 1), row(" GERENTE ", "77", 2), row("gerénte", "", 3),
                                              row("Gerenta", None, 4), row("Cajero", "1", 5), row("Cajero", "1", 6)]))
    kept, removed = merge.split_superseded(df)
    assert sorted(r.pos for r in removed.collect()) == [1, 3] and sorted(r.pos for r in kept.collect()) == [2, 4, 5, 6]
    assert kept.columns == df.columns == removed.columns


def test_expiry_split(spark):
    df = spark.createDataFrame([(k, d) for k, d in enumerate(("31/12/2027", "01/01/2028", "31/02/2027", None, " 30/12/2027"))],
                               "id int, fecha_fin string")
    kept, removed = merge.split_expired(df, "2028-01-01")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3] and sorted(r.id for r in removed.collect()) == [0, 4]


def test_run_summary_against_its_parts(spark):
    rows = [("a", "k1", None, 1, True, "d"), ("b", "k1", "7", 0, True, None), ("c", "k2", None, 1, False, "d"),
            ("d", "k3", "", 1, True, "d"), ("e", "k1", None, 1, False, None), ("f", "k4", "9", 0, False, "d")]
    df = spark.createDataFrame(rows, "id string, base_key string, codigo_servir string, n_before int, open boolean, doc string")
    got = merge.run_summary(df, document="doc").first().asDict()
    assert got == {"n_before": 4, "n_after": 2, "n_expired": 2, "n_merged": 2, "n_documents": 1, "n_new": -2}


def test_rows_without_url_are_set_aside(spark):
    cols = "fuente string, url_oficial string, fecha_inicio string, titulo string, src_ord int, page_id bigint, card_pos int"
    new = spark.createDataFrame([("LinkedIn", None, "20/08/2026", "x", 2, 1, 0), ("LinkedIn", None, "20/08/2026", "y", 2, 1, 1),
                                 ("LinkedIn", "u", "20/08/2026", "z", 2, 1, 2)], cols)
    out = refresh.refresh(new.limit(0), new, sc.sources_df(spark), "2026-08-22").collect()
    assert [r.titulo for r in out] == ["z"] and refresh.rows_without_url(new).count() == 2


def test_first_match_is_one_rule_for_any_list(spark):
    texts = spark.createDataFrame([(1, "En SAN LUIS y Mala"), (2, "한국어 강남구"), (3, ""), (4, None), (5, "nada")], "i int, t string")
    terms = [(3, "mala"), (1, ""), (2, "San Luis"), (9, "강남")]
    padded = terms + [(100 + k, f"zz{k}") for k in range(400)]
    for some in (terms, padded):
        out = matching.first_match(texts, "t", spark.createDataFrame(some, "o int, term string"), "o", "term")
        assert {r.i: r.label for r in out.collect()} == {1: "San Luis", 2: "강남", 3: "", 4: "", 5: ""}


def test_first_match_of_many_terms_copies_no_text(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 2)                       # terms come in several blocks
    long = "y" * 40
    texts = spark.createDataFrame([(1, "xx " + long + "z"), (2, "xx " + long), (3, "\U0001f600abc"), (4, "c" * 9 + "ddddddddd")],
                                  "i int, t string")
    terms = spark.createDataFrame([(1, long + "z"), (2, "?abc"), (3, "cccccccc" + "x"), (4, "dddddddd"), (5, "xx"), (6, "b")],
                                  "o int, term string")
    out = matching.first_match(texts, "t", terms, "o", "term")
    assert {r.i: r.label for r in out.collect()} == {1: long + "z", 2: "xx", 3: "b", 4: "dddddddd"}
    rows = spark.createDataFrame([(1, "abc")], "_row long, _key string")
    asked = spark.createDataFrame([(1, "abc", "abc")], "n int, k string, gram string")
    plan = matching.first_numbers(rows, asked, [3], 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_message_lacking_a_part_is_not_published(spark):
    df = spark.createDataFrame([(str(k), "T", e, "L", "1", "5", "01/01/2026", "02/01/2026") for k, e in enumerate(("E", None))],
                               "id string, titulo string, entidad string, ubicacion string, vacantes string, remuneracion string, "
                               "fecha_inicio string, fecha_fin string")
    assert [r.id for r in outbox.outbox_rows(df, "2026-01-01").collect()] == ["0"]


def test_carry_forward_presence_semantics(spark):
    prev = spark.createDataFrame([("a", -1, "old-req", "old-link", "P")], "id string, pos int, requerimiento string, url_postulacion string, titulo string")
    new = spark.createDataFrame([("a", 1, None, "", "N1"), ("a", 2, None, None, "N2"), ("b", 3, "r", None, "B")],
                                "id string, pos int, requerimiento string, url_postulacion string, titulo string")
    out = {r.id: r for r in merge.carry_forward_upsert(prev, new).collect()}
    assert out["a"].titulo == "N2"
    assert out["a"].requerimiento == "old-req"      # absent twice: carried from the previous version
    assert out["a"].url_postulacion == ""           # present but empty in N1 blocks the older value
    assert out["b"].requerimiento == "r"


def test_refresh_fallback_fresh_then_last_wins(spark):
    cols = "fuente string, url_oficial string, fecha_inicio string, titulo string, src_ord int, page_id bigint, card_pos int"
    prev = spark.createDataFrame([
        ("LinkedIn", "u1", "20/08/2026", "prev-li", 2, 0, 0),
        ("Indeed Perú", "u2", "20/08/2026", "prev-in", 1, 0, 0),
        ("Desconocida", "u3", "20/08/2026", "unknown", 9, 0, 0)], cols)
    new = spark.createDataFrame([
        ("Indeed Perú", "u2", "21/08/2026", "new-in", 1, 5, 0),
        ("Indeed Perú", "u4", "01/01/2020", "stale", 1, 5, 1),
        ("Bumeran Perú", "u4", "21/08/2026", "fresh", 3, 6, 0),
        ("Bumeran Perú", "u5", "21/08/2026", "b-first", 3, 6, 1),
        ("Bumeran Perú", "u5", "22/08/2026", "b-last", 3, 7, 0)], cols)
    out = {r.url_oficial: r.titulo for r in refresh.refresh(prev, new, sc.sources_df(spark), "2026-08-22").collect()}
    assert out == {"u1": "prev-li", "u2": "new-in", "u4": "fresh", "u5": "b-last"}
    status = {r.fuente: r.status for r in refresh.source_status(sc.sources_df(spark), new).collect()}
    assert status["LinkedIn"] == "kept previous" and status["Indeed Perú"] == "updated"


def test_dedupe_first_and_last_and_topk(spark):
    df = spark.createDataFrame([(1, "u", 0, "a"), (1, "u", 1, "b"), (1, "v", 2, "c"), (2, "u", 0, "d")],
                               "page_id int, url string, card_pos int, v string")
    first = {(r.page_id, r.url): r.v for r in dedupe.first_wins(df, ["page_id", "url"], F.col("card_pos")).collect()}
    last = {(r.page_id, r.url): (r.v, r.first_pos) for r in dedupe.last_wins(df, ["page_id", "url"], F.col("card_pos")).collect()}
    assert first[(1, "u")] == "a" and last[(1, "u")] == ("b", 0)
    top = dedupe.top_k_per_group(df, ["page_id"], ["card_pos"], 2).collect()
    assert sorted((r.page_id, r.v) for r in top) == [(1, "a"), (1, "b"), (2, "d")]


def test_outbox_either_key_and_order(spark):
    df = spark.createDataFrame([
        ("1", "CAS-1", "10/08/2026", "30/08/2026", 0), ("2", "CAS-2", "12/08/2026", "30/08/2026", 1),
        ("3", "CAS-3", "", "30/08/2026", 2), ("4", "CAS-4", "12/08/2026", "30/08/2026", 3),
        ("5", "CAS-5", "12/08/2026", "01/08/2026", 4), ("6", "CAS-6", "11/08/2026", "x", 5)],
        "id string, numero_convocatoria string, fecha_inicio string, fecha_fin string, pos int")
    ledger = spark.createDataFrame([("1",), ("CAS-4",)], "token string")
    q = [r.id for r in outbox.pending(df, ledger, "2026-08-22").collect()]
    assert q == ["2", "6", "3"]
    msg = outbox.message(df.withColumn("titulo", F.lit("T")).withColumn("entidad", F.lit("E"))
                         .withColumn("ubicacion", F.lit("L")).withColumn("vacantes", F.lit("1"))
                         .withColumn("remuneracion", F.lit("")).withColumn("url_postulacion", F.lit(None).cast("string"))).first().message
    assert msg.startswith(fv.MESSAGE_HEADER) and "S/. \n" in msg and "Requisitos y enlace de postulación:" in msg


def test_search_and_collated_order(spark):
    df = spark.createDataFrame([("1", "Peña grande", "Muni", "MALA", 0), ("2", "Pena chica", "Otra", "ASIA", 1),
                                ("3", "Nube", "X", "MALA", 2), ("4", "ñandú", "X", "MALA", 3), ("5", "Oso", "X", "MALA", 4)],
                               "id string, titulo string, entidad string, distrito string, pos int")
    assert {r.id for r in search.search(df, text="PEÑA").collect()} == {"1", "2"}
    assert {r.id for r in search.search(df, text="pena", district="MALA").collect()} == {"1"}
    saved = spark.createDataFrame([("2",)], "id string")
    assert [r.id for r in search.search(df, saved=saved).collect()] == ["2"]
    order = [r.titulo for r in search.locale_order(df).collect()]
    assert order.index("Nube") < order.index("ñandú") < order.index("Oso")
    toggled = {r.id for r in search.toggle_saved(saved, spark.createDataFrame([("2",), ("3",)], "id string")).collect()}
    assert toggled == {"3"}


def test_audit_rules(spark):
    rows = [
        (1, "a", "Título", "", "Mala, Lima", "X", "1", "20/08/2026", "27/08/2026", "LinkedIn",
         "https://pe.linkedin.com/jobs/view/1", None),
        (2, "a", "Título", "E", "Mala", "X", "1", "01/01/2026", "08/01/2026", "Computrabajo Perú",
         "https://pe.computrabajo.com/empresas/x", "https://share.google/x"),
        (3, "c", "T", "E", "L", "X", "1", "xx", "", "linkedin", "https://pe.linkedin.com/jobs/view/2", None),
        (4, "d", "T", "E", "L", "X", "1", "01/01/2026", "", "SERVIR - Talento Perú", "https://example.com/x", None)]
    df = spark.createDataFrame(rows, "pos int, id string, titulo string, entidad string, ubicacion string, "
                               "numero_convocatoria string, vacantes string, fecha_inicio string, fecha_fin string, "
                               "fuente string, url_oficial string, url_postulacion string")
    v = {(r.pos, r.rule) for r in audit.row_violations(df, "2026-08-22").collect()}
    assert (1, "missing_fields") in v and (2, "duplicate_id") in v and (2, "age_out_of_window") in v
    assert (2, "not_individual_listing") in v and (2, "indirect_application_link") in v
    assert (3, "invalid_date") not in v          # the age rule matches the source name exactly
    assert (4, "not_official_source") in v and (3, "not_official_source") not in v
    diff = audit.name_diff(spark.createDataFrame([("a.html",), ("b.html",)], "name string"),
                           spark.createDataFrame([("b.html",), ("z.html",)], "name string"))
    assert {(r.name, r.status) for r in diff.collect()} == {("a.html", "missing"), ("b.html", "ok"), ("z.html", "obsolete")}
    rep = audit.obsolete_report(diff).first()
    assert rep.n_obsolete == 1 and rep.first_obsolete == "z.html"


def test_text_records_and_sections(spark):
    page = ("Listado\nAnalista de Datos\nMUNICIPALIDAD DE MALA\nUbicación: LIMA - CAÑETE - MALA Número de Convocatoria: "
            "CAS-7 Cantidad de Vacantes: 2 Remuneración: S/. 3000 Fecha Inicio de Publicación: 01/08/2026 "
            "Fecha Fin de Publicación: 15/08/2026\nX\nUbicación: LIMA Número de Convocatoria:  Cantidad de Vacantes: 1 "
            "Remuneración: 0 Fecha Inicio")
    df = spark.createDataFrame([(1, page)], "page_id long, text string")
    rec = extract.text_records(df).collect()
    assert len(rec) == 1
    r = rec[0]
    assert (r.titulo, r.entidad, r.departamento, r.provincia, r.distrito) == (
        "Analista de Datos", "MUNICIPALIDAD DE MALA", "LIMA", "CAÑETE", "MALA")
    assert (r.numero_convocatoria, r.vacantes, r.fecha_inicio, r.fecha_fin) == ("CAS-7", "2", "01/08/2026", "15/08/2026")
    heads = [head for _, head, _ in fv.DETAIL_SECTIONS]
    values = {head: f"valor {k} – ñ" for k, head in enumerate(heads)}
    values[heads[2]], values[heads[4]] = " - no aplica - ", ""
    body = " ".join(f"{h.lower() if k % 2 else h} \n {values[h]}" for k, h in enumerate(heads)) + " " + fv.DETAIL_SECTIONS[-1][2]
    s = extract.extract_sections(F.col("t"))
    row = spark.createDataFrame([(body + " 3 Nº 40321 y N° 12",)], "t string").select(
        *[s[k].alias(k) for k in s], extract.service_code(F.col("t")).alias("code")).first().asDict()
    want = {f: f"valor {k} – ñ" for k, (f, _, _) in enumerate(fv.DETAIL_SECTIONS)}
    want[fv.DETAIL_SECTIONS[2][0]] = want[fv.DETAIL_SECTIONS[4][0]] = None
    assert row == {**want, "code": "40321"}


def test_link_classification(spark):
    html = ('<a href="https://entidad.gob.pe/convocatoria">Postular</a><a href="/bases.pdf">Bases</a>'
            '<a href="https://app.servir.gob.pe/x">SERVIR</a><a href="https://otra.gob.pe/y">Otra</a>'
            '<a href="https://share.google/abc">Atajo</a><a href="mailto:a@b.c">Mail</a>')
    df = spark.createDataFrame([(1, "https://entidad.gob.pe/p/1", html)], "page_id long, url string, html string")
    out = extract.classify_links(extract.harvest_links(df, "page_id", "url", "html"), "page_id").first()
    assert out.url_postulacion == "https://entidad.gob.pe/convocatoria"
    assert out.url_consulta == "https://otra.gob.pe/y"
    assert [(d.titulo, d.url) for d in out.enlaces_bases] == [("Bases", "https://entidad.gob.pe/bases.pdf")]


def test_links_in_any_markup(spark):
    html = ("<!-- <a href='https://no.example.com/'>no</a> --><script>'<a href=\"/no\">'</script>"
            "<A HREF='/uno?a=1&amp;b=2'><b>Bases</b> del <i>con&amp;curso</i></A><a class=x href=dos>dos</a>"
            '<a name="here">sin enlace</a><a data-href="/no" title="a>b" href = "//tres.example.com/x">tres')
    df = spark.createDataFrame([(1, "https://e.example.com/p/", html), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: [(x.url, x.text) for x in r.links] for r in extract.harvest_links(df, "page_id", "url", "html").collect()}
    assert got == {1: [("https://e.example.com/uno?a=1&b=2", "Bases del con&curso"), ("https://e.example.com/p/dos", "dos"),
                       ("https://tres.example.com/x", "tres")], 2: []}


def test_rename_plan_matches_paths(spark):
    docs = spark.createDataFrame([("file:/r/x/a.tmp", ".tmp", ".docx"), ("file:/r/y/a.tmp", ".tmp", ".tmp"), ("file:/r/c.pdf", ".pdf", ".pdf")],
                                 "path string, ext string, doc_ext string")
    lst = spark.createDataFrame([("1", "x/a.tmp"), ("2", "./y/a.tmp"), ("3", "c.pdf"), ("4", "z/a.tmp"), ("5", None), ("6", "x/a.tmp")],
                                "id string, archivo_oficial string")
    got = {r.id: (r.archivo_oficial, r.renamed) for r in files.rename_plan(lst, docs).collect()}
    assert got == {"1": ("x/a.docx", True), "6": ("x/a.docx", True), "2": ("./y/a.tmp", False), "3": ("c.pdf", False),
                   "4": ("z/a.tmp", False), "5": (None, False)}


def test_detail_view_actions(spark):
    rows = [("1", "1", "22/07/2026", "31/07/2026", "SERVIR - Talento Perú", None, None, "3,000"),
            ("2", "2", "22/07/2026", "31/07/2026", "LinkedIn", "https://entidad.gob.pe/c", None, ""),
            ("3", "1", "22/07/2026", "31/07/2026", None, None, "https://share.google/IovzweaQemtlVGF9i", "S/. 10")]
    df = spark.createDataFrame(rows, "id string, vacantes string, fecha_inicio string, fecha_fin string, fuente string, "
                               "url_postulacion string, url_consulta string, remuneracion string")
    v = {r.id: r for r in views.detail_view(df).collect()}
    assert (v["1"].action_kind, v["2"].action_kind, v["3"].action_kind) == ("none", "direct", "portal")
    assert v["3"].certificate_notice and not v["1"].certificate_notice
    assert v["2"].date_label == "publication" and v["1"].date_text == "22/07/2026 — 31/07/2026"
    assert (v["1"].salary, v["2"].salary, v["3"].salary) == ("S/. 3,000", "No especificado", "S/. 10")
    assert v["2"].vacancy_label == "vacantes"


def test_global_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = sorted((r.k, r.row_no) for r in common.global_row_number(df.repartition(7), [F.col("k")]).collect())
    assert out == [(i, i + 1) for i in range(1000)]


def test_ledger_roundtrip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ledger.json")
    with open(p, "w", encoding="utf-8") as f:
        f.write('["b", "a", "b"]')
    assert sorted(r.token for r in files.read_ledger(spark, p).collect()) == ["a", "b"]
    assert files.read_ledger(spark, os.path.join(tmp_dir, "missing.json")).count() == 0
    out = os.path.join(tmp_dir, "ledger_table")
    files.write_ledger(search.ledger_add(files.read_ledger(spark, p), spark.createDataFrame([("c",)], "token string")), out)
    assert [r.token for r in files.read_ledger(spark, out, fmt="parquet").orderBy("token").collect()] == ["a", "b", "c"]


def test_document_sniffing(spark, tmp_dir):
    tmp_dir = os.path.join(tmp_dir, "docs")
    os.mkdir(tmp_dir)
    with open(os.path.join(tmp_dir, "a.tmp"), "wb") as f:
        f.write(b"PK\x03\x04rest")
    with open(os.path.join(tmp_dir, "b.tmp"), "wb") as f:
        f.write(b"plain")
    with open(os.path.join(tmp_dir, "c.pdf"), "wb") as f:
        f.write(b"%PDF")
    fp = {r.name: r for r in files.fingerprints(spark, tmp_dir).collect()}
    assert (fp["a.tmp"].doc_ext, fp["b.tmp"].doc_ext, fp["c.pdf"].doc_ext) == (".docx", ".tmp", ".pdf")
    assert len(fp["c.pdf"].version) == 10
    lst = spark.createDataFrame([("1", "docs/a.tmp"), ("2", "docs/c.pdf")], "id string, archivo_oficial string")
    plan = {r.id: r for r in files.rename_plan(lst, files.fingerprints(spark, tmp_dir)).collect()}
    assert plan["1"].archivo_oficial == "docs/a.docx" and plan["1"].renamed and not plan["2"].renamed
