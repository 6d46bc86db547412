import datetime as dt
from urllib.parse import parse_qs, urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow import fixed_values as fv
from noticeflow.functions import dates, text, urls
from noticeflow.functions import unicode_maps as um
from tests.keys import plain_key

ANY = st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=12)
LATIN = st.text(alphabet=st.characters(min_codepoint=0x09, max_codepoint=0x24F), max_size=40)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ANY, min_size=100, max_size=100), st.lists(LATIN, min_size=50, max_size=50))
def test_text_key_matches_unicodedata(spark, samples, latin):
    samples = samples + latin + ["Straße ﬁne", "ǅemal", "Ｆｕｌｌ　width", "Ⅻ ½ …", "  Técnico/a  EN GESTIÓN III ",
                                 "한국어 텍스트 각", "ﷺ ﻼ ㎏ ㍿", "𝒜𝓑 𝟘𝟙 🄰", "a\x1cb\x85c\u3000d", "İı ŉ ΐ"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.k for r in df.select(text.text_key("s").alias("k")).collect()]
    assert got == [plain_key(s) for s in samples]


def test_text_key_of_every_assigned_character(spark):
    every = um._all()
    rows = ["x".join(every[i:i + 300]) for i in range(0, len(every), 300)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    bad = [r.i for r in df.select("i", text.text_key("s").alias("k")).collect() if r.k != plain_key(rows[r.i])]
    assert bad == []


def test_identity_shares_its_keys(spark):
    df = spark.createDataFrame([("Óptica", "R 1", "  Vendedor/a ", "Lima", c) for c in (None, "", "N7")],
                               "e string, r string, t string, l string, c string")
    one = text.identity("e", "r", "t", "l", "c")
    rows = df.select(one.alias("n"), text.stable_id("e", "r", "t", "l", F.col("c")).alias("i"),
                     text.base_key("e", "r", "t", "l").alias("b"),
                     text.file_name(one["id"], "t").alias("f")).select("n.*", "i", "b", "f").collect()
    assert all((r.id, r.base_key, r.file_name) == (r.i, r.b, r.f) for r in rows)
    assert rows[0].id == rows[1].id != rows[2].id


def test_text_key_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",)], "s string")
    assert [r.k for r in df.select(text.text_key("s").alias("k")).collect()] == ["", "", ""]


def test_search_key_folds_accents_and_tilde(spark):
    df = spark.createDataFrame([("  Peña CAÑETE Zúñiga ",)], "s string")
    assert df.select(text.search_key("s")).first()[0] == "pena canete zuniga"


def test_slug_and_file_name(spark):
    df = spark.createDataFrame([("k7", "¿Ñandú & Pingüino? (2)"), ("x" * 90, "y"), ("", ""), ("z" * 79, "q")], "i string, t string")
    rows = df.select(text.slugify("t").alias("s"), text.file_name("i", "t").alias("f")).collect()
    assert rows[0].s == "nandu-pinguino-2" and rows[0].f == "k7-nandu-pinguino-2.html"
    assert rows[1].f == "x" * 80 + ".html" and rows[3].f == "z" * 79 + ".html"
    assert rows[2].s == "oferta"


URLS = ["/lista/x-ABC#frag", "https://a.example.com/jobs/view/op-1?position=1", "//cdn.x.com/a?b",
        "?q=1", "x/y/../z", "/a/./b/../c", "HTTPS://Pe.LinkedIn.com:443/jobs/view/9/", "https://u@Host.com:80/p;par?jk=1#f",
        "http://a b_c.com/x", "", "jk", "/rc/clk?jk=ABC123&from=x", "/viewjob?jk=&jk=Z%20Y", "mailto:x@y.z",
        "../../up", "a//b/c", "https://pe.indeed.com/a//b/./c/.."]


def test_url_join_and_parts_match_urllib(spark):
    for base in ["https://pe.computrabajo.com", "http://blog.x.example.net/en/960", "https://x.com/a/b/"]:
        df = spark.createDataFrame([(u,) for u in URLS], "u string")
        got = [r.j for r in df.select(urls.join(F.lit(base), "u").alias("j")).collect()]
        assert got == [urljoin(base, u) for u in URLS]
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    rows = df.select(urls.scheme("u"), urls.host("u"), urls.path("u"), urls.query("u"), urls.key_param("u", "jk")).collect()
    for u, r in zip(URLS, rows):
        p = urlparse(u)
        assert tuple(r) == (p.scheme, p.hostname or "", p.path, p.query, parse_qs(p.query).get("jk", [""])[0]), u


def test_url_predicates(spark):
    """Each rule on the host itself, a subdomain, a look-alike, another scheme and no host."""
    official = fv.OFFICIAL_DOMAINS[0]
    blocked, (pair_host, pair_path) = fv.BLOCKED_APPLICATION_DOMAINS[0], fv.BLOCKED_DIRECT_PAIRS[0]
    short = fv.BLOCKED_DIRECT_HOSTS[0]
    cases = [
        (f"https://{official}/a", True, True, True), (f"http://x.y.{official}", True, True, True),
        (f"https://x{official}/a", False, True, True), (f"https://{official}.example.com/a", False, True, True),
        (f"https://{blocked}/z", False, False, True), (f"https://www.{blocked}/z", False, False, True),
        (f"https://my{blocked}/z", False, True, True),
        (f"https://{pair_host}{pair_path}/", False, True, False), (f"https://{pair_host}{pair_path}/more", False, True, True),
        (f"https://{short}/q", False, True, False), (f"ftp://x.{official}/a", True, False, False),
        ("mailto:a@b.example", False, False, False), ("", False, False, False),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "u string")
    rows = df.select(urls.is_official("u"), urls.is_valid_application("u"), urls.is_direct_link("u")).collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in cases]


def test_age_days_and_recency(spark):
    """The vocabulary in every unit, at 0, 7 and 8 days, with and without accents and case."""
    cases = [(f"hace {n} {unit}", n * days, n * days <= 7) for unit, days in (("día", 1), ("DIAS", 1), ("semana", 7), ("Semanas", 7))
             for n in (0, 1, 7, 8)]
    cases += [(f"{w} publicada", 0, True) for w in ("HOY", "hace 5 minutos,", "hace una hora,", "recién")]
    cases += [("AYER", 1, True), ("más de 2 días", None, False), ("hace 2 meses", None, False), ("mañana", None, False),
              ("", None, False), (None, None, False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "a string")
    rows = df.select(dates.age_days("a"), dates.is_recent("a")).collect()
    assert [(r[0], bool(r[1])) for r in rows] == [c[1:] for c in cases]


def test_parse_dmy_matches_strptime(spark):
    texts = ["1/8/2026", "31/02/2026", "01/08/26", " 1/08/2026", " 01/08/2026", "", "22/07/2026", "22/07/2026 ",
             "0/1/2026", "29/02/2028", "12/13/2026", "01/01/0000", "\x011/1/2026", "2026-01-02"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r[0] for r in df.select(dates.parse_dmy("d")).collect()]

    def ref(t):
        try:
            return dt.datetime.strptime(t, "%d/%m/%Y").date()
        except ValueError:
            return None
    assert got == [ref(t) for t in texts]


def test_expiry_and_still_open(spark):
    df = spark.createDataFrame([("28/02/2027",), ("01/03/2027",), ("02/03/2027",), (None,), ("soon",), ("\t28/02/2027 ",)], "f string")
    rows = df.select(dates.not_expired("f", "2027-03-01"), dates.still_open("f", "2027-03-01")).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, True), (True, True), (True, True), (True, True), (False, True)]
