"""URL Column expressions: split, join, canonical forms and predicates.

``parse_url`` throws on bad input and ``try_parse_url`` rejects hosts with
spaces or underscores, whereas the behaviour to match is lenient.  URLs are
therefore split with the RFC 3986 appendix-B regular expression; host = netloc
without user-info and port, lower-cased; the path loses ``;params`` of its last
segment.  All of it is plain JVM string code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import _c, let, py_strip

URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def prepare(u) -> Column:
    """Leading C0/space removed, tab/CR/LF removed anywhere (as urlsplit does)."""
    u = F.coalesce(_c(u), F.lit(""))
    u = F.regexp_replace(u, r"^[\x00-\x20]+", "")
    return F.regexp_replace(u, r"[\t\r\n]", "")


def _group(u: Column, i: int) -> Column:
    return F.regexp_extract(u, URL_PATTERN, i)


def scheme(u) -> Column:
    return F.lower(_group(prepare(u), 1))


def has_netloc(u) -> Column:
    return prepare(u).rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")


def netloc(u) -> Column:
    return _group(prepare(u), 2)


def host_of_netloc(n: Column) -> Column:
    h = F.regexp_replace(n, r"^.*@", "")
    h = F.regexp_replace(h, r":.*$", "")
    return F.lower(h)


def host(u) -> Column:
    return host_of_netloc(netloc(u))


def raw_path(u) -> Column:
    return _group(prepare(u), 3)


def path(u) -> Column:
    return F.regexp_replace(raw_path(u), r";[^/]*$", "")


def params(u) -> Column:
    return F.regexp_extract(raw_path(u), r";([^/]*)$", 1)


def query(u) -> Column:
    return _group(prepare(u), 4)


def fragment(u) -> Column:
    return _group(prepare(u), 5)


def parts(u) -> Column:
    """All components at once: struct(scheme, netloc, host, path, params, query, fragment).

    The URL is prepared and split once (bound with ``let``), so predicates that
    look at several components do not re-run the regular expressions.
    """
    def split(p):
        n = _group(p, 2)
        rp = _group(p, 3)
        return F.struct(
            F.lower(_group(p, 1)).alias("scheme"), n.alias("netloc"), host_of_netloc(n).alias("host"),
            F.regexp_replace(rp, r";[^/]*$", "").alias("path"),
            F.regexp_extract(rp, r";([^/]*)$", 1).alias("params"),
            _group(p, 4).alias("query"), _group(p, 5).alias("fragment"))
    return let(prepare(u), split)


def without_fragment(u) -> Column:
    return F.regexp_replace(_c(u), "#.*$", "")


def _resolve_dots(segs: Column) -> Column:
    """Remove '.' and '..' segments (a '..' pops the previous segment, if any)."""
    acc0 = F.array().cast("array<string>")

    def step(acc, s):
        return (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(s == ".", acc)
                .otherwise(F.concat(acc, F.array(s))))

    resolved = F.aggregate(segs, acc0, step)
    last = F.try_element_at(segs, F.lit(-1))
    return F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)


DOTS = r"(?:^|/)\.\.?(?:/|$)"


def _merged(base_path: Column, path_: Column) -> Column:
    """The path of a link that has one, on top of the base's; dots are resolved only where there are any."""
    def relative(folder):
        def squeezed(all_):
            n = F.size(all_)
            return F.when(n <= 2, all_).otherwise(F.concat(
                F.slice(all_, 1, 1), F.filter(F.slice(all_, 2, n - 2), lambda x: x != ""), F.slice(all_, -1, 1)))
        return let(F.concat(F.when(F.try_element_at(folder, F.lit(-1)) != "", F.slice(folder, 1, F.size(folder) - 1))
                            .otherwise(folder), F.split(path_, "/")), squeezed)

    whole = F.when(path_.startswith("/"), path_).otherwise(
        F.array_join(let(F.split(base_path, "/"), relative), "/"))
    return let(whole, lambda p: F.when(p.rlike(DOTS), F.array_join(let(F.split(p, "/"), _resolve_dots), "/")).otherwise(p))


def join(base, href) -> Column:
    """Resolve ``href`` against ``base`` the way ``urllib.parse.urljoin`` does (http/https bases).

    Both are split once; a constant base is split when the plan is made.
    """
    base, href = _c(base), _c(href)
    raw = prepare(href)
    x = F.struct(base.alias("base"), href.alias("href"), raw.alias("raw"), parts(base).alias("b"), parts(href).alias("h"),
                 raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:").alias("has_scheme"), has_netloc(href).alias("has_netloc"))

    def resolved(x):
        b, h, own = x.b, x.h, x.has_netloc
        no_path = (h.path == "") & (h.params == "")
        path_ = F.when(own, h.path).when(no_path, b.path).otherwise(let(
            _merged(b.path, h.path), lambda p: F.when(p == "", F.lit("/")).otherwise(p)))
        params_ = F.when(own | ~no_path, h.params).otherwise(b.params)
        query_ = F.when(~own & no_path & (h.query == ""), b.query).otherwise(h.query)
        tail = let(F.concat(path_, F.when(params_ != "", F.concat(F.lit(";"), params_)).otherwise(F.lit(""))),
                   lambda p: F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p))
        rebuilt = F.concat(
            F.when(x.has_scheme, h.scheme).otherwise(b.scheme), F.lit("://"), F.when(own, h.netloc).otherwise(b.netloc), tail,
            let(query_, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))),
            F.when(h.fragment != "", F.concat(F.lit("#"), h.fragment)).otherwise(F.lit("")))
        return (F.when(x.raw == "", x.base)
                .when(F.coalesce(x.base, F.lit("")) == "", x.href)
                .when(x.has_scheme & (h.scheme != b.scheme), x.href)
                .otherwise(rebuilt))

    return let(x, resolved)


def path_only(u) -> Column:
    """``scheme://netloc/path`` (query and fragment dropped)."""
    return let(parts(u), lambda P: F.concat(P.scheme, F.lit("://"), P.netloc, P.path))


def canonical_path_url(href, base: str, host_name: str, path_prefix: str,
                       path_suffix: str | None = None, strip_slash: bool = False) -> Column:
    """Individual-listing URL with host/path allow rule, else ''."""
    def rule(P):
        ok = (P.host == host_name) & P.path.startswith(path_prefix)
        if path_suffix:
            ok = ok & P.path.endswith(path_suffix)
        out = F.concat(P.scheme, F.lit("://"), P.netloc, P.path)
        if strip_slash:
            out = F.regexp_replace(out, "/+$", "")
        return F.when(ok, out).otherwise(F.lit(""))

    return let(parts(join(F.lit(base), href)), rule)


def key_param(u, name: str) -> Column:
    """First non-blank value of query parameter ``name`` (decoded), else ''."""
    def value(raw):
        return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")), F.lit(""))

    hit = F.filter(F.split(query(u), "&"), lambda x: x.startswith(name + "=") & (F.length(x) > len(name) + 1))
    return let(F.substring(F.try_element_at(hit, F.lit(1)), len(name) + 2, 1 << 30), value)


def key_param_url(href, base: str, name: str = "jk", path_str: str = "/viewjob") -> Column:
    return let(key_param(join(F.lit(base), href), name), lambda code: F.when(
        code != "", F.concat(F.lit(base + path_str + "?" + name + "="), code)).otherwise(F.lit("")))


def _http(P) -> Column:
    return P["scheme"].isin("http", "https") & (P["host"] != "")


def is_http(u) -> Column:
    return let(parts(u), _http)


def is_direct_link(u) -> Column:
    """A specific application page: http(s), a host, not a blocked host or (host, path) pair."""
    def rule(P):
        h = P["host"]
        p = F.regexp_replace(P["path"], "/+$", "")
        ok = _http(P) & ~h.isin(*fv.BLOCKED_DIRECT_HOSTS)
        for bh, bp in fv.BLOCKED_DIRECT_PAIRS:
            ok = ok & ~((h == bh) & (p == bp))
        return ok
    return let(parts(py_strip(F.coalesce(_c(u), F.lit("")))), rule)


def under_domains(h: Column, domains) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def is_official(u, domains=fv.OFFICIAL_DOMAINS) -> Column:
    return under_domains(host(u), domains)


def is_valid_application(u, blocked=fv.BLOCKED_APPLICATION_DOMAINS) -> Column:
    return let(parts(u), lambda P: _http(P) & ~under_domains(P["host"], blocked))


def is_individual_listing(source, u) -> Column:
    """Per-portal individual-listing rule (source compared case-insensitively).

    NULL for sources without a portal rule.
    """
    src = F.lower(F.coalesce(_c(source), F.lit("")))

    def rule(P):
        h, p, q = P["host"], P["path"], P["query"]
        return (
            F.when(src == fv.SOURCE_COMPUTRABAJO.lower(),
                   (h == fv.HOST_COMPUTRABAJO) & p.contains("/ofertas-de-trabajo/"))
            .when(src == fv.SOURCE_INDEED.lower(),
                  (h == fv.HOST_INDEED) & (p == "/viewjob") & q.contains("jk="))
            .when(src == fv.SOURCE_LINKEDIN.lower(),
                  (h == fv.HOST_LINKEDIN) & p.startswith("/jobs/view/"))
            .when(src == fv.SOURCE_BUMERAN.lower(),
                  (h == fv.HOST_BUMERAN) & p.startswith("/empleos/") & p.endswith(".html"))
        )
    return let(parts(u), rule)


def is_document_link(url, text) -> Column:
    """Document-like link: office/pdf extension, or a base/annex/schedule word."""
    t = F.lower(F.concat_ws(" ", F.coalesce(_c(url), F.lit("")), F.coalesce(_c(text), F.lit(""))))
    out = t.rlike(fv.DOC_EXTENSION_PATTERN)
    for w in fv.DOC_WORDS:
        out = out | t.contains(w)
    return out
