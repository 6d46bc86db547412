"""Text Column expressions: whitespace cleaning, comparison keys, ids, slugs.

Every function takes and returns a ``Column``; nothing leaves the JVM.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_maps as um


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.lru_cache(maxsize=None)
def ws_class() -> str:
    return um.java_class(um.python_whitespace())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda over a Column).

    ``transform(array(v), x -> body(x))[1]``: the usual way to bind an
    intermediate result inside one Spark SQL expression, so an expensive value
    referenced several times is computed once even when the plan runs without
    common-subexpression elimination.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def truthy(c) -> Column:
    """Python truthiness of an optional string: present and non-empty."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def empty_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def clean(c) -> Column:
    """Collapse every whitespace run to one space and strip (no case/accent change)."""
    return F.btrim(collapse_ws(F.coalesce(_c(c), F.lit(""))), F.lit(" "))


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    w = ws_class()
    return F.regexp_replace(_c(c), "^" + w + "+|" + w + "+$", "")


def _expanded(s: Column, multi) -> Column:
    """Characters whose key has several letters, and Hangul syllables, written out.

    A text without any of them stays as it is.
    """
    table = F.from_json(F.lit(json.dumps(dict(multi))), "map<string,string>")
    syllable = "[\\x{%04X}-\\x{%04X}]" % (um.HANGUL_FIRST, um.HANGUL_LAST)
    jamo = F.from_json(F.lit(json.dumps([chr(c) for c in range(um.LEADS, um.TRAILS + um.N_TRAILS)])), "array<string>")

    def hangul(ch):
        def parts(n):
            trail = n % um.N_TRAILS
            lead = F.floor(n / (um.N_VOWELS * um.N_TRAILS)).cast("int")
            vowel = F.floor(n % (um.N_VOWELS * um.N_TRAILS) / um.N_TRAILS).cast("int")
            return F.concat(F.get(jamo, lead), F.get(jamo, vowel + (um.VOWELS - um.LEADS)),
                            F.when(trail > 0, F.get(jamo, trail + (um.TRAILS - um.LEADS))).otherwise(""))
        return let(F.ascii(ch) - um.HANGUL_FIRST, parts)

    def written(ch):
        return F.when(ch.rlike(syllable), hangul(ch)).otherwise(F.coalesce(F.try_element_at(table, ch), ch))

    def step(t):
        # each different character is looked up once; then all are put back in order.  They are picked by few ranges
        # that hold them all, as Java tests a text's every character against a class range by range
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(hull), F.lit(0)))
        some = F.filter(found, lambda c: c.rlike(any_of))
        return F.when(t.rlike(beyond), F.aggregate(some, t, lambda acc, c: F.replace(acc, c, written(c)))).otherwise(t)

    beyond = "[\\x{%04X}-\\x{10FFFF}]" % min(um.HANGUL_FIRST, *(ord(a) for a, _ in multi))
    any_of, hull = (um.java_class([a for a, _ in multi], gap)[:-1] + syllable[1:] for gap in (1, um.HULL_GAP))
    return let(s, step)


ASCII_SPACE = "[\\t-\\r\\x1C-\\x20]"


def _keyed(c, ascii_path, full_path) -> Column:
    """``ascii_path`` for texts of one byte a character, where it gives the same result as ``full_path``."""
    return let(F.coalesce(_c(c), F.lit("")),
               lambda t: F.when(F.octet_length(t) == F.char_length(t), ascii_path(t)).otherwise(full_path(t)))


@functools.lru_cache(maxsize=None)
def _collapse_pattern() -> str:
    """Any run of whitespace (replaced by one space)."""
    return um.java_class(um.python_whitespace()) + "+"


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), _collapse_pattern(), " ")


def _collapsed_ascii(t: Column) -> Column:
    return F.btrim(F.when(t.rlike("[\\t-\\r\\x1C-\\x1F]|  "), F.regexp_replace(t, ASCII_SPACE + "+", " ")).otherwise(t),
                   F.lit(" "))


def text_key(c) -> Column:
    """Comparison key: NFKD, combining marks dropped, whitespace collapsed, stripped, casefolded.

    Exact for every character of every plane; NULL and "" give "".
    """
    matching, replacement, multi = um.key_maps()
    return _keyed(c, lambda t: _collapsed_ascii(F.lower(t)),
                  lambda t: F.btrim(collapse_ws(_expanded(F.translate(t, matching, replacement), multi)), F.lit(" ")))


def search_key(c) -> Column:
    """Search normalization: NFD, U+0300-036F removed, lower case, JS-trimmed (no collapse).

    Marks outside U+0300-036F keep the order in which they were written.
    """
    matching, replacement, multi = um.search_maps()
    return _keyed(c, lambda s: F.btrim(F.lower(s), F.lit("\t\n\x0b\x0c\r ")),
                  lambda s: F.btrim(_expanded(F.translate(s, matching, replacement), multi), F.lit(um.js_trim_chars())))


def identity(entity, reference, title, location, code=None) -> Column:
    """struct(id, base_key, file_name): the four keys are computed once and shared by all three."""
    code = F.lit(None).cast("string") if code is None else _c(code)
    keys = F.struct(*[text_key(x).alias(n) for n, x in zip("ertl", (entity, reference, title, location))],
                    F.when(truthy(code), text_key(code)).alias("c"))

    def named(k):
        return F.struct(id_from_keys(k.e, k.r, k.t, k.l, k.c).alias("id"),
                        F.concat_ws("|", k.e, k.r, k.t, k.l).alias("base_key"), k.t.alias("title_key"))

    def filed(n):
        return F.struct(n.id.alias("id"), n.base_key.alias("base_key"),
                        F.concat(slug_from_key(F.concat(n.id, F.lit("-"), n.title_key)), F.lit(".html")).alias("file_name"))

    return let(let(keys, named), filed)


def stable_id(entity, reference, title, location, code=None) -> Column:
    """First 20 hex of SHA-256 over the keys; the code is a fifth part only when truthy."""
    code_key = None if code is None else F.when(truthy(code), text_key(code))
    return id_from_keys(text_key(entity), text_key(reference), text_key(title), text_key(location), code_key)


def id_from_keys(entity_k, reference_k, title_k, location_k, code_k=None) -> Column:
    """Stable id from already computed keys (``code_k`` NULL when the code is absent)."""
    parts = [entity_k, reference_k, title_k, location_k] + ([code_k] if code_k is not None else [])
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def base_key(entity, reference, title, location) -> Column:
    """The four-part identity without the service code (one string, '|' separated)."""
    return F.concat_ws("|", text_key(entity), text_key(reference), text_key(title), text_key(location))


def slugify(c, limit: int = 80) -> Column:
    return slug_from_key(text_key(c), limit)


def slug_from_key(k, limit: int = 80) -> Column:
    """Slug of an already computed key: non-alphanumerics as '-', cut, 'oferta' when empty."""
    s = F.substring(F.btrim(F.regexp_replace(_c(k), "[^a-z0-9]+", "-"), F.lit("-")), 1, limit)
    return F.coalesce(F.rtrim(F.nullif(s, F.lit("")), F.lit("-")), F.lit("oferta"))


def file_name(id_col, title) -> Column:
    """Detail file name: slug of ``<id>-<title>`` (the cut includes the id) + ``.html``."""
    return F.concat(slugify(F.concat(_c(id_col), F.lit("-"), F.coalesce(_c(title), F.lit("")))), F.lit(".html"))


def reference_code(prefix: str, url) -> Column:
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(_c(url), 256), 1, 10)))


def place_display(c, aliases: dict | None = None) -> Column:
    """Alias for ambiguous places, else Title Case."""
    c = _c(c)
    out = F.initcap(c)
    for k, v in (aliases or {}).items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def url_slug(c, aliases: dict | None = None) -> Column:
    """Place slug for search URLs: alias, else key with non-alphanumerics as '-'."""
    c = _c(c)
    out = F.btrim(F.regexp_replace(text_key(c), "[^a-z0-9]+", "-"), F.lit("-"))
    for k, v in (aliases or {}).items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def strip_trailing_blanks(c) -> Column:
    """Remove spaces/tabs that end a line."""
    return F.regexp_replace(_c(c), "[ \\t]+(?=\\n)", "")


def contains_any(c, words) -> Column:
    c = _c(c)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out
