"""Markup Column expressions: character references and attribute values."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _reference(ref: Column) -> Column:
    """The character of one reference; unknown ones stay as they are."""
    names = F.from_json(F.lit(json.dumps({n: chr(c) for n, c in html.entities.name2codepoint.items()} | {"apos": "'"})),
                        "map<string,string>")
    body = F.substring(ref, 2, 40)
    body = F.left(body, F.length(body) - 1)
    code = F.when(F.lower(F.left(body, F.lit(2))) == "#x", F.conv(F.substring(body, 3, 10), 16, 10)).when(
        body.startswith("#"), F.substring(body, 2, 10)).cast("int")
    fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(body.startswith("#"), F.when(fine, char).otherwise("�")).otherwise(
        F.coalesce(F.try_element_at(names, body), ref))


def decoded(c: Column) -> Column:
    """Named and numeric character references, each decoded once."""
    pieces = F.regexp_extract_all(c, F.lit("(?s)" + REFERENCE + "|[^&]++|&"), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(
        pieces, lambda x: F.when(x.rlike("^" + REFERENCE + "$"), _reference(x)).otherwise(x)), "")).otherwise(c)


def attribute(raw: Column, name: str) -> Column:
    """The decoded value of an attribute, '' without a value, NULL if absent."""
    lead = r"(?is)^(?:[^\"']|\"[^\"]*+\"|'[^']*+')*?"
    found = lead + rf"(?<=[\s\"'])(?:{name})(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)"
    value = F.concat(*[F.regexp_extract(raw, found, k) for k in (1, 2, 3)])
    return F.when(F.lower(raw).contains(name) & raw.rlike(found), decoded(value))
