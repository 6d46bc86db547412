"""Extraction: pages and texts -> listing rows.

Text layouts (record splitter, labelled sections, codes, page counters, link
classification) are pure Spark: regular expressions and higher-order array
functions evaluated inside the row that holds the text, so they need no
shuffle at all.  HTML cards need a tolerant HTML parser (the pages are not
well-formed, so ``xpath`` fails); a small ``mapInPandas`` tokenizer emits raw
card strings only, and every rule after it (URL, locality, age, dedupe, limit,
id) is Column code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import markup as mk
from ..functions import text as tx
from ..functions import urls as ur

_META = set("\\.^$|?*+()[]{}")


def rx_quote(s: str) -> str:
    """Escape regex metacharacters only (portable between Java and RE2)."""
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def _lines(c: Column) -> Column:
    """Non-blank, stripped lines of a text (split on '\\n' only)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: tx.py_strip(x)), lambda x: x != "")


def _last(arr: Column, n: int) -> Column:
    return F.when(F.size(arr) >= n, F.try_element_at(arr, F.lit(-n))).otherwise(F.lit(""))


# ------------------------------------------------------------ EXT-5 text records
def split_text_location(c: Column) -> dict:
    """Location split on ' - ' into department (whole text when no parts), province, district."""
    whole = tx.clean(c)
    parts = F.filter(F.transform(F.split(whole, " - "), lambda x: tx.py_strip(x)), lambda x: x != "")
    return {
        "department": F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(1))).otherwise(whole),
        "province": F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")),
        "district": F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")),
    }


def _field(block: Column, pattern: str) -> Column:
    return tx.clean(F.regexp_extract(block, "(?s)" + pattern, 1))


def text_records(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """Split page text at the location label; title/entity are the last two non-blank
    lines of the *previous* block.  The previous block is read by array index in the
    same row (no window, no shuffle)."""
    blocks = F.split(F.coalesce(F.col(text_col), F.lit("")), fv.TEXT_RECORD_MARKER)
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(blocks), F.lit(2))),
                        lambda i: F.struct(i.alias("i"), F.try_element_at(blocks, i - 1).alias("prev"),
                                           F.try_element_at(blocks, i).alias("cur")))
    x = pages.select(id_col, F.posexplode(pairs).alias("block_pos", "b")).where(F.col("b.cur").isNotNull())
    prev_lines = _lines(F.col("b.prev"))
    cur = F.col("b.cur")
    loc = split_text_location(F.regexp_extract(cur, "(?s)" + fv.TEXT_FIELDS[0][1], 1))
    out = x.select(
        id_col, F.col("block_pos").cast("int").alias("card_pos"),
        _last(prev_lines, 2).alias("titulo"), _last(prev_lines, 1).alias("entidad"),
        *[_field(cur, pat).alias(name) for name, pat in fv.TEXT_FIELDS],
        loc["department"].alias("departamento"), loc["province"].alias("provincia"), loc["district"].alias("distrito"),
        F.regexp_extract(cur, fv.TEXT_START_DATE, 1).alias("fecha_inicio"),
        F.regexp_extract(cur, fv.TEXT_END_DATE, 1).alias("fecha_fin"),
        F.lit(fv.SOURCE_OFFICIAL).alias("fuente"), F.lit(fv.OFFICIAL_URL).alias("url_oficial"))
    return out.where((F.length("titulo") > 3) & tx.truthy("numero_convocatoria"))


def previous_block_fields(df: DataFrame, part: str, pos: str, text: str) -> DataFrame:
    """For blocks stored one per row (consecutive positions), title/entity from the previous row.

    A self equi-join on ``(part, pos - 1)`` instead of ``lag`` over ``part``: the
    join key is the pair, so a huge ``part`` is spread over many tasks.
    """
    prev = df.select(F.col(part).alias("_p"), (F.col(pos) + 1).alias("_q"), _lines(F.col(text)).alias("_lines"))
    j = df.join(prev, (df[part] == prev["_p"]) & (df[pos] == prev["_q"]))
    return j.select(*[df[c] for c in df.columns], _last(F.col("_lines"), 2).alias("title"),
                    _last(F.col("_lines"), 1).alias("entity"))


# ------------------------------------------------------------ EXT-6/7/10
def extract_sections(c: Column, sections=None) -> dict:
    """Each field between its own header and the specific next header (case-insensitive,
    shortest); ' -' stripped; empty and 'NO APLICA' dropped (NULL)."""
    sections = sections or fv.DETAIL_SECTIONS
    t = tx.clean(c)
    out = {}
    for field, begin, end in sections:
        pat = "(?iu)" + rx_quote(begin) + r"\s*(.*?)\s*" + rx_quote(end)
        v = F.regexp_replace(F.regexp_extract(t, pat, 1), "^[ -]+|[ -]+$", "")
        out[field] = F.when((v != "") & (F.upper(v) != fv.NOT_APPLICABLE), v)
    return out


def service_code(c: Column) -> Column:
    v = F.regexp_extract(F.coalesce(c, F.lit("")), "(?i)" + fv.SERVICE_CODE_PATTERN, 1)
    return F.nullif(v, F.lit(""))


def page_counter(c: Column) -> dict:
    cur = F.regexp_extract(F.coalesce(c, F.lit("")), fv.PAGE_COUNTER_PATTERN, 1)
    tot = F.regexp_extract(F.coalesce(c, F.lit("")), fv.PAGE_COUNTER_PATTERN, 2)
    return {"current": cur.try_cast("int"), "total": tot.try_cast("int")}


def crawl_completeness(pages: DataFrame, crawl_col: str, text_col: str) -> DataFrame:
    """Per crawl: highest page seen vs announced total; incomplete crawls must not be saved."""
    pc = page_counter(F.col(text_col))
    agg = pages.groupBy(crawl_col).agg(F.max(pc["current"]).alias("max_page"), F.max(pc["total"]).alias("total_pages"))
    return agg.withColumn("complete", F.coalesce(F.col("max_page") >= F.col("total_pages"), F.lit(True)))


def blocked_pages(pages: DataFrame, host_col: str, html_col: str, words) -> DataFrame:
    """Per host: pages, and pages that show the block word of their source.

    ``words``: (host suffix, word) pairs, one per source; other hosts are never blocked.
    """
    html, hit = F.lower(F.coalesce(F.col(html_col), F.lit(""))), F.lit(False)
    for suffix, word in words:
        hit = hit | (F.col(host_col).endswith(suffix) & html.contains(word))
    return pages.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(hit).alias("n_blocked"))


# ------------------------------------------------------------ EXT-8/9 links
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\z)"
ANCHOR = r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?=</a\s*>|<a\s|\z)"
HREF = r"(?is)^<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
OPENING = r"(?is)^<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
def harvest_links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per page with its links as an ordered array of (pos, url, text); hrefs resolved
    against the page URL.  Comments and scripts hold no links; the text is what the anchor
    shows, without inner tags; names in any case, values in any quotes."""
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, " ")
    anchors = F.filter(F.regexp_extract_all(html, F.lit(ANCHOR), 0), lambda a: a.rlike(HREF))
    base = F.col(url_col)

    def link(a, i):
        href = F.concat(*[F.regexp_extract(a, HREF, k) for k in (1, 2, 3)])
        text = F.regexp_replace(F.regexp_replace(a, OPENING, ""), r"(?s)<[^>]*>", "")
        return F.struct(i.alias("pos"), ur.join(base, tx.py_strip(mk.decoded(href))).alias("url"),
                        tx.clean(mk.decoded(text)).alias("text"))

    return pages.select(id_col, F.transform(anchors, link).alias("links"))


def classify_links(df: DataFrame, id_col: str, links_col: str = "links") -> DataFrame:
    """Per page (in-row, no shuffle): skip non-http / host-less / own-portal links; document-like
    links -> ``documents``; first direct link -> ``url_postulacion``; the first other link
    (a second direct one included) -> ``url_consulta``."""
    links = F.col(links_col)
    eligible = F.filter(links, lambda x: ur.is_http(x["url"]) & ~ur.host(x["url"]).endswith(fv.OFFICIAL_HOST_SUFFIX))
    tagged = F.transform(eligible, lambda x: F.struct(
        x["pos"].alias("pos"), x["url"].alias("url"), x["text"].alias("text"),
        ur.is_document_link(x["url"], x["text"]).alias("doc"), ur.is_direct_link(x["url"]).alias("direct")))
    docs = F.filter(tagged, lambda x: x["doc"])
    other = F.filter(tagged, lambda x: ~x["doc"])
    direct = F.try_element_at(F.filter(other, lambda x: x["direct"]), F.lit(1))
    consult = F.try_element_at(
        F.filter(other, lambda x: F.coalesce(x["pos"] != direct["pos"], F.lit(True))), F.lit(1))
    documents = F.transform(docs, lambda x: F.struct(
        F.when(x["text"] != "", x["text"]).otherwise(F.lit(fv.DEFAULT_DOC_TITLE)).alias("titulo"), x["url"].alias("url")))
    return df.select(
        id_col, F.size(tagged).cast("bigint").alias("n_links"), F.size(docs).cast("bigint").alias("n_documents"),
        documents.alias("enlaces_bases"), direct["url"].alias("url_postulacion"), consult["url"].alias("url_consulta"))


# ------------------------------------------------------------ generic article cards
def article_cards(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Generic ``article`` cards of a page table: title (first h1..h3), paragraphs, visible characters.

    Articles do not nest here; an article that is not closed ends with the page.
    """
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, " ")
    found = F.regexp_extract_all(html, F.lit(r"(?is)<article\b.*?(?:</article\s*>|\z)"), 0)
    cards = pages.select(id_col, F.posexplode(found).alias("card_pos", "card"))
    title = F.regexp_extract("card", r"(?is)<(h[1-3])\b[^>]*>(.*?)</\1\s*>", 2)

    def visible(c):
        return tx.clean(mk.decoded(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))

    return cards.select(
        id_col, "card_pos", visible(title).alias("title"),
        F.regexp_count("card", F.lit(r"(?i)<p[\s>]")).cast("bigint").alias("n_paragraphs"),
        F.char_length(visible(F.col("card"))).cast("bigint").alias("card_chars"))
