"""Pages as a flat table of elements with start and end numbers, and the cards found in it.

Every page becomes rows (page, position, kind, tag, attributes, text).  Windows
over a page give each element the position where it ends, so that "inside" is a
range test: an end tag closes the nearest open element of its name, an element
that is never closed ends with the closed one around it, and a paragraph ends
at the next block, closed or not.  Scripts, styles, templates and comments hold
neither elements nor text.

Cards are elements (or links and their nearest accepted ancestors); what a card
shows is what lies between its start and its end: a slice of the page's texts,
which are numbered.  Rows are dealt to tasks by page, before they are saved and
after; windows, and the row per page that the cards are made of, need no join.  No page is parsed by
Python, and no task holds more than one page's rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.markup import attribute, decoded
from ..session import materialize

HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b.*?(?:</\1\s*>|\z)|<[!?][^>]*>"
TOKEN = r"(?s)</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"
# Fixed values of the markup language.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "b", "i", "em", "strong", "span", "small", "u", "font", "mark", "sub", "sup", "time", "label")
BLOCKS = ("p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "form", "header",
          "footer", "nav", "aside", "main", "blockquote", "pre")
LAST = 2 ** 31 - 1


def tokens(pages: DataFrame, html_col: str = "html", keep=()) -> DataFrame:
    """(keep..., page, pos, kind, tag, raw, text); kind is open, close, void or text."""
    source = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, " ")
    rows = pages.select(*keep, F.monotonically_increasing_id().alias("page"), source.alias("_html")).select(
        *keep, "page", F.posexplode(F.regexp_extract_all("_html", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    token, tag = F.col("token"), F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1))
    kind = F.when(token.startswith("</") & (tag != ""), "close").when(
        (tag != "") & token.endswith(">"), F.when(tag.isin(*VOID) | token.endswith("/>"), "void").otherwise("open")
    ).otherwise("text")
    rows = rows.select(*keep, "page", "pos", kind.alias("kind"), F.when(kind != "text", tag).alias("tag"),
                       F.when(kind.isin("open", "void"), F.regexp_extract("token", r"(?s)^<[A-Za-z][^\s/>]*(.*?)/?>$", 1))
                       .alias("raw"), F.when(kind == "text", tx.py_strip(decoded(token))).alias("text"))
    return rows.where((F.col("kind") != "text") | (F.col("text") != ""))


def with_ends(rows: DataFrame) -> DataFrame:
    """Adds ``n``, ``end`` and ``end_n``, without a shuffle if the rows lie by page.

    ``end`` is the position where an element ends (its own for void ones, NULL
    for other rows); ``n`` and ``end_n`` number the texts of the page before the
    row and before that position, so that a span of texts is a slice of them.
    """
    ahead = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.count(F.when(F.col("kind") == "text", 1)).over(ahead).cast("int"))
    here, last = F.struct("pos", "n"), F.struct(F.lit(LAST).alias("pos"), F.lit(LAST).alias("n"))
    tagged = Window.partitionBy("page", "tag").orderBy("pos")
    so_far, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    out = rows.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(tagged.rowsBetween(*so_far)))
    low = F.least(F.coalesce(F.min("_sum").over(tagged.rowsBetween(*earlier)), F.lit(0)), F.lit(0))
    out = out.withColumn("_before", F.col("_sum") - F.col("_step") - low)
    # the level of an element among those of its name; its end tag comes next on that level
    out = out.withColumn("_level", F.when(F.col("kind") == "open", F.col("_before") + 1).when(
        (F.col("kind") == "close") & (F.col("_before") > 0), F.col("_before")))
    level = Window.partitionBy("page", "tag", "_level").orderBy("pos")
    own = F.when((F.col("kind") == "open") & (F.lead("kind").over(level) == "close"), F.lead(here).over(level))
    closes = F.when((F.col("kind") == "close") & F.col("_level").isNotNull() & (F.lag("kind").over(level) == "open"), 1)
    out = out.withColumn("_own", F.when(F.col("_level").isNotNull(), own)).withColumn(
        "_closes", F.coalesce(closes, F.lit(0)))
    # how many closed elements are around a row, paragraphs apart
    page = Window.partitionBy("page").orderBy("pos")
    block = F.col("tag") != "p"
    opened = block & (F.col("kind") == "open") & F.col("_own").isNotNull()
    closed = block & (F.col("_closes") == 1)
    deep = F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(page.rowsBetween(*so_far))
    out = out.withColumn("_closed", F.coalesce(closed, F.lit(False))).withColumn(
        "_deep", deep + F.when(F.coalesce(closed, F.lit(False)), 1).otherwise(0))
    # what comes next is what came last, read backwards (a frame that grows costs one step a row)
    around = Window.partitionBy("page", "_deep").orderBy(F.desc("pos")).rowsBetween(*earlier)
    outer = F.last(F.when(F.col("_closed"), here), ignorenulls=True).over(around)
    edge = ((F.col("kind") == "open") & F.col("tag").isin(*BLOCKS)) | (
        (F.col("kind") == "close") & ~F.col("tag").isin(*INLINE))
    back = Window.partitionBy("page").orderBy(F.desc("pos")).rowsBetween(*earlier)
    following = F.last(F.when(edge, here), ignorenulls=True).over(back)
    out = out.withColumn("_outer", F.coalesce(outer, last)).withColumn("_edge", F.coalesce(following, last))
    end = F.when(F.col("kind") == "void", here).when(F.col("kind") == "open", F.when(
        F.col("tag") == "p", F.col("_edge")).otherwise(F.coalesce("_own", "_outer")))
    out = out.withColumn("_end", end)
    return out.withColumn("end", F.col("_end.pos")).withColumn("end_n", F.col("_end.n")).drop("_end").drop(*[c for c in out.columns if c.startswith("_")])


def within(mark: Column) -> Column:
    """Whether a row lies inside any element that ``mark`` holds for."""
    before = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(mark, F.col("end"))).over(before) > F.col("pos"), F.lit(False))


def innermost(rows: DataFrame, mark: str, name: str, value: Column | None = None) -> DataFrame:
    """Adds ``name``: the start of the nearest element around a row whose column ``mark`` is true (or its ``value``).

    A marked row is listed once more where it ends; on each level of nesting the
    last marked start before a row is the one around it.
    """
    value = F.col("pos") if value is None else value
    here, end = (F.struct(F.lit(k).alias("ends"), F.col(c).alias("at")) for k, c in ((0, "pos"), (1, "end")))
    # at one position ends come first, so that an element that starts there is outside
    events = rows.withColumn("_event", F.explode(F.when(F.col(mark), F.array(here, end)).otherwise(F.array(here))))
    ends = F.col("_event.ends")
    opens = (ends == 0) & F.coalesce(F.col(mark), F.lit(False))
    order = Window.partitionBy("page").orderBy("_event.at", F.desc("_event.ends")).rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.when(opens, 1).otherwise(0) - ends).over(order)
    events = events.withColumn("_around", level - F.when(opens, 1).otherwise(0)).withColumn(
        "_level", F.when(opens, F.col("_around") + 1).otherwise(F.col("_around")))
    # an opening row looks one level up, so it is listed on both
    listed = events.where(ends == 0).withColumn("_at", F.explode(F.when(
        opens, F.array("_level", "_around")).otherwise(F.array("_around"))))
    own = opens & (F.col("_at") == F.col("_level"))
    last = Window.partitionBy("page", "_at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(own, value), ignorenulls=True).over(last)
    return listed.withColumn(name, F.when(F.col("_around") > 0, found)).where(~own).drop(
        "_event", "_around", "_level", "_at")


ATTRIBUTES = {"href": "href", "title": "title", "class": "class", "testid": "data-testid", "jk": "data-jk"}


def page_table(pages: DataFrame, keep=(), html_col: str = "html", attributes: dict = ATTRIBUTES) -> DataFrame:
    """The saved rows of all pages, with the ``attributes`` and the paragraph that each text stands in (``para``).

    Pages are dealt whole; what follows here are sorts in place.  Saved rows are
    dealt by page once more where the cards are made.
    """
    rows = with_ends(tokens(pages, html_col, keep).repartition("page"))
    rows = rows.withColumns({c: attribute(F.col("raw"), name) for c, name in attributes.items()}).drop("raw")
    before = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_p = (F.col("tag") == "p") & F.col("end").isNotNull()
    para = F.last(F.when(is_p, F.struct("pos", "end")), ignorenulls=True).over(before)
    rows = rows.withColumn("_p", para).withColumn("para", F.when(F.col("_p.end") > F.col("pos"), F.col("_p.pos")))
    return materialize(rows.drop("_p"))


SHOWN = ("card_text", "paragraphs", "strings")
SPAN = ("pos", "end", "n", "end_n")


def _next(rows: DataFrame, marks: dict, *columns) -> DataFrame:
    """Adds a column per mark: the next row of the page (``SPAN`` and ``columns``) that it holds for.

    What comes next is what came last, read backwards: one sort for any number
    of cards, however deep they lie in each other.
    """
    back = Window.partitionBy("page").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.last(F.when(mark, F.struct(*SPAN, *columns)), ignorenulls=True).over(back)
                             for name, mark in marks.items()})


def _field_marks(fields: dict) -> dict:
    return {f"_at_{name}": mark & F.col("end").isNotNull() for name, mark in fields.items()}


def _texts() -> Column:
    """The texts of a page, in order (an aggregate)."""
    return F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text", "para"))))


def contents(rows: DataFrame, is_card: Column, columns: dict, fields, keep, shown) -> DataFrame:
    """What each card shows: a row per row of ``rows`` that ``is_card`` holds for.

    ``columns`` makes card, start, stop, from_n, to_n, link, link_end, link_n,
    link_to_n, href and link_title of it; ``_at_<field>`` holds the first element
    that fits the field, if it lies inside the card.  Texts are slices of the
    page's, so nested cards cost no more than what they show.
    """
    card = F.struct(*keep, *[c.alias(name) for name, c in columns.items()], *[f"_at_{f}" for f in fields])
    firsts = [F.min(F.when(mark, F.struct(*SPAN))).alias(f"_first{name}") for name, mark in _field_marks(fields).items()]
    pages = rows.groupBy("page").agg(_texts().alias("_texts"), F.collect_list(F.when(is_card, card)).alias("_cards"), *firsts)

    def show(c):
        def texts(low: Column, high: Column) -> Column:
            return F.slice("_texts", low + 1, F.greatest(F.least(high, c.to_n) - low, F.lit(0)))

        def joined(low: Column, high: Column) -> Column:
            return F.array_join(texts(low, high).getField("text"), " ")

        def field(name):
            at = F.when(c.start < 0, F.col(f"_first_at_{name}")).otherwise(c[f"_at_{name}"])
            return F.when(at.pos < c.stop, F.struct(F.lit(name).alias("key"), joined(at.n, at.end_n).alias("value")))

        found = F.array_compact(F.array(*[field(name) for name in fields])) if fields else None
        out = [*[c[k].alias(k) for k in keep], *[c[k].alias(k) for k in ("card", "link", "link_end", "href", "link_title")],
               F.when(c.link.isNotNull(), joined(c.link_n, c.link_to_n)).alias("link_text"),
               (F.when(F.size(found) > 0, F.map_from_entries(found)) if fields else F.lit(None).cast(
                   "map<string,string>")).alias("fields")]
        whole = texts(c.from_n, c.to_n)
        if "card_text" in shown:
            out.append(F.array_join(whole.getField("text"), " ").alias("card_text"))
        if "strings" in shown:
            out.append(whole.getField("text").alias("strings"))
        if "paragraphs" in shown:
            paras = F.array_distinct(F.filter(whole.getField("para"), lambda p: p > c.start))
            out.append(F.transform(paras, lambda p: F.array_join(F.filter(
                whole, lambda s: s.para == p).getField("text"), " ")).alias("paragraphs"))
        return F.struct(*out)

    return pages.select("page", F.inline(F.transform("_cards", show)))


def containers(rows: DataFrame, card: Column, link: Column, fields: dict, keep=(), shown=SHOWN) -> DataFrame:
    """Elements that ``card`` holds for, with the first element inside that is a ``link``.

    ``fields`` names conditions on elements; the first element inside the card
    that fits gives the field its text.  ``shown`` names what else of the card's
    text is wanted.
    """
    rows = _next(rows, _field_marks(fields))
    rows = _next(rows, {"_l": link}, "href", F.col("title").alias("link_title"))
    # a card without a link is no listing
    is_card = F.coalesce(card & (F.col("_l.pos") < F.col("end")), F.lit(False))
    return contents(rows, is_card, {
        "card": F.col("pos"), "start": F.col("pos"), "stop": F.col("end"), "from_n": F.col("n"), "to_n": F.col("end_n"),
        "link": F.col("_l.pos"), "link_end": F.col("_l.end"), "link_n": F.col("_l.n"), "link_to_n": F.col("_l.end_n"),
        "href": F.coalesce("_l.href", F.lit("")), "link_title": F.col("_l.link_title")}, fields, keep, shown)


def linked(rows: DataFrame, link: Column, ancestor: Column, fields: dict, keep=(), max_chars: int | None = None,
           pattern: str | None = None, shown=SHOWN) -> DataFrame:
    """Links, each with its nearest ancestor that ``ancestor`` holds for, or else its parent, as the card.

    With ``max_chars`` and ``pattern`` an ancestor must also show no more than
    so many characters (from running sums of the lengths) and match the pattern.
    """
    marked = rows.withColumn("_fits", F.coalesce(ancestor & F.col("end").isNotNull() & (F.col("kind") == "open"),
                                                 F.lit(False)))
    if max_chars is not None:
        marked = _short(marked, max_chars, pattern)
    marked = _next(marked, _field_marks(fields)).withColumn(
        "_any", (F.col("kind") == "open") & F.col("end").isNotNull()).withColumn("_link", F.coalesce(link, F.lit(False)))
    shell = F.struct(*SPAN, *[f"_at_{f}" for f in fields])
    around = innermost(innermost(marked, "_fits", "_near", shell).withColumn("_near", F.when(F.col("_link"), F.col("_near"))),
                       "_any", "_parent", shell)
    around = around.withColumn("_shell", F.when(F.col("_link"), F.coalesce("_near", "_parent"))).withColumns(
        {f"_at_{f}": F.col(f"_shell._at_{f}") for f in fields})
    # a link that no element surrounds has the whole page as its card
    return contents(around, F.col("_link"), {
        "card": F.col("pos"), "start": F.coalesce("_shell.pos", F.lit(-1)), "stop": F.coalesce("_shell.end", F.lit(LAST)),
        "from_n": F.coalesce("_shell.n", F.lit(0)), "to_n": F.coalesce("_shell.end_n", F.lit(LAST)),
        "link": F.col("pos"), "link_end": F.col("end"), "link_n": F.col("n"), "link_to_n": F.col("end_n"),
        "href": F.coalesce("href", F.lit("")), "link_title": F.col("title")}, fields, keep, shown)


def _short(rows: DataFrame, max_chars: int, pattern: str) -> DataFrame:
    """Keeps ``_fits`` for elements that show at most ``max_chars`` characters, the pattern among them."""
    page = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("kind") == "text", F.length(tx.clean(F.coalesce("text", F.lit("")))) + 1).otherwise(0)
    summed = rows.withColumn("_sum", F.sum(size).over(page))
    others = [c for c in rows.columns if c not in ("page", "_fits")]
    pages = summed.groupBy("page").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text", "_sum")))).alias("_texts"),
        F.collect_list(F.struct(*others, "_fits")).alias("_rows"))

    def said(r):
        some = F.slice("_texts", r.n + 1, F.least(r.end_n, F.size("_texts")) - r.n)
        return tx.clean(F.array_join(some.getField("text"), " "))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.get("_texts", n - 1).getField("_sum")).otherwise(0)

    def judged(r):
        last = F.least(r.end_n, F.size("_texts"))
        fits = F.when(r._fits & (last > r.n), F.when(
            upto(last) - upto(r.n) - 1 <= max_chars, said(r).rlike(pattern)).otherwise(False)).otherwise(False)
        return F.struct(*[r[c].alias(c) for c in others], F.coalesce(fits, F.lit(False)).alias("_fits"))

    return pages.select("page", F.inline(F.transform("_rows", judged)))
