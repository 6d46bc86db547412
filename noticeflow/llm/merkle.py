"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

Leaves are paragraphs (lines, long ones in pieces of ``PIECE`` code points);
``SECTION`` leaves make a section; the root hashes the section hashes.  The
fingerprint writes the whole tree, ``root/sections/leaves``: equal roots mean
equal texts, and differing branches say where texts differ.

Defined results: NULL text is empty; an empty text has a root and no leaves;
equal texts have equal fingerprints and likeness 1; NULL ids come last in the
order of documents, repeated ids in the order of their texts; a lone document
is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import partitions

PIECE = 32
SECTION = 16
DIGITS = 8


def paragraphs(text: Column) -> Column:
    """The leaves' texts; joined, they are the text again."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}\n?|\n"), F.lit(0))


def fingerprint(text: Column) -> Column:
    leaves = F.transform(paragraphs(text), lambda p: F.substring(F.sha2(p, 256), 1, DIGITS))
    tree = F.transform(F.array(leaves), lambda ls: F.struct(ls.alias("leaves"), F.when(
        F.size(ls) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / SECTION).cast("int")),
                                    lambda i: F.substring(F.sha2(F.concat_ws(".", F.slice(
                                        ls, i * SECTION + 1, SECTION)), 256), 1, DIGITS))).otherwise(
        F.array().cast("array<string>")).alias("sections")))
    # a root over truncated hashes would not tell all texts apart: it takes the text's own digest as well
    whole = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.element_at(F.transform(tree, lambda t: F.concat_ws(
        "/", F.sha2(F.concat_ws(".", whole, F.concat_ws(".", t.sections)), 256),
        F.concat_ws(".", t.sections), F.concat_ws(".", t.leaves))), 1)


def _part(print_: Column, n: int) -> Column:
    return F.filter(F.split(F.element_at(F.split(print_, "/"), n), r"\."), lambda x: x != "")


def _same(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal leaves (0 to 1): in place, or as sets where text has moved; 1 for equal roots."""
    pair = F.array(F.struct(_part(a, 3).alias("x"), _part(b, 3).alias("y")))
    score = F.element_at(F.transform(pair, lambda p: F.greatest(
        _same(p.x, p.y) / F.greatest(F.size(p.x), F.size(p.y), F.lit(1)),
        F.size(F.array_intersect(p.x, p.y)) / F.greatest(
            F.size(F.array_distinct(p.x)), F.size(F.array_distinct(p.y)), F.lit(1)))), 1)
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), F.lit(1.0)).otherwise(
        score.cast("double"))


def edits(a: Column, b: Column) -> Column:
    """The numbers (from 0) of the leaves that differ, found only below sections that differ."""
    def all_of(p):
        n = F.greatest(F.size(p.s), F.size(p.t))
        section = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.get(
            p.s, i - 1).eqNullSafe(F.get(p.t, i - 1)))
        leaf = F.flatten(F.transform(section, lambda i: F.sequence((i - 1) * SECTION, i * SECTION - 1)))
        return F.filter(leaf, lambda k: ~F.get(p.x, k).eqNullSafe(F.get(p.y, k)))

    pair = F.array(F.struct(_part(a, 2).alias("s"), _part(b, 2).alias("t"),
                            _part(a, 3).alias("x"), _part(b, 3).alias("y")))
    return F.element_at(F.transform(pair, all_of), 1)


def _range_number(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are <= key, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[i:i + step] for i in range(0, len(cuts), step)]
    upto = F.size(F.filter(F.lit(coarse), lambda c: c <= key))
    inner = F.element_at(F.array(*[F.lit(f) for f in fine]), F.greatest(upto, F.lit(1)))
    return F.when(upto == 0, F.lit(0)).otherwise(
        (upto - 1) * step + F.size(F.filter(inner, lambda c: c <= key)))


def with_next(docs: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """Each row with ``next_<column>`` of the following row by ``key`` (after the last: the first).

    Rows are dealt into ranges of the key; the first row of each range is also
    sent to the range before it, so no task sees more than one range.
    """
    n = partitions(docs.sparkSession)
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)
    cuts = sorted({int(c) for c in cuts})
    last = len(cuts) + 1
    dealt = docs.withColumn("_range", F.when(F.col(key).isNull(), F.lit(last)).otherwise(
        _range_number(F.col(key), cuts)))
    first = dealt.groupBy("_range").agg(F.min(key).alias("_first")).collect()      # one row per range
    first = sorted((r["_range"], r["_first"]) for r in first)
    # the first row of every range, and the range before it (before the first: the last)
    kind = docs.schema[key].dataType.simpleString()
    borders = json.dumps([{"_home": home, "_first": k, "_host": first[i - 1][0]} for i, (home, k) in enumerate(first)])
    hosts = docs.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(borders), f"array<struct<_home:int,_first:{kind},_host:int>>")))
    ids = [k for _, k in first if k is not None]
    wanted = F.col(key).isin(ids) if ids else F.lit(False)
    if any(k is None for _, k in first):
        wanted = wanted | F.col(key).isNull()
    guests = dealt.where(wanted).join(hosts, (F.col("_range") == F.col("_home")) & F.col(key).eqNullSafe(
        F.col("_first"))).withColumn("_range", F.col("_host")).select(dealt.columns)
    rows = dealt.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_guest", F.col(key).asc_nulls_last(), F.col(text))
    nexts = [F.lead(F.col(c)).over(order).alias(f"next_{c}") for c in (text, *carried)]
    return rows.select("*", *nexts).where(F.col("_guest") == 0).drop("_guest", "_range")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many (or all) of the following text's first."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(text.substr(F.lit(1), n - cut), following.substr(F.lit(1), cut))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the fingerprints of text and edited text, and their likenesses."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(own.withColumn("print", fingerprint(F.col("text"))), "doc_id", "text", "print")
    own = own.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    own = own.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                     F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print",
                     fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return own.select("doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), "edited_fingerprint",
                      likeness(F.col("print"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("print"), F.col("next_print")).alias("near_next"))
