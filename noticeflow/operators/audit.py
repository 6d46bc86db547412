"""Rule-based data-quality audit: one long violations table ``(pos, id, rule, detail)``.

Row rules are one ``select`` producing an array of violations per row, then an
``explode``; the duplicate-id rule is an aggregate joined back; the file rules
are joins against a file inventory.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates as dt
from ..functions import text as tx
from ..functions import urls as ur
from .dedupe import duplicate_rows

VIOLATION = "struct<rule:string,detail:string>"


def _v(cond, rule: str, detail):
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))


def _opt(df: DataFrame, c: str):
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def row_violations(df: DataFrame, as_of, pos: str = "pos", max_days: int = fv.MAX_AGE_DAYS) -> DataFrame:
    """Per-row rules; ``df`` needs ``id`` and ``pos`` (1-based position)."""
    missing = F.array_compact(F.array(*[
        F.when(~tx.truthy(_opt(df, c)), F.lit(c)) for c in fv.REQUIRED_FIELDS]))
    source = _opt(df, "fuente")
    portal_exact = F.coalesce(source.isin(*fv.PORTAL_SOURCES), F.lit(False))
    published = dt.parse_dmy(_opt(df, "fecha_inicio"))
    age = F.datediff(dt.as_date(as_of), published)
    url = F.coalesce(_opt(df, "url_oficial"), F.lit(""))
    individual = ur.is_individual_listing(source, url)
    app = F.coalesce(_opt(df, "url_postulacion"), F.lit(""))
    consult = F.coalesce(_opt(df, "url_consulta"), F.lit(""))
    rules = F.array(
        _v(F.size(missing) > 0, "missing_fields", F.array_join(missing, ", ")),
        _v(portal_exact & published.isNotNull() & ((age < 0) | (age > max_days)), "age_out_of_window", age),
        _v(portal_exact & published.isNull(), "invalid_date", _opt(df, "fecha_inicio")),
        _v(individual.isNotNull() & ~F.coalesce(individual, F.lit(True)), "not_individual_listing", url),
        _v(individual.isNull() & (url != "") & ~ur.is_official(url), "not_official_source", url),
        _v((app != "") & ~(ur.is_valid_application(app) & ur.is_direct_link(app)), "indirect_application_link", app),
        _v((consult != "") & ~ur.is_valid_application(consult), "invalid_consult_link", consult),
    )
    per_row = df.select(pos, "id", F.explode(F.array_compact(rules)).alias("v"))
    out = per_row.select(pos, "id", "v.rule", "v.detail")
    if "enlaces_bases" in df.columns:
        out = out.unionByName(link_violations(df, pos))
    dups = duplicate_rows(df.select(pos, "id"), "id", F.col(pos))
    out = out.unionByName(dups.select(pos, "id", F.lit("duplicate_id").alias("rule"), F.col("id").alias("detail")))
    return out


def link_violations(df: DataFrame, pos: str = "pos", links: str = "enlaces_bases") -> DataFrame:
    """Document links that are empty or not a valid application address."""
    each = df.select(pos, "id", F.explode(links).alias("l"))
    bad = each.where(~(tx.truthy(F.col("l.url")) & ur.is_valid_application(F.col("l.url"))))
    return bad.select(pos, "id", F.lit("invalid_document_link").alias("rule"),
                      F.coalesce(F.col("l.url"), F.lit("")).alias("detail"))


def raw_link_violations(df: DataFrame, pos: str = "pos", raw: str = "links_json") -> DataFrame:
    """The link rules over unparsed JSON: links that are no list, and elements that are no object with a valid address.

    Absent and empty values (null, false, 0, empty text, list or object) break no rule.
    """
    value = F.try_parse_json(F.col(raw))
    rows = df.where(tx.truthy(raw)).select(pos, "id", F.col(raw).alias("_raw"), value.alias("_v"), F.coalesce(
        F.schema_of_variant(value), F.lit("TEXT")).alias("_kind"))
    empty = F.trim("_raw").isin("null", "false", '""', "{}", "[]") | F.coalesce(
        F.try_variant_get("_v", "$", "double") == 0, F.lit(False))
    rows = rows.where(~empty)
    is_list = F.col("_kind").startswith("ARRAY")
    no_list = rows.where(~is_list).select(pos, "id", F.lit("links_not_a_list").alias("rule"), F.col("_raw").alias("detail"))
    each = rows.where(is_list).select(pos, "id", F.explode(F.try_variant_get("_v", "$", "array<variant>")).alias("_e"))
    url = F.coalesce(F.try_variant_get("_e", "$.url", "string"), F.lit(""))
    bad = each.select(pos, "id", url.alias("detail")).where(~(tx.truthy("detail") & ur.is_valid_application("detail")))
    return no_list.unionByName(bad.select(pos, "id", F.lit("invalid_document_link").alias("rule"), "detail"))


def file_violations(df: DataFrame, generated: DataFrame, documents: DataFrame | None = None,
                    pos: str = "pos") -> DataFrame:
    """File rules.  ``generated``: (name, content) of detail files; ``documents``: (path)."""
    expected = df.select(pos, "id", tx.file_name("id", "titulo").alias("name"),
                         _opt(df, "archivo_oficial").alias("doc"))
    gen = generated.select("name", "content")
    missing = expected.join(gen.select("name"), "name", "left_anti").select(
        pos, "id", F.lit("missing_detail_file").alias("rule"), F.col("name").alias("detail"))
    present = expected.join(gen, "name")
    word = present.where(tx.contains_any(F.col("content"), fv.FORBIDDEN_WORD_DOC)).select(
        pos, "id", F.lit("forbidden_word_document").alias("rule"), F.col("name").alias("detail"))
    general = present.where(tx.contains_any(F.col("content"), fv.FORBIDDEN_GENERAL_LIST)).select(
        pos, "id", F.lit("forbidden_general_list").alias("rule"), F.col("name").alias("detail"))
    out = missing.unionByName(word).unionByName(general)
    if documents is not None:
        docs = documents.select(F.col("path").alias("doc"))
        nodoc = expected.where(tx.truthy("doc")).join(docs, "doc", "left_anti").select(
            pos, "id", F.lit("missing_document").alias("rule"), F.col("doc").alias("detail"))
        out = out.unionByName(nodoc)
    return out


def name_diff(expected: DataFrame, actual: DataFrame, name: str = "name") -> DataFrame:
    """Expected vs actual names: (name, status) with status missing / obsolete / ok."""
    e = expected.select(name).distinct().withColumn("_e", F.lit(True))
    a = actual.select(name).distinct().withColumn("_a", F.lit(True))
    both = e.join(a, name, "full_outer")
    status = (F.when(F.col("_a").isNull(), F.lit("missing"))
              .when(F.col("_e").isNull(), F.lit("obsolete")).otherwise(F.lit("ok")))
    return both.select(name, status.alias("status"))


def obsolete_report(diff: DataFrame, name: str = "name", first: int = 5) -> DataFrame:
    """One row: number of obsolete names and the first few (sorted) joined by ', '."""
    obs = diff.where(F.col("status") == "obsolete").select(name)
    head = obs.orderBy(name).limit(first)
    report = head.agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("first_obsolete"))
    n = obs.select(F.count(F.lit(1))).scalar()
    return report.select(n.alias("n_obsolete"), F.coalesce("first_obsolete", F.lit("")).alias("first_obsolete"))
