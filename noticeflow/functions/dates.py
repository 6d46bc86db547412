"""Date Column expressions: relative age, tolerant day/month/year parsing, rendering.

``as_of`` ("today") is always an explicit argument; no operator calls
``current_date()``, so every result is reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import _c, contains_any, let, py_strip, text_key

# Day/month/year exactly as ``strptime("%d/%m/%Y")`` accepts it: one or two
# digit day and month (a single digit may be preceded by one space), four digit
# year, nothing before or after.
DMY_PATTERN = r"^(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])/(1[0-2]|0[1-9]|[1-9])/([0-9]{4})$"


def as_date(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.strftime("%Y-%m-%d")
    return F.to_date(F.lit(str(as_of)))


def age_days(c) -> Column:
    """Relative age text -> days (NULL when it cannot be verified)."""
    k = text_key(c)
    days = F.regexp_extract(k, fv.AGE_DAYS_PATTERN, 1)
    weeks = F.regexp_extract(k, fv.AGE_WEEKS_PATTERN, 1)
    return (
        F.when(k == "", F.lit(None).cast("bigint"))
        .when(contains_any(k, fv.AGE_NONE_WORDS), F.lit(None).cast("bigint"))
        .when(contains_any(k, fv.AGE_ZERO_WORDS), F.lit(0).cast("bigint"))
        .when(k.contains(fv.AGE_ONE_WORD), F.lit(1).cast("bigint"))
        .when(days != "", days.try_cast("bigint"))
        .when(weeks != "", weeks.try_cast("bigint") * 7)
        .otherwise(F.lit(None).cast("bigint"))
    )


def is_recent(c, max_days: int = fv.MAX_AGE_DAYS) -> Column:
    d = age_days(c)
    return d.isNotNull() & (d <= F.lit(max_days))


def parse_dmy(c) -> Column:
    """Tolerant ``dd/mm/yyyy`` parse; anything else (incl. 31/02) -> NULL.

    One regex pass rewrites an accepted text to ``\u0001yyyy-m-d``; a text that
    does not match stays unchanged, so "changed" means "accepted".
    """
    def from_iso(iso):
        ok = F.startswith(iso, F.lit("\u0001")) & (F.substring(iso, 2, 4) != F.lit("0000"))
        return F.when(ok, F.try_to_date(F.translate(F.substring(iso, 2, 16), " ", ""), "yyyy-M-d"))
    # A text starting with \u0001 cannot match the pattern, so it is rejected
    # up front; otherwise a leading \u0001 in the result means "rewritten".
    c = _c(c)
    rewritten = let(F.regexp_replace(c, DMY_PATTERN, "\u0001$3-$2-$1"), from_iso)
    return F.when(~F.startswith(c, F.lit("\u0001")), rewritten)


def parse_dmy_stripped(c) -> Column:
    """Same parse after Python-style strip (expiry reads stripped text)."""
    return parse_dmy(py_strip(c))


def date_text(d) -> Column:
    return F.date_format(_c(d), "dd/MM/yyyy")


def published_from_age(age_text, as_of) -> Column:
    """Publication date = as_of - age (unknown age counts as 0)."""
    return F.date_sub(as_date(as_of), F.coalesce(age_days(age_text), F.lit(0)).cast("int"))


def still_open(end_text, as_of) -> Column:
    """Open while the close date is unknown/unparsable or not before as_of (text not stripped)."""
    return let(parse_dmy(end_text), lambda d: d.isNull() | (d >= as_date(as_of)))


def not_expired(end_text, as_of) -> Column:
    """Expiry rule on stripped text: unparsable/empty close dates are kept."""
    return let(parse_dmy_stripped(F.coalesce(_c(end_text), F.lit(""))),
               lambda d: d.isNull() | (d >= as_date(as_of)))


def age_in_window(start_text, as_of, max_days: int = fv.MAX_AGE_DAYS) -> Column:
    """0 <= as_of - published <= max_days; unparsable/missing -> False."""
    diff = F.datediff(as_date(as_of), parse_dmy(start_text))
    return F.coalesce(let(diff, lambda x: (x >= 0) & (x <= max_days)), F.lit(False))
