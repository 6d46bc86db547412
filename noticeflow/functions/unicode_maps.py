"""Character maps generated from Python's ``unicodedata``, for every code point of every plane.

Spark has no Unicode normalization function, so the comparison keys are
expressed with ``translate`` (one pass, JVM side) for characters whose key is
one character or none, a lookup for those whose key is longer, and the
arithmetic rule for Hangul syllables.  The tables are derived from a rule,
never typed in.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

# Hangul syllables decompose by arithmetic: lead, vowel, and trail unless it is 0.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEADS, VOWELS, TRAILS = 0x1100, 0x1161, 0x11A7
N_VOWELS, N_TRAILS = 21, 28
HULL_GAP = 256


@functools.lru_cache(maxsize=None)
def _all() -> tuple[str, ...]:
    """Every assigned character (others are their own key); surrogates are none."""
    return tuple(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Co", "Cs"))


def java_class(chars, gap: int = 1) -> str:
    """A regex character class usable by Java and RE2 (``\\x{HHHH}`` escapes).

    Consecutive code points are merged into ranges: Java tests a class as a
    chain of predicates, so fewer items make every position cheaper.  With a
    larger ``gap`` code points at most so far apart share a range, which then
    holds what lies between them too.
    """
    cps = sorted({ord(c) for c in chars})
    items, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] <= cps[j] + gap:
            j += 1
        items.append("\\x{%04X}" % cps[i] if i == j else "\\x{%04X}-\\x{%04X}" % (cps[i], cps[j]))
        i = j + 1
    return "[" + "".join(items) + "]"


@functools.lru_cache(maxsize=None)
def python_whitespace() -> str:
    """All characters matched by Python's ``\\s`` on str."""
    return "".join(c for c in _all() if c.isspace() and re.match(r"\s", c))


@functools.lru_cache(maxsize=None)
def js_trim_chars() -> str:
    """Characters removed by JavaScript's ``String.prototype.trim``."""
    extra = "\t\x0b\x0c\ufeff\n\r\u2028\u2029"
    return "".join(sorted(set(extra) | {c for c in _all() if unicodedata.category(c) == "Zs"}))


def _key_of(ch: str) -> str:
    d = unicodedata.normalize("NFKD", ch)
    d = "".join(c for c in d if not unicodedata.combining(c))
    return d.casefold()


def _search_of(ch: str) -> str:
    d = unicodedata.normalize("NFD", ch)
    d = "".join(c for c in d if not ("\u0300" <= c <= "\u036f"))
    return d.lower()


@functools.lru_cache(maxsize=None)
def _build(kind: str):
    fn = _key_of if kind == "key" else _search_of
    src, dst, drop, multi = [], [], [], []
    for ch in _all():
        if HANGUL_FIRST <= ord(ch) <= HANGUL_LAST:
            continue
        out = fn(ch)
        if out == ch:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif not out:
            drop.append(ch)
        else:
            multi.append((ch, out))
    # translate(): characters beyond the length of the replacement are deleted.
    return "".join(src) + "".join(drop), "".join(dst), tuple(multi)


def key_maps():
    """(matching, replacement, multi) for the comparison key (NFKD, no marks, casefold)."""
    return _build("key")


def search_maps():
    """(matching, replacement, multi) for the search key (NFD, no U+0300-036F, lower)."""
    return _build("search")
