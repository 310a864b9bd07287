"""Canonical text and small string helpers, as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as the extraction side defines it (regex class body).
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The same as characters, for the functions that take no pattern.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Letters and signs that compatibility normalisation leaves alone; anything else takes the Arrow path.
# ASCII is apart: most characters are, and one range is tested faster than a class of many.
_PLAIN = (
    r"\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E"
    r"\u0141-\u0148\u014A-\u017E\u2010\u2012-\u2015\u2018-\u201E\u2020-\u2022\u20AC\u2212"
)

# Signs that the canonical form writes in ASCII.
_SIGNS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2018\u2019\u201c\u201d\u201e"


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # Most batches hold nothing that can change, and go back as they came.
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if s is None else unicodedata.normalize("NFKC", s) for s in texts.to_pylist()], texts.type)


def _ascii(c: Column) -> Column:
    # Bytes and characters are counted where they lie; a pattern would make a new string of each text.
    return F.octet_length(c) == F.length(c)


def _spaced(c: Column) -> Column:
    """No ASCII whitespace but single spaces between words, told without a pattern."""
    marks = [F.contains(c, F.lit(x)) for x in ("  ", "\n", "\t", "\r", "\x0b", "\f")] + [F.startswith(c, F.lit(" ")), F.endswith(c, F.lit(" "))]
    untidy = marks[0]
    for m in marks[1:]:
        untidy = untidy | m
    return ~untidy


def _tidy(c: Column) -> Column:
    """ASCII without whitespace but single spaces between words: the common case."""
    return _ascii(c) & _spaced(c)


def nfkc(col: Column) -> Column:
    """NFKC. Only rows that can change travel to Python; the rest stay as they are."""
    odd = ~_ascii(col) & col.rlike(rf"[^\x00-\x7F](?<![{_PLAIN}])")
    return F.coalesce(_nfkc(F.when(odd, col)), col)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(col: Column) -> Column:
    # One plain space stays as it is, so only a longer run, or one that begins with another sign, is replaced. The first
    # test of a place is one range, which no whitespace is in; only what passes is looked up in the class.
    more = rf"[^!-~](?<=[{WS}])"
    return F.trim(F.regexp_replace(col, rf" (?:{more})++|[^ -~](?<=[{WS}])(?:{more})*+", " "))


def squeeze_untidy(col: Column) -> Column:
    """The same, for a plain column: it is mentioned often, so that tidy texts need no pattern."""
    return F.when(_tidy(col), col).otherwise(squeeze(col))


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WS_CHARS))


def canonical(col: Column | str) -> Column:
    """The one text form in which values, quotes and pages are compared."""
    c = F.col(col) if isinstance(col, str) else col
    return after_nfkc(nfkc(F.replace(c, F.lit("\\n"), F.lit(" "))))


def after_nfkc(c: Column) -> Column:
    """The part of `canonical` that stays on the native path, so that it can run inside arrays."""
    signs = F.translate(c, _SIGNS, "-------''\"\"\"")
    # Most values have no sign to replace and nothing but single spaces between words. What is left to look for is not
    # ASCII, so that a place is tested by one range.
    plain = _spaced(c) & (_ascii(c) | ~c.rlike(rf"[^\x00-\x7F](?<=[{_SIGNS}{WS}])"))
    return F.lower(F.when(plain, c).otherwise(squeeze(signs)))


def no_spaces(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit(""))


def contains_loosely(haystack: Column, needle: Column) -> Column:
    """Containment of canonical text, or the same with every space removed."""
    return F.contains(haystack, needle) | F.contains(no_spaces(haystack), no_spaces(needle))


def overlapping_count(haystack: Column, needle: Column) -> Column:
    """How often needle starts in haystack, overlaps included; an empty needle counts 0."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(needle == "", F.lit(0)).otherwise(F.regexp_count(haystack, quoted))


def printed_once(haystack: Column, needle: Column) -> Column:
    """needle is not empty and starts at exactly one place of haystack."""
    first = F.position(needle, haystack)
    return (needle != "") & (first > 0) & (F.position(needle, haystack, first + 1) == 0)


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def tagged_sha256(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))
