"""Column functions on text shared by the operators. Patterns carry (?U) or (?mdU) so that white space,
digits and line ends mean what they mean to a Unicode-aware, newline-only engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ENDS = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
#: Line ends other than \n, by character.
LINE_END_MARKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Unicode white space, as a set of characters for trimming without a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def lines(c: Column) -> Column:
    """Lines without their ends; a last end makes no empty line; empty text has none."""
    parts = F.split(c, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fiscal_year_int(c: Column) -> Column:
    """The first run of three or four digits; below 1911 it counts from 1911."""
    year = F.nullif(F.regexp_extract(c.cast("string"), r"(\d{3,4})", 1), F.lit("")).cast("int")
    return F.when(year < 1911, year + 1911).otherwise(year)


def parse_filter_values(c: Column) -> Column:
    """R2: '2022-2024' to its years, 'a, b' to its trimmed parts, one value to one part; blank or an
    empty range to null, which is no filter."""
    text = strip(c)
    low, high = F.regexp_extract(text, r"^(\d{4})-(\d{4})$", 1), F.regexp_extract(text, r"^(\d{4})-(\d{4})$", 2)
    low, high = F.nullif(low, F.lit("")).cast("int"), F.nullif(high, F.lit("")).cast("int")
    years = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda y: y.cast("string")))
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
    values = F.when(text.rlike(r"^\d{4}-\d{4}$"), years).otherwise(parts)
    return F.when(F.size(values) > 0, values)
