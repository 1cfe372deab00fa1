"""Cleaning and rewriting Markdown, in column expressions; packing by budget in one small helper."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END_MARKS, LINE_ENDS, strip
from ._packing import pack_lines
from .dictionary import replace_terms

#: Words of a heading that begin a contents section, and section labels of navigation bars.
CONTENTS_WORDS = ["目錄", "目 錄", "Table of Contents", "CONTENTS", "contents"]
NAVIGATION = ["Overview", "治理", "減碳", "增綠", "自然", "共融", "附錄"]
#: Patterns of lines that repeat on pages, on the trimmed line.
HEADER_FOOTER = [r"^[-—–]\s*\d+\s*[-—–]$", r"^\d+\s*$", r"^第\s*\d+\s*頁", r"^Page\s+\d+", r"(?i)^(confidential|internal use)"]
#: Patterns of contents lines, on the trimmed line: title, leader dots or spaces (three or more), page number; only
#: leaders. A run of leaders holds no digit, so it is taken whole (possessive) and a long run is never backtracked over.
CONTENTS_LINES = [r"^.{2,60}?[.\s·…]{3,}+\d{1,4}$", r"^[.\s·…]{5,}+$"]
#: Fixed value: two replacement characters in a row.
GARBLED = "\ufffd\ufffd"
#: Fixed value: numbers that make a bold line a second-level heading.
NUMBERED = r"(?:\d+[.\-]\d*\s*|[壹貳參肆伍陸柒捌玖拾]、|[一二三四五六七八九十]+、|第[一二三四五六七八九十\d]+[章節篇])"


def remove_toc_sections(ls: Column, words: list[str] = CONTENTS_WORDS) -> Column:
    """C1 on an array of lines: a heading that contains a contents word and what follows, up to the next heading of the
    same or a higher level (which is kept without being tested itself)."""
    # the fold keeps only where sections begin and end, so it stays linear in the lines
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("cuts"))

    def worded(line: Column) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | line.contains(w)
        return hit

    def step(s: Column, line: Column) -> Column:
        level = F.when(line.contains("#"), F.length(F.regexp_extract(strip(line), r"(?U)^(#{1,6})\s+\S", 1))).otherwise(0)
        inside = s["level"] > 0
        ends = inside & (level > 0) & (level <= s["level"])
        begins = ~inside & (level > 0) & worded(line)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(begins, level).when(ends, 0).otherwise(s["level"]).alias("level"),
            F.when(begins | ends, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"),
        )

    def cut(s: Column) -> Column:
        # a line is left out if an odd number of cuts lies at or before it
        kept = F.filter(s["l"], lambda x, i: F.size(F.filter(s["c"], lambda c: c <= i)) % 2 == 0)
        return F.when(F.size(s["c"]) == 0, s["l"]).otherwise(kept)

    cuts = F.aggregate(F.filter(ls, lambda x: x.isNotNull()), start, step)["cuts"]
    some = F.exists(ls, lambda x: x.contains("#") & worded(x))
    return F.when(some, F.transform(F.array(F.struct(cuts.alias("c"), ls.alias("l"))), cut)[0]).otherwise(ls)


def _any_of(patterns: list[str]) -> str:
    """One pattern for a trimmed line: tried once, from its first character."""
    return "(?U)^(?:" + "|".join(f"(?:{p.removeprefix('^')})" if not p.startswith("(?i)^") else f"(?i:{p.removeprefix('(?i)^')})" for p in patterns) + ")"


def _navigation(labels: list[str]) -> str:
    one = "(?:" + "|".join(map(re.escape, labels)) + ")"
    return rf"^{one}(?:\s+{one})+$"


def _without(ls: Column, patterns: list[str]) -> Column:
    return F.filter(ls, lambda x: ~strip(x).rlike(_any_of(patterns)))


def drop_header_footer(ls: Column, patterns: list[str] = HEADER_FOOTER) -> Column:
    """C2"""
    return _without(ls, patterns)


def drop_nav_bars(ls: Column, labels: list[str] = NAVIGATION) -> Column:
    """Lines of nothing but two or more section labels."""
    return _without(ls, [_navigation(labels)])


def drop_garbled(ls: Column) -> Column:
    """C4: lines with two replacement characters in a row."""
    return F.filter(ls, lambda x: ~x.contains(GARBLED))


def drop_toc_lines(ls: Column) -> Column:
    """Title, leader dots or three spaces and more, page number; only dots and spaces."""
    return _without(ls, CONTENTS_LINES)


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _where(c: Column, marks: list[str], change) -> Column:
    """change(c) for texts that hold one of the marks: looking for a mark is far cheaper than trying a pattern everywhere."""

    def of(t: Column) -> Column:
        has = t.contains(marks[0])
        for m in marks[1:]:
            has = has | t.contains(m)
        return F.when(has, change(t)).otherwise(t)

    return _let(c, of)


def _bold_to_headings(t: Column) -> Column:
    t = F.regexp_replace(t, rf"(?mdU)^\*\*\s*({NUMBERED}\s*.+?)\*\*\s*$", "## $1")
    return F.regexp_replace(t, r"(?mdU)^\*\*([^*\n]{3,40})\*\*\s*$", "### $1")


def normalize_headings(c: Column) -> Column:
    """A numbered bold line to a second-level heading, another bold line of 3 to 40 characters to a third-level one, and
    a space after the hashes."""
    return _where(_where(c, ["**"], _bold_to_headings), ["#"], lambda t: F.regexp_replace(t, r"(?mdU)^(#{1,6})([^#\s])", "$1 $2"))


def _right_stripped(c: Column) -> Column:
    """Lines without white space at their ends; line ends are \\n alone."""
    return _let(c, lambda t: F.when(t.rlike(r"[\p{Zs}\t\x1f](?:\n|\z)"), F.regexp_replace(t, r"[\p{Zs}\t\x1f]++(?=\n|\z)", "")).otherwise(t))


def squeeze_blank_lines(c: Column) -> Column:
    """C7"""
    return strip(_where(_right_stripped(c), ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")))


def _whole_lines(patterns: list[str]) -> str:
    """One pattern for the lines of a whole text, ends included, whose trimmed form one of the patterns matches from its start.
    For right-trimmed lines; white space in a pattern stays inside its line."""
    out = []
    for p in patterns:
        inner = p.replace("(?i)^", "^").removeprefix("^").replace(r"\s", r"[^\S\n]")
        inner = inner.removesuffix("$") if inner.endswith("$") else inner + r"[^\n]*+"
        out.append(f"(?i:{inner})" if p.startswith("(?i)") else f"(?:{inner})")
    return r"(?mdU)^[^\S\n]*+(?:" + "|".join(out) + r")(?:\n|\z)"


#: C2 to C5 over a whole text.
_NOISE = _whole_lines([*HEADER_FOOTER, _navigation(NAVIGATION), rf"^[^\n]*?{GARBLED}", *CONTENTS_LINES])


def clean_markdown_column(c: Column) -> Column:
    """C1 to C7. Null stays null. A text is taken apart into lines only where a contents section may begin; the rest
    are patterns over the whole text, one for C2 to C5 together, each tried only where its mark is found."""

    def without_contents(t: Column) -> Column:
        ls = _let(F.split(t, "\n", -1), lambda ls: remove_toc_sections(ls))
        return F.when(t.contains("#"), F.array_join(ls, "\n")).otherwise(t)

    c = _where(c, list(LINE_END_MARKS), lambda t: F.regexp_replace(t, LINE_ENDS, "\n"))
    c = _right_stripped(_where(c, CONTENTS_WORDS, without_contents))
    return squeeze_blank_lines(normalize_headings(F.regexp_replace(c, _NOISE, "")))


def clean_markdown(df: DataFrame, col: str = "text") -> DataFrame:
    """C8"""
    return df.withColumn(col, clean_markdown_column(F.col(col)))


def apply_terms(df: DataFrame, terms: DataFrame | list[tuple[str, str]], col: str = "text") -> DataFrame:
    """Dictionary terms by their full names, longest first, one after another, in any case, where no ASCII letter or CJK
    character touches; terms_applied lists those that hit. The dictionary is a list of pairs or a table(term, full_name); all
    its terms are looked for in one pass (dictionary.py)."""
    return replace_terms(df, terms, col, "terms_applied", edge="A-Za-z\\u4e00-\\u9fff", any_case=True)


def split_by_budget(df: DataFrame, max_chars: int = 8000, col: str = "text") -> DataFrame:
    """Pos, piece for each document's pieces of at most max_chars where lines allow it."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_lines(t or "", max_chars))

    return df.withColumn("_pieces", cut(F.col(col))).select(*(c for c in df.columns if c != col), F.posexplode("_pieces").alias("pos", "piece"))
