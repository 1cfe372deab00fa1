"""Dictionaries of terms as tables: all terms are looked for in one pass over a text.

Terms are applied one after another, longest first, each to what the ones before left. A multi-pattern automaton (Aho and
Corasick) says which terms a text can hold at all; only those are tried, in their order, and after each one that hits only the
surroundings of what it changed are searched again. Texts meet as many expressions as they hold terms, not as the table has.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of terms and replacements that go to executors at once; a larger table goes in several parts, longest terms first.
PART_CHARS = 8_000_000


class _Folded(dict):
    """Of each character one that stands for all that equal it in any case, as regular expressions have it: those whose lower
    cases have one upper case. Always one character, so places stay."""

    def __init__(self):
        first: dict[str, str] = {}
        for c in range(0x10000):
            low = "i" if c == 0x130 else chr(c).lower()
            self[c] = ord(first.setdefault(low.upper(), low))

    def __missing__(self, c: int) -> int:
        self[c] = ord(chr(c).lower())
        return self[c]


@lru_cache(maxsize=1)
def _folded() -> _Folded:
    return _Folded()


def fold(text: str) -> str:
    """Equal for texts that are equal in any case, character by character."""
    return text.lower() if text.isascii() else text.translate(_folded())


class Terms:
    """Sequential replacement of (term, replacement) pairs, longest term first, equals by their letters.

    edge: a class of characters that may not touch a term, '' for none; any_case: case doesn't matter."""

    def __init__(self, pairs: list[tuple[str, str]], edge: str = "", any_case: bool = False):
        first: dict[str, str] = {}
        for term, full in sorted(pairs):
            if term:
                first.setdefault(term, full)
        self.pairs = sorted(first.items(), key=lambda p: (-len(p[0]), p[0]))
        self.touching = re.compile(f"[{edge}]", re.IGNORECASE if any_case else 0).match if edge else None
        self.fold = fold if any_case else str
        self.folded = [(self.fold(term), self.fold(full)) for term, full in self.pairs]
        self.longest = len(self.pairs[0][0]) if self.pairs else 0
        self.automaton = ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for i, (key, _) in enumerate(self.folded):
            numbers.setdefault(key, []).append(i)
        for key, own in numbers.items():
            self.automaton.add_word(key, own)
        self.automaton.make_automaton()

    def candidates(self, folded: str, above: int = -1) -> set[int]:
        """Numbers, greater than `above`, of terms that the folded text holds, edges or not."""
        return {i for _, own in self.automaton.iter(folded) for i in own if i > above} if self.pairs else set()

    def places(self, i: int, text: str, folded: str) -> list[int]:
        """Where term i is replaced, from left to right."""
        key, out = self.folded[i][0], []
        at = folded.find(key)
        while at >= 0:
            end = at + len(key)
            if self.touching and ((at and self.touching(text[at - 1])) or (end < len(text) and self.touching(text[end]))):
                end = at + 1
            else:
                out.append(at)
            at = folded.find(key, end)
        return out

    def apply(self, text: str) -> tuple[str, list[str]]:
        """The text after all terms, and those that hit, in their order."""
        folded, hits, done = self.fold(text), [], -1
        waiting = list(self.candidates(folded))
        heapify(waiting)
        while waiting:
            i = heappop(waiting)
            if i == done:
                continue
            done = i
            (term, full), size = self.pairs[i], len(self.pairs[i][0])
            found = self.places(i, text, folded)
            if not found:
                continue
            hits.append(term)
            ends = [0, *(at + size for at in found)]
            cuts = list(zip(ends, [*found, len(text)], strict=True))
            text, folded = full.join([text[a:b] for a, b in cuts]), self.folded[i][1].join([folded[a:b] for a, b in cuts])
            grown = len(full) - size
            starts = [at + k * grown for k, at in enumerate(found)]
            if len(starts) * (len(full) + 2 * self.longest) < len(text):
                around = {folded[max(0, a - self.longest) : a + len(full) + self.longest] for a in starts}
            else:
                around = {folded}
            for new in set().union(*(self.candidates(x, i) for x in around)).difference(waiting):
                heappush(waiting, new)
        return text, hits


_built: dict[str, Terms] = {}


def _shared(spark: SparkSession, pairs: list[tuple[str, str]], edge: str, any_case: bool) -> Callable[[], Terms]:
    """For tasks: the automaton, built once in each Python worker."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(pairs)

    def own() -> Terms:
        if name not in _built:
            _built.clear()
            _built[name] = Terms(sent.value, edge, any_case)
        return _built[name]

    return own


def _parts(terms: DataFrame, chars: int) -> Iterator[list[tuple[str, str]]]:
    """terms(term, full_name) in parts of about `chars` characters, longer terms first: ranges of lengths. The driver holds one
    part at a time."""
    t = terms.select("term", F.coalesce("full_name", F.lit("")).alias("full_name")).where("term <> ''").withColumn("n", F.length("term"))
    sizes = t.groupBy("n").agg(F.sum(F.length("term") + F.length("full_name")).alias("chars")).orderBy(F.desc("n")).collect()  # one row for each length of a term
    high, total = None, 0
    for k, r in enumerate(sizes):
        high, total = r["n"] if high is None else high, total + r["chars"]
        if total >= chars or k == len(sizes) - 1:
            yield [(x["term"], x["full_name"]) for x in t.where(F.col("n").between(r["n"], high)).collect()]
            high, total = None, 0


def replace_terms(df: DataFrame, terms: DataFrame | list[tuple[str, str]], col: str, hits: str, edge: str = "", any_case: bool = False, part_chars: int = PART_CHARS) -> DataFrame:
    """df with `col` after all terms and with `hits`, the terms that hit, in their order. terms is a list of pairs or a table
    (term, full_name); of a term's repeats the least full_name counts, null and empty terms are none. A null text stays null
    and has no hits. Rows keep their other columns; one named `hits` is replaced."""
    parts = _parts(terms, part_chars) if isinstance(terms, DataFrame) else [terms]
    df = df.withColumn(hits, F.array().cast("array<string>"))
    for pairs in parts:
        df = df.withColumn("_made", _applied(_shared(df.sparkSession, pairs, edge, any_case))(F.col(col))).withColumns({hits: F.concat(hits, "_made.hits"), col: F.col("_made.text")}).drop("_made")
    return df


def _applied(own: Callable[[], Terms]):
    @F.pandas_udf("struct<text:string,hits:array<string>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = own()
        for part in texts:
            made = [terms.apply(t) if t is not None else (None, []) for t in part]
            yield pd.DataFrame({"text": [m[0] for m in made], "hits": [m[1] for m in made]})

    return run
