"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with k = floor(error_rate * m) edits. Cut into k + 1 pieces, at
least one piece then occurs unchanged. All pieces of all items are looked for in one pass over a text
(Aho-Corasick); around each piece found, Myers' bit-parallel automaton works out the distance.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ERROR_RATE = 0.05
#: Characters of test items that one broadcast block holds at most (but for a single longer item).
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of the errors + 1 nearly equal pieces of an item longer than errors."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of item in text with at most `most` edits; the first end of equals."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score <= most:
            best, most = (score, at + 1), score - 1
            if most < 0:
                break
    return best


class Searcher:
    """Finds all items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, math.floor(error_rate * len(t))) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item that occurs in the normalised text."""
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - length - offset)
        out = []
        for n, at in starts.items():
            item, pattern, errors = self.items[n]
            best = None
            exact = [s for s in sorted(at) if s >= 0 and text.startswith(pattern, s)]
            if exact:
                best = (0, exact[0] + len(pattern))
            else:
                for a, b in _merged([(max(0, s - errors), s + len(pattern) + errors) for s in sorted(at)]):
                    hit = myers(pattern, text[a:b], errors if best is None else best[0] - 1)
                    if hit:
                        best = hit[0], a + hit[1]
            if best:
                out.append((item, *best))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = spans[:1]
    for a, b in spans[1:]:
        if a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_searchers: dict[str, Searcher] = {}


def leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, end_char: each test item that occurs in each document.

    Texts are compared in lower case with white space squeezed; an item occurs in a document if some
    substring is within floor(error_rate * length) edits of it. distance is the smallest, end_char the first
    place (in the squeezed text) where it is reached. Whole texts are searched, whatever their length.

    Items are broadcast in blocks of at most block_chars characters, one pass over the documents for each
    block; a small benchmark is one block. Null or blank items and documents match nothing. Repeated
    items or documents give repeated rows; a null id is passed on. Other columns are not read.
    """
    found = None
    for block in _blocks(docs, items, block_chars):
        part = _search(docs, block, error_rate)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns as they are, in whose text no test item occurs. As leaks() for nulls."""
    for block in _blocks(docs, items, block_chars):
        docs = _clean(docs, block, error_rate)
    return docs


def _blocks(docs: DataFrame, items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of about block_chars, one in the driver at a time."""
    common.bound_batches(docs.sparkSession)
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("trim(text) <> ''")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(chars / block_chars))
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # bounded: a block
        yield [(r["item_id"], t) for r in rows if (t := normal(r["text"]))]


def _searcher(items: list[tuple[int, str]], error_rate: float, spark: SparkSession) -> Callable[[], Searcher | None]:
    """For tasks: the block's automaton, built once in each Python worker."""
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def own() -> Searcher | None:
        common.work_for("leaks")
        if name not in _searchers:
            _searchers.clear()
            _searchers[name] = Searcher(shared.value, error_rate) if shared.value else None
        return _searchers[name]

    return own


def _search(docs: DataFrame, items: list[tuple[int, str]], error_rate: float) -> DataFrame:
    searcher = _searcher(items, error_rate, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = searcher()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            hits = [(i, *hit) for i, text in zip(ids, texts, strict=True) if own and text for hit in own.search(normal(text))]
            columns = list(zip(*hits, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end_char"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, distance long, end_char long")


def _clean(docs: DataFrame, items: list[tuple[int, str]], error_rate: float) -> DataFrame:
    searcher = _searcher(items, error_rate, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = searcher()
        for batch in batches:
            yield batch.filter(pa.array([not (own and text and own.search(normal(text))) for text in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
