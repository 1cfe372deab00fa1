"""Runs of repeated words: periodic stretches found on an enhanced suffix array by the branching-tandem test.

An interval of the suffix array whose suffixes share exactly d words holds the squares of period d that no word to the right
continues: i starts one if i and i + d lie in different children of the interval. For every suffix of all children but the
largest, ISA[i + d] and ISA[i - d] are looked up, which finds each such square in n log n steps. Rotated to the left as far
as words agree, a square becomes its whole run; squares of one run are merged, the smallest period counts. Intervals and
children are arrays of borders; no tree is built. All steps work on whole arrays.

A run of at least 24 words and three periods holds a stretch of 16 words that occurs twice in its text, so only words inside
such stretches go into the suffix array; every other word can belong to no run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run is at least so many words and so many periods long; then GRAM words occur twice: length - period is at least both
#: LEAST - period and (TIMES - 1) * period, of which the larger is never below LEAST * (TIMES - 1) / TIMES.
LEAST, TIMES = 24, 3
GRAM = LEAST * (TIMES - 1) // TIMES
U64 = np.uint64

RUNS = "array<struct<start:long,length:long,period:long>>"


# ---------------------------------------------------------------- enhanced suffix array


def doubled_ranks(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, … symbols from each place on, until all differ; past the end counts as smallest."""
    n = len(x)
    levels = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while levels[-1].max() < n - 1:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1])
        width *= 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share, for places a != b."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a + out, b + out
        ok = (p < n) & (q < n)
        rank = levels[k]
        same = ok & (rank[np.where(ok, p, 0)] == rank[np.where(ok, q, 0)])
        out += same.astype(np.int64) << k
    return out


def common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the stretches ending before a and before b share, for a < b."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a - out - (1 << k), b - out - (1 << k)
        ok = p >= 0
        rank = levels[k]
        same = ok & (rank[np.where(ok, p, 0)] == rank[np.where(ok, q, 0)])
        out += same.astype(np.int64) << k
    return out


def next_smaller(h: np.ndarray) -> np.ndarray:
    """For each place the next one whose value is smaller, len(h) if none: pointers that double."""
    n = len(h)
    padded = np.append(h, -1)
    to = np.arange(1, n + 1)
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[padded[to[open_]] >= h[open_]]
        to[open_] = to[to[open_]]
    return to


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the squares that can't be moved to the right, by intervals of lcp[k] = shared symbols of the suffixes
    numbered k - 1 and k. At most about `most` suffixes are looked up at once, but for one larger interval."""
    n = len(sa)
    at = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    right = next_smaller(lcp) - 1
    left = n - 1 - next_smaller(lcp[::-1])[::-1]  # the last place before with a smaller value: the interval's first suffix
    order = np.lexsort((at, lcp[at], left[at]))
    at = at[order]
    lo, hi, depth = left[at], right[at], lcp[at]
    first = np.ones(len(at), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    node = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    # Children: from the interval's start and from each border on, up to the next border.
    slot = np.arange(len(at)) + node + 1
    begin = np.zeros(len(at) + len(heads), np.int64)
    begin[slot] = at
    begin[heads + np.arange(len(heads))] = lo[heads]
    of = np.zeros(len(begin), np.int64)
    of[slot] = node
    of[heads + np.arange(len(heads))] = np.arange(len(heads))
    end = np.append(begin[1:] - 1, 0)
    last = np.append(heads[1:] + np.arange(1, len(heads)), len(begin)) - 1
    end[last] = hi[heads]
    size = end - begin + 1
    biggest = np.lexsort((-size, of))[heads + np.arange(len(heads))]
    small = np.ones(len(begin), bool)
    small[biggest] = False
    child = np.flatnonzero(small)
    places, periods = [], []
    cuts = np.searchsorted(np.cumsum(size[child]), np.arange(most, size[child].sum() + most, most)) + 1
    a = 0
    for b in np.unique(np.minimum(cuts, len(child))).tolist():
        part, a = child[a:b], b
        mine = np.repeat(part, size[part])
        i, d = sa[_spans(begin[part], size[part])], depth[heads[of[mine]]]
        inside = lambda j, mine=mine: (j >= lo[heads[of[mine]]]) & (j <= hi[heads[of[mine]]]) & ((j < begin[mine]) | (j > end[mine]))
        for other, start in ((i + d, i), (i - d, i - d)):
            ok = (other >= 0) & (other < n)
            ok[ok] = inside(isa[np.where(ok, other, 0)])[ok]
            places.append(start[ok])
            periods.append(d[ok])
    return np.concatenate(places), np.concatenate(periods)


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs of at least `least` symbols and `times` periods, by start, then period.
    times is at least 2."""
    none = np.zeros(0, np.int64)
    if len(x) < 2:
        return none, none, none
    levels = doubled_ranks(x)
    isa = levels[-1]
    sa = np.empty(len(x), np.int64)
    sa[isa] = np.arange(len(x))
    lcp = np.zeros(len(x), np.int64)
    lcp[1:] = common_prefix(levels, sa[:-1], sa[1:])
    place, period = branching_squares(sa, isa, lcp)
    end = place + 2 * period
    start = place - common_suffix(levels, place, place + period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of equal stretches the smallest period
    own &= end - start >= np.maximum(least, times * period)
    start, length, period = start[own], (end - start)[own], period[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


# ---------------------------------------------------------------- texts


def repeated_words(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch of GRAM words that occurs twice in its document; perhaps a few others, since stretches
    are compared by hashes. Documents lie one after another."""
    covered = np.zeros(len(ids), bool)
    n = len(ids) - GRAM + 1
    if n < 2:
        return covered
    h = common.mix(ids.astype(U64) + (doc.astype(U64) << U64(32)))
    width = 1
    while width < GRAM:
        h = common.mix(h[:-width] * U64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    h = np.where(doc[:n] == doc[GRAM - 1 :], h, np.arange(n, dtype=U64))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += hit
    edge[GRAM:] -= hit
    return np.cumsum(edge[:-1]) > 0


def runs_in(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, length, period) of all runs in texts of words."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(repeated_words(ids, doc))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    # Words of one document that lie side by side stay so; after any others stands a symbol of its own.
    gap = np.ones(len(at), bool)
    gap[:-1] = (np.diff(at) != 1) | (np.diff(doc[at]) != 0)
    place = np.arange(len(at)) + np.cumsum(gap) - gap
    x = np.full(len(at) + int(gap.sum()), -1, np.int64)
    x[place] = doc[at] * (len(number) + 1) + ids[at]
    own = x < 0
    x[own] = -1 - np.arange(own.sum())
    start, length, period = runs_of(x)
    where = np.zeros(len(x), np.int64)
    where[place] = at
    word = where[start]
    of = doc[word]
    return of, word - (np.cumsum(sizes) - sizes)[of], length, period


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but `text`, and n_words, runs (array of start, length, period, by start, then period) and collapsed:
    the text's words joined by one space without those that a run repeats, that is, that follow a run's first period.

    Words are [^\\x20\\x09-\\x0D]+, compared byte by byte. Null text: no words, no runs, an empty collapsed text, as for an
    empty one. Each row is a text for itself, so repeated rows and ids don't matter; columns named n_words, runs or collapsed
    are replaced. Whole texts are read, whatever their length; an empty table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    made = ("n_words", "runs", "collapsed")
    kept = [f for f in docs.schema if f.name not in (text, *made)]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or b"").split() for t in batch.column(text).cast(pa.binary()).to_pylist()]
        of, start, length, period = runs_in(texts)
        offs = np.searchsorted(of, np.arange(len(texts) + 1))
        collapsed = []
        for i, words in enumerate(texts):
            a, b = offs[i], offs[i + 1]
            if a < b:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[a:b] + period[a:b], 1)
                np.add.at(edge, start[a:b] + length[a:b], -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]  # noqa: PLW2901
            collapsed.append(b" ".join(words))
        values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], fields=list(run_type))
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.record_batch([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("runs")
        for batch in batches:
            for part in common.slices(batch, text, 1 << 19):
                yield one(part)

    from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

    fields = [StructField("n_words", LongType()), StructField("runs", _parse_datatype_string(RUNS)), StructField("collapsed", StringType())]
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`")).mapInArrow(run, StructType([*kept, *fields]))


def strongest(runs: Column) -> Column:
    """Of an array of runs the one with the greatest length / period, compared exactly; of equals the first. Null if none."""
    better = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about one text in ten all words from a place on repeat a stretch, as the task of this query says."""
    h = common.crc32_of_id()
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), r"[ \t-\r]+"), lambda w: w != "")
    n = F.size("words")
    a = F.pmod(F.col("g"), n)
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.pmod(F.col("g"), F.lit(8))))
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(F.pmod(h, F.lit(10)) == 0, words).alias("words"))
    placed = chosen.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    # words are numbered from 0 here and from 1 by element_at
    own = F.concat(F.expr("slice(words, 1, int(a))"), F.expr("transform(sequence(a, size(words) - 1), i -> element_at(words, int(a + (i - a) % p) + 1))"))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", own)).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(common.table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
