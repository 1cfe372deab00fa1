"""Quality by weak labels: overlapping heuristics, their accuracies by expectation-maximisation, and a
hashed linear scorer trained on the posterior labels. No gold label is read.

The heuristics' votes on all documents come down to counts of vote patterns (at most 3^6 of them), which
is all that expectation-maximisation needs, so it runs over a bounded table whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Documents that the scorer is fitted on, at most (expected number, drawn by a hash of text and id).
FIT_DOCS = 12_000
BITS = 14
ROUNDS = 4
PARTS = 6
VOTERS = ("shouting", "symbols", "word_length", "sentences", "repeated_words", "distinct_words")
BAD, GOOD, ABSTAIN = 0, 1, 2
#: Below the first a voter calls the text good, above the second bad; between, it abstains.
LIMITS = np.array([[0.06, 0.15], [0.03, 0.1], [7.0, 9.5], [25.0, 60.0], [0.03, 0.1], [0.3, 0.6]])

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".?;:"]] = True


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offs]).astype(float)


def measures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, 6) numbers, each higher for worse text; a text without words gives zeros."""
    starts, ends, at = common.word_bounds(data, offs)
    words, n = common.word_hashes(data, starts, ends), np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    lone = np.maximum(n, 1)
    upper, lower = _UPPER[data], (data >= 97) & (data < 123)
    letters = np.maximum(_per_row(upper | lower, offs), 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(n))
    expected = np.minimum(n, 30 + 2.2 * np.maximum(n, 1) ** 0.75)  # distinct words of plain prose of that length
    return np.stack(
        [
            _per_row(upper, offs) / letters,
            _per_row(_SYMBOLS[data], offs) / lone,
            np.bincount(row, weights=(ends - starts).astype(float), minlength=len(n)) / lone,
            np.where(n >= 8, n / np.maximum(_per_row(_ENDS[data], offs), 0.5), 0.0),
            np.bincount(row[again], minlength=len(n)) / lone,
            np.where(n > 0, 1 - distinct / np.maximum(expected, 1), 0.0),
        ],
        axis=1,
    )


def votes(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers < LIMITS[:, 0], GOOD, np.where(numbers > LIMITS[:, 1], BAD, ABSTAIN)).astype(np.int8)


def pattern_of(voted: np.ndarray) -> np.ndarray:
    return voted @ (3 ** np.arange(len(VOTERS)))


def fit_voters(counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P(good) of every vote pattern, from the patterns' counts: naive Bayes over voters with unknown
    accuracies, by expectation-maximisation from the voters' majority."""
    k = len(VOTERS)
    pattern = np.arange(3**k)[:, None] // 3 ** np.arange(k) % 3
    good = ((pattern == GOOD).sum(1) + 0.5) / ((pattern != ABSTAIN).sum(1) + 1.0)
    good = np.where((pattern == BAD).any(1), good * 0.2, good)  # voters look for different faults: one that finds its own outweighs others
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        log = np.log(prior)[:, None].repeat(3**k, 1)
        for v in range(k):
            table = np.stack([np.bincount(pattern[:, v], weights=w, minlength=3) for w in weight])
            # a voter is better than chance: each says its own class's word more often than the other class does
            table = table + np.array([[2.0, 0.1, 0.5], [0.1, 2.0, 0.5]])
            log += np.log(table / table.sum(1, keepdims=True))[:, pattern[:, v]]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    return good


# ---------------------------------------------------------------- the hashed linear scorer


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, weights and row offsets: hashed byte trigrams by frequency, and hashed bins of the measures."""
    n = len(offs) - 1
    numbers = measures(data, offs)
    bins = np.clip(np.searchsorted(np.array([0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.5, 0.65, 0.85, 1, 3, 6, 9.5, 11, 13, 16, 20, 25, 40]), numbers), 0, 31)
    fixed = ((np.arange(len(VOTERS)) * 32 + bins + 1).astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - BITS)).astype(np.int64)
    d = data.astype(np.uint32)
    slots = np.zeros(len(data), np.int64)
    if len(data) > 2:
        slots[:-2] = ((d[:-2] * np.uint32(0x01000193) ^ d[1:-1]) * np.uint32(0x01000193) ^ d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    slots += 1 << BITS  # trigrams and bins have a half each
    size = np.diff(offs)
    weights = np.repeat(1.0 / np.maximum(size, 1), size)
    at = offs[:-1].repeat(len(VOTERS)).reshape(n, -1)
    return np.insert(slots, at.ravel(), fixed.ravel()), np.insert(weights, at.ravel(), 0.25), offs + len(VOTERS) * np.arange(n + 1)


def score_rows(weights: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    slots, amount, at = features(data, offs)
    total = np.zeros(len(slots) + 1)
    np.cumsum(weights[slots] * amount, out=total[1:])
    return 1 / (1 + np.exp(-np.clip(np.diff(total[at]) + weights[-1], -40, 40)))


def _fit(weights: np.ndarray, texts: list[bytes], target: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4.0) -> np.ndarray:
    """Logistic regression on soft labels, by mini-batches with per-slot step sizes."""
    w, squares = weights.copy(), np.full(len(weights), 1e-4)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            data = np.frombuffer(b"".join([texts[i] for i in own]), np.uint8)
            offs = np.cumsum([0, *(len(texts[i]) for i in own)])
            slots, amount, at = features(data, offs)
            total = np.zeros(len(slots) + 1)
            np.cumsum(w[slots] * amount, out=total[1:])
            p = 1 / (1 + np.exp(-np.clip(np.diff(total[at]) + w[-1], -40, 40)))
            t = target[own]
            error = (p - t) / len(own)
            gradient = np.bincount(slots, weights=amount * np.repeat(error, np.diff(at)), minlength=len(w))
            gradient[-1] += error.sum() * 0.1
            squares += gradient**2
            w -= rate * 0.05 * gradient / np.sqrt(squares)
    return w


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> np.ndarray:
    """The scorer's weights. Votes of all documents are counted; about fit_docs of them fit the scorer,
    in PARTS groups whose weights are averaged after each of ROUNDS rounds; groups don't depend on partitions."""
    spark = docs.sparkSession
    common.bound_batches(spark)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("quality")
        counts = np.zeros(3 ** len(VOTERS), np.int64)
        for batch in batches:
            data, offs = common.text_bytes(batch.column("text"))
            for a, b in common.byte_runs(offs):
                counts += np.bincount(pattern_of(votes(measures(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))), minlength=len(counts))
        yield pa.record_batch([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["pattern", "n"])

    found = docs.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3^6 rows
    counts = np.zeros(3 ** len(VOTERS))
    for r in found:
        counts[r["pattern"]] = r["n"]
    good, total = fit_voters(counts), max(1.0, counts.sum())

    threshold = int(min(1.0, fit_docs / total) * (1 << 30))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < threshold)
    drawn = drawn.select("text", F.pmod(F.xxhash64(F.lit(PARTS), "doc_id", "text"), F.lit(PARTS)).alias("part"))
    drawn = common.written(drawn.repartition(PARTS, "part"), "quality-fit")
    weights = np.zeros((2 << BITS) + 1)
    for _ in range(ROUNDS):
        at = spark.sparkContext.broadcast(weights)

        def train(rows: pa.Table) -> pa.Table:
            common.work_for("quality")
            data, offs = common.text_bytes(rows.column("text"))
            texts = sorted(data[a:b].tobytes() for a, b in zip(offs, offs[1:], strict=False))  # in one order, however rows arrive
            target = []
            for a in range(0, len(texts), 256):
                own = texts[a : a + 256]
                target.append(good[pattern_of(votes(measures(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))))])
            fitted = _fit(at.value, texts, np.concatenate(target))
            return pa.table({"n": pa.array([len(texts)], pa.int64()), "weights": pa.array([fitted.tobytes()], pa.binary())})

        parts = drawn.groupBy("part").applyInArrow(train, "n long, weights binary").collect()  # PARTS rows of bounded size, however many partitions
        if parts:
            weights = np.average([np.frombuffer(r["weights"]) for r in parts], axis=0, weights=[r["n"] for r in parts])
    return weights


def score(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """All columns of docs(doc_id, text, ...) with quality_score, 0 to 1, higher for better text.

    Without weights, they are fitted on docs first. A null or empty text counts as a text without words and
    scores 0. Repeated rows score alike; other columns, whatever their names, pass through, but an
    existing quality_score is replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    weights = fit(docs) if weights is None else weights
    shared = spark.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != "quality_score"]
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("quality")
        for batch in batches:
            data, offs = common.text_bytes(batch.column("text"))
            out = np.zeros(len(offs) - 1)
            for a, b in common.byte_runs(offs):
                out[a:b] = score_rows(shared.value, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            out[np.diff(offs) == 0] = 0.0
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "quality_score"])

    schema = StructType([*(docs.schema[c] for c in kept), StructField("quality_score", DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))
