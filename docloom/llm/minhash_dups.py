"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, then exact sets.

A signature is chunks x width symbols of 16 bits. Two signatures that differ in at most
2 * chunks - 1 symbols agree, by pigeonhole, in some chunk with at most one differing symbol, and so
share the key that this chunk gives when that symbol is left out. Enumerating the one allowed error
of every chunk (chunks * width keys a text) therefore finds all pairs under that distance. layout()
picks the number of chunks so that a pair of just the asked similarity is missed with a probability
of at most MISS; pairs above it are missed far more rarely.

Keys of up to HOT texts are paired row by row. Texts of larger keys (a page's thousands of variants, say)
are gathered into clusters that share such keys and travel in packs of like size; two packs are
compared by one product of their incidence matrices. Every pack of a cluster first meets the cluster's PIVOTS, the
text of each pack that shares most keys with others;
texts that a pivot joins need no comparison with one another, so packs are made anew, by what was joined,
and meet only where their texts are still apart. A large group of variants so costs its packs, not its pairs
of packs. Both ways end in the same exact test on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import U64, mix
from .graph import components, roots

SHINGLE = 5
#: Highest probability that a pair of exactly the asked similarity shares no key.
MISS = 2e-5
#: Texts of a key that are paired row by row; texts, and shingles, of a pack.
HOT, PACK_TEXTS, PACK_SHINGLES = 32, 256, 1 << 18
#: Texts of a cluster that all its others are compared with first; texts that make up packs of their own once they are joined.
PIVOTS, JOINED = 48, 64
#: Binary logarithm of the bits in the map of documents to compare.
BITMAP = 22

_PLACE = common._randoms(2, 64)
_XOR = common._randoms(3, 512)
_MULTIPLY = common._randoms(4, 512)
_PART = common._randoms(5, 512)


def layout(percent: int) -> tuple[int, int]:
    """(chunks, width): symbols in a chunk, and as many chunks as MISS asks for at this similarity."""
    s, width = percent / 100, 7 if percent >= 85 else 6
    agree = s**width + width * s ** (width - 1) * (1 - s)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - agree))) if agree < 1 else 1, width


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each row, one row after another and sorted, and row offsets."""
    starts, ends, at = common.word_bounds(data, offs)
    words, counts = common.word_hashes(data, starts, ends), np.diff(at)
    n = len(counts)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1] * _PLACE[0]
        for k in range(1, size):
            rolled = rolled + words[k : len(words) - size + 1 + k] * _PLACE[k]
    else:
        rolled = np.zeros(0, U64)
    row = np.repeat(np.arange(n), counts)
    whole = (np.arange(len(words)) + size <= np.repeat(at[1:], counts))[: len(rolled)]
    hashes, owner = mix(rolled[whole]), row[: len(rolled)][whole]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):  # the whole short sequence is one shingle
        short = [int(np.sum(words[at[i] : at[i + 1]] * _PLACE[8 : 8 + counts[i]], dtype=U64)) ^ int(counts[i]) for i in few]
        hashes, owner = np.concatenate([hashes, mix(np.array(short, U64))]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def signatures(sets: np.ndarray, at: np.ndarray, symbols: int) -> np.ndarray:
    """(rows, symbols) 16-bit symbols: low bits of each mixed minimum. Rows must not be empty."""
    out = np.empty((len(at) - 1, symbols), np.uint16)
    for j in range(symbols):
        low = np.minimum.reduceat((sets ^ _XOR[j]) * _MULTIPLY[j], at[:-1])
        out[:, j] = (mix(low) >> U64(48)).astype(np.uint16)
    return out


def chunk_keys(symbols: np.ndarray, width: int) -> np.ndarray:
    """As many keys as symbols: for each chunk and each position in it, the other symbols' hash."""
    n = symbols.shape[1]
    parts = mix(symbols.astype(U64) * U64(0x9E3779B97F4A7C15) + _PART[:n])
    rest = parts.reshape(-1, n // width, width).sum(axis=2, dtype=U64).repeat(width, axis=1) - parts
    return mix(rest + _PART[::-1][:n])


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.view(np.int64)))


def _signed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    chunks, width = layout(percent)
    symbols = chunks * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("minhash")
        for batch in batches:
            data, offs = common.text_bytes(batch.column("text"))
            for a, b in common.byte_runs(offs):
                sets, at = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                keys, two = np.zeros((0, symbols), U64), np.zeros((2, b - a), U64)
                if len(full):
                    keys = chunk_keys(signatures(sets, np.append(at[:-1][full], len(sets)), symbols), width)
                    two[0, full] = np.add.reduceat(mix(sets + U64(1)), at[:-1][full])
                    two[1, full] = np.add.reduceat(mix(sets ^ _PLACE[20]), at[:-1][full])
                key_at = np.concatenate([[0], np.cumsum((sizes > 0) * symbols)])
                columns = [pa.array(sizes.astype(np.int64)), pa.array(two[0].view(np.int64)), pa.array(two[1].view(np.int64)), _lists(keys.ravel(), key_at)]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, shingles of the documents wanted(doc_id). A bitmap of hashed ids, of fixed size, lets tasks pass over most
    other texts, so that only few sets are shuffled to the exact join."""

    def bits(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.view(U64)) >> U64(64 - BITMAP)).astype(np.int64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (BITMAP - 6), U64)
        for batch in batches:
            at = bits(batch.column("doc_id").to_numpy())
            np.bitwise_or.at(own, at >> 6, U64(1) << (at & 63).astype(U64))
        used = np.flatnonzero(own)
        yield pa.record_batch([pa.array(used), pa.array(own[used].view(np.int64))], ["word", "bits"])

    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in wanted.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # at most 2 ** (BITMAP - 6) rows
        bitmap[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(U64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("minhash")
        for batch in batches:
            at = bits(batch.column("doc_id").to_numpy())
            batch = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)))
            data, offs = common.text_bytes(batch.column("text"))
            for a, b in common.byte_runs(offs):
                found, at = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), _lists(found, at)], ["doc", "shingles"])

    made = docs.where("doc_id IS NOT NULL").mapInArrow(sets, "doc long, shingles array<long>")
    return common.written(made.join(wanted.withColumnRenamed("doc_id", "doc"), "doc", "left_semi"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    x, y = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _packs(texts: DataFrame, percent: int) -> DataFrame:
    """Packs of texts(cluster, joined, doc, n, weight, shingles): texts of a cluster, and of what they are joined to, in one class
    of size, dealt by a hash of the doc into packs of about PACK_TEXTS texts and PACK_SHINGLES shingles, whatever the number of
    partitions. Texts more than one class apart in size can't be linked."""
    size = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    texts = texts.withColumns({"at": F.coalesce("joined", F.lit(-(1 << 63))), "class": size})
    many = texts.groupBy("cluster", "at", "class").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total"))
    parts = many.select("cluster", "at", "class", F.greatest(F.ceil(F.col("texts") / PACK_TEXTS), F.ceil(F.col("total") / PACK_SHINGLES)).alias("parts"))
    placed = texts.join(parts, ["cluster", "at", "class"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    packs = placed.groupBy("cluster", "at", "class", "part").agg(
        F.first("joined").alias("joined"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.max_by(F.struct("weight", "doc", "shingles"), F.struct("weight", "doc")).alias("pivot"), F.collect_list(F.struct("doc", "shingles")).alias("texts"),
    )
    return common.written(packs.withColumn("id", F.xxhash64("cluster", "at", "class", "part")), "packs")


def _common(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, width: int = 8192) -> np.ndarray:
    """(texts of a, texts of b) sizes of the intersections: products of 0/1 matrices, `width` shingles at a time."""
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(a_sizes), len(b_sizes)), np.float32)
    sides = []
    for values, sizes in ((a, a_sizes), (b, b_sizes)):
        place = np.searchsorted(shared, values)
        place[place == len(shared)] = 0
        known = shared[place] == values if len(shared) else np.zeros(len(values), bool)
        place, row = place[known], np.repeat(np.arange(len(sizes)), sizes)[known]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], row[order], len(sizes)))
    for at in range(0, len(shared), width):
        matrices = []
        for place, row, n in sides:
            x, y = np.searchsorted(place, [at, at + width])
            m = np.zeros((n, width), np.float32)
            m[row[x:y], place[x:y] - at] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def _texts_of(column: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Docs, set sizes and shingles, one set after another, of a pack."""
    offs = column.offsets
    docs, sets = column.values.slice(offs[k].as_py(), offs[k + 1].as_py() - offs[k].as_py()).flatten()
    return docs.to_numpy(), np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()


def _met(met: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that connect, inside each met pair of packs (a, b: arrays of doc and shingles), what is linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (a, n, x), (b, m, y) = (_texts_of(batch.column(c), k) for c in ("a", "b"))
                both = _common(x, n, y, m).astype(np.int64)
                i, j = np.nonzero(100 * both >= percent * (n[:, None] + m[None] - both))
                ids = np.concatenate([a, b])
                root = roots(i, j + len(n), ids)
                far = np.flatnonzero(root != ids)
                yield pa.record_batch([pa.array(ids[far]), pa.array(root[far])], ["a", "b"])

    return met.select("a", "b").mapInArrow(run, "a long, b long")


def _near(one: str, two: str, percent: int) -> Column:
    """Whether sizes of two packs allow a link."""
    return (F.lit(100) * F.col(f"{one}_high") >= F.lit(percent) * F.col(f"{two}_low")) & (F.lit(100) * F.col(f"{two}_high") >= F.lit(percent) * F.col(f"{one}_low"))


def _cluster_links(texts: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that connect what is linked inside clusters, of texts(cluster, doc, n, weight, shingles)."""
    heads = lambda packs, x: packs.select("cluster", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "joined", "class", "low", "high")))
    side = lambda packs, x: packs.select(F.col("id").alias(f"{x}_id"), F.col("texts").alias(x))
    texts = common.written(texts, "cluster-texts")

    packs = _packs(texts.withColumn("joined", F.lit(None).cast("long")), percent)
    # the heads are ranked before their shingles are fetched, so a cluster gathers PIVOTS texts, however many packs it has
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("pivot.weight"), F.desc("pivot.doc")))
    heads_of = packs.select("id", "cluster", rank.alias("rank")).where(F.col("rank") <= PIVOTS).select("id", "rank")
    best = packs.select("id", "cluster", "pivot").join(heads_of, "id").groupBy("cluster")
    best = best.agg(F.sort_array(F.collect_list(F.struct("rank", "pivot"))).alias("b"))
    best = best.select("cluster", F.transform("b", lambda x: F.struct(x["pivot"]["doc"].alias("doc"), x["pivot"]["shingles"].alias("shingles"))).alias("b"))
    first = common.written(_met(packs.select("cluster", F.col("texts").alias("a")).join(best, "cluster"), percent), "pivot-links")

    joined = components(first).select(F.col("node").alias("doc"), F.col("component").alias("joined"))
    large = joined.groupBy("joined").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") >= JOINED).select("joined")
    apart = _packs(texts.join(joined.join(large, "joined"), "doc", "left"), percent)
    one, two = heads(apart, "a"), heads(apart, "b")
    still = F.col("a_joined").isNull() | F.col("b_joined").isNull() | (F.col("a_joined") != F.col("b_joined"))
    meet = one.join(two, "cluster").where((F.col("a_id") <= F.col("b_id")) & still & (F.abs(F.col("a_class") - F.col("b_class")) <= 1) & _near("a", "b", percent)).select("a_id", "b_id")
    rest = _met(meet.join(side(apart, "a"), "a_id").join(side(apart, "b"), "b_id"), percent)
    return first.unionByName(common.written(rest, "pack-links"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    A row's set: its distinct shingles of 5 words (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+); with fewer
    words the whole sequence is one shingle. Rows are linked if 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links, kept says whether it is the row's own.

    Null or wordless text: n_shingles 0, linked with nothing. A row with a null doc_id is linked with
    nothing, has component_id null and kept true. Rows that repeat a doc_id are one node of the graph with
    all their texts' links. Equal sets are grouped before the join, so copies cost nothing there. No rows
    in, no rows out; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.written(docs.mapInArrow(_signed(percent), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"), "signed")
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # equal sets: one representative each
    classes = linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = common.written(classes, "classes")
    copies = classes.where("rows > 1").select("set_a", "set_b", "doc")
    same = linkable.select("doc_id", "set_a", "set_b").join(copies, ["set_a", "set_b"]).select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))

    # keys that several sets share
    keyed = classes.select("doc", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    members = common.written(keyed.join(shared, "key"), "members")
    few, many = members.where(F.col("sets") <= HOT), members.where(F.col("sets") > HOT)
    other = few.select("key", F.col("doc").alias("b"), F.col("n").alias("b_n"))
    fits = (F.lit(100) * F.least("n", "b_n") >= F.lit(percent) * F.greatest("n", "b_n")) & (F.col("doc") < F.col("b"))
    pairs = common.written(few.join(other, "key").where(fits).select(F.col("doc").alias("a"), "b").distinct(), "pairs")
    lowest = many.groupBy("doc").agg(F.min("first").alias("low"), F.sum("sets").alias("weight"))  # a text ties its keys' first texts to one of them
    ties = many.join(lowest, "doc").select(F.col("first").alias("a"), F.col("low").alias("b")).union(lowest.select("doc", "low"))
    clusters = components(ties).select(F.col("node").alias("doc"), F.col("component").alias("cluster")).join(lowest.select("doc", "weight"), "doc")
    clusters = common.written(clusters, "clusters")

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(clusters.select("doc")).distinct()
    sets = _sets_of(docs, common.written(wanted, "wanted"))
    links = _confirmed(pairs, sets, percent)
    in_packs = _cluster_links(sets.join(clusters, "doc").withColumn("n", F.size("shingles")), percent)

    whole = components(same.unionByName(links).unionByName(in_packs)).withColumnRenamed("node", "doc_id")
    return (
        signed.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i WHERE 100 * i >= 85 * (na + nb - i) UNION ALL SELECT b, a FROM i WHERE 100 * i >= 85 * (na + nb - i)
), r AS (
  SELECT doc_id, doc_id AS to_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a
), c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
