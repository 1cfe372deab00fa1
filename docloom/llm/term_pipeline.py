"""Ranked lexical search by pipelined term partitioning.

Query terms are dealt to owners by how rare they are. An owner holds the postings of its terms, cut by blocks of documents. Item
bundles, each a group of items and a block of documents, pass the owners one after another, the rarest terms first, and
meet each owner's postings by cogroup; they carry the scores so far of the documents that some term has named. An
owner adds its terms' contributions, whole numbers, so the order of owners changes nothing. What can't come among an item's k
best even with all that later owners could add is left out of the bundle: scores never fall, so this loses no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Terms are letters and digits of ASCII, A-Z in lower case, and all characters beyond ASCII.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

#: Shares of all documents up to which a term belongs to an owner; the last owner has the rest.
OWNERS = (1 / 256, 1 / 16, 1 / 4)
#: Documents of a block on average, items of a bundle at most, characters of items whose terms are sought in one pass.
BLOCK_DOCS, BUNDLE_ITEMS, PASS_CHARS = 4096, 256, 1_000_000
#: No document adds as much for one occurrence of a term of weight 1.
CEILING = 1_000_000
NO_ID = -(1 << 63)

DOCS = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = "bundle int, block int, owner int, terms array<int>, upto array<int>, docs array<int>, tfs array<int>, m array<long>, ids array<long>"
BUNDLE = "bundle int, block int, items array<int>, docs array<int>, scores array<long>"
FOUND = "item int, doc_id long, score long"


def terms(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TERMS).split()


def _lists(values: np.ndarray, upto: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and len + 1 offsets into them."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(own) else np.zeros(0, np.int64)
    return own.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


class Asked:
    """The items of one pass: their terms by number, and by bundle which items ask for a term and how often."""

    def __init__(self, items: list[tuple[int | None, bytes | None]]):
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.asks: list[dict[int, tuple[list[int], list[int]]]] = []  # bundle -> term -> items of the bundle, occurrences
        for n, (_, text) in enumerate(items):
            if n % BUNDLE_ITEMS == 0:
                self.asks.append({})
            for term, times in Counter(terms(text)).items():
                of, often = self.asks[-1].setdefault(self.vocab.setdefault(term, len(self.vocab)), ([], []))
                of.append(n % BUNDLE_ITEMS)
                often.append(times)

    def weigh(self, df: dict[int, int], n: int, owners: tuple[float, ...]) -> None:
        """Weights and owners of terms, and by bundle and owner what later owners can add to each item at most."""
        df_of = np.array([df.get(t, 0) for t in range(len(self.vocab))], np.int64)
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df_of.tolist()], np.int64)
        self.owner = np.searchsorted(np.array(owners) * n, df_of)
        self.later = np.zeros((len(self.asks), len(owners) + 1, BUNDLE_ITEMS), np.int64)
        for g, asks in enumerate(self.asks):
            for t, (of, often) in asks.items():
                self.later[g, : self.owner[t], of] += (np.array(often) * self.weights[t] * CEILING)[:, None]


def postings(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the sought terms with their occurrences, of each document that has a term."""
    common.bound_batches(docs.sparkSession)
    shared, many = docs.sparkSession.sparkContext.broadcast(vocab), max(1, len(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("terms")
        get = shared.value.get
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                words = [terms(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                ids = np.fromiter((i for w in words for i in map(get, w, repeat(-1))), np.int64, int(n.sum()))
                row = np.repeat(np.arange(len(words)), n)[ids >= 0]
                keys, tfs = np.unique(row * many + ids[ids >= 0], return_counts=True)
                upto = np.searchsorted(keys, np.arange(len(words) + 1) * many)
                out = pa.record_batch([batch.column("doc_id"), pa.array(n), _lists(keys % many, upto, pa.int32()), _lists(tfs, upto, pa.int32())], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DOCS)


def document_frequencies(found: DataFrame) -> DataFrame:
    """term, df: summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column("terms"))[0])
            if len(own) > len(seen):
                seen, own = own, seen
            seen[: len(own)] += own
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["term", "df"])

    return found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _index(found: DataFrame, shared, blocks: int) -> DataFrame:
    """Postings of each bundle's terms by owner and block of documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked: Asked = shared.value
        term, upto = _flat(table.column("terms"))
        tf = _flat(table.column("tfs"))[0]
        doc = np.repeat(np.arange(table.num_rows), np.diff(upto))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(term)).astype(np.int64) if len(term) else starts
        distinct = term[starts]
        ids = table.column("ids").to_numpy()
        rows: list[tuple] = []
        for g, asks in enumerate(asked.asks):
            mine = np.fromiter(asks, np.int64, len(asks))
            for owner in range(asked.later.shape[1]):
                at = np.flatnonzero(np.isin(distinct, mine[asked.owner[mine] == owner]))
                if len(at) or owner == asked.later.shape[1] - 1:  # the last owner's row has the documents' ids, so there always is one
                    sizes = (ends - starts)[at]
                    upto = np.append(0, np.cumsum(sizes))
                    place = np.arange(upto[-1]) + np.repeat(starts[at] - upto[:-1], sizes)
                    rows.append((g, key[0].as_py(), owner, distinct[at], upto, doc[place], tf[place], table.column("m").to_numpy(), ids if owner == asked.later.shape[1] - 1 else []))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    kinds = [pa.int32()] * 3 + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.int64())] * 2
    names = [c.split()[0] for c in INDEX.split(", ")]
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block")
    rows = found.where(F.size("terms") > 0).select(block, F.coalesce("doc_id", F.lit(NO_ID)).alias("ids"), "m", "terms", "tfs")
    return rows.groupBy("block").applyInArrow(run, INDEX)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 where a row is shorter."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] >= k else np.zeros(len(scores), np.int64)


def _added(key: tuple, bundle: pa.Table, owned: pa.Table, asked: Asked, owner: int, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of a bundle's items (rows) and its block's documents (columns) after an owner's terms; the documents' ids."""
    g = key[0].as_py()
    held = [_flat(bundle.column(c))[0].astype(np.int64) for c in ("items", "docs", "scores")]
    n_docs = int(held[1].max(initial=-1)) + 1
    if owned.num_rows:
        n_docs = len(_flat(owned.column("m"))[0])
    scores = np.zeros((BUNDLE_ITEMS, n_docs), np.int64)
    scores[held[0], held[1]] = held[2]
    if not owned.num_rows:
        return scores, None
    term, upto, doc, tf, m, ids = (_flat(owned.column(c))[0].astype(np.int64) for c in ("terms", "upto", "docs", "tfs", "m", "ids"))
    value = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    # Items whose k-th best here can't be reached by this and later owners alone take no new documents.
    closed = _kth(scores, k) > asked.later[g, owner - 1] if owner else np.zeros(BUNDLE_ITEMS, bool)
    known = scores > 0
    for t, a, b in zip(term.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        of, often = (np.array(x, np.int64) for x in asked.asks[g][t])
        scores[of[:, None], doc[a:b]] += (often * asked.weights[t])[:, None] * value[a:b]
    scores[closed[:, None] & ~known] = 0
    return scores, ids


def _stage(bundles: DataFrame, index: DataFrame, shared, owner: int, k: int) -> DataFrame:
    """Bundles after one more owner."""

    def run(key: tuple, bundle: pa.Table, owned: pa.Table) -> pa.Table:
        asked: Asked = shared.value
        if not owned.num_rows:
            return bundle.select(["bundle", "block", "items", "docs", "scores"])
        scores, _ = _added(key, bundle, owned, asked, owner, k)
        keep = (scores > 0) & (scores + asked.later[key[0].as_py(), owner][:, None] >= _kth(scores, k)[:, None])
        item, doc = np.nonzero(keep)
        columns = [pa.array([[*x]], pa.list_(t)) for x, t in ((item, pa.int32()), (doc, pa.int32()), (scores[item, doc], pa.int64()))]
        return pa.table([pa.array([v.as_py()], pa.int32()) for v in key] + columns, ["bundle", "block", "items", "docs", "scores"])

    return bundles.groupBy("bundle", "block").cogroup(index.where(F.col("owner") == owner).groupBy("bundle", "block")).applyInArrow(run, BUNDLE)


def _last(bundles: DataFrame, index: DataFrame, shared, owner: int, k: int) -> DataFrame:
    """item, doc_id, score of each item's k best documents of each block, after the last owner."""

    def run(key: tuple, bundle: pa.Table, owned: pa.Table) -> pa.Table:
        g = key[0].as_py()
        scores, ids = _added(key, bundle, owned, shared.value, owner, k)
        item, doc = np.nonzero((scores > 0) & (scores >= _kth(scores, k)[:, None]))
        value = scores[item, doc]
        order = np.lexsort((ids[doc], -value, item))
        item, doc, value = item[order], doc[order], value[order]
        best = np.arange(len(item)) - np.searchsorted(item, item) < k
        return pa.table([pa.array(item[best] + g * BUNDLE_ITEMS, pa.int32()), pa.array(ids[doc[best]]), pa.array(value[best])], ["item", "doc_id", "score"])

    return bundles.groupBy("bundle", "block").cogroup(index.where(F.col("owner") == owner).groupBy("bundle", "block")).applyInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, owners: tuple[float, ...] = OWNERS, block_docs: int = BLOCK_DOCS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k documents of the highest scores above 0, ties by ascending doc_id.

    docs(doc_id, text), items(item_id, text); other columns aren't read. Terms are the maximal matches of
    [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z in lower case. Null and empty texts have no terms: such a document
    counts nowhere, such an item finds nothing. Each row is a document or an item for itself, also where ids repeat; a null
    doc_id comes before others among ties. Empty tables give an empty result. Whole texts are read.

    Items go to executors in passes of about pass_chars characters, one reading of the documents each.
    """
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    chars = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, math.ceil(chars / pass_chars))
    result = None
    for p in range(passes):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()  # bounded: a pass
        asked = Asked(sorted(((r["item_id"], r["text"].encode()) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
        part = _pass(spark, docs, asked, k, owners, block_docs)
        result = part if result is None else result.unionByName(part)
    return result


def _pass(spark: SparkSession, docs: DataFrame, asked: Asked, k: int, owners: tuple[float, ...], block_docs: int) -> DataFrame:
    found = common.written(postings(docs, asked.vocab).withColumn("uid", F.monotonically_increasing_id()), "term-docs")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n, length = total["n"], max(1, total["l"])
    asked.weigh({r["term"]: r["df"] for r in document_frequencies(found).collect()}, n, owners)  # bounded: the pass's terms
    shared = spark.sparkContext.broadcast(asked)
    blocks = max(1, math.ceil(n / block_docs))
    found = found.withColumn("m", F.expr(f"25L + (75L * n * {n}L) div {length}L"))
    index = common.written(_index(found, shared, blocks), "term-index")
    bundles = spark.createDataFrame([], BUNDLE)
    for owner in range(len(owners)):
        bundles = _stage(bundles, index, shared, owner, k)
    best = _last(bundles, index, shared, len(owners), k)
    ids = [(i, own) for i, own in enumerate(asked.ids)]
    w = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame(ids, "item int, item_id long")  # bounded: a pass
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc_terms AS (
  SELECT row_no, doc_id, unnest(found) AS term, len(found)::BIGINT AS n
  FROM (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents)
), tfs AS (
  SELECT row_no, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*)::BIGINT AS tf FROM doc_terms GROUP BY row_no, term
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM (SELECT any_value(n) AS n FROM tfs GROUP BY row_no)
), item_terms AS (
  SELECT item_no, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS item_no FROM benchmark)
), asked AS (
  SELECT item_no, any_value(item_id) AS item_id, term, count(*)::BIGINT AS times FROM item_terms GROUP BY item_no, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, total WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
  SELECT item_no, any_value(asked.item_id) AS item_id, row_no, any_value(tfs.doc_id) AS doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term), total GROUP BY item_no, row_no
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
