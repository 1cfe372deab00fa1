"""Exact nearest vectors for query tables of any size: a block join of packs.

Queries and chunks are both packed into rows of about a thousand vectors. A pack of queries meets a pack of chunks in one row and
is scored by one matrix product; a task keeps the best of each query over all packs that it sees, so what is shuffled is queries x n x
tasks and never pairs. Query packs go to every task where their size and the rows that a task then keeps, which are counted, allow
it, and chunks are then read once and not shuffled; beyond that both sides are dealt over a grid of cells by an equi-join. The grid
has as many cells as the pairs ask for, and as many columns (each holds every query's best) as make best rows and copies of chunks
least together. No vector passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..storage import bound_batches, written

#: Vectors of a pack; bytes of query packs that are broadcast at most; query packs of one row of the grid beyond that.
PACK_QUERIES, PACK_CHUNKS, BROADCAST_BYTES, ROW_PACKS = 1024, 4096, 32 << 20, 64
#: Best rows of a task where queries are broadcast; pairs of a cell of the grid; bytes of a best row on its way.
BROADCAST_ROWS, CELL_PAIRS, ROW_BYTES = 1 << 18, 1 << 26, 24
#: Best rows that a task holds at most before it hands them on; a cell of the grid has no more. Results don't depend on it.
HELD_ROWS = 4_000_000
NONE = -(1 << 63)


def packs(df: DataFrame, id_col: str, vector: str, size: int, others: list[str] = ()) -> DataFrame:
    """width, ids, vectors and one array for each other column: rows of `df` with a usable vector in packs of at most `size`, each
    of one width. Vectors that are null, empty, all zero or hold a null or a value that isn't finite are in none."""
    fields = {f.name: f.dataType for f in df.schema}
    value = fields[vector].elementType
    schema = StructType([StructField("width", IntegerType()), StructField("ids", ArrayType(LongType())), StructField("vectors", ArrayType(value)), *(StructField(c, ArrayType(fields[c])) for c in others)])

    def row(width: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        columns = [whole.column(c).combine_chunks() for c in (id_col, *others)]
        flat = whole.column(vector).combine_chunks().flatten()
        return pa.record_batch([pa.array([width], pa.int32()), one(columns[0].cast(pa.int64())), one(flat), *map(one, columns[1:])], ["width", "ids", "vectors", *others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            widths = _usable(batch.column(vector))
            for width in np.unique(widths[widths > 0]).tolist():
                own = batch.filter(pa.array(widths == width))
                while len(own):
                    parts = waiting.setdefault(width, [])
                    room = min(len(own), size - sum(map(len, parts)))
                    parts.append(own.slice(0, room))
                    own = own.slice(room)
                    if sum(map(len, parts)) == size:
                        yield row(width, waiting.pop(width))
        for width, parts in waiting.items():
            yield row(width, parts)

    return df.select(id_col, vector, *others).mapInArrow(run, schema)


def _usable(column: pa.ListArray) -> np.ndarray:
    """The width of each row's vector, 0 where it can't be compared."""
    widths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(widths)), widths)
    square = np.bincount(rows, flat * flat, len(widths)) if len(flat) else np.zeros(len(widths))
    return np.where(np.isfinite(square) & (square > 0), widths, 0)


def _units(scalar: pa.ListScalar, width: int) -> np.ndarray:
    x = scalar.values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Masks:
    """Which rows of a pack of chunks pass a set of filters: one bitmap for each value asked of a field, combined for each set of filters."""

    def __init__(self, fields: list[pa.Array]):
        self.fields, self.maps = fields, {}

    def of(self, field: int, value: str) -> np.ndarray:
        found = self.maps.get((field, value))
        if found is None:
            found = self.maps[field, value] = pc.equal(self.fields[field], value).fill_null(False).to_numpy(zero_copy_only=False)
        return found

    def passing(self, asked: list[tuple[int, str | tuple]]) -> np.ndarray:
        """AND over (field, value or values), OR over the values of one field."""
        ok = np.ones(len(self.fields[0]), bool)
        for field, value in asked:
            if isinstance(value, tuple):
                any_of = np.zeros(len(ok), bool)
                for v in value:
                    if v is not None:
                        any_of |= self.of(field, v)
                ok &= any_of
            else:
                ok &= self.of(field, value)
        return ok


def _cut(row: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each row, by score, then id, in that order."""
    order = np.lexsort((ids, -score, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < n]


class Best:
    """The n best of each query of one pack over the packs of chunks seen so far."""

    def __init__(self, queries: int, carried: int):
        self.row, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.carried = [np.zeros(0, np.int64)] * carried
        self.floor = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, carried: list[np.ndarray], n: int, least: float) -> None:
        """scores: not rounded yet, which only those near a row's floor need."""
        floor = np.maximum(self.floor, least)
        if scores.shape[1] > n and np.isneginf(floor).any():
            floor = np.maximum(floor, np.round(np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n], 12))
        row, at = np.nonzero(scores >= np.maximum(floor - 1e-11, -2)[:, None])  # a score left out is -inf
        near = np.round(scores[row, at], 12)
        kept = near >= floor[row]
        row, at, near = row[kept], at[kept], near[kept]
        if not len(row):
            return
        row_, score, own = np.concatenate([self.row, row]), np.concatenate([self.score, near]), np.concatenate([self.ids, ids[at]])
        keep = _cut(row_, score, own, n)
        self.row, self.score, self.ids = row_[keep], score[keep], own[keep]
        self.carried = [np.concatenate([a, b[at]])[keep] for a, b in zip(self.carried, carried, strict=True)]
        full = np.bincount(self.row, minlength=len(self.floor)) == n
        ends = np.searchsorted(self.row, np.flatnonzero(full), "right") - 1
        self.floor[full] = self.score[ends]


def _grid(queries: Row, chunks: Row, n: int, row_packs: int) -> tuple[int, int]:
    """Rows and columns. A column costs the queries and their best rows once more, a row the chunks."""
    cells = max(1, math.ceil(queries["rows"] * chunks["rows"] / CELL_PAIRS))
    column, row = queries["bytes"] + queries["rows"] * n * ROW_BYTES, max(1, chunks["bytes"] // 2)
    columns = min(cells, max(1, round(math.sqrt(cells * row / max(1, column)))))
    least = max(math.ceil(queries["n"] / row_packs), math.ceil(queries["rows"] * n / HELD_ROWS) if HELD_ROWS else 1)
    return max(1, least, math.ceil(cells / columns)), columns


def nearest(chunks: DataFrame, queries: DataFrame, n: int, threshold: float | None = None, filters: dict[str, str] | None = None, carry: list[str] = (), broadcast_bytes: int = BROADCAST_BYTES, row_packs: int = ROW_PACKS) -> DataFrame:
    """query_id, id, similarity, carried columns (long), vec_rank: each query's n chunks of the greatest cosine, at least
    `threshold`, ties by the smaller id; cosines are rounded to 12 places, so equal vectors tie.

    chunks(id, embedding, carried columns), queries(query_id, query_embedding). filters names columns of queries and the columns of
    chunks that they filter: a text that must be equal, or a list of texts of which one must be; null or an empty list asks
    for nothing. Only vectors of equal width meet; a vector that is null, empty, zero or not finite meets none. Rows are compared
    each for itself, repeated ids too. Empty tables give an empty result.
    """
    filters = filters or {}
    asks, fields = list(filters), list(dict.fromkeys(filters.values()))
    spark = chunks.sparkSession
    wide = chunks.where("embedding IS NOT NULL").select("id", "embedding", *(F.col(c).cast("long").alias(c) for c in carry), *fields)
    bound_batches(spark)
    few = written(packs(queries, "query_id", "query_embedding", PACK_QUERIES, asks).withColumn("pack", F.monotonically_increasing_id()), "query-packs")
    counts = [F.coalesce(F.sum(F.size(c) * F.lit(x)), F.lit(0)).alias(name) for name, c, x in (("bytes", "vectors", 8), ("rows", "ids", 1))]
    size = few.agg(*counts, F.count(F.lit(1)).alias("n")).first()
    many = packs(wide, "id", "embedding", PACK_CHUNKS, [*carry, *fields])
    ask = few.select("width", "pack", F.struct("ids", "vectors", *asks).alias("q"))
    if size["bytes"] <= broadcast_bytes and size["rows"] * n <= BROADCAST_ROWS:
        met = many.select("width", F.struct("ids", "vectors", *carry, *fields).alias("c")).join(F.broadcast(ask), "width")
    else:
        many = written(many.withColumn("pack", F.monotonically_increasing_id()), "chunk-packs")
        rows, columns = _grid(size, many.agg(*counts).first(), n, row_packs)
        numbers = lambda packs, name, k: packs.select("pack", (F.row_number().over(W.orderBy("pack")) % k).alias(name))  # noqa: E731 - a number for each pack alone
        each = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
        ask = ask.join(F.broadcast(numbers(few, "_row", rows)), "pack").select("*", each(columns, "_column"))
        own = many.select("width", "pack", F.struct("ids", "vectors", *carry, *fields).alias("c")).join(F.broadcast(numbers(many, "_column", columns)), "pack")
        met = own.drop("pack").select("*", each(rows, "_row")).join(ask.hint("merge"), ["width", "_row", "_column"]).select("width", "c", "pack", "q")
    lists = [isinstance(queries.schema[c].dataType, ArrayType) for c in asks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            width, pack, c, q = (batch.column(x) for x in ("width", "pack", "c", "q"))
            for i in range(len(batch)):
                chunk, asked = c[i], q[i]
                ids = chunk["ids"].values.to_numpy(zero_copy_only=False)
                names = asked["ids"].values.to_numpy(zero_copy_only=False)
                x = _units(asked["vectors"], width[i].as_py()) @ _units(chunk["vectors"], width[i].as_py()).T
                if asks:
                    masks = Masks([chunk[f].values for f in fields])
                    sets: dict[tuple, list[int]] = {}
                    for k, values in enumerate(zip(*(asked[a].as_py() for a in asks), strict=True)):
                        sets.setdefault(tuple((tuple(v) or None if more and v is not None else v) for v, more in zip(values, lists, strict=True)), []).append(k)
                    for values, of in sets.items():
                        ok = masks.passing([(fields.index(filters[a]), v) for a, v in zip(asks, values, strict=True) if v is not None])
                        if not ok.all():
                            x[np.ix_(of, ~ok)] = -np.inf
                carried = [chunk[k].values.fill_null(NONE).to_numpy(zero_copy_only=False) for k in carry]
                key = pack[i].as_py()
                if key not in held:
                    held[key] = names.copy(), Best(len(names), len(carry))
                held[key][1].add(x, ids, carried, n, -np.inf if threshold is None else threshold)
            if sum(len(b.row) for _, b in held.values()) > HELD_ROWS:
                yield from map(out, held.values())
                held = {}
        yield from map(out, held.values())

    def out(item: tuple[np.ndarray, Best]) -> pa.RecordBatch:
        names, best = item
        carried = [pa.array(v, pa.int64(), mask=v == NONE) for v in best.carried]
        return pa.record_batch([pa.array(names[best.row], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.score), *carried], ["query_id", "id", "similarity", *carry])

    found = met.mapInArrow(run, ", ".join(["query_id long", "id long", "similarity double", *(f"{c} long" for c in carry)]))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("vec_rank", F.row_number().over(w)).where(F.col("vec_rank") <= n)
